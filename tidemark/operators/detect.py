"""Detection of mentions in filings, from text to scored and classified rows. One narrow stage, no shuffle, no Python."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocabulary as v
from tidemark.config import Config
from tidemark.functions import predicates as p
from tidemark.functions import text as t

Triggers = list[tuple[str, str]]


def default_triggers() -> Triggers:
    """(kind, core) of all terms in order of preference."""
    return [("hard", c) for c in v.HARD] + [("soft", c) for c in v.SOFT]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_matches(text: str, low: str, ordinal: int, kind: str, core: str) -> str:
    """SQL for all matches of one core as an array of (_start, _ord, _trigger, _term); starts from the lengths of matches and
    gaps. The core is looked for only where its literal stands in the lower-cased text. With a hundred cores, text that is
    parsed once costs far less than as many calls."""
    pattern, literal = _sql(v.located(core, v.TAILS.get(core, ""))), v.literal(core)
    size = lambda a, n: f"aggregate(slice({a}, 1, {n}), 0, (s, x) -> s + length(x))"
    found, gaps = f"regexp_extract_all({text}, {pattern}, 0)", f"split({text}, {pattern}, -1)"
    located = f"transform({found}, (m, i) -> named_struct('_start', {size(gaps, 'i + 1')} + {size(found, 'i')}, '_ord', {ordinal}, '_trigger', {_sql(kind)}, '_term', m))"
    return f"CASE WHEN contains({low}, {_sql(literal)}) THEN {located} END" if literal else located


def detect_terms(docs: DataFrame, key: str, text: str, config: Config | None = None, triggers: Triggers | None = None) -> DataFrame:
    """(key, sentence_no, start, trigger, term, context, marked): one row for each term found, other columns of `docs` kept.

    Of the terms that begin at one place the first in order counts. A context is the sentence with its neighbours, at most
    `window` characters to either side of the term, without boilerplate, cleaned, and cut to `max_context` characters around the
    term's first occurrence, which is marked in `marked`. Null and empty texts give no rows.
    """
    config, triggers = config or Config(), triggers or default_triggers()
    around = config.sentences_around
    any_term = v.exists(*[c for _, c in triggers])

    def cut(c: Column, place: Column) -> Column:
        most = F.lit(config.max_context)
        start = F.least(F.greatest(F.lit(0), place - 1 - config.max_context // 2), F.greatest(F.lit(0), F.length(c) - most))
        return F.when(F.length(c) > most, F.concat(c.substr(start + 1, most), F.lit("..."))).otherwise(c)

    def in_context(sentence: Column, i: Column) -> Column:
        begin = F.greatest(F.lit(0), i - around)
        whole = F.array_join(F.slice("_s", begin + 1, i - begin + 1 + around), " ")
        head = F.length(F.array_join(F.slice("_s", begin + 1, i - begin), " ")) + F.when(i > begin, 1).otherwise(0)
        return F.struct(i.alias("_no"), sentence.alias("_sentence"), whole.alias("_whole"), head.alias("_head"))

    # generators keep sentences, matches and contexts from being computed again in every expression on them
    split = docs.where(F.col(text).rlike(any_term)).withColumn("_s", t.sentences(F.col(text)))
    rows = split.select(*docs.columns, F.inline(F.filter(F.transform("_s", in_context), lambda x: x["_sentence"].rlike(any_term))))
    matches = F.expr("flatten(array_compact(array(" + ", ".join(term_matches("_sentence", "_low", i, kind, core) for i, (kind, core) in enumerate(triggers)) + ")))")
    rows = rows.withColumn("_low", F.lower("_sentence"))
    ordered = rows.select(*docs.columns, "_no", "_whole", "_head", F.explode(F.array(F.array_sort(matches))).alias("_o"))
    found = ordered.select(*docs.columns, "_no", "_whole", "_head", F.inline(F.filter("_o", lambda m, i: (i == 0) | (F.get("_o", i - 1)["_start"] != m["_start"]))))
    at, term = F.col("_head") + F.col("_start"), F.col("_term")
    left = F.greatest(F.lit(0), at - config.window)
    near = F.col("_whole").substr(left + 1, at - left + F.length(term) + config.window)
    cleaned = F.trim(F.regexp_replace(t.clean(t.without_boilerplate(near)), r"\s+", " "))
    held = found.withColumn("_x", F.explode(F.array(cleaned)))
    place = F.instr(F.col("_x"), term)
    marked = F.when(place > 0, F.concat(F.col("_x").substr(F.lit(1), place - 1), F.lit(">>>"), term, F.lit("<<<"), F.col("_x").substr(place + F.length(term), F.length("_x")))).otherwise(F.col("_x"))
    return held.select(*docs.columns, F.col("_no").alias("sentence_no"), F.col("_start").alias("start"), F.col("_trigger").alias("trigger"), F.col("_term").alias("term"), cut(F.col("_x"), place).alias("context"), cut(marked, place).alias("marked"))


def score_mentions(mentions: DataFrame, doc_type: str = "doc_type", config: Config | None = None) -> DataFrame:
    """Drops false positives and, unless the config keeps them, traditional robots and processes, scores the rest, and treats negated contexts: hard ones
    go, soft ones keep four tenths of their confidence and become mention_only."""
    context, term = F.col("context"), F.col("term")
    judged = F.when(F.col("trigger") == "semantic", "").otherwise(term)  # a paragraph has no term of its own
    kept = mentions.where(~p.false_positive(judged, context)).withColumns({"robotics_type": p.robotics_class(context), "rpa_type": p.rpa_class(context), "negation": p.negation(context)})
    config = config or Config()
    unwanted = [F.col(c) == kind for c, kind, on in (("robotics_type", "traditional_robotics", config.filter_traditional_robotics), ("rpa_type", "traditional_rpa", config.filter_traditional_rpa), ("negation", "hard", True)) if on]
    kept = kept.where(~reduce(or_, unwanted))
    score, strength, reasons = p.confidence(F.col("trigger"), F.coalesce("semantic_score", F.lit(0.0)) if "semantic_score" in mentions.columns else F.lit(0.0), context, F.col(doc_type))
    soft = F.col("negation") == "soft"
    return kept.withColumns({"confidence_score": score, "reference_strength": strength, "confidence_reasons": reasons}).withColumns(
        {
            "confidence_score": F.when(soft, F.round(F.col("confidence_score") * 0.4, 3)).otherwise(F.col("confidence_score")),
            "reference_strength": F.when(soft, "mention_only").otherwise(F.col("reference_strength")),
            "confidence_reasons": F.when(soft, F.concat_ws(";", F.nullif("confidence_reasons", F.lit("")), F.lit("negation_soft"))).otherwise(F.col("confidence_reasons")),
            "is_negated_context": soft,
        }
    )


def mark_priority_term(paragraph: Column, terms: list[str]) -> tuple[Column, Column]:
    """The first of `terms` that a paragraph holds, and the paragraph with its first occurrence marked; without any, the
    first 50 characters and the paragraph as it is."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(paragraph, v.located(c), 0), F.lit("")) for c in terms])
    at = F.instr(paragraph, F.coalesce(found, F.lit("")))
    marked = F.concat(paragraph.substr(F.lit(1), at - 1), F.lit(">>>"), found, F.lit("<<<"), paragraph.substr(at + F.length(found), F.length(paragraph)))
    return F.coalesce(found, F.substring(paragraph, 1, 50)), F.coalesce(marked, paragraph)
