"""Queries of detection, scoring, filters and classification over all filings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import vocabulary as v
from tidemark.functions import predicates as p
from tidemark.functions import text as t
from tidemark.operators import classify, detect, semantic
from tidemark.plans.text_plans import boilerplate_sql, clean_sql
from tidemark.sources.tables import spread, table

_COLUMNS = ("doc_id", "text", "company", "year", "doc_type")


def _found(spark: SparkSession, base: str) -> DataFrame:
    return detect.detect_terms(spread(table(spark, base, "documents", *_COLUMNS)), "doc_id", "text").drop("text")


def _contexts(spark: SparkSession, base: str, *more: str) -> DataFrame:
    rows = spread(table(spark, base, "mentions", "mention_id", "context", "doc_type", *more)).where(" and ".join(f"{c} is not null" for c in ("context", *more)))
    return rows.withColumn("context", F.regexp_replace(t.unmarked(F.col("context")), r"\s+", " "))


def detect_hard_soft(spark: SparkSession, base: str) -> DataFrame:
    return _found(spark, base).select("doc_id", "sentence_no", "start", "trigger", "term")


def context_window(spark: SparkSession, base: str) -> DataFrame:
    return _found(spark, base).select("doc_id", "sentence_no", "start", F.md5("context").alias("context_md5"), F.length("marked").cast("bigint").alias("marked_chars"))


def detect_with_negation(spark: SparkSession, base: str) -> DataFrame:
    rows = detect.score_mentions(_found(spark, base))
    return rows.select("doc_id", "sentence_no", "start", "term", "robotics_type", "rpa_type", F.round("confidence_score", 6).alias("confidence_score"), "reference_strength", "confidence_reasons", "is_negated_context")


def semantic_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    """Paragraphs near an anchor, found by hashed word vectors in place of a model."""
    rows = semantic.detect_paragraphs(spread(table(spark, base, "documents", *_COLUMNS)), "doc_id", "text", separator="\n")
    return detect.score_mentions(rows).select("doc_id", "sentence_no", "term", F.round("semantic_score", 6).alias("semantic_score"), F.round("confidence_score", 6).alias("confidence_score"), "reference_strength")


def mention_only_filter(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "reference_strength", "detection_method")
    strength = F.coalesce(F.nullif("reference_strength", F.lit("unknown")), t.decoded_detection(F.col("detection_method"))["strength"], F.lit("unknown"))
    return rows.select("mention_id", strength.alias("strength")).where("strength <> 'mention_only'")


def fp_filter(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base, "text").select("mention_id", p.false_positive(F.col("text"), F.col("context")).alias("is_false"))


def corrupted_context(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base).select("mention_id", p.corrupted_context(F.col("context")).alias("is_corrupted"))


def validator_check(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base).select("mention_id", p.contains_any(F.col("context"), v.VALIDATORS).alias("is_valid"))


def robotics_class(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base).select("mention_id", p.robotics_class(F.col("context")).alias("made"))


def rpa_class(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base).select("mention_id", p.rpa_class(F.col("context")).alias("made"))


def negation_class(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base).select("mention_id", p.negation(F.col("context")).alias("negation"))


def esg_like(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base).select("mention_id", p.esg_like(F.col("doc_type"), F.col("context")).alias("is_esg"))


def feature_counts(spark: SparkSession, base: str) -> DataFrame:
    return _contexts(spark, base).select("mention_id", *[p.hits(F.col("context"), c).alias(n) for n, c in (("implementation", v.IMPLEMENTATION), ("artifact", v.ARTIFACT), ("marketing", v.MARKETING))])


def confidence_strength(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "context", "doc_type", "page", "semantic_score").where("context is not null")
    rows = rows.withColumn("context", F.regexp_replace(t.unmarked(F.col("context")), r"\s+", " "))
    trigger = F.when(F.col("page") == 0, "semantic").otherwise("soft")
    score, strength, reasons = p.confidence(trigger, F.coalesce(F.nanvl("semantic_score", F.lit(0.0)), F.lit(0.0)), F.col("context"), F.col("doc_type"))
    return rows.select("mention_id", F.round(score, 6).alias("confidence"), strength.alias("strength"), reasons.alias("reasons"))


def _classified(axis: str, gate: float | None, none: str):
    def query(spark: SparkSession, base: str) -> DataFrame:
        best = classify.best_category(F.concat_ws(" ", "text", "context"), axis, gate, none)
        return _contexts(spark, base, "text").select("mention_id", best.alias("b")).select("mention_id", "b.code", "b.domain", F.round("b.confidence", 6).alias("confidence"))

    return query


classify_axis_a = _classified("a", 0.25, "none")
classify_axis_b = _classified("b", 0.25, "none")
classify_eu = _classified("eu", None, "Unclassified")


def tri_axis_unclassified(spark: SparkSession, base: str) -> DataFrame:
    both = F.concat_ws(" ", "text", "context")
    a, b, eu = classify.best_category(both, "a")["code"], classify.best_category(both, "b")["code"], classify.best_category(both, "eu", None, "Unclassified")["code"]
    return _contexts(spark, base, "text").select(((a == "none") & (b == "none") & (eu == "Unclassified")).alias("open")).agg(F.count("*").alias("n"), F.count_if("open").alias("n_unclassified"))


def doc_categories(spark: SparkSession, base: str) -> DataFrame:
    """How many mentions of each category a document has, as a map in a fixed order."""
    rows = detect.score_mentions(_found(spark, base)).select("doc_id", classify.best_category(F.concat_ws(" ", "term", "context"), "a")["code"].alias("code"))
    counts = rows.groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "code", "n"))), ";").alias("categories"))  # as many as there are codes


def doc_counters(spark: SparkSession, base: str) -> DataFrame:
    rows = detect.score_mentions(_found(spark, base))
    return rows.groupBy("doc_id").agg(F.count("*").alias("total_refs"), F.count_if(F.col("trigger") == "hard").alias("hard_refs"), F.count_if(F.col("reference_strength") == "mention_only").alias("mention_only_refs"), F.countDistinct(F.lower("term")).alias("terms"))


def keyword_tiers(spark: SparkSession, base: str) -> DataFrame:
    """How many mentions of each regular code hold a keyword of it, by the keyword and its tier."""
    words = classify.taxonomy_table(spark).where("axis <> 'eu'")
    mentions = spread(table(spark, base, "mentions", "mention_id", "context", "category_a", "category_b")).where("context is not null")
    coded = mentions.select(F.lower("context").alias("low"), F.explode(F.array_distinct(F.array(F.upper(F.trim("category_a")), F.upper(F.trim("category_b"))))).alias("code"))
    held = coded.join(F.broadcast(words), "code").where(F.col("low").contains(F.col("keyword")))  # the taxonomy, a few hundred rows
    counts = held.groupBy("code", "keyword").agg(F.count("*").alias("n"))
    return words.join(counts, ["code", "keyword"], "left").select("code", "keyword", "tier", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_lookup(spark: SparkSession, base: str) -> DataFrame:
    codes = table(spark, base, "taxonomy_codes", "code", "axis", "label")
    held = F.array(*[F.struct(F.lit(axis).alias("axis"), F.upper(F.trim(f"category_{axis}")).alias("code")) for axis in ("a", "b")])
    mentions = table(spark, base, "mentions", "category_a", "category_b").select(F.inline(held))
    return codes.join(mentions.groupBy("axis", "code").agg(F.count("*").alias("n")), ["axis", "code"], "left").select("code", "axis", "label", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {f.__name__: f for f in (detect_hard_soft, context_window, detect_with_negation, mention_only_filter, fp_filter, corrupted_context, validator_check, robotics_class, rpa_class, negation_class, esg_like, feature_counts, confidence_strength, tri_axis_unclassified, doc_counters, doc_categories, keyword_lookup, keyword_tiers, semantic_paragraphs)}
QUERIES |= {"classify_axis_a": classify_axis_a, "classify_axis_b": classify_axis_b, "classify_eu": classify_eu}


def _q(s: str) -> str:
    return s.replace("'", "''")


def _doubled(core: str) -> str:
    """The core for text in which every character that belongs to no word stands twice, so that each match has its own
    boundaries although RE2 consumes them."""
    return core.replace(r"[\s-]?", r"(?:[\s-]{2})?").replace(r"\s+", r"(?:\s\s)+")


_W = v.WORD_CHARS
_ANY = _q(v.exists(*[c for _, c in detect.default_triggers()]))
_PARTS = " UNION ALL ".join(
    f"SELECT doc_id, no, {i} AS ord, '{k}' AS trigger, string_split(regexp_replace(twice, '(?i)(^|[^{_W}])({_q(_doubled(c))})([^{_W}{v.TAILS.get(c, '')}]|$)', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)) AS q FROM twofold"
    for i, (k, c) in enumerate(detect.default_triggers())
)
DETECT = f"""
WITH sents AS MATERIALIZED (
  SELECT doc_id, company, year, doc_type, s, i - 1 AS no, s[i] AS sentence FROM (
    SELECT doc_id, company, year, doc_type, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT doc_id, company, year, doc_type, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM documents WHERE regexp_matches(text, '{_ANY}')))
  WHERE regexp_matches(s[i], '{_ANY}')
), twofold AS MATERIALIZED (
  SELECT doc_id, no, regexp_replace(sentence, '([^{_W}])', '\\1\\1', 'g') AS twice FROM sents
), parts AS ({_PARTS}
), hits AS (
  SELECT doc_id, no, ord, trigger, array_to_string(q[1:2 * k - 1], '') AS head, q[2 * k] AS hit FROM (SELECT *, unnest(range(1, len(q) // 2 + 1)) AS k FROM parts WHERE len(q) > 1)
), located AS (
  SELECT doc_id, no, ord, trigger, length(head) - length(regexp_replace(head, '[{_W}]', '', 'g')) // 2 AS start, length(hit) - length(regexp_replace(hit, '[{_W}]', '', 'g')) // 2 AS size FROM hits
), once AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, no, start ORDER BY ord) AS nth FROM located
), found AS (
  SELECT doc_id, company, year, doc_type, CAST(no AS INTEGER) AS sentence_no, CAST(start AS INTEGER) AS start, trigger, substr(sentence, start + 1, size) AS term,
    array_to_string(s[greatest(0, no - 2) + 1:no + 3], ' ') AS joined, CASE WHEN no > 0 THEN length(array_to_string(s[greatest(0, no - 2) + 1:no], ' ')) + 1 ELSE 0 END + start AS place FROM once JOIN sents USING (doc_id, no) WHERE nth = 1
), near AS (
  SELECT * EXCLUDE (joined, place), substr(joined, greatest(0, place - 2000) + 1, place - greatest(0, place - 2000) + length(term) + 2000) AS n FROM found
), tidy AS (
  SELECT * EXCLUDE (n), trim(regexp_replace({clean_sql(boilerplate_sql("n"))}, '\\s+', ' ', 'g'), ' ') AS whole FROM near
), mentions_found AS (
  SELECT * EXCLUDE (whole), CASE WHEN length(whole) > 2000 THEN substr(whole, least(greatest(0, strpos(whole, term) - 1001), length(whole) - 2000) + 1, 2000) || '...' ELSE whole END AS context,
    CASE WHEN strpos(whole, term) = 0 THEN least(length(whole), 2003) WHEN length(whole) + 6 > 2000 THEN 2003 ELSE length(whole) + 6 END AS marked_chars FROM tidy
)"""


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{_q(pattern)}')"


def _any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{_q(n)}')" for n in needles) + ")"


CORRUPTED = "coalesce(length(context) >= 20 AND (length(regexp_replace(context, '[\\p{L}\\p{N}\\s.,;:!?''\"()%€$<>’“”«»–-]', '', 'g')) / length(context) > 0.10 OR (length(context) > 100 AND (length(context) - length(replace(context, ' ', ''))) / length(context) < 0.05) OR regexp_matches(context, '(?i)[bcdfghjklmnpqrstvwxz]{8,}')), false)"


def _fp(term: str) -> str:
    both = f"{term} || ' ' || context"
    unless = " OR ".join(f"({_m(both, p)} AND NOT {_m(both, q)})" for p, q in v.FALSE_UNLESS.values())
    return f"({CORRUPTED} OR {' OR '.join(_m(both, x) for x in v.FALSE_POSITIVE.values())} OR {unless} OR (length({term}) <= 3 AND NOT {_any('context', v.VALIDATORS)}))"


ROBOTICS = f"CASE WHEN NOT contains(lower(context), 'robot') THEN 'not_robotics' WHEN {_m('context', v.ROBOT_AI)} THEN 'ai_robotics' WHEN {_m('context', v.ROBOT_TRADITIONAL)} THEN 'traditional_robotics' WHEN {_any('context', v.ROBOT_HINTS)} THEN 'ai_robotics' ELSE 'traditional_robotics' END"
_BEHIND = f"regexp_replace(context, '(?is)^.*(?:^|[^{_W}]){v.RPA_NAMES}', '')"
RPA = f"CASE WHEN NOT {_any('context', v.RPA_GUARD)} THEN 'not_rpa' WHEN {_m('context', v.RPA_AI)} THEN 'ai_rpa' WHEN {_m('context', v.exists(v.RPA_NAMES))} AND NOT {_m(_BEHIND, v.RPA_LEARNING)} OR {_m('context', v.RPA_RULES)} THEN 'traditional_rpa' ELSE 'not_rpa' END"
NEGATION = f"CASE WHEN {_m('context', v.exists(*v.NEGATION_HARD))} THEN 'hard' WHEN {_m('context', v.exists(*v.NEGATION_SOFT))} THEN 'soft' ELSE 'none' END"
ESG = f"({_any(chr(99) + 'oalesce(doc_type, ' + chr(39) * 2 + ')', v.ESG_TYPES)} OR {_any('context', v.ESG_TEXT)})"
CUES = f"{_m('context', v.exists(*v.IMPLEMENTATION))} AS impl, {_m('context', v.exists(*v.ARTIFACT))} AS arti, {_m('context', v.exists(*v.HARD))} AS hardterm, {_m('context', v.exists(*v.MARKETING))} AS marks, {ESG} AS esg"
_SUB = "(impl OR arti OR hardterm)"


def _confidence(base: str) -> str:
    return (
        f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {base} + CASE WHEN impl THEN 0.12::DOUBLE ELSE 0::DOUBLE END + CASE WHEN arti THEN 0.10::DOUBLE ELSE 0::DOUBLE END + CASE WHEN hardterm THEN 0.08::DOUBLE ELSE 0::DOUBLE END"
        f" - CASE WHEN marks AND NOT {_SUB} THEN 0.18::DOUBLE ELSE 0::DOUBLE END - CASE WHEN esg AND NOT {_SUB} THEN 0.12::DOUBLE ELSE 0::DOUBLE END))"
    )


REASONS = f"concat_ws(';', CASE WHEN impl THEN 'impl_cue' END, CASE WHEN arti THEN 'artifact_cue' END, CASE WHEN hardterm THEN 'hard_term' END, CASE WHEN marks AND NOT {_SUB} THEN 'marketing_only' END, CASE WHEN esg AND NOT {_SUB} THEN 'esg_like' END)"
STRENGTH = "CASE WHEN conf >= 0.70::DOUBLE THEN 'strong' WHEN conf >= 0.55::DOUBLE THEN 'medium' ELSE 'mention_only' END"
SCORED = (
    DETECT
    + f""", judged AS (
  SELECT *, {ROBOTICS} AS robotics_type, {RPA} AS rpa_type, {NEGATION} AS negation, {CUES} FROM mentions_found WHERE NOT {_fp('term')}
), summed AS (
  SELECT *, {_confidence("CASE WHEN trigger = 'hard' THEN 0.72::DOUBLE ELSE 0.35::DOUBLE END")} AS conf, {REASONS} AS why FROM judged WHERE robotics_type <> 'traditional_robotics' AND rpa_type <> 'traditional_rpa' AND negation <> 'hard'
), scored AS (
  SELECT doc_id, company, year, doc_type, sentence_no, start, trigger, term, context, robotics_type, rpa_type, CASE WHEN negation = 'soft' THEN round(conf * 0.4::DOUBLE, 3) ELSE conf END AS confidence_score,
    CASE WHEN negation = 'soft' THEN 'mention_only' ELSE {STRENGTH} END AS reference_strength, CASE WHEN negation = 'soft' THEN concat_ws(';', nullif(why, ''), 'negation_soft') ELSE why END AS confidence_reasons, negation = 'soft' AS is_negated_context FROM summed
)"""
)
CONTEXTS = "WITH c AS (SELECT mention_id, text, doc_type, regexp_replace(regexp_replace(context, '>>>(.*?)<<<', '\\1', 'g'), '\\s+', ' ', 'g') AS context FROM mentions WHERE context IS NOT NULL) "
BOTH = CONTEXTS.replace("WHERE context", "WHERE text IS NOT NULL AND context")


def _scores_sql(axis: str) -> str:
    scores = []
    for i, (code, domain, keywords, patterns) in enumerate((c, d, k, ps) for a, c, d, k, ps in v.TAXONOMY if a == axis):
        sums = " + ".join([f"CASE WHEN {_m('low', v.exists(c))} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for c, w in [(x, 0.5) for x in patterns] + [(k, 0.2) for k in keywords]])
        scores.append(f"{{'score': {sums}, 'first': {-i}, 'code': '{code}', 'domain': '{domain}'}}")
    return f"list_max([{', '.join(scores)}])"


def best_sql(axis: str, gate: float | None, none: str) -> str:
    """The code of the best category of the column `low`."""
    return f"list_transform([{_scores_sql(axis)}], lambda b: CASE WHEN {_fits(gate)} THEN b.code ELSE '{none}' END)[1]"


def _fits(gate: float | None) -> str:
    return f"least(1.0::DOUBLE, b.score / 1.5::DOUBLE) >= {gate}::DOUBLE" if gate is not None else "b.score > 0"


def _classify_sql(axis: str, gate: float | None, none: str) -> str:
    fits = _fits(gate)
    return BOTH + f"""SELECT mention_id, CASE WHEN {fits} THEN b.code ELSE '{none}' END AS code, CASE WHEN {fits} THEN b.domain ELSE '{none}' END AS domain, round(CASE WHEN {fits} THEN least(1.0::DOUBLE, b.score / 1.5::DOUBLE) ELSE 0 END, 6) AS confidence
FROM (SELECT mention_id, {_scores_sql(axis)} AS b FROM (SELECT mention_id, lower(text || ' ' || context) AS low FROM c))"""


def _hits_sql(cores: list[str]) -> str:
    return " + ".join(f"CAST({_m('context', v.exists(c))} AS INTEGER)" for c in cores)


ORACLE = {
    "detect_hard_soft": DETECT + " SELECT doc_id, sentence_no, start, trigger, term FROM mentions_found",
    "context_window": DETECT + " SELECT doc_id, sentence_no, start, md5(context) AS context_md5, CAST(marked_chars AS BIGINT) AS marked_chars FROM mentions_found",
    "detect_with_negation": SCORED + " SELECT doc_id, sentence_no, start, term, robotics_type, rpa_type, round(confidence_score, 6) AS confidence_score, reference_strength, confidence_reasons, is_negated_context FROM scored",
    "doc_counters": SCORED + " SELECT doc_id, count(*) AS total_refs, count(*) FILTER (trigger = 'hard') AS hard_refs, count(*) FILTER (reference_strength = 'mention_only') AS mention_only_refs, count(DISTINCT lower(term)) AS terms FROM scored GROUP BY doc_id",
    "doc_categories": SCORED + f" SELECT doc_id, array_to_string(list_sort(list(code || '=' || n)), ';') AS categories FROM (SELECT doc_id, code, count(*) AS n FROM (SELECT doc_id, {best_sql('a', 0.25, 'none')} AS code FROM (SELECT doc_id, lower(term || ' ' || context) AS low FROM scored)) GROUP BY ALL) GROUP BY doc_id",
    "mention_only_filter": "SELECT * FROM (SELECT mention_id, coalesce(nullif(reference_strength, 'unknown'), nullif(regexp_extract(detection_method, '(?:^|\\|)strength=([a-z_]+)', 1), ''), 'unknown') AS strength FROM mentions) WHERE strength <> 'mention_only'",
    "fp_filter": BOTH + f"SELECT mention_id, {_fp('text')} AS is_false FROM c",
    "corrupted_context": CONTEXTS + f"SELECT mention_id, {CORRUPTED} AS is_corrupted FROM c",
    "validator_check": CONTEXTS + f"SELECT mention_id, {_any('context', v.VALIDATORS)} AS is_valid FROM c",
    "robotics_class": CONTEXTS + f"SELECT mention_id, {ROBOTICS} AS made FROM c",
    "rpa_class": CONTEXTS + f"SELECT mention_id, {RPA} AS made FROM c",
    "negation_class": CONTEXTS + f"SELECT mention_id, {NEGATION} AS negation FROM c",
    "esg_like": CONTEXTS + f"SELECT mention_id, {ESG} AS is_esg FROM c",
    "feature_counts": CONTEXTS + f"SELECT mention_id, {_hits_sql(v.IMPLEMENTATION)} AS implementation, {_hits_sql(v.ARTIFACT)} AS artifact, {_hits_sql(v.MARKETING)} AS marketing FROM c",
    "confidence_strength": f"""
WITH c AS (SELECT mention_id, doc_type, page, CASE WHEN semantic_score IS NULL OR isnan(semantic_score) THEN 0::DOUBLE ELSE semantic_score END AS sem, regexp_replace(regexp_replace(context, '>>>(.*?)<<<', '\\1', 'g'), '\\s+', ' ', 'g') AS context FROM mentions WHERE context IS NOT NULL),
f AS (SELECT *, {CUES} FROM c), g AS (SELECT mention_id, {_confidence("CASE WHEN page = 0 THEN 0.35::DOUBLE + 0.55::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, sem)) ELSE 0.35::DOUBLE END")} AS conf, {REASONS} AS reasons FROM f)
SELECT mention_id, round(conf, 6) AS confidence, {STRENGTH} AS strength, reasons FROM g""",
    "classify_axis_a": _classify_sql("a", 0.25, "none"),
    "classify_axis_b": _classify_sql("b", 0.25, "none"),
    "classify_eu": _classify_sql("eu", None, "Unclassified"),
    "keyword_tiers": "WITH k(code, keyword) AS (VALUES " + ", ".join(f"('{c}', '{k}')" for a, c, _, ks, _ in v.TAXONOMY if a != "eu" for k in dict.fromkeys(ks)) + """), m AS (
  SELECT lower(context) AS low, unnest(list_distinct([upper(trim(category_a, ' ')), upper(trim(category_b, ' '))])) AS code FROM mentions WHERE context IS NOT NULL
) SELECT k.code, k.keyword, 2 AS tier, count(m.low) AS n FROM k LEFT JOIN m ON m.code = k.code AND contains(m.low, k.keyword) GROUP BY k.code, k.keyword""",
    "keyword_lookup": "SELECT code, axis, label, CASE axis WHEN 'a' THEN (SELECT count(*) FROM mentions m WHERE upper(trim(m.category_a, ' ')) = t.code) ELSE (SELECT count(*) FROM mentions m WHERE upper(trim(m.category_b, ' ')) = t.code) END AS n FROM taxonomy_codes t",
}
ORACLE["tri_axis_unclassified"] = f"SELECT count(*) AS n, count(*) FILTER (a.code = 'none' AND b.code = 'none' AND e.code = 'Unclassified') AS n_unclassified FROM ({ORACLE['classify_axis_a']}) a JOIN ({ORACLE['classify_axis_b']}) b USING (mention_id) JOIN ({ORACLE['classify_eu']}) e USING (mention_id)"
