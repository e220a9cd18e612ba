"""Predicates and small classes of contexts as Columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import vocabulary as v


def holds(text: Column, *cores: str) -> Column:
    """Whether any core stands in the text as whole words; one alternation, tried where a word that it needs is there."""
    return possible(text, cores) & text.rlike(v.exists(*cores))


def possible(text: Column, cores: tuple[str, ...] | list[str]) -> Column:
    """A cheap test that every text with one of `cores` passes."""
    stems = v.gate(list(cores))
    return contains_any(text, stems) if stems else F.lit(True)


def hits(text: Column, cores: list[str]) -> Column:
    """How many of the cores stand in the text, each counted once."""
    return reduce(lambda a, b: a + b, [holds(text, c).cast("int") for c in cores])


def contains_any(text: Column, needles: list[str]) -> Column:
    """Whether the lower-cased text holds any needle. Many needles are one array, which keeps the plan small, and the text is
    lower-cased once."""
    if len(needles) < 5:
        low = F.lower(text)
        return reduce(or_, [low.contains(n) for n in needles])
    held = F.split(F.lit("\x00".join(needles)), "\x00")  # folded to a constant
    return F.transform(F.array(F.lower(text)), lambda low: F.exists(held, lambda n: low.contains(n)))[0]


def corrupted_context(context: Column) -> Column:
    """Too many signs, too few blanks or a long run of consonants; short contexts are not judged."""
    n = F.length(context)
    signs = F.length(F.regexp_replace(context, r"[\p{L}\p{N}\s.,;:!?'\"()%€$<>’“”«»–-]", ""))
    blanks = n - F.length(F.replace(context, F.lit(" "), F.lit("")))
    return F.coalesce((n >= 20) & ((signs / n > 0.10) | ((n > 100) & (blanks / n < 0.05)) | context.rlike("(?i)[bcdfghjklmnpqrstvwxz]{8,}")), F.lit(False))


def false_positive(term: Column, context: Column) -> Column:
    """Cheap tests first: corrupted, an exclusion, or a short term without a validator."""
    both = F.concat(term, F.lit(" "), context)
    unless = [both.rlike(p) & ~both.rlike(q) for p, q in v.FALSE_UNLESS.values()]
    return corrupted_context(context) | reduce(or_, [both.rlike(p) for p in v.FALSE_POSITIVE.values()] + unless) | ((F.length(term) <= 3) & ~contains_any(context, v.VALIDATORS))


def robotics_class(context: Column) -> Column:
    """not_robotics, ai_robotics or traditional_robotics. A rule for learning robots comes before one for traditional ones, and
    a hint of learning anywhere before the rest."""
    traditional = context.rlike(v.ROBOT_TRADITIONAL)
    learning = context.rlike(v.ROBOT_AI) | ~traditional & contains_any(context, v.ROBOT_HINTS)
    return F.when(~F.lower(context).contains("robot"), "not_robotics").when(learning, "ai_robotics").otherwise("traditional_robotics")


def rpa_class(context: Column) -> Column:
    """ai_rpa, traditional_rpa or not_rpa. Process automation is traditional if no word of learning follows its last mention."""
    behind = F.regexp_replace(context, rf"(?is)^.*(?:^|[^{v.WORD_CHARS}]){v.RPA_NAMES}", "")
    plain = context.rlike(v.exists(v.RPA_NAMES)) & ~behind.rlike(v.RPA_LEARNING)
    return F.when(~contains_any(context, v.RPA_GUARD), "not_rpa").when(context.rlike(v.RPA_AI), "ai_rpa").when(plain | context.rlike(v.RPA_RULES), "traditional_rpa").otherwise("not_rpa")


def negation(context: Column) -> Column:
    """hard, soft or none."""
    return F.when(holds(context, *v.NEGATION_HARD), "hard").when(holds(context, *v.NEGATION_SOFT), "soft").otherwise("none")


def esg_like(doc_type: Column, context: Column) -> Column:
    """A cue in the kind of filing or in the context."""
    return contains_any(F.coalesce(doc_type, F.lit("")), v.ESG_TYPES) | contains_any(context, v.ESG_TEXT)


def confidence(trigger: Column, semantic: Column, context: Column, doc_type: Column) -> tuple[Column, Column, Column]:
    """Confidence, strength and reasons of a mention, added up in a fixed order of operands."""
    implementation, artifact, hard = holds(context, *v.IMPLEMENTATION), holds(context, *v.ARTIFACT), holds(context, *v.HARD)
    substance = implementation | artifact | hard
    marketing, esg = holds(context, *v.MARKETING) & ~substance, esg_like(doc_type, context) & ~substance
    base = F.when(trigger == "hard", F.lit(0.72)).when(trigger == "semantic", F.lit(0.35) + F.lit(0.55) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic))).otherwise(F.lit(0.35))
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    total = base + add(implementation, 0.12) + add(artifact, 0.10) + add(hard, 0.08) - add(marketing, 0.18) - add(esg, 0.12)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    strength = F.when(score >= F.lit(0.70), "strong").when(score >= F.lit(0.55), "medium").otherwise("mention_only")
    reasons = F.array_join(F.array_compact(F.array(F.when(implementation, F.lit("impl_cue")), F.when(artifact, F.lit("artifact_cue")), F.when(hard, F.lit("hard_term")), F.when(marketing, F.lit("marketing_only")), F.when(esg, F.lit("esg_like")))), ";")
    return score, strength, reasons
