"""Classification on taxonomy axes: half a point for each pattern, a fifth for each keyword; the best category wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import vocabulary as v


def axis_scores(text: Column, axis: str, taxonomy: list = v.TAXONOMY) -> list[tuple[str, str, Column]]:
    """(code, domain, score) of every category of an axis."""
    low = F.lower(text)
    one = lambda core, w: F.when(low.contains(v.literal(core)) & low.rlike(v.exists(core)), F.lit(w)).otherwise(F.lit(0.0))
    return [(code, domain, reduce(lambda a, b: a + b, [one(c, 0.5) for c in patterns] + [one(k, 0.2) for k in keywords])) for a, code, domain, keywords, patterns in taxonomy if a == axis]


def best_category(text: Column, axis: str, gate: float | None = 0.25, none: str = "none", taxonomy: list = v.TAXONOMY) -> Column:
    """(code, domain, confidence): the category with the highest score, the first one on ties; confidence is a share of 1.5,
    at most 1. Below the gate, or without any hit, the category is `none` with confidence 0."""
    rows = [F.struct(score.alias("score"), F.lit(-i).alias("first"), F.lit(code).alias("code"), F.lit(domain).alias("domain")) for i, (code, domain, score) in enumerate(axis_scores(text, axis, taxonomy))]
    def judged(best: Column) -> Column:
        confidence = F.least(F.lit(1.0), best["score"] / 1.5)
        fits = (confidence >= gate) if gate is not None else best["score"] > 0
        return F.struct(F.when(fits, best["code"]).otherwise(none).alias("code"), F.when(fits, best["domain"]).otherwise(none).alias("domain"), F.when(fits, confidence).otherwise(0.0).alias("confidence"))

    return F.transform(F.array(F.array_max(F.array(*rows))), judged)[0]  # the scores are worked out once


def taxonomy_table(spark: SparkSession, taxonomy: list = v.TAXONOMY, first_tier: tuple[str, ...] = ()) -> DataFrame:
    """(axis, code, domain, keyword, tier): the keywords of a taxonomy as a table. `first_tier` keywords have tier 1; the others
    tier 2 on the axes a and b, and 1 on the axis of EU domains."""
    rows = [(a, code, domain, k, 1 if a == "eu" or k in first_tier else 2) for a, code, domain, keywords, _ in taxonomy for k in dict.fromkeys(keywords)]
    return spark.createDataFrame(rows, "axis string, code string, domain string, keyword string, tier int")
