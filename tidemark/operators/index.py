"""The seven dimensions and the composite index. Every dimension is a sum over mentions, so one aggregation makes them all."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocabulary as v
from tidemark.config import Config

DIMENSIONS = ["intensity", "semantic", "diversity", "sentiment", "maturity", "future", "commitment"]


def _may(low: Column, cores: list[str]) -> Column:
    stems = v.gate(cores)
    return reduce(or_, [low.contains(x) for x in stems]) if stems else F.lit(True)


def _count(text: Column, low: Column, cores: list[str]) -> Column:
    """Occurrences of any core; the neighbouring characters belong to the match, as in `exists`."""
    return F.when(_may(low, cores), F.regexp_count(text, F.lit(v.exists(*cores)))).otherwise(0)


def weight(confidence: Column) -> Column:
    """The confidence where there is one above 0, else 1."""
    return F.when(confidence > 0, confidence).otherwise(1.0)


def dimension_inputs(context: Column, low: Column) -> dict[str, Column]:
    """Per mention: hits of each maturity stage, whether it looks forward, weighted commitment hits."""
    stages = {f"m_{name}": _count(context, low, cores) for name, (_, cores) in v.MATURITY.items()}
    commitment = reduce(lambda a, b: a + b, [_count(context, low, cores) * F.lit(w) for w, cores in v.COMMITMENT.values()])
    return stages | {"looks_forward": _may(low, v.FUTURE) & context.rlike(v.exists(*v.FUTURE)), "commitment_hits": commitment}


def entropy(mentions: DataFrame, keys: list[str], labels: list[str], classes: int, name: str, none: list[str]) -> DataFrame:
    """keys and `name`: weighted Shannon entropy of the labels, as a share of that of `classes` equal ones."""
    each = mentions.select(*keys, "w", F.explode(F.array(*[F.col(c) for c in labels])).alias("label")).where(F.col("label").isNotNull() & ~F.col("label").isin(none))
    sums = each.groupBy(*keys, "label").agg(F.sum("w").alias("w"))
    # -sum(p log p) = log(W) - sum(w log w) / W, so no second pass over the group is needed
    total = F.sum("w")
    return sums.groupBy(*keys).agg(F.greatest(F.lit(0.0), (F.log2(total) - F.sum(F.col("w") * F.log2("w")) / total) / math.log2(classes)).alias(name), F.count("*").alias(f"{name}_labels"))


def adoption_index(mentions: DataFrame, keys: list[str], pages: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """keys, the seven dimensions, both composites and counts, for mentions with context, category_a, category_b,
    eu_subdomain, sentiment_score, semantic_score, confidence_score and reference_strength.

    mention_only rows are left out. `pages` gives keys and total_pages; without it, or with no pages, the rates are 0. Keys
    without any counted mention give no row. Null scores count as missing.
    """
    config = config or Config()
    rows = mentions.where(F.coalesce("reference_strength", F.lit("")) != "mention_only")
    # a generator keeps the context from being made again for each of its uses
    rows = rows.select(*[c for c in rows.columns if c != "context"], F.explode(F.array(F.coalesce("context", F.lit("")))).alias("context"))
    rows = rows.select("*", F.explode(F.array(F.lower("context"))).alias("_low"))
    rows = rows.withColumns({"w": weight(F.col("confidence_score"))} | dimension_inputs(F.col("context"), F.col("_low")))
    s = F.nanvl("semantic_score", F.lit(0.0))
    strong = s > config.semantic_threshold
    x = F.nanvl("sentiment_score", F.lit(None).cast("double"))
    stage_sum = [(score, F.sum(F.col(f"m_{n}") * F.col("w"))) for n, (score, _) in v.MATURITY.items()]
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("total_refs"), F.sum("w").alias("w_sum"), (F.sum(F.when(strong, s * F.col("w"))) / F.sum(F.when(strong, F.col("w")))).alias("sem"), (F.sum(x * F.col("w")) / F.sum(F.when(x.isNotNull(), F.col("w")))).alias("sent"),
        (reduce(lambda a, b: a + b, [F.lit(sc) * c for sc, c in stage_sum]) / F.nullif(reduce(lambda a, b: a + b, [c for _, c in stage_sum]), F.lit(0.0))).alias("mat"),
        F.sum(F.when(F.col("looks_forward"), F.col("w")).otherwise(0.0)).alias("fut"), F.sum(F.col("commitment_hits") * F.col("w")).alias("com"),
    )
    base = base.join(entropy(rows, keys, ["category_a", "category_b"], 15, "diversity", ["none", ""]), keys, "left").join(entropy(rows, keys, ["eu_subdomain"], 12, "diversity_eu", ["Unclassified", ""]), keys, "left")
    base = base.join(pages, keys, "left") if pages is not None else base.withColumn("total_pages", F.lit(0).cast("bigint"))
    rate = lambda c, k: F.when(F.coalesce("total_pages", F.lit(0)) > 0, F.least(F.lit(1.0), F.col(c) / F.col("total_pages") * k)).otherwise(0.0)
    full = base.select(
        *keys, rate("w_sum", 10).alias("intensity_index"), F.coalesce("sem", F.lit(0.0)).alias("semantic_index"), F.coalesce("diversity", F.lit(0.0)).alias("diversity_index"), F.coalesce((F.col("sent") + 1) / 2, F.lit(0.5)).alias("sentiment_index"),
        F.coalesce("mat", F.lit(0.0)).alias("maturity_index"), rate("fut", 30).alias("future_index"), rate("com", 2.5).alias("commitment_index"), F.coalesce("diversity_eu", F.lit(0.0)).alias("diversity_index_eu"),
        "total_refs", F.coalesce("total_pages", F.lit(0)).cast("bigint").alias("total_pages"), F.coalesce("diversity_labels", F.lit(0)).alias("categories_used"), F.coalesce("diversity_eu_labels", F.lit(0)).alias("categories_used_eu"),
    )
    part = lambda d, c: F.lit(config.weights[d] * 100) * F.col(c)
    both = {"ai_adoption_index": "diversity_index", "ai_adoption_index_eu": "diversity_index_eu"}
    return full.withColumns({n: reduce(lambda a, b: a + b, [part(d, div if d == "diversity" else f"{d}_index") for d in DIMENSIONS]) for n, div in both.items()})
