"""Merging of repeated rows: upserts, first and last values, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import cut


def upsert(rows: DataFrame, keys: list[str], order: list[Column], first: list[str], last: list[str], largest: list[str], last_non_empty: list[str] = (), count: str = "occurrence_count") -> DataFrame:
    """One row for each key as if the rows had been inserted or updated in `order`: some columns keep the first value, some
    take the last, some the largest, some the last that is neither null nor empty. Null keys are equal to each other."""
    at = F.struct(*order)
    filled = {c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(at.alias("at"), F.col(c).alias("v"))) for c in last_non_empty}
    return rows.groupBy(*keys).agg(
        F.count("*").alias(count), *[F.min_by(F.struct(c), at)[c].alias(c) for c in first], *[F.max_by(F.struct(c), at)[c].alias(c) for c in last], *[F.max(c).alias(c) for c in largest], *[F.max(f)["v"].alias(c) for c, f in filled.items()]
    )


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-ignore: the first row of each key, whole."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def merge_clusters(rows: DataFrame, cluster: str, row_id: str, confidence: str, semantic: str, context: str, kind: str, occurrences: str, sentiment: str) -> DataFrame:
    """One row for each cluster: the representative (highest confidence, then semantic score, then longest context, then
    smallest id), the sorted distinct kinds of filing, their number, all occurrences, and means of the scores; of the semantic
    score only values above 0 count. Null and NaN scores count as missing."""
    none = F.lit(None).cast("double")
    s, c, x = (F.nanvl(name, none) for name in (semantic, confidence, sentiment))
    best = F.struct(F.coalesce(c, F.lit(-1.0)), F.coalesce(s, F.lit(-1.0)), F.coalesce(F.length(context), F.lit(0)), -F.col(row_id))
    return rows.groupBy(cluster).agg(
        F.max_by(row_id, best).alias("representative"), F.array_join(F.sort_array(F.collect_set(kind)), ";").alias("sources"), F.countDistinct(kind).alias("doc_count"), F.sum(occurrences).alias("total_occurrences"),
        F.avg(x).alias("avg_sentiment_score"), F.coalesce(F.avg(F.when(s > 0, s)), F.lit(0.0)).alias("avg_semantic_score"), F.avg(c).alias("avg_confidence_score"), F.count("*").alias("n_rows"),
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component): connected components of the edges (a, b), the smallest id naming each.

    Large star and small star in turn until nothing changes; each round is cut to the checkpoint folder. No component is
    gathered: all steps are joins on ids and minima, which are partly aggregated before the shuffle.
    """
    current = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:  # the number of rounds grows with the logarithm of the longest path
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        current = cut(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = current.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())
