"""Problem 4: one surviving record for each group of rows on the same mention.

Two ways to the surviving values. `preferred_rows` takes each single-valued field from the row that stated preferences name:
one aggregation with a largest struct for each field, partly aggregated before the shuffle, so a group of any size costs one
buffer a task. `true_values` is for fields that may hold several true values: a latent two-sided quality model, fitted by
expectation-maximisation, gives every claimer a sensitivity (it states what is true) and a specificity (it doesn't state what
is false), and all values more likely true than not survive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import cut


def preferred_rows(df: DataFrame, keys: list[Column], row_id: str, fields: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """group_id and, for each entry `name: (eligible, order)` of `fields`, the id of the row that supplies it, 0 if none.

    Of the eligible rows the one with the largest `order` wins, nulls last, at a full tie the smallest id. A group is two or
    more rows with equal, non-null `keys`; its group_id is the smallest id. Single rows and rows with a null key belong to no
    group. Other columns of `df` are neither read nor returned, so their names cannot clash.
    """
    inputs = [k.alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col(row_id).alias("_id")]
    for i, (eligible, order) in enumerate(fields.values()):
        inputs.append(F.when(eligible, F.struct(*[c.alias(f"o{j}") for j, c in enumerate(order)], (-F.col(row_id)).alias("last"))).alias(f"_f{i}"))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*inputs).dropna(subset=names)
    best = [F.coalesce(-F.max(f"_f{i}")["last"], F.lit(0)).cast("bigint").alias(name) for i, name in enumerate(fields)]
    return rows.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_id").alias("group_id"), *best).where("_n > 1").select("group_id", *fields)


class Quality:
    """The sensitivity and specificity of each claimer, as a table; one claimer's pair is fetched when it is asked for."""

    def __init__(self, table: DataFrame):
        self.table = table

    def __getitem__(self, claimer: object) -> tuple[float, float]:
        row = self.table.where(F.col("c") == F.lit(claimer)).first()
        if row is None:
            raise KeyError(claimer)
        return row["s"], row["p"]


def true_values(df: DataFrame, keys: list[str], claimer: str, value: str, rounds: int = 8, start: tuple[float, float] = (0.8, 0.8)) -> tuple[DataFrame, Quality]:
    """(keys, value, probability, is_true) of every value claimed in a group, and the quality of every claimer.

    Every claimer that has a row in a group either states a candidate value or does not; null values and null claimers state
    nothing, groups without any value give no rows. Equal patterns of claims are counted once with a weight, so the rounds of
    expectation-maximisation run over distinct patterns. Qualities are a table that is joined, whatever its size; only two
    sums a round reach the driver. Fields that should not share qualities need claimers of their own.
    """
    group = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.col(claimer).alias("_c"), F.col(value).alias("_v")).dropna(subset=["_c", *group])
    claims = rows.distinct()
    present = claims.groupBy(*group).agg(F.sort_array(F.collect_set("_c")).alias("_present"))
    stated = claims.where("_v is not null").groupBy(*group, "_v").agg(F.sort_array(F.collect_set("_c")).alias("_yes"))
    candidates = cut(stated.join(present, group).select(*group, "_v", "_yes", F.array_except("_present", "_yes").alias("_no")).withColumn("_pattern", F.xxhash64(F.size("_yes"), "_yes", "_no")))
    patterns = cut(candidates.groupBy("_pattern").agg(F.first("_yes").alias("_yes"), F.first("_no").alias("_no"), F.count("*").alias("_w")))
    said = lambda names, one: F.transform(names, lambda c: F.struct(c.alias("c"), F.lit(one).alias("one")))
    votes = cut(patterns.select("_pattern", "_w", F.inline(F.concat(said("_yes", 1), said("_no", 0)))))
    quality = votes.select("c").distinct().select("c", F.lit(start[0]).alias("s"), F.lit(start[1]).alias("p"))
    prior = 0.5
    for _ in range(rounds):
        scored = votes.join(_probability(votes, quality, prior), "_pattern")
        weighed = patterns.select("_pattern", "_w").join(_probability(votes, quality, prior), "_pattern").agg(F.sum(F.col("_w") * F.col("_p")), F.sum("_w")).first()
        if not weighed[1]:
            break
        prior = min(max(weighed[0] / weighed[1], 0.01), 0.99)
        w, p, one = F.col("_w"), F.col("_p"), F.col("one")
        sums = scored.groupBy("c").agg(F.sum(w * p * one).alias("tp"), F.sum(w * p).alias("t"), F.sum(w * (1 - p) * (1 - one)).alias("tn"), F.sum(w * (1 - p)).alias("f"))
        quality = cut(sums.select("c", ((F.col("tp") + 4) / (F.col("t") + 5)).alias("s"), ((F.col("tn") + 4) / (F.col("f") + 5)).alias("p")))  # four of five as a prior
    result = candidates.join(_probability(votes, quality, prior), "_pattern")
    return result.select(*[F.col(g).alias(k) for k, g in zip(keys, group)], F.col("_v").alias("value"), F.col("_p").alias("probability"), (F.col("_p") >= 0.5).alias("is_true")), Quality(quality)


def _probability(votes: DataFrame, quality: DataFrame, prior: float) -> DataFrame:
    """(_pattern, _p): the probability that a value with these claims is true, from the claimers that state it and those
    present that do not."""
    odds = F.when(F.col("one") == 1, F.log(F.col("s") / (1 - F.col("p")))).otherwise(F.log((1 - F.col("s")) / F.col("p")))
    return votes.join(quality, "c").groupBy("_pattern").agg((1 / (1 + F.exp(-(F.lit(math.log(prior / (1 - prior))) + F.sum(odds))))).alias("_p"))
