"""Cosine similarity of vectors inside groups, against anchors, and clusters of what is similar."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The scalar product of two arrays, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def _vectors(values: list) -> np.ndarray:
    return np.array(values, dtype=np.float64).reshape(len(values), -1)


def word_vectors(texts: list[str]) -> np.ndarray:
    """Word counts over the words of just these texts."""
    code: dict[str, int] = {}
    at, rows = [], []
    for i, t in enumerate(texts):
        found = [code.setdefault(w, len(code)) for w in re.findall(r"[^\W_]+", t.lower())]
        at += found
        rows += [i] * len(found)
    counts = np.zeros((len(texts), max(1, len(code))))
    np.add.at(counts, (np.array(rows, dtype=np.int64), np.array(at, dtype=np.int64)), 1)
    return counts


def similar_in_groups(rows: DataFrame, key: str, group: str | list[str], value: str, threshold: float, block: int = 2000, embed: Callable[[list], np.ndarray] | None = None) -> DataFrame:
    """(a, b, similarity), a < b: pairs of one group whose vectors have a cosine of at least `threshold`.

    `value` is an array column of one length, or anything that `embed` turns into the rows of a matrix. A group is cut into
    blocks of about `block` rows by a hash of the id, so the number of blocks follows its size; each pair of blocks is a cell,
    and a cell one matrix product of bounded size in a task of its own. Every pair is compared, so the work grows with the
    square of a group. Null values and groups have no partners, nor have vectors of length 0.
    """
    embed = embed or _vectors
    groups = [group] if isinstance(group, str) else group
    base = rows.select(F.col(key).alias("id"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col(value).alias("v")).dropna()
    by = [f"g{i}" for i in range(len(groups))]
    sizes = base.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    numbered = base.join(sizes, by).withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    cells = numbered.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("id", *by, "v", "k", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"))
    kind = rows.schema[key].dataType.simpleString()

    def compare(cell: pa.Table) -> pa.Table:
        ids, blocks = cell.column("id").to_numpy(), cell.column("k").to_numpy()
        v = embed(cell.column("v").to_pylist())
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        low, high = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
        left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        found = v[left] @ v[right].T
        i, j = np.nonzero(found >= threshold - 1e-12)
        a, b, s = ids[left[i]], ids[right[j]], found[i, j]
        keep = a < b if low == high else a != b
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s[keep]})

    return cells.groupBy(*by, "x", "y").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def nearest_anchor(rows: DataFrame, key: str, vector: str, anchors: DataFrame, anchor_key: str, anchor_vector: str, at_once: int = 1000) -> DataFrame:
    """(key, anchor, similarity): the most similar of a fixed set of anchors, the smallest anchor id on ties.

    Anchors become literal arrays of about `at_once`, so nothing is joined or shuffled; of several arrays the best one counts.
    Null vectors are near nothing. Without any anchor there are no rows.
    """
    wanted = anchors.select(F.col(anchor_key).alias("anchor"), unit(F.col(anchor_vector)).alias("v")).dropna()
    parts = max(1, -(-wanted.count() // at_once))
    best = []
    for part in range(parts):
        held = (wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == part)).collect()
        if held:
            anchors_json = json.dumps([{"anchor": r["anchor"], "v": list(r["v"])} for r in sorted(held)])
            table = F.from_json(F.lit(anchors_json), "array<struct<anchor:bigint,v:array<double>>>")  # folded to a constant
            best.append(F.array_max(F.transform(table, lambda x: F.struct(dot(F.col("_u"), x["v"]).alias("similarity"), (-x["anchor"]).alias("n")))))
    scored = rows.select(key, unit(F.col(vector)).alias("_u")).withColumn("_b", F.array_max(F.array(*best)) if best else F.lit(None).cast("struct<similarity:double,n:bigint>"))
    return scored.where("_b.similarity is not null").select(key, (-F.col("_b.n")).alias("anchor"), F.col("_b.similarity").alias("similarity"))
