"""Problem 5: the top N of every group, by merging sorted runs with a loser tree.

Every map task turns its rows into one run, sorted by group, score and tie keys, and leaves from each group only its first N:
a group of a third of all rows shrinks to N rows a run before anything is shuffled. The runs are bucketed by group and stored
there in the order of groups. A bucket is read in blocks of whole groups; the runs of a block are merged through a loser tree,
and once a group has its N rows, every run seeks to its next group by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoserTree:
    """Tournament over the heads of sorted runs: each inner node holds the loser, so a new head replays one path only."""

    def __init__(self, heads: list):
        self.k = max(1, len(heads))
        self.heads = list(heads) or [None]
        self.losers = [0] * self.k
        self.winner = self._build(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and (x < y or x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first, second = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = second
        return first

    def replace(self, run: int, head: object) -> None:
        """The winner's run shows its next row; its path to the root is played again."""
        self.heads[run] = head
        node = (run + self.k) // 2
        while node >= 1:
            if self._less(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.winner = run


def merge_runs(runs: list[tuple[np.ndarray, list[tuple]]], n: int) -> Iterator[tuple[int, int, int]]:
    """(run, row, position) of the first `n` rows of every group; a run is its sorted group codes and its rows' sort keys."""
    at = [0] * len(runs)

    def head(r: int) -> tuple | None:
        groups, keys = runs[r]
        return (groups[at[r]], *keys[at[r]]) if at[r] < len(groups) else None

    if not runs:
        return
    tree, group, taken = LoserTree([head(r) for r in range(len(runs))]), None, 0
    while (top := tree.heads[tree.winner]) is not None:
        r = tree.winner
        if top[0] != group:
            group, taken = top[0], 0
        if taken < n:
            taken += 1
            yield r, at[r], taken
            at[r] += 1
        else:
            at[r] = int(np.searchsorted(runs[r][0], group, side="right"))
        tree.replace(r, head(r))


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], keep: list[str], n: int, buckets: int | None = None, block_rows: int = 20_000) -> DataFrame:
    """groups, keep and pos (1 to n): the `n` rows of each group with the highest score, ties by `ties` ascending.

    Rows with a null group or a null or NaN score are left out; nulls in a tie column come last; rows equal in all of
    these come in any order but never twice. Strings compare by code points. An empty table gives no rows.
    """
    wanted = list(dict.fromkeys([*groups, *keep]))
    inner = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*groups, score, *ties, *keep]))}
    rows = df.select(*[F.col(c).alias(a) for c, a in inner.items()]).dropna(subset=[inner[g] for g in groups] + [inner[score]]).where(~F.isnan(F.col(inner[score]).cast("double")))
    order: list[Column] = [F.col(inner[g]).asc() for g in groups] + [F.col(inner[score]).desc()] + [F.col(inner[t]).asc_nulls_last() for t in ties]
    by = [inner[g] for g in groups]

    def cut_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the run is sorted: a batch may continue the group of the batch before
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in by]))
            take = []
            for i, key in enumerate(keys):
                seen = seen + 1 if key == last else 1
                last = key
                if seen <= n:
                    take.append(i)
            yield batch.take(pa.array(take, pa.int64()))

    schema = rows.schema
    runs = rows.sortWithinPartitions(*order).mapInArrow(cut_run, schema).withColumn("_run", F.spark_partition_id())
    bucketed = runs.repartition(buckets, *by) if buckets else runs.repartition(*by)
    # a bucket's runs lie side by side group by group, sorted by Spark's own sort, which spills
    stored = bucketed.sortWithinPartitions(*by, "_run", *order[len(by) :])
    kept = [schema[inner[c]] for c in wanted]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, by, block_rows):
            groups = list(zip(*[block.column(c).to_pylist() for c in by]))
            code, number = [0] * len(groups), 0
            for i in range(1, len(groups)):
                number += groups[i] != groups[i - 1]
                code[i] = number
            parts = [[-x for x in block.column(inner[score]).to_pylist()]] + [x for t in ties for v in [block.column(inner[t]).to_pylist()] for x in ([y is None for y in v], v)]
            keys = list(zip(*parts))
            of_run: dict[int, list[int]] = {}
            for i, r in enumerate(block.column("_run").to_pylist()):
                of_run.setdefault(r, []).append(i)
            held = [(np.array([code[i] for i in rows]), [keys[i] for i in rows], rows) for rows in of_run.values()]
            picked = list(merge_runs([x[:2] for x in held], n))
            if picked:
                out = block.select([inner[c] for c in wanted]).take(pa.array([held[r][2][i] for r, i, _ in picked], pa.int64()))
                yield from out.append_column("pos", pa.array([p for _, _, p in picked], pa.int32())).combine_chunks().to_batches()

    final = T.StructType([*kept, T.StructField("pos", T.IntegerType())])
    return stored.mapInArrow(merge, final).select(*[F.col(inner[c]).alias(c) for c in wanted], "pos")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of at least `least` rows (the last may be smaller) that end where a group ends; rows come sorted by group. A
    group has at most n rows of each run, so a table has a bound however many groups a bucket has."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < least:
            continue
        block = pa.Table.from_batches(held).combine_chunks()
        last = [block.column(c)[-1].as_py() for c in by]
        end = len(block)
        while end and all(block.column(c)[end - 1].as_py() == x for c, x in zip(by, last)):
            end -= 1
        if end:
            yield block.slice(0, end)
        held = block.slice(end).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()
