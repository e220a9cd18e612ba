"""Problem 1: frequency of every value, term and n-gram, by suffix arrays with common-prefix intervals.

Every Arrow batch is a block of the collection. Equal values are collapsed to one weighted record first, so a value that a
third of all rows hold costs one record. Over the block's records, those of like length together, a suffix array is sorted,
as deep as the longest record or cut at `n_max` terms where only shorter n-grams are wanted; runs of
neighbours with a common prefix of d terms are the intervals, one for each d-gram, and their weight is its number of
occurrences. A second order, by record and then by suffix, has the repeats inside a record side by side: each neighbour pair
with a common prefix of d terms takes one from the record count of its d-gram. The blocks' counts are summed by key in one
shuffle of small partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "field string, n int, ngram array<string>, occurrences bigint, records bigint"


def category_terms(value: str) -> list[str]:
    """The one term of a category: its trimmed, lower-cased value."""
    term = value.strip(" ").lower()
    return [term] if term else []


def detection_terms(value: str) -> list[str]:
    """The pieces between | signs, trimmed; a piece `reasons=a,b` gives its parts instead."""
    terms = []
    for piece in value.lower().split("|"):
        piece = piece.strip(" ")
        if piece.startswith("reasons="):
            terms += [part.strip(" ") for part in piece[len("reasons=") :].split(",")]
        else:
            terms.append(piece)
    return [t for t in terms if t]


def _common_prefix(rows: np.ndarray) -> np.ndarray:
    """Of each row, how many leading terms it shares with the row before; the first shares none."""
    same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
    return np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)]).astype(np.int64)


def block_counts(records: list[list[str]], weights: np.ndarray, n_max: int | None = None) -> list[tuple[int, list[str], int, int]]:
    """(n, n-gram, occurrences, records) of every n-gram, up to `n_max` terms if given; weights[i] rows hold records[i]."""
    lengths = np.array([len(r) for r in records], dtype=np.int64)
    flat = [t for r in records for t in r]
    if not flat:
        return []
    n_max = int(lengths.max()) if n_max is None else min(n_max, int(lengths.max()))
    names, codes = np.unique(np.array(flat, dtype=object), return_inverse=True)
    owner = np.repeat(np.arange(len(records)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # terms to the record's end
    suffixes = np.zeros((len(flat), n_max), dtype=np.int64)
    for d in range(n_max):
        suffixes[: len(flat) - d, d] = codes[d:] + 1
        suffixes[left <= d, d] = 0
    weight = np.asarray(weights, dtype=np.int64)[owner]
    array = np.lexsort(suffixes[:, ::-1].T)
    shared = _common_prefix(suffixes[array])
    within = np.lexsort(np.column_stack([suffixes[:, ::-1], owner]).T)
    repeated = _common_prefix(suffixes[within])
    repeated[1:][owner[within][1:] != owner[within][:-1]] = 0
    interval = np.empty(len(flat), dtype=np.int64)
    out = []
    for d in range(1, n_max + 1):
        deep = suffixes[array, d - 1] > 0
        begins = deep & (shared < d)
        if not begins.any():
            break
        number = np.cumsum(begins) - 1
        interval[array] = number
        total = np.bincount(number[deep], weights=weight[array][deep]).astype(np.int64)
        again = within[repeated >= d]
        twice = np.bincount(interval[again], weights=weight[again], minlength=len(total)).astype(np.int64)
        for at, all_, double in zip(array[begins], total, twice):
            out.append((d, [names[c - 1] for c in suffixes[at, :d]], int(all_), int(all_ - double)))
    return out


def by_length(records: list[list[str]], weights: np.ndarray) -> Iterator[tuple[list[list[str]], np.ndarray]]:
    """The records in classes of like length, so that a long one does not deepen the suffixes of all."""
    sizes = np.array([len(r).bit_length() for r in records], dtype=np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield [records[i] for i in at], weights[at]


def term_frequency(df: DataFrame, fields: dict[str, Callable[[str], list[str]]], n_max: int | None = 1) -> DataFrame:
    """Occurrences and records of every n-gram (1 to `n_max` terms, without a bound if None) of every field over all rows.

    `fields` maps a string column to the function that splits a value into its terms. Null, empty and blank values give no
    terms; an empty table gives no rows. Columns besides `fields` are ignored, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("field", pa.string()), ("n", pa.int32()), ("ngram", pa.list_(pa.string())), ("occurrences", pa.int64()), ("records", pa.int64())])
        for batch in batches:
            rows = []
            for field, split in fields.items():
                values = pc.value_counts(batch.column(field).drop_null())
                held, weights = values.field(0).to_pylist(), values.field(1).to_numpy(zero_copy_only=False)
                for records, held_by in by_length([split(v) for v in held], weights):
                    rows += [(field, *x) for x in block_counts(records, held_by, n_max)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    parts = df.select(*fields).mapInArrow(count, COUNTS)
    return parts.groupBy("field", "n", "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_useless(counts: DataFrame, df: DataFrame, fields: list[str], rare: int = 3, common: float = 0.4) -> DataFrame:
    """`counts` with in_rows (records in which the field is not null), is_rare (in at most `rare` records) and is_common
    (in more than the share `common` of in_rows). The totals are one row a field, so they are broadcast."""
    pairs = ", ".join(f"'{f}', `in_{i}`" for i, f in enumerate(fields))
    totals = df.agg(*[F.count(f).alias(f"in_{i}") for i, f in enumerate(fields)]).selectExpr(f"stack({len(fields)}, {pairs}) as (field, in_rows)")
    return counts.join(F.broadcast(totals), "field").withColumns({"is_rare": F.col("records") <= rare, "is_common": F.col("records") > F.col("in_rows") * F.lit(str(common)).cast("decimal(9,6)")})
