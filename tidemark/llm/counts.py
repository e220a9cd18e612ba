"""Exact counts of the words of a whole collection, and decisions on words that are taken where their counts are.

Counts stay a table. What a decision needs is asked of it by joins, a word at a time and not a text at a time, so the cost
follows the vocabulary. Only decisions reach the texts: sent to all tasks if they are few, joined if they are many.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.storage import cut

#: Most decisions that are sent to all tasks; more of them are joined to the texts instead.
MOST_SENT = 500_000
BITS = 1 << 26


def count_words(df: DataFrame, text: str, words: Callable[[str], list[str]]) -> DataFrame:
    """(word, n): how often each of words(text) occurs in all rows; nulls count nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(words(t))
            if len(seen) > 200_000:
                yield _pairs(seen)
                seen = Counter()
        if seen:
            yield _pairs(seen)

    return df.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


class WordFilter:
    """Whether a word may be in a set: never wrong for its members, now and then for others. BITS bits whatever the set; a
    larger set makes more words pass, which costs questions to the exact counts and changes no decision."""

    def __init__(self, bits: np.ndarray, longest: int):
        self.bits, self.longest = bits, longest

    @staticmethod
    def slots(word: str) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(word)
        return h % BITS, (h >> 32) % BITS

    def __contains__(self, word: str) -> bool:
        a, b = self.slots(word)
        return bool(self.bits[a >> 3] >> (a & 7) & 1 and self.bits[b >> 3] >> (b & 7) & 1)

    @classmethod
    def of(cls, counts: DataFrame, least: int) -> WordFilter:
        """The words with at least `least` occurrences, and the length of the longest of them."""
        frequent = counts.where(F.col("n") >= least)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.array([s for w in batch.column(0).to_pylist() for s in cls.slots(w)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["place", "bits"])

        made = frequent.select("word").mapInArrow(spread, "place int, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BITS / 64 rows
        bits = np.zeros(BITS // 64, dtype=np.int64)
        bits[made["place"].to_numpy()] = made["bits"].to_numpy()
        return cls(bits.view(np.uint8), frequent.agg(F.max(F.length("word"))).first()[0] or 0)


def only_with(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """`rows` without most of those whose `key` is not in `wanted`, before they are shuffled for a join with it. A bitmap of BITS
    bits says which may be; the more keys are wanted, the fewer rows it can drop."""
    slots = lambda c: [F.pmod(F.xxhash64(c), F.lit(BITS)), F.pmod(F.xxhash64(F.lit(7), c), F.lit(BITS))]
    held = wanted.select(F.explode(F.array(*slots(key))).alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()  # at most BITS / 64 rows
    bits = np.zeros(BITS // 64, dtype=np.int64)
    bits[held["place"].to_numpy()] = held["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint8))
    columns = rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            x, y = batch.column("_x").to_numpy(), batch.column("_y").to_numpy()
            may = (b[x >> 3] >> (x & 7)) & (b[y >> 3] >> (y & 7)) & 1
            yield batch.filter(pa.array(may.astype(bool))).select(columns)

    marked = rows.withColumns(dict(zip(("_x", "_y"), slots(key))))
    return marked.mapInArrow(keep, rows.schema)


def counts_of(spark: SparkSession, words: set[str], counts: DataFrame) -> dict[str, int]:
    """The counts of some words known to the driver."""
    asked = spark.createDataFrame(pa.table({"word": pa.array(sorted(words), pa.string())}))
    return {r["word"]: r["n"] for r in asked.join(counts, "word").collect()}  # at most as many as were asked


def decided(asks: DataFrame, counts: DataFrame, judge: Callable[[str, dict[str, int]], str | None]) -> DataFrame:
    """(item, result) of the items for which judge(item, counts of what it asks for) is not None; `asks` has (item, word)."""
    answers = asks.join(counts, "word", "left").groupBy("item").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("answers"))  # as many as an item asks

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, results = [], []
            for item, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                result = judge(item, {x["word"]: x["n"] for x in held})
                if result is not None:
                    items.append(item)
                    results.append(result)
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(results, pa.string())], names=["item", "result"])

    return answers.mapInArrow(decide, "item string, result string")


def with_decisions(rows: DataFrame, decisions: DataFrame, items: Callable[[pa.RecordBatch], list[set[str]]], act: Callable[[pa.RecordBatch, Callable[[int], dict[str, str]]], pa.RecordBatch | None], schema: str, most_sent: int = MOST_SENT) -> DataFrame:
    """act(batch, decisions of a row of it) for all batches of `rows`. items(batch) names what each row may need."""
    decisions = cut(decisions)
    if decisions.count() <= most_sent:
        held = decisions.toArrow()  # at most `most_sent` rows
        shared = rows.sparkSession.sparkContext.broadcast(dict(zip(held["item"].to_pylist(), held["result"].to_pylist())))

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            yield from filter(None, (act(batch, lambda _: known) for batch in batches))

        return rows.mapInArrow(alone, schema)
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = items(batch)
            n = pa.array(np.repeat(np.arange(len(batch)), [len(x) for x in asked]))
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(n), pa.array([i for x in asked for i in x], pa.string())], names=["_row", "item"])

    found = numbered.mapInArrow(ask, "_row bigint, item string").join(decisions, "item").groupBy("_row").agg(F.collect_list(F.struct("item", "result")).alias("_held"))  # of one text

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [{x["item"]: x["result"] for x in h or ()} for h in batch.column("_held").to_pylist()]
            out = act(batch, held.__getitem__)
            if out is not None:
                yield out

    return numbered.join(found, "_row", "left").mapInArrow(beside, schema)
