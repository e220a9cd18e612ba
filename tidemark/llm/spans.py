"""Problem 10: long spans that occur verbatim in more than one document.

1. Every document leaves fingerprints of the phrases that are smallest by hash in a window; any span of `least` characters
   holds a whole window, so two documents that share a span chose the same phrase of it.
2. Phrases chosen in at least two documents are confirmed as recurring. Each belongs to the first document that chose it.
3. The confirmed phrases are sharded by that document, and each shard compiles Aho-Corasick automata (pyahocorasick) of at most
   AUTOMATON phrases. Every document that can hold a phrase of a shard is streamed through the shard's automata, which alone
   tell where phrases occur. A phrase document with more than `unit` followers has its phrases in several shards, and each
   follower goes to one of them.
4. Around an occurrence, a span of `least` characters reaches x characters to the left for some x. A few core keys, each for
   a range of x, are hashes of the characters that all spans of the range have in common. Occurrences with one core key and
   the same hash of the fringe beside it share the span; only where fringes differ are the windows themselves hashed.
5. Documents with equal keys share a span. Keys with the same documents are merged before pairs are made.

No group is collected or compared pairwise: equality of keys, partly aggregated, does all the work. Only the pairs that share
a span are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.functions.storage import cut, stored
from tidemark.llm.codepoints import to_codes
from tidemark.llm.counts import only_with

PHRASE, STEPS, SHORTEST, AUTOMATON, UNIT = 200, 2, 60, 2_000, 20_000
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def phrase_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k code points, by prefix sums of a polynomial modulo 2^64, mixed so that its order is random."""
    n = len(codes)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE))])
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * powers[:n])])
    h = (sums[k:] - sums[:-k]) * back[: n - k + 1]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of each window of `width`, from running minima of blocks of that width."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def chosen_phrases(codes: np.ndarray, offsets: np.ndarray, least: int, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash) of the phrases that rows choose; rows shorter than `least` choose none."""
    width = least - phrase + 1
    rows, places, hashes = [], [], []
    lengths = np.diff(offsets)
    first = 0
    while first < len(lengths):  # some million characters at a time
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 2_000_000, side="right")) - 1)
        a, b = offsets[first], offsets[last]
        if b - a >= least:
            h = phrase_hashes(codes[a:b], phrase)
            place = (np.arange(len(h)) - np.repeat(offsets[first:last] - a, lengths[first:last])[: len(h)]).astype(np.uint64)
            keys = (h & np.uint64(0xFFFFFFFFFF000000)) | (place & np.uint64(0xFFFFFF))
            if len(keys) >= width:
                small = window_minima(keys, width)
                row = np.repeat(np.arange(first, last), lengths[first:last])[: len(small)]
                inside = place[: len(small)].astype(np.int64) + least <= lengths[row]
                row, low = row[inside], (small[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
                start = place[: len(small)][inside].astype(np.int64)
                at = (start & ~0xFFFFFF) + low  # texts of over 16 million characters wrap
                at = np.where(at < start, at + (1 << 24), at)
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])]) if len(row) else np.empty(0, dtype=bool)
                rows.append(row[new])
                places.append(at[new])
                hashes.append(h[(offsets[row[new]] - a + at[new]).astype(np.int64)])
        first = last
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in ((rows, np.int64), (places, np.int64), (hashes, np.uint64)))


def _digest(text: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def compiled(phrases: list[str]) -> list[ahocorasick.Automaton]:
    """Automata of at most AUTOMATON phrases each, which together hold all."""
    out = []
    for k in range(0, len(phrases), AUTOMATON):
        automaton = ahocorasick.Automaton()
        for p in phrases[k : k + AUTOMATON]:
            automaton.add_word(p, len(p))
        automaton.make_automaton()
        out.append(automaton)
    return out


def core_keys(text: str, automata: list[ahocorasick.Automaton], least: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(key, key, hash of the fringes, begin of the core, its length, begin and end with the fringes) around every occurrence
    of a phrase."""
    for automaton in automata:
        for end, phrase in automaton.iter(text):
            p, spare = end - phrase + 1, least - phrase
            step = -(-spare // STEPS)
            for j in range(STEPS):
                a, b = p - j * step, p + phrase + max(0, spare - (j + 1) * step)
                if a < 0 or b > len(text):
                    continue
                fringe = least - (b - a)
                first, last = max(0, a - fringe), min(len(text), b + fringe)
                if last - first >= least:
                    beside = xxhash.xxh3_64_intdigest(f"{text[first:a]}\x00{text[b:last]}".encode("utf-8", "surrogatepass")) - (1 << 63)
                    yield (*_digest(f"{j} {text[a:b]}"), beside, a, b - a, first, last)


def shared_windows(docs: DataFrame, key: str, text: str, least: int = 300, unit: int = UNIT) -> DataFrame:
    """(g1, g2, id, start, stop): stretches of at least `least` characters that documents with the same (g1, g2) share.

    Null texts, null ids and texts shorter than `least` share nothing. A span that a document holds twice counts only if
    another document holds it too. Other columns are ignored; an empty table gives no rows. `least` is at least SHORTEST;
    `unit` says how many documents follow one phrase document into a shard, and changes no result.
    """
    if least < SHORTEST:
        raise ValueError(f"spans must have at least {SHORTEST} characters")
    phrase = min(PHRASE, 2 * least // 3)
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where((F.length("t") >= least) & F.col("id").isNotNull())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, h = chosen_phrases(*to_codes(batch.column(1)), least, phrase)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32))], names=["id", "h", "p"])

    phrases = stored(docs.mapInArrow(choose, "id bigint, h bigint, p int"))
    # one for each recurring phrase: the document that it belongs to, and where it stands there
    recurring = cut(phrases.groupBy("h").agg(F.min(F.struct("id", "p")).alias("r"), F.max("id").alias("last")).where("r.id <> last").select("h", F.col("r.id").alias("owner"), F.col("r.p").alias("p")))
    shards = max(1, -(-recurring.count() // AUTOMATON))
    follow = stored(phrases.join(recurring.select("h", "owner"), "h").select("id", "owner").distinct())
    large = follow.groupBy("owner").agg(F.ceil(F.count("*") / unit).cast("int").alias("units")).where("units > 1")
    shard = lambda owner, u: F.pmod(F.xxhash64(owner, u), F.lit(shards)).cast("int")
    units = F.coalesce("units", F.lit(1))
    to = follow.join(large, "owner", "left").select("id", shard(F.col("owner"), F.pmod(F.xxhash64("id"), units).cast("int")).alias("s")).groupBy("id").agg(F.collect_set("s").alias("to"))  # at most as many as a text chose
    own = recurring.join(large, "owner", "left").groupBy(F.col("owner").alias("id")).agg(F.collect_list("p").alias("ps"), F.array_distinct(F.flatten(F.collect_set(F.transform(F.sequence(F.lit(0), units - 1), lambda u: shard(F.col("owner"), u.cast("int")))))).alias("own"))
    row = lambda s, kind, t: F.struct(s.alias("s"), F.lit(kind).alias("kind"), t.alias("t"))
    held = F.flatten(F.transform("own", lambda s: F.transform("ps", lambda p: row(s, 0, F.col("t").substr(p + 1, F.lit(phrase))))))
    routed = stored(only_with(docs, "id", follow).join(to, "id").join(own, "id", "left"))
    streamed = routed.select("id", F.inline(F.concat(F.coalesce(held, F.array().cast("array<struct<s:int,kind:int,t:string>>")), F.transform("to", lambda s: row(s, 1, F.col("t"))))))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, automata = None, [], None
        for batch in batches:
            found = []
            for i, (id_, s, kind, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if s != current:
                    current, known, automata = s, [], None
                if kind == 0:
                    known.append(t)
                    continue
                if automata is None:
                    automata = compiled(sorted(set(known)))
                found += [(id_, *x) for x in core_keys(t, automata, least)]
                if len(found) > 50_000:
                    yield _cores(found)
                    found = []
            if found:
                yield _cores(found)

    cores = stored(streamed.repartition("s").sortWithinPartitions("s", "kind").mapInArrow(locate, "id bigint, k1 bigint, k2 bigint, f bigint, a int, n int, start int, stop int"))
    kinds = cores.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.max("id").alias("high"), (F.min("f") != F.max("f")).alias("mixed")).where("low <> high").select("k1", "k2", "mixed")
    live = cores.join(kinds, ["k1", "k2"])
    whole = live.where("not mixed").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "id", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))
    reach = live.where("mixed").groupBy("id").agg(F.collect_set(F.struct("a", "n")).alias("cores"))  # at most as many as a text holds

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, t, held in zip(*(c.to_pylist() for c in batch.columns)):
                starts = {s for c in held for s in range(max(0, c["a"] - least + c["n"]), min(c["a"], len(t) - least) + 1)}
                if starts:
                    out = [(*_digest(t[s : s + least]), id_, s, s + least) for s in sorted(starts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["g1", "g2", "id", "start", "stop"])

    exact = routed.select("id", "t").join(reach, "id").mapInArrow(each_window, "g1 bigint, g2 bigint, id bigint, start bigint, stop bigint")
    groups = exact.groupBy("g1", "g2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("g1", "g2")
    return whole.unionByName(exact.join(groups, ["g1", "g2"]))


def _cores(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["id", "k1", "k2", "f", "a", "n", "start", "stop"])


def sharing_pairs(docs: DataFrame, key: str, text: str, least: int = 300, unit: int = UNIT) -> DataFrame:
    """(a, b), a < b: the documents that share a span of at least `least` characters, as `shared_windows` finds them."""
    members = cut(shared_windows(docs, key, text, least, unit).select("g1", "g2", "id").distinct())
    same = members.groupBy("g1", "g2").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.hash("id")).alias("s"), F.count("*").alias("n"))
    kept = same.groupBy("x", "s", "n").agg(F.min(F.struct("g1", "g2")).alias("g")).select("g.g1", "g.g2")  # one key for each set of documents
    once = members.join(kept, ["g1", "g2"])
    other = once.select("g1", "g2", F.col("id").alias("b"))
    return once.withColumnRenamed("id", "a").join(other, ["g1", "g2"]).where("a < b").select("a", "b").distinct()


def shared_share(docs: DataFrame, key: str, text: str, least: int = 300) -> DataFrame:
    """(key, n_chars, shared_chars, share): of each document that shares a span, how many characters lie in shared spans."""
    windows = shared_windows(docs, key, text, least).select("id", "start", "stop").distinct()
    order = W.Window.partitionBy("id").orderBy("start", "stop")
    reach = windows.withColumn("before", F.coalesce(F.max("stop").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    covered = reach.groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("shared_chars"))
    sizes = docs.select(F.col(key).cast("bigint").alias("id"), F.length(text).cast("bigint").alias("n_chars")).dropna()
    return covered.join(sizes, "id").select(F.col("id").alias(key), "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("share"))
