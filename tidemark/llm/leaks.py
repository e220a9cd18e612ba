"""Problem 9: passages of held-out items inside the corpus, by a positional inverted index distributed by document.

Each block of documents stores the postings of all its terms: where each of them stands, document behind document. The index is
written once to the shared folder; looking up test passages, however many, reads postings and no text again.

A window of `span` consecutive passage words can only match where its rarest term stands, so every window is looked up by the
term with the fewest postings in the block. The postings, shifted by the term's offset, are alignments of the passage with the
block. For an exact phrase they are intersected with the neighbouring words' positions, outwards in both directions, until a
word disagrees; for a match by proximity the words of the window are looked for near their shifted places.

The test set is taken in blocks of at most `block_items` items and about `block_words` words, each sent to all tasks: the size
of what is sent has a bound, and a larger test set means more passes over the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.llm.words import words

#: Most alignments that are looked at in one go, most words of an index block, words kept with their hashes in a worker.
STEP, BLOCK_WORDS, REMEMBERED = 1_000_000, 2_000_000, 300_000
_known: dict[str, int] = {}


def term_codes(found: list[str]) -> list[int]:
    """The 64-bit codes of words."""
    try:
        return [_known[w] for w in found]
    except KeyError:
        if len(_known) > REMEMBERED:
            _known.clear()
        for w in set(found).difference(_known):
            _known[w] = xxhash.xxh3_64_intdigest(w) - (1 << 63)
        return [_known[w] for w in found]


def passage_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(ids, ends, terms, begins, places), one row for each block of documents, written to the shared folder.

    The words of the block's documents are numbered in a row with one number between documents; `ends` are the numbers behind
    each document, and the places of terms[i] are places[begins[i]:begins[i + 1]]. Null texts have no words.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        codes: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.array(term_codes(words(t)), dtype=np.int64)
                ids.append(k)
                codes.append(found)
                total += len(found)
                if total > BLOCK_WORDS:
                    yield row(ids, codes)
                    ids, codes, total = [], [], 0
        if ids:
            yield row(ids, codes)

    def row(ids: list, codes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        flat = np.concatenate(codes)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        terms, begins = np.unique(flat[order], return_index=True)
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        return pa.RecordBatch.from_arrays([one(ids, kinds[0]), one(ends.astype(np.int32), pa.int32()), one(terms, pa.int64()), one(np.append(begins, len(flat)).astype(np.int32), pa.int32()), one(place[order].astype(np.int32), pa.int32())], names=["ids", "ends", "terms", "begins", "places"])

    kind = docs.schema[key].dataType
    kinds = [pa.string() if kind.simpleString() == "string" else pa.int64()]
    stored_kind = "string" if kind.simpleString() == "string" else "bigint"
    return stored(docs.select(F.col(key).cast(stored_kind), text).mapInArrow(build, f"ids array<{stored_kind}>, ends array<int>, terms array<bigint>, begins array<int>, places array<int>"))


class TestPassages:
    """All passages of one block of items as one array of term codes, with a gap between passages."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]], span: int):
        self.span = span
        code: dict[int, int] = {}
        codes, owner = [], []
        for item, passage in items:
            found = term_codes(words(passage))
            if len(found) < span:
                continue
            codes += [code.setdefault(w, len(code)) for w in found] + [-1]
            owner += [item] * (len(found) + 1)
        self.terms = np.array(list(code), dtype=np.int64)
        self.codes = np.array([-1, *codes], dtype=np.int32)
        self.owner = np.array([0, *owner], dtype=object if owner and isinstance(owner[0], str) else np.int64)
        if len(self.codes) > span:
            windows = np.lib.stride_tricks.sliding_window_view(self.codes, span)
            self.starts = np.flatnonzero((windows >= 0).all(axis=1))
        else:
            self.starts = np.empty(0, dtype=np.int64)

    def postings(self, ends: np.ndarray, terms: np.ndarray, begins: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one block: the code at each place (-2 for other words, -3 between documents), postings by code, where each code's
        begin, and the document of each place."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(0, len(terms) - 1))
        held = terms[at] == self.terms if len(terms) else np.zeros(len(self.terms), dtype=bool)
        first, n = np.where(held, begins[at], 0), np.where(held, begins[np.minimum(at + 1, len(begins) - 1)] - begins[at], 0)
        begin = np.concatenate([[0], np.cumsum(n)])
        found = places[np.repeat(first - begin[:-1], n) + np.arange(begin[-1])] if len(places) else places
        corpus = np.full(int(ends[-1]) + 2, -2, dtype=np.int32)
        corpus[0] = corpus[ends + 1] = -3  # places are shifted by one, so that there is a gap before the first
        corpus[found + 1] = np.repeat(np.arange(len(self.terms)), n)
        return corpus, found + 1, begin, np.searchsorted(ends + 1, np.arange(len(corpus)), side="left")

    def phrases(self, ends: np.ndarray, terms: np.ndarray, begins: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document number, item, words in a row) of alignments with at least `span` equal consecutive words."""
        if not len(self.starts):
            return
        corpus, postings, begin, text_of = self.postings(ends, terms, begins, places)
        df = np.diff(begin)
        rarity = np.where(self.codes >= 0, df[self.codes], 0)
        windows = np.lib.stride_tricks.sliding_window_view(rarity, self.span)[self.starts]
        rarest = windows.argmin(axis=1)
        possible = windows[np.arange(len(windows)), rarest] > 0
        anchors = np.unique((self.starts + rarest)[possible])
        for a, c in _alignments(anchors, self.codes, df, begin, postings, STEP):
            run = np.ones(len(a), dtype=np.int64)
            for step in (1, -1):
                live, at = np.arange(len(a)), step
                while len(live):
                    live = live[self.codes[a[live] + at] == corpus[c[live] + at]]
                    run[live] += 1
                    at += step
            long = run >= self.span
            yield text_of[c[long]], self.owner[a[long]], run[long]

    def near(self, ends: np.ndarray, terms: np.ndarray, begins: np.ndarray, places: np.ndarray, misses: int, drift: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document number, item, words found) of windows of which at most `misses` words are not found within `drift` words of
        their places. One of the `misses` + 1 rarest words of such a window is in the document, so these are looked up."""
        if not len(self.starts):
            return
        corpus, postings, begin, text_of = self.postings(ends, terms, begins, places)
        df = np.diff(begin)
        rarity = np.where(self.codes >= 0, df[self.codes], 0)
        windows = np.lib.stride_tricks.sliding_window_view(rarity, self.span)[self.starts]
        for r in np.argsort(windows, axis=1, kind="stable")[:, : misses + 1].T:
            at = self.starts + r
            for w, c in _alignments(np.arange(len(at)), self.codes[at], df, begin, postings, STEP // 5):
                base, doc, found = c - r[w], text_of[c], np.zeros(len(c), dtype=np.int64)
                for j in range(self.span):
                    here = np.zeros(len(c), dtype=bool)
                    for o in range(-drift, drift + 1):
                        place = np.clip(base + j + o, 0, len(corpus) - 1)
                        here |= (corpus[place] == self.codes[self.starts[w] + j]) & (text_of[place] == doc)
                    found += here
                    still = found + (self.span - 1 - j) >= self.span - misses
                    if not still.all():
                        base, doc, found, w = base[still], doc[still], found[still], w[still]
                        c = c[still]
                if len(found):
                    yield doc, self.owner[self.starts[w]], found


def _alignments(anchors: np.ndarray, codes: np.ndarray, df: np.ndarray, begin: np.ndarray, postings: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor, place) for all postings of the anchors' terms, some at a time."""
    n = np.where(codes[anchors] >= 0, df[codes[anchors]], 0)
    steps = np.searchsorted(np.cumsum(n), np.arange(most, n.sum() + most, most), side="left")
    for part in np.split(np.arange(len(anchors)), np.unique(np.minimum(steps + 1, len(anchors)))):
        count = n[part]
        if count.sum():
            first = begin[codes[anchors[part]]]
            yield np.repeat(anchors[part], count), postings[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]


def _looked_up(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, span: int, block_items: int, block_words: int, name: str, find: Callable) -> DataFrame:
    kinds = {k: d.schema[k].dataType.simpleString() for d, k in ((docs, key), (items, item_key))}
    wanted = items.select(F.col(item_key).alias("i"), F.col(passage).alias("p")).where("p is not null")
    held, characters = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    blocks = max(1, -(-held // block_items), -(-characters // (6 * block_words)))
    index = passage_index(docs, key, text)
    found = []
    for b in range(blocks):
        block = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == b)
        shared = docs.sparkSession.sparkContext.broadcast(TestPassages([(r["i"], r["p"]) for r in block.collect()], span))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(len(batch)):
                    ids, *block = (c[k].values for c in batch.columns)
                    hits = list(find(shared.value, *(x.to_numpy() for x in block)))
                    if hits:
                        at, item, n = (np.concatenate(x) for x in zip(*hits))
                        best = pd.DataFrame({key: ids.to_numpy(zero_copy_only=False)[at], item_key: item, name: n}).groupby([key, item_key], as_index=False).max()
                        yield from pa.Table.from_pandas(best, preserve_index=False).combine_chunks().to_batches()

        found.append(index.mapInArrow(look, f"`{key}` {'string' if kinds[key] == 'string' else 'bigint'}, `{item_key}` {'string' if kinds[item_key] == 'string' else 'bigint'}, `{name}` bigint"))
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(F.col(key).cast(kinds[key]).alias(key), F.col(item_key).cast(kinds[item_key]).alias(item_key)).agg(F.max(name).alias(name))


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, span: int = 12, block_items: int = 20_000, block_words: int = 2_000_000) -> DataFrame:
    """(key, item_key, longest) of every document that holds at least `span` consecutive words of an item's passage.

    Case, punctuation and white space do not matter. Null and empty texts and passages, and passages of fewer words, match
    nothing; equal ids give one row with the longest run; other columns are ignored; empty tables give no rows.
    """
    return _looked_up(docs, key, text, items, item_key, passage, span, block_items, block_words, "longest", TestPassages.phrases)


def near_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, span: int = 12, misses: int = 2, drift: int = 2, block_items: int = 20_000, block_words: int = 2_000_000) -> DataFrame:
    """(key, item_key, found) of every document that holds, for some `span` consecutive words of an item's passage, all but at
    most `misses` of them within `drift` words of their places. Nulls, empty texts, repeats and empty tables as above."""
    return _looked_up(docs, key, text, items, item_key, passage, span, block_items, block_words, "found", lambda p, *block: p.near(*block, misses, drift))
