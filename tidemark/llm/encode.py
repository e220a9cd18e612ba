"""Problem 8: token ids of every text by a public byte-level BPE, by replaying the merges over a block's words.

A block of texts is cut into words; each distinct word is encoded once. The replay keeps all new words of the block as one
long symbol sequence, with an inverted index from each pair of neighbouring symbols to the positions where it stands. The
merges are applied in rank order; each touches only the positions of its own pair and updates the pairs of their neighbours.
A merge makes only pairs of a later rank, so the order of ranks is also the order in which a single word would be merged.
Words known to the worker process are looked up; that store is emptied when it is full, which changes no result.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The word pattern of the byte_bpe_50k vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where vocabulary files are looked for, unless a folder is passed.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Most chunks that a worker remembers.
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Replay:
    """The merges of a byte-level BPE file, applied to many words at once."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.byte_ids = [vocab[s] for s in byte_symbols()]
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.word = regex.compile(WORD)
        #: None: a space beside other white space, only there a chunk's words depend on its neighbours
        self.chunks: dict[str, bytes | None] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes the distinct `words` in one replay."""
        merges, symbols, ends = self.merges, [], []
        for w in words:
            symbols += [self.byte_ids[b] for b in w.encode("utf-8", "surrogatepass")]
            symbols.append(-1)
            ends.append(len(symbols) - 1)
        following = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(len(symbols) - 1):
            pair = (symbols[i], symbols[i + 1])
            if pair in merges:
                where.setdefault(pair, []).append(i)
        queue = [(merges[pair][0], pair) for pair in where]
        heapq.heapify(queue)
        while queue:
            _, pair = heapq.heappop(queue)
            left, right = pair
            new = merges[pair][1]
            for i in sorted(where.pop(pair)):
                j = following[i]
                if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                    continue  # merged away since it was indexed
                symbols[i], symbols[j] = new, -2
                k = following[j]
                following[i] = k
                before[k] = i
                for at, other in ((before[i], (symbols[before[i]], new)), (i, (new, symbols[k]))):
                    if at >= 0 and other in merges:
                        if other not in where:
                            where[other] = []
                            heapq.heappush(queue, (merges[other][0], other))
                        where[other].append(at)
        begin = 0
        for w, end in zip(words, ends):
            self.words[w] = tuple(s for s in symbols[begin:end] if s >= 0)
            begin = end + 1

    def _ids(self, words: list[str]) -> bytes:
        """The ids of `words`, as bytes that can be joined."""
        new = set(words).difference(self.words)
        if new:
            self.learn(sorted(new))
        return np.array([i for w in words for i in self.words[w]], dtype=np.int32).tobytes()

    def _ensure(self, chunks: set[str]) -> None:
        """Puts the ids of a space and each of `chunks` into the store; None where white space stands beside the space."""
        odd = {c for c in chunks if not c or c[0].isspace() or c[-1].isspace()}
        cut = {c: self.word.findall(" " + c) for c in chunks - odd}
        new = {w for parts in cut.values() for w in parts}.difference(self.words)
        if new:
            self.learn(sorted(new))
        self.chunks.update(dict.fromkeys(odd))
        for c, parts in cut.items():
            self.chunks[c] = self._ids(parts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; of null and empty texts, none.

        A single space always opens a word, so texts are cut at spaces. Where a space stands beside other white space the
        words depend on more than the chunk; such texts are cut by the word pattern itself.
        """
        cut = [t.split(" ") if t else [""] for t in texts]
        first = [c.pop(0) for c in cut]
        missing = set(chain.from_iterable(cut)).difference(self.chunks)
        if len(self.chunks) + len(missing) > REMEMBERED:
            self.chunks.clear()
            self.words.clear()
            if len(texts) > 1:  # a block at a time of what fits
                half = len(texts) // 2
                return self.encode(texts[:half]) + self.encode(texts[half:])
            missing = set(chain.from_iterable(cut))
        self._ensure(missing)
        known, out = self.chunks.__getitem__, []
        for t, f, c in zip(texts, first, cut):
            parts = list(map(known, c))
            if None in parts or f[-1:].isspace():
                parts = [self._ids(self.word.findall(t))]
            elif f:
                parts.insert(0, self._ids(self.word.findall(f)))
            out.append(np.frombuffer(b"".join(parts), dtype=np.int32))
        return out


_loaded: dict[str, Replay] = {}


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): every row with the list of token ids of its text, no special tokens added or recognised.

    Null, empty texts give an empty list; repeated rows come out as often as they went in; other columns are ignored. The
    vocabulary file is read once in each worker process from `folder`, which every executor must have.
    """
    path = f"{folder or FOLDER}/{vocabulary}.json"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _loaded.setdefault(path, None) or Replay(path)
        _loaded[path] = replay
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                part = batch.slice(begin, 2000)
                ids = replay.encode(part.column(text).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
