"""Problem 7: records whose word sets nearly agree, by a count-vector R-tree.

A record's words are hashed into GROUPS groups; the counts are a point. Two records share at most the sum of the smaller
counts of each group, so a node of the tree is passed over if the sum of the minima with its upper corner is too small. Pairs
that survive this bound are verified on the words themselves.

Only records of one text are compared, so the rows of a text meet in one task. There a text's rare words make its trees: in an
order from rare to frequent, the first words of a record must include one of any record similar enough, so each of them is a
tree of the records that have it among their first. All trees of a task, of two records or of many thousands, are one forest
of arrays with the same leaves, inner nodes and query; no size is treated otherwise.

A text with more than `local` rows does not fit one task: its rows are dealt by context to blocks, and the words of each block
are written once to the shared folder. A task reads two blocks and joins them: their rows are sorted by size in one tree each,
and the nodes of one tree descend beside those of the other as long as the summed minima of both upper corners are enough. In
leaves that meet, the parities of finer counts are compared first, since two records differ in at least as many words as parities;
then counts, then words. Nothing but ids and results is moved, so disk grows with the rows and not with the pairs of blocks.
Rows with equal text and context are one class: classes are compared, and their members follow at the end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import stored_by
from tidemark.llm.words import words

GROUPS, LEAF, FAN, LOCAL, CHUNK, SHARD, STEP = 40, 16, 8, 8_000, 32_000, 32_000, 200_000
BITS, TILE, ROW = 512, 64, 1_000  # parities of a record, rows of a leaf where blocks are joined, classes in a stored row
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STORED = "block int, first int, words array<bigint>, sizes array<int>, ids array<bigint>, copies array<int>"
_TOP = 65_535  # counts are kept up to here; of two records with more words the sum says nothing

_chunks: dict[str, tuple[int, ...]] = {}


def word_hashes(context: str | None) -> np.ndarray:
    """The sorted hashes of a context's distinct words.

    No word holds white space, so the words of each distinct chunk between white space are hashed once in a worker; the store
    is emptied when it is full.
    """
    chunks = set(context.split()) if context else set()
    new = chunks.difference(_chunks)
    if new:
        if len(_chunks) + len(new) > 300_000:
            _chunks.clear()
            new = chunks
        for c in new:
            _chunks[c] = tuple(xxhash.xxh3_64_intdigest(w) for w in words(c))
    held = set(chain.from_iterable(map(_chunks.__getitem__, chunks)))
    h = np.fromiter(held, dtype=np.uint64, count=len(held))
    h.sort()
    return h


def points_of(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The count vector of each of `n` records."""
    at = owner * GROUPS + (flat >> np.uint64(40)).astype(np.int64) % GROUPS
    counts = np.bincount(at, minlength=n * GROUPS).reshape(n, GROUPS)
    most = int(counts.max()) if counts.size else 0
    return np.minimum(counts, _TOP).astype(np.uint8 if most < 256 else np.uint16)


def partner_limit(sizes: np.ndarray, ranks: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The largest partner that a row can have as the smaller of a pair, from the words that can follow the common one."""
    a, b = share
    return np.minimum(sizes * b // a, (sizes - ranks) * (a + b) // a - sizes)


class Forest:
    """R-trees over rows that come sorted by tree and, in it, by size; one for each tree number.

    Level 0 has nodes of LEAF neighbouring rows, each level above nodes of FAN neighbours below it, until a tree has one node.
    A node holds its upper corner, its smallest size and its last row.
    """

    def __init__(self, tree: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, points: np.ndarray, share: tuple[int, int]):
        self.sizes, self.ranks, self.points, self.share = sizes, ranks, points, share
        self.limit = partner_limit(sizes, ranks, share)
        self.levels: list[dict[str, np.ndarray]] = []
        self.roots: list[tuple[int, np.ndarray, np.ndarray]] = []  # (level, rows, node of each)
        begins = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(tree) else np.empty(0, dtype=np.int64)
        lengths = np.diff(np.append(begins, len(tree)))
        trees = np.flatnonzero(lengths > 1)
        rows_of = lambda t: np.repeat(begins[t], lengths[t]) + _ramp(lengths[t])
        below = rows_of(trees)  # what the next level is made of, by tree
        counts, upper, low, last = lengths[trees], points, sizes, np.arange(len(tree))
        fan = LEAF
        while len(trees):
            made = -(-counts // fan)
            starts = np.repeat(np.cumsum(counts) - counts, made) + _ramp(made) * fan
            size = np.diff(np.append(starts, len(below)))
            node = {"child": below, "first": starts, "n": size, "upper": np.maximum.reduceat(upper[below], starts, axis=0), "low": low[below[starts]], "last": last[below[starts + size - 1]]}
            self.levels.append(node)
            one = made == 1
            offsets = np.cumsum(made) - made
            rows = rows_of(trees[one])
            root = np.repeat(offsets[one], lengths[trees[one]])
            live = self.limit[rows] >= sizes[rows]
            self.roots.append((len(self.levels) - 1, rows[live], root[live]))
            below = np.repeat(offsets[~one], made[~one]) + _ramp(made[~one])
            trees, counts, upper, low, last, fan = trees[~one], made[~one], node["upper"], node["low"], node["last"], FAN

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) of one tree, i before j, that the bounds let pass; every such pair comes once a tree."""
        a, b = self.share
        stack = [(level, rows[k : k + STEP], nodes[k : k + STEP]) for level, rows, nodes in self.roots for k in range(0, len(rows), STEP)]
        while stack:
            level, r, v = stack.pop()
            node = self.levels[level]
            keep = np.flatnonzero((node["last"][v] > r) & (node["low"][v] <= self.limit[r]))
            r, v = r[keep], v[keep]
            m = self.sizes[r]
            need = np.where(m > _TOP, 0, -(-a * (m + np.maximum(m, node["low"][v])) // (a + b)))
            open_ = np.flatnonzero(_minima(self.points[r], node["upper"][v]) >= need)
            r, v = r[open_], v[open_]
            n = node["n"][v]
            for part in _parts(n, STEP):
                i = np.repeat(r[part], n[part])
                below = node["child"][np.repeat(node["first"][v[part]], n[part]) + _ramp(n[part])]
                if level:
                    stack.append((level - 1, i, below))
                    continue
                fits = np.flatnonzero((below > i) & (self.sizes[below] <= self.limit[i]))
                i, j = i[fits], below[fits]
                good = self._alike(i, j)
                if len(good):
                    yield i[good], j[good]

    def _alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The numbers of the pairs that can be similar enough: by how many words can follow the common one, and by the summed
        minima of their own counts."""
        a, b = self.share
        m, n = self.sizes[i], self.sizes[j]
        need = -(-a * (m + n) // (a + b))
        keep = np.flatnonzero(np.minimum(m - self.ranks[i], n - self.ranks[j]) >= need)
        i, j = i[keep], j[keep]
        return keep[(_minima(self.points[i], self.points[j]) >= need[keep]) | ((m[keep] > _TOP) & (n[keep] > _TOP))]


def _minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed minima of the coordinates of each row of x with that of y."""
    return np.minimum(x, y).sum(axis=1, dtype=np.uint16 if x.dtype == np.uint8 else np.int64)


def _few(mask: np.ndarray) -> np.ndarray:
    """The flat places that are true, found faster where few are."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64) != 0)
    at = np.flatnonzero(flat.reshape(-1, 8)[some])
    return some[at >> 3] * 8 + (at & 7)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each count, one behind the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _parts(counts: np.ndarray, most: int) -> list[slice]:
    """Slices of neighbours whose counts sum to about `most`."""
    if not len(counts):
        return []
    edges = np.searchsorted(np.cumsum(counts), np.arange(most, int(counts.sum()), most), side="left") + 1
    edges = np.unique(np.concatenate([[0], edges, [len(counts)]]))
    return [slice(int(x), int(y)) for x, y in zip(edges[:-1], edges[1:])]


def bounded_pairs(tree: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, points: np.ndarray, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of one tree that can be similar enough."""
    return Forest(tree, sizes, ranks, points, share).pairs()


class TextClasses:
    """The classes of some whole texts: their words, coded so that rarer words of a text have smaller codes."""

    def __init__(self, text: np.ndarray, hashes: list[np.ndarray], share: tuple[int, int]):
        self.share, self.sizes = share, np.array([len(h) for h in hashes], dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(hashes)), self.sizes)
        self.points = points_of(flat, owner, len(hashes))
        names, codes, counts = np.unique(flat ^ (text * _MIX)[owner], return_inverse=True, return_counts=True)
        order = np.argsort(counts, kind="stable")
        code = np.empty(len(names), dtype=np.uint64)
        code[order] = np.arange(len(names), dtype=np.uint64)
        packed = (owner.astype(np.uint64) << np.uint64(32)) | code[codes]
        packed.sort()
        self.codes, self.often = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), counts[order]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Classes (i, j) of one text that are similar enough, each pair once."""
        a, b = self.share
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(owner)) - self.ends[:-1][owner]
        first = np.flatnonzero((place < (self.sizes - -(-a * self.sizes // b) + 1)[owner]) & (self.often[self.codes] > 1))
        tree, row, rank = self.codes[first], owner[first], place[first]
        order = np.lexsort((self.sizes[row], tree))
        tree, row, rank = tree[order], row[order], rank[order]
        held, waiting = [], 0
        for i, j in bounded_pairs(tree, self.sizes[row], rank, self.points[row], self.share):
            held.append((row[i], row[j], tree[i]))
            waiting += len(i)
            if waiting > 20 * STEP:
                yield from self._verified(*map(np.concatenate, zip(*held)))
                held, waiting = [], 0
        if held:
            yield from self._verified(*map(np.concatenate, zip(*held)))

    def _verified(self, i: np.ndarray, j: np.ndarray, tree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The similar pairs among candidates. A pair counts only from the tree of its first common word, so that pairs found
        in several trees come once, although not all candidates are held at the same time."""
        a, b = self.share
        i, j = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((tree, j, i))
        i, j, tree = i[order], j[order], tree[order]
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        i, j, tree = i[new], j[new], tree[new]
        m, n = self.sizes[i], self.sizes[j]
        for part in _parts(m + n, 10 * STEP):
            x, y, sx, sy = i[part], j[part], m[part], n[part]
            number = np.arange(len(x), dtype=np.uint64) << np.uint64(32)
            of = lambda z, s: np.repeat(number, s) | self.codes[np.repeat(self.ends[z], s) + _ramp(s)].astype(np.uint64)
            both = np.concatenate([of(x, sx), of(y, sy)])
            both.sort()
            common = both[1:][both[1:] == both[:-1]]
            pair = (common >> np.uint64(32)).astype(np.int64)
            shared = np.bincount(pair, minlength=len(x))
            smallest = np.full(len(x), -1, dtype=np.int64)
            smallest[pair[::-1]] = (common[::-1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            good = (shared * (a + b) >= a * (sx + sy)) & (smallest == tree[part])
            if good.any():
                yield x[good], y[good]


def whole_texts(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """Tables of at least `least` rows (the last may be smaller) that end where `column`, by which rows are sorted, changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < least:
            continue
        part = pa.Table.from_batches(held).combine_chunks()
        value = part.column(column).to_numpy()
        other = np.flatnonzero(value != value[-1])
        if len(other):
            yield part.slice(0, int(other[-1]) + 1)
            part = part.slice(int(other[-1]) + 1)
        held = part.to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _compare_texts(share: tuple[int, int], least_words: int, expand: bool, chunk: int):
    """For rows (th, id, c) sorted by text: id pairs, or one row for each id with its class and its number of links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_texts(batches, "th", chunk):
            texts, ids = part.column("th").to_numpy().view(np.uint64), part.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")  # so that a class's members come sorted, its representative first
            known: dict[tuple[int, str], int] = {}
            hashes, text, member, of = [], [], [], []
            contexts = part.column("c").to_pylist()
            for r in order.tolist():
                key = (int(texts[r]), contexts[r])
                k = known.get(key)
                if k is None:
                    h = word_hashes(contexts[r])
                    k = known[key] = len(hashes) if len(h) >= least_words else -1
                    if k >= 0:
                        hashes.append(h)
                        text.append(texts[r])
                if k >= 0:
                    member.append(ids[r])
                    of.append(k)
            if not hashes:
                continue
            of = np.array(of)
            by = np.argsort(of, kind="stable")
            of, member = of[by], np.array(member)[by]
            once = np.concatenate([[True], (of[1:] != of[:-1]) | (member[1:] != member[:-1])])
            of, member = of[once], member[once]
            n = np.bincount(of, minlength=len(hashes))
            begin = np.cumsum(n) - n
            links, rows = n - 1, np.arange(len(hashes))
            inner = np.flatnonzero(n > 1)
            found = chain(TextClasses(np.array(text, dtype=np.uint64), hashes, share).pairs(), [(inner, inner)] if expand and len(inner) else [])
            for i, j in found:
                if not expand:
                    links = links + np.bincount(i, weights=n[j], minlength=len(rows)).astype(np.int64) + np.bincount(j, weights=n[i], minlength=len(rows)).astype(np.int64)
                    continue
                yield from _id_pairs(i, j, (n, begin, member), (n, begin, member), i is j)
            if not expand:
                yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(member[begin[of]]), pa.array(links[of])], names=["id", "class_id", "links"])

    return compare


def _id_pairs(i: np.ndarray, j: np.ndarray, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], same: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of ids of classes i and j; left and right: how many members each class has, where they begin, and all members.
    same: i and j are the same classes, of which each pair of members is wanted once."""
    (n, begin, member), (n2, begin2, member2) = left, right
    # row by row of the first class, so that what is made at once has a bound
    row = np.repeat(i, n[i])
    x, y = begin[row] + _ramp(n[i]), np.repeat(j, n[i])
    for piece in _parts(n2[y], 5 * STEP):
        size = n2[y[piece]]
        u, w = member[np.repeat(x[piece], size)], member2[np.repeat(begin2[y[piece]], size) + _ramp(size)]
        keep = (u < w) if same else (u != w)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, w)[keep]), pa.array(np.maximum(u, w)[keep])], names=["a", "b"])


def _stored_blocks(least_words: int):
    """For rows (block, id, c) sorted by block: the classes of each block in rows of at most ROW classes, with the number of the
    first one, the words of all of them, how many each has, their members, and how many each has."""

    def rows_of(block: int, ids: list[np.ndarray], of: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        member, of = np.concatenate(ids), np.concatenate(of)
        order = np.lexsort((member, of))
        member, of = member[order], of[order]
        once = (of >= 0) & np.concatenate([[True], (of[1:] != of[:-1]) | (member[1:] != member[:-1])])
        member, n = member[once], np.bincount(of[once], minlength=len(hashes))
        ends = np.concatenate([[0], np.cumsum(n)])
        for k in range(0, len(hashes), ROW):
            some = hashes[k : k + ROW]
            lists = [np.concatenate(some).view(np.int64), np.array([len(h) for h in some], dtype=np.int32), member[ends[k] : ends[k + len(some)]], n[k : k + ROW].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([k], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists)], names=["block", "first", "words", "sizes", "ids", "copies"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, ids, of, hashes = None, {}, [], [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else []
            for low, high in zip(edges[:-1], edges[1:]):
                if blocks[low] != now:
                    yield from rows_of(now, ids, of, hashes)
                    now, known, ids, of, hashes = int(blocks[low]), {}, [], [], []
                part = batch.slice(low, high - low)
                found = []
                for c in part.column("c").to_pylist():
                    k = known.get(c)
                    if k is None:
                        h = word_hashes(c)
                        k = known[c] = len(hashes) if len(h) >= least_words else -1
                        if k >= 0:
                            hashes.append(h)
                    found.append(k)
                ids.append(part.column("id").to_numpy())
                of.append(np.array(found, dtype=np.int64))
        yield from rows_of(now, ids, of, hashes)

    return classes


def parities_of(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whether the counts of BITS groups are odd, as the bits of a row of words for each of `n` records. Two records differ in at
    least as many words as in such bits."""
    counts = np.bincount(owner * BITS + ((flat >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64), minlength=n * BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, BITS), axis=1).view(np.uint64)


class Block:
    """The classes of a stored block by size, and the count-vector R-tree over them: leaves of TILE rows, then nodes of FAN."""

    def __init__(self, number: int, first: np.ndarray, words: list[np.ndarray], sizes: list[np.ndarray], ids: list[np.ndarray], copies: list[np.ndarray]):
        flat, size, self.members, n = (np.concatenate([x[k] for k in np.argsort(first)]) if x else np.empty(0, dtype=np.int64) for x in (words, sizes, ids, copies))
        order = np.argsort(size, kind="stable")
        self.number, self.place, self.sizes, self.n = number, order, size[order].astype(np.int64), n[order].astype(np.int64)
        self.begin = (np.cumsum(n, dtype=np.int64) - n)[order]
        self.words = flat.view(np.uint64)[np.repeat((np.cumsum(size, dtype=np.int64) - size)[order], self.sizes) + _ramp(self.sizes)]
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        owner = np.repeat(np.arange(len(order)), self.sizes)
        self.points = points_of(self.words, owner, len(order))
        fine = [np.empty((0, BITS // 64), dtype=np.uint64)]
        for k in range(0, len(order), 4_000):
            m = min(len(order), k + 4_000)
            part = slice(self.ends[k], self.ends[m])
            fine.append(parities_of(self.words[part], owner[part] - k, m - k))
        bits = np.ascontiguousarray(np.concatenate(fine).T)
        self.parities = {len(bits): bits}  # by number of words; two halves laid on each other are the parities of coarser groups
        while len(bits) > 1:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
            self.parities[len(bits)] = bits
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # upper corner, smallest and largest size of the nodes
        upper, low, high, fan = self.points, self.sizes, self.sizes, TILE
        while len(low) and (not self.levels or len(low) > 1):
            at = np.arange(0, len(low), fan)
            upper, low, high, fan = np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), FAN
            self.levels.append((upper, low, high))

    def below(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The first child of nodes of a level and how many they have; above its root the tree goes on as it is."""
        if level >= len(self.levels):
            return nodes, np.ones_like(nodes)
        return nodes * FAN, np.minimum(FAN, len(self.levels[level - 1][1]) - nodes * FAN)


def read_block(path: str, number: int) -> Block:
    """A block from the folder that `stored_by` gave; one without any class has no folder."""
    system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{base}/block={number}", allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.ParquetFile(system.open_input_file(f)).read(["first", "words", "sizes", "ids", "copies"]) for f in files]
    first = np.concatenate([t.column("first").to_numpy() for t in tables]) if tables else np.empty(0, dtype=np.int32)
    return Block(number, first, *([x.values.to_numpy() for t in tables for x in t.column(c)] for c in ("words", "sizes", "ids", "copies")))


class Join:
    """The similar classes of two blocks, or of one with itself if both are the same object."""

    def __init__(self, x: Block, y: Block, share: tuple[int, int]):
        self.x, self.y, self.share = x, y, share

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of both trees that can hold similar classes, two of one tree once."""
        x, y, (a, b) = self.x, self.y, self.share
        top = max(len(x.levels), len(y.levels)) - 1
        i = j = np.zeros(1 if x.levels and y.levels else 0, dtype=np.int64)
        for level in range(top, -1, -1):
            (ux, lx, hx), (uy, ly, hy) = (z.levels[min(level, len(z.levels) - 1)] if z.levels else (z.points, z.sizes, z.sizes) for z in (x, y))
            keep = np.flatnonzero((hx[i] * b >= ly[j] * a) & (hy[j] * b >= lx[i] * a) & ((j >= i) | (x is not y)))
            i, j = i[keep], j[keep]
            need = np.where(np.minimum(hx[i], hy[j]) > _TOP, 0, -(-a * (lx[i] + ly[j]) // (a + b)))
            open_ = [np.flatnonzero(_minima(ux[i[k : k + STEP]], uy[j[k : k + STEP]]) >= need[k : k + STEP]) + k for k in range(0, len(i), STEP)]
            keep = np.concatenate(open_) if open_ else keep
            i, j = i[keep], j[keep]
            if level:
                (fi, ni), (fj, nj) = x.below(i, level), y.below(j, level)
                pair, at = np.repeat(np.arange(len(i)), ni * nj), _ramp(ni * nj)
                i, j = fi[pair] + at // nj[pair], fj[pair] + at % nj[pair]
        return i, j

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows whose counts let them be similar. Leaves of y beside each other are compared with one of x at once."""
        x, y, (a, b) = self.x, self.y, self.share
        i, j = self.leaves()
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1] + 1) | (j[1:] % TILE == 0)])) if len(i) else i
        held, waiting = [], 0
        for k, m in zip(begins.tolist(), [*begins[1:].tolist(), len(i)]):
            rows = slice(int(i[k]) * TILE, min((int(i[k]) + 1) * TILE, len(x.sizes)))
            columns = slice(int(j[k]) * TILE, min((int(j[m - 1]) + 1) * TILE, len(y.sizes)))
            most = int(x.sizes[rows.stop - 1] + y.sizes[columns.stop - 1]) * (b - a) // (a + b)
            parts = next((n for n in sorted(x.parities) if most <= 24 * n), max(x.parities))
            p, q = x.parities[parts], y.parities[parts]
            apart = np.bitwise_count(p[0, rows, None] ^ q[0, None, columns])
            for n in range(1, parts):
                apart = np.add(apart, np.bitwise_count(p[n, rows, None] ^ q[n, None, columns]), dtype=np.uint16)
            at = _few(apart <= most)
            held.append((at // apart.shape[1] + rows.start, at % apart.shape[1] + columns.start))
            waiting += len(at)
            if waiting > STEP:
                yield self._alike(*map(np.concatenate, zip(*held)))
                held, waiting = [], 0
        if held:
            yield self._alike(*map(np.concatenate, zip(*held)))

    def _alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that parities of finer groups and the summed minima of their own counts let pass."""
        x, y, (a, b) = self.x, self.y, self.share
        if x is y:
            i, j = i[i < j], j[i < j]
        for parts in sorted(x.parities)[1:]:
            m = x.sizes[i] + y.sizes[j]
            keep = np.flatnonzero(sum(np.bitwise_count(p[i] ^ q[j]).astype(np.int64) for p, q in zip(x.parities[parts], y.parities[parts])) <= m + 2 * (-a * m // (a + b)))
            i, j = i[keep], j[keep]
        need = -(-a * (x.sizes[i] + y.sizes[j]) // (a + b))
        keep = np.flatnonzero((_minima(x.points[i], y.points[j]) >= need) | (np.minimum(x.sizes[i], y.sizes[j]) > _TOP))
        return i[keep], j[keep]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) that are similar by their words, each pair once."""
        x, y, (a, b) = self.x, self.y, self.share
        for i, j in self.candidates():
            for part in _parts(x.sizes[i] + y.sizes[j], 10 * STEP):
                u, v = i[part], j[part]
                number = np.arange(len(u), dtype=np.uint64) << np.uint64(32)
                of = lambda z, r: z.words[np.repeat(z.ends[r], z.sizes[r]) + _ramp(z.sizes[r])]
                codes = np.unique(np.concatenate([of(x, u), of(y, v)]), return_inverse=True)[1].astype(np.uint64)
                both = np.concatenate([np.repeat(number, x.sizes[u]), np.repeat(number, y.sizes[v])]) | codes
                both.sort()
                common = (both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64)
                good = np.bincount(common, minlength=len(u)) * (a + b) >= a * (x.sizes[u] + y.sizes[v])
                if good.any():
                    yield u[good], v[good]


def _compare_blocks(path: str, begin: list[int], base: list[int], blocks: list[int], share: tuple[int, int], expand: bool):
    """For the numbers of pairs of blocks: id pairs, or the classes of them that have similar ones with how many rows these have.
    A text has its pairs from `begin` on and its blocks from `base` on."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Block(-1, np.empty(0), [], [], [], [])
        for number in chain.from_iterable(batch.column(0).to_pylist() for batch in batches):
            text = bisect_right(begin, number) - 1
            row, column = _cell(number - begin[text], blocks[text])
            if x.number != base[text] + row:
                x = read_block(path, base[text] + row)
            y = x if row == column else read_block(path, base[text] + column)
            more_x, more_y = np.zeros(len(x.n), dtype=np.int64), np.zeros(len(y.n), dtype=np.int64)
            left, right = (x.n, x.begin, x.members), (y.n, y.begin, y.members)
            for i, j in Join(x, y, share).pairs():
                if expand:
                    yield from _id_pairs(i, j, left, right, False)
                else:
                    np.add.at(more_x, i, y.n[j])
                    np.add.at(more_y, j, x.n[i])
            if expand and x is y:
                inner = np.flatnonzero(x.n > 1)
                yield from _id_pairs(inner, inner, left, left, True)
            if not expand:
                for z, more in ((x, more_x), (y, more_y)):
                    at = np.flatnonzero(more)
                    yield pa.RecordBatch.from_arrays([pa.array(z.place[at] + (z.number << 32)), pa.array(more[at])], names=["class", "more"])

    return compare


def _cell(number: int, blocks: int) -> tuple[int, int]:
    """The row and column of a cell, row by row in the upper triangle with its diagonal."""
    back = blocks * (blocks + 1) // 2 - 1 - number  # counted from the end, the rows are 1, 2, 3 ... long
    row = (isqrt(8 * back + 1) - 1) // 2
    return blocks - 1 - row, blocks - 1 - (back - row * (row + 1) // 2)


def _class_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, id, class_id, n) of stored rows of blocks."""
    for batch in batches:
        for block, first, ids, copies in zip(*(batch.column(c) for c in ("block", "first", "ids", "copies"))):
            member, n = ids.values.to_numpy(), copies.values.to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([pa.array((block.as_py() << 32) + first.as_py() + of), pa.array(member), pa.array(member[(np.cumsum(n) - n)[of]]), pa.array(n[of])], names=["class", "id", "class_id", "n"])


def _spread_texts(rows: DataFrame, large: list[tuple[int, int, int]], share: tuple[int, int], least_words: int, expand: bool) -> DataFrame:
    """(a, b), or (id, class_id, links), of the rows (block, id, c) of texts too large for a task; of each text its first block
    and how many it has."""
    spark = rows.sparkSession
    path = stored_by(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_stored_blocks(least_words), _STORED), "block")
    base, blocks = [t[1] for t in large], [t[2] for t in large]
    *begin, cells = accumulate((k * (k + 1) // 2 for k in blocks), initial=0)
    tasks = min(cells, max(8 * spark.sparkContext.defaultParallelism, cells // 4))
    compare = _compare_blocks(path, begin, base, blocks, share, expand)
    numbers = spark.range(0, cells, 1, tasks)
    if expand:
        return numbers.mapInArrow(compare, "a bigint, b bigint")
    more = numbers.mapInArrow(compare, "class bigint, more bigint").groupBy("class").agg(F.sum("more").alias("more"))
    members = spark.read.schema(_STORED).parquet(path).select("block", "first", "ids", "copies").mapInArrow(_class_members, "class bigint, id bigint, class_id bigint, n bigint")
    return members.join(more, "class", "left").select("id", "class_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))


def _texts(df: DataFrame, key: str, text: str, context: str, local: int, shard_rows: int) -> tuple[DataFrame, DataFrame | None, list[tuple[int, int, int]]]:
    """Rows (th, id, c) of texts with at most `local` rows, rows (block, id, c) of other texts if there are any, and of these the
    text, its first block and how many it has."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.lower(F.trim(text))).alias("th"), F.col(context).alias("c"), F.col(text).isNotNull().alias("has"))
    rows = rows.where("has and c is not null and id is not null").drop("has")
    held = sorted((r["th"], -(-r["n"] // shard_rows)) for r in rows.groupBy("th").agg(F.count("*").alias("n")).where(F.col("n") > local).collect())  # one of `local` rows at most
    if not held:
        return rows, None, []
    large = [(th, base, k) for (th, k), base in zip(held, accumulate((k for _, k in held), initial=0))]
    known = F.broadcast(df.sparkSession.createDataFrame(large, "th bigint, base int, k int"))
    dealt = rows.join(known, "th").select((F.col("base") + F.pmod(F.xxhash64("c"), F.col("k"))).cast("int").alias("block"), "id", "c")
    return rows.join(known, "th", "left_anti"), dealt, large


def _similar(df: DataFrame, key: str, text: str, context: str, share: tuple[int, int], least_words: int, local: int, shard_rows: int, expand: bool) -> DataFrame:
    small, dealt, large = _texts(df, key, text, context, local, shard_rows)
    found = small.repartition("th").sortWithinPartitions("th").mapInArrow(_compare_texts(share, least_words, expand, min(CHUNK, local)), "a bigint, b bigint" if expand else "id bigint, class_id bigint, links bigint")
    return found if dealt is None else found.unionByName(_spread_texts(dealt, large, share, least_words, expand))


def similar_pairs(df: DataFrame, key: str, text: str, context: str, share: tuple[int, int] = (7, 10), least_words: int = 30, local: int = LOCAL, shard_rows: int = SHARD) -> DataFrame:
    """(a, b), a < b: the rows with equal trimmed, lower-cased `text` whose distinct words of `context` have a Jaccard
    similarity of at least share[0] / share[1], both with at least `least_words` distinct words.

    Rows with a null id, text or context or fewer words have no partners; rows with equal context are partners; repeated rows
    count once; other columns are ignored; an empty table gives no rows. Nothing is capped. `local` and `shard_rows` say how
    many rows of a text a task may hold, or of a block of a larger text; they change no result.
    """
    return _similar(df, key, text, context, share, least_words, local, shard_rows, True)


def similar_counts(df: DataFrame, key: str, text: str, context: str, share: tuple[int, int] = (7, 10), least_words: int = 30, local: int = LOCAL, shard_rows: int = SHARD) -> DataFrame:
    """(id, class_id, links): each row that can have partners, the smallest id with its text and context, and how many rows
    `similar_pairs` pairs it with. Copies are never expanded into pairs. Nulls, repeats and empty tables as there."""
    return _similar(df, key, text, context, share, least_words, local, shard_rows, False)
