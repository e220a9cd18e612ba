"""Problem 3: text that looks the same but is made of other characters.

A column is one array of code points. A lookup table says of each code point what it stands for (nothing, another one, or
several); the output is made by gathers and expansion offsets. Look-alike letters change only inside words that also hold
Latin letters. Then letters with marks are taken apart, the marks put in canonical order, and both composed by a second lookup,
for all letters at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codepoints import from_codes, only_rows, row_of, rows_with, to_codes
from tidemark.llm.counts import MOST_SENT, with_decisions
from tidemark.llm.garbled import EDGES, span_mask, wrong_words

# Letters of other scripts and phonetic letters, with the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ϲ": "c", "ϳ": "j", "γ": "y", "η": "n", "τ": "t", "ω": "w", "χ": "x", "ε": "e",
    "ɡ": "g", "ɑ": "a", "ı": "i", "ӕ": "æ", "Ӕ": "Æ", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
}
# Characters that show nothing (the default-ignorable ranges of Unicode), and blanks other than U+0020 and line breaks.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF0, 0xFFF9), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000)]
BLANKS = [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
TOP = 0xE1000
SCRIPTS = 0x20000  # letters from here on are ideographs and have no Latin form


@lru_cache
def tables() -> dict[str, np.ndarray]:
    """For each code point: how many it becomes, where these begin in the pool, what class it has, its Latin look-alike."""
    count = np.ones(TOP, dtype=np.int64)
    first = np.arange(TOP, dtype=np.int64)
    pool = list(range(TOP))
    stands = np.zeros(TOP, dtype=bool)
    for c in INVISIBLE:
        count[c], stands[c] = 0, True
    for c in BLANKS:
        first[c], stands[c] = 0x20, True
    for c in range(0x80, SCRIPTS):
        form = unicodedata.decomposition(chr(c))
        if form.startswith(("<wide>", "<font>", "<compat>")) and (plain := unicodedata.normalize("NFKC", chr(c))).isalnum() and (form.startswith("<font>") or not 0x2100 <= c < 0x2190) or 0xFF01 <= c <= 0xFF5E:
            plain = unicodedata.normalize("NFKC", chr(c))
            stands[c] = plain.isalnum() and (c >= 0xFB00 or form.startswith("<font>")) and not 0xFE70 <= c <= 0xFEFC
            if stands[c] or 0xFF01 <= c <= 0xFF5E:
                first[c], count[c] = len(pool), len(plain)
                pool += map(ord, plain)
    for c, plain in ((0x212A, 0x4B), (0x212B, 0xC5)):  # Kelvin and Angstrom: letters by definition
        first[c], stands[c] = plain, True
    letter = np.zeros(TOP, dtype=np.int8)  # 1 Latin, 2 another script
    for c in range(0x41, SCRIPTS):
        if chr(c).isalpha():
            letter[c] = 1 if unicodedata.name(chr(c), "").startswith(("LATIN", "FULLWIDTH LATIN")) else 2
    alike = np.zeros(TOP, dtype=np.int64)
    for odd, latin in LOOKALIKES.items():
        if len(odd) == 1:
            alike[ord(odd)], letter[ord(odd)] = ord(latin), 2
    mark = np.zeros(TOP, dtype=np.int64)
    mark[0x300:0x370] = np.arange(1, 0x71)
    rank = np.zeros(0x370, dtype=np.int64)
    rank[0x300:] = [unicodedata.combining(chr(c)) for c in range(0x300, 0x370)]
    apart, begin = np.ones(0x2000, dtype=np.int64), np.arange(0x2000, dtype=np.int64)
    for c in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and all(0x300 <= ord(p) < 0x370 for p in parts[1:]):
            apart[c], begin[c] = len(parts), len(pool)
            pool += map(ord, parts)
    return {"rank": rank, "apart": apart, "begin": begin, "count": count, "first": first, "pool": np.array(pool, dtype=np.uint32), "stands": stands, "letter": letter, "alike": alike, "mark": mark}


@lru_cache
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys letter * 2^21 + mark, and the composed letters."""
    keys, made = [], []
    for c in range(0xC0, 0x2000):
        form = unicodedata.decomposition(chr(c))
        if form and not form.startswith("<") and len(parts := [int(x, 16) for x in form.split()]) == 2 and unicodedata.normalize("NFC", chr(c)) == chr(c):
            keys.append((parts[0] << 21) + parts[1])
            made.append(c)
    order = np.argsort(keys)
    return np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.uint32)[order]


def in_latin_word(codes: np.ndarray, offsets: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Which code points are look-alikes in a run of letters (marks and invisible characters included) with a Latin letter."""
    low = np.minimum(codes, TOP - 1)
    kind = t["letter"][low]
    inner = (kind > 0) | (t["mark"][low] > 0) | (t["count"][low] == 0)
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[offsets] = True
    new = inner & (np.concatenate([[True], ~inner[:-1]]) | begins[:-1])
    word = np.cumsum(new)
    latin = np.bincount(word[inner & (kind == 1)], minlength=int(word[-1]) + 1 if len(word) else 1) > 0
    return (t["alike"][low] > 0) & inner & latin[word]


def in_emoji(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which invisible characters belong to an emoji: joiners, variation selectors and tags directly behind a pictograph."""
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[offsets] = True
    held = (codes == 0x200D) | (codes == 0xFE0E) | (codes == 0xFE0F) | (codes >= 0xE0020) & (codes <= 0xE007F)
    at = np.where(held & ~begins[:-1], 0, np.arange(len(codes)))
    base = codes[np.maximum.accumulate(at)]  # the character before a run of them
    keycap = np.isin(base, [0x23, 0x2A, *range(0x30, 0x3A)]) & (np.concatenate([codes[1:], [0]]) == 0x20E3)
    sign = (base >= 0x2190) & (base < 0x3300) | (base >= 0x1F000) & (base < 0x20000) | np.isin(base, [0xA9, 0xAE, 0x203C, 0x2049, 0x2122, 0x2139])
    return held & ~begins[:-1] & (sign | keycap)


def ordinary_forms(codes: np.ndarray, offsets: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes in one consistent form, their offsets, and which rows held a character that stands for another; positions
    in `skip` (garbled text) stay and do not count."""
    t = tables()
    hit = np.zeros(len(offsets) - 1, dtype=bool)
    if not len(codes):
        return codes, offsets, hit
    low = np.minimum(codes, TOP - 1).astype(np.int64)
    far = codes >= TOP
    free = ~skip & ~far
    joiner = in_emoji(codes, offsets)
    stands = t["stands"][low] & free & ~joiner
    alike = in_latin_word(codes, offsets, t) & free
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[offsets] = True
    accent = (t["mark"][low] > 0) & free & np.concatenate([[False], t["letter"][low[:-1]] > 0]) & ~begins[:-1]
    hit[row_of(offsets, np.flatnonzero(stands | alike | accent))] = True
    change = free & ~joiner
    count = np.where(change, t["count"][low], 1)
    first = np.where(alike, t["alike"][low], np.where(change, t["first"][low], low))
    ends = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(np.arange(len(codes)), count)
    out = t["pool"][first[source] + np.arange(ends[-1]) - ends[source]]
    out[far[source]] = codes[source][far[source]]
    return *_composed_rows(out, ends[offsets]), hit


def _composed_rows(out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, those that hold a separate mark composed."""
    rows = rows_with((out >= 0x300) & (out < 0x370), offsets)
    if not len(rows):
        return out, offsets
    part, ends = composed(*only_rows(out, offsets, rows))
    size = np.diff(offsets)
    size[rows] = np.diff(ends)
    made = np.concatenate([[0], np.cumsum(size)])
    begin = offsets[:-1].copy()
    begin[rows] = len(out) + ends[:-1]
    source = np.concatenate([out, part])
    return source[np.repeat(begin - made[:-1], size) + np.arange(made[-1])], made


def composed(out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes with every letter and the marks behind it in canonical composition, and their offsets."""
    t = tables()
    begins = np.zeros(len(out) + 1, dtype=bool)
    begins[offsets] = True
    marked = (out >= 0x300) & (out < 0x370) & ~begins[:-1]
    if not marked.any():
        return out, offsets
    # letters before a mark are taken apart, so that all their marks can be ordered
    count = np.where(np.concatenate([marked[1:], [False]]) & (out < 0x2000), t["apart"][np.minimum(out, 0x1FFF)], 1)
    ends = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(np.arange(len(out)), count)
    inner = np.arange(ends[-1]) - ends[source]
    out = np.where(count[source] > 1, t["pool"][np.where(count[source] > 1, t["begin"][np.minimum(out, 0x1FFF)][source] + inner, 0)], out[source]).astype(np.uint32)
    marked, offsets = marked[source] | (inner > 0), ends[offsets]
    rank = np.where(marked, t["rank"][np.minimum(out, 0x36F)], 0)
    at = np.flatnonzero(rank > 0)
    run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) if len(at) else at
    out[at] = out[at][np.lexsort((rank[at], run))]
    rank[at] = t["rank"][out[at]]
    # the base of a run of marks, and the run's length
    first = np.flatnonzero(marked & ~np.concatenate([[False], marked[:-1]]))
    size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], np.diff(np.flatnonzero(marked)) > 1])), int(marked.sum())))
    base, last = first - 1, np.zeros(len(first), dtype=np.int64)
    keep = np.ones(len(out), dtype=bool)
    keys, made = compositions()
    for j in range(int(size.max())):
        live = np.flatnonzero(size > j)
        place = first[live] + j
        key = (out[base[live]].astype(np.int64) << 21) + out[place]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        fits = (keys[found] == key) & (last[live] < rank[place])  # a mark of the same rank between them blocks
        out[base[live[fits]]] = made[found[fits]]
        keep[place[fits]] = False
        last[live[~fits]] = rank[place[~fits]]
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def odd_words(codes: np.ndarray, offsets: np.ndarray, skip: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(word without punctuation at its edges, row, begin, end) of the words with a sign that may be another encoding's and
    more than one character beyond ASCII: such a word decides whether all of it is garbled."""
    odd = np.flatnonzero(tables()["stands"][np.minimum(codes, TOP - 1)] & (codes >= 0x80) & ((codes < 0x100) | (codes >= 0xFB00) & (codes < 0xFB07)) & ~skip)
    if not len(odd):
        return pa.array([], pa.string()), odd, odd, odd
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[offsets] = True
    inner = codes > 0x20
    begin = np.flatnonzero(inner & (edge[:-1] | np.concatenate([[True], ~inner[:-1]])))
    end = np.flatnonzero(inner & (edge[1:] | np.concatenate([~inner[1:], [True]]))) + 1
    number = np.searchsorted(begin, np.flatnonzero(inner & (codes > 0x7F)), side="right") - 1
    held = np.unique(np.searchsorted(begin, odd, side="right") - 1)
    held = held[np.bincount(number, minlength=len(begin))[held] > 1]
    begin, end = begin[held], end[held]
    size = end - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    words = from_codes(codes[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends)
    return pc.utf8_trim(words, characters=EDGES), row_of(offsets, begin), begin, end


def consistent_text(df: DataFrame, key: str, text: str, most_sent: int = MOST_SENT) -> DataFrame:
    """(key, normal, changed): every row's text in one consistent form, and whether it held a character standing for another.

    Null stays null and is not changed; an empty text stays empty. Garbled stretches of a wrong encoding are left alone.
    Other columns are ignored; repeated rows come out as often as they went in.
    """
    kind = df.schema[key].dataType.simpleString()

    def needed(batch: pa.RecordBatch) -> list[set[str]]:
        codes, offsets = to_codes(batch.column("t"))
        items: list[set[str]] = [set() for _ in range(len(batch))]
        words, rows, _, _ = odd_words(codes, offsets, span_mask(codes, offsets))
        for w, r in zip(words.to_pylist(), rows.tolist()):
            items[r].add(w)
        return items

    def normalise(batch: pa.RecordBatch, known: Callable[[int], dict[str, str]]) -> pa.RecordBatch:
        column = batch.column("t")
        codes, offsets = to_codes(column)
        held = rows_with((codes > 0x7F) | (codes == 9), offsets)  # nothing else can change
        codes, offsets = only_rows(codes, offsets, held)
        skip = span_mask(codes, offsets)
        words, rows, begin, end = odd_words(codes, offsets, skip)
        garbled = np.array([w in known(int(held[r])) for w, r in zip(words.to_pylist(), rows.tolist())], dtype=bool)
        edges = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(edges, begin[garbled], 1)
        np.add.at(edges, end[garbled], -1)
        out, ends, hit = ordinary_forms(codes, offsets, skip | (np.cumsum(edges)[:-1] > 0))
        place, changed = np.arange(len(column)), np.zeros(len(column), dtype=bool)
        place[held], changed[held] = len(column) + np.arange(len(held)), hit
        normal = pa.concat_arrays([pa.concat_arrays([column.cast(pa.string())]), from_codes(out, ends)]).take(pa.array(place))
        return pa.RecordBatch.from_arrays([batch.column("k"), normal, pa.array(changed)], names=[key, "normal", "changed"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return with_decisions(rows, wrong_words(df, [text]), needed, normalise, f"`{key}` {kind}, normal string, changed boolean", most_sent)
