"""Problem 6: text that was decoded with the wrong encoding.

Characters are mapped back to the bytes they had in a legacy encoding. Over these bytes an automaton of the structure of
UTF-8 finds maximal well-formed multibyte spans, all positions of a column at once. Sequences that sound text could hold by
chance count only beside another sequence or where the characters around them rule that out. Only those spans are decoded,
again and again until none is left (text may be garbled twice).

Single bytes read in the wrong single-byte encoding leave no such structure. They are found by word: a word with characters
that are letters only in another encoding, or one whose re-reading is far more frequent in the whole collection than the word
itself. The counts are exact and come from all distinct values, so that copies do not vote for their own damage; a word is judged
once for the whole collection.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.llm.codepoints import from_codes, row_of, to_codes
from tidemark.llm.counts import MOST_SENT, count_words, decided, with_decisions

#: Encodings in which UTF-8 bytes, or bytes of western Windows text, are found to have been read.
MULTIBYTE = ("cp1252", "mac_roman", "cp850", "cp437")
PASSES = (*((codec, False) for codec in MULTIBYTE), ("cp1252", True))
SINGLE_BYTE = ("mac_roman", "cp850")
_WORD = re.compile(r"[^\s]*[^\x00-\x7f\s][^\s]*")
EDGES = ".,;:!?()[]<>\"'"
# Letters and numbers that no English, French, German or Spanish word holds between small letters, each with
# the letters that may follow it there for all that: õ in Portuguese, þ (read for ç) in Icelandic.
_FOREIGN = {"õ": "e", "þ": "bcdefghijklmnpqrstvwxyzáéíóúýæöð", "³": "", "¹": "", "¾": "", "ˆ": ""}
# Signs that may stand behind a capital or an accented letter in sound text, and those that may join two words.
_BEHIND = "’‘”“»«›‹…–—™®©°¹²³ªº·•§¿¡\u00a0\u00ad"
_BETWEEN = "–—·•…\u00a0\u00ad"
_METRES = re.compile(r"(?:^|[^a-z])[cdkm]?m$")


@lru_cache
def legacy_bytes(codec: str) -> np.ndarray:
    """For each code point below U+10000 its byte in `codec`, 0 where it has none or is ASCII. Bytes that cp1252 leaves
    undefined, and C1 controls, stand for themselves, which covers latin-1 too."""
    table = np.zeros(0x10000, dtype=np.uint8)
    if codec == "cp1252":
        table[0x80:0x100] = np.arange(0x80, 0x100)
    for b in range(0x80, 0x100):
        char = bytes([b]).decode(codec, "ignore")
        if char:
            table[ord(char)] = b
    return table


@lru_cache
def _expected() -> np.ndarray:
    """What a sequence may decode to: 2 what filings often hold (western letters and signs, punctuation, Greek, Cyrillic, CJK,
    forms), 1 any other assigned character that shows something, 0 nothing else."""
    table = np.zeros(0x110000, dtype=np.int8)
    for c in range(0xA0, 0x30000):
        table[c] = unicodedata.category(chr(c)) not in ("Cc", "Cn", "Co", "Cs")
    for a, b in ((0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2DC), (0x300, 0x36F), (0x391, 0x3C9), (0x410, 0x44F), (0x2000, 0x206F), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x2190, 0x22FF), (0x2500, 0x25FF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xFB00, 0xFB06), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E), (0xFFFD, 0xFFFD), (0x1F300, 0x1FAFF)):
        table[a : b + 1] = 2
    return table


@lru_cache
def _signs(characters: str) -> np.ndarray:
    table = np.zeros(0x10000, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table


@lru_cache
def _small() -> np.ndarray:
    return np.array([chr(c).islower() for c in range(0x250)])


def multibyte_spans(codes: np.ndarray, offsets: np.ndarray, codec: str, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, code point) of each UTF-8 sequence among `codes` as read in `codec`; no sequence crosses rows. `wide`
    adds the characters that filings seldom hold, and single letters of extended Latin."""
    at = np.flatnonzero(codes > 0x7F)
    if not len(at):
        return at, at, at
    b = legacy_bytes(codec)[np.minimum(codes[at], 0xFFFF)].astype(np.int64)
    b[codes[at] > 0xFFFF] = 0
    row = row_of(offsets, at)
    joined = np.zeros(len(at) + 3, dtype=bool)  # the next high character stands directly behind, in the same row
    joined[: len(at) - 1] = (np.diff(at) == 1) & (row[1:] == row[:-1])
    pad = np.concatenate([b, [0, 0, 0]])
    n = len(at)
    tail = [pad[i : n + i] for i in range(4)]
    rest = [(tail[i] & 0xC0) == 0x80 for i in range(4)]
    one = joined[:n] & rest[1]
    two = one & joined[1 : n + 1] & rest[2]
    three = two & joined[2 : n + 2] & rest[3]
    length = np.where((b >= 0xC2) & (b <= 0xDF) & one, 2, np.where((b >= 0xE0) & (b <= 0xEF) & two, 3, np.where((b >= 0xF0) & (b <= 0xF4) & three, 4, 0)))
    low = [t & 0x3F for t in tail]
    point = np.select([length == 2, length == 3, length == 4], [((b & 0x1F) << 6) | low[1], ((b & 0x0F) << 12) | (low[1] << 6) | low[2], ((b & 0x07) << 18) | (low[1] << 12) | (low[2] << 6) | low[3]], 0)
    shortest = np.select([length == 3, length == 4], [0x800, 0x10000], 0x80)
    good = (length > 0) & (point >= shortest) & (point <= 0x10FFFF)
    kind = np.zeros(n, dtype=np.int8)
    kind[good] = _expected()[point[good]]
    good &= kind >= (1 if wide else 2)
    # what a lone pair of western characters could feign: only beside another such sequence, or where sound text has no such signs
    shy = good & ((kind == 1) | (point >= 0x3040) & (point <= 0x9FFF) | (point >= 0x410) & (point <= 0x44F) & (codec != "cp1252") | (point >= 0x100) & (point <= 0x13F))
    if shy.any():
        starts, ends = np.zeros(len(codes) + 5, dtype=bool), np.zeros(len(codes) + 5, dtype=bool)
        starts[at[good]] = ends[at[good] + length[good]] = True
        lone = shy & ~starts[at + length] & ~ends[at]
        latin = (point >= 0x100) & (point < 0x250) | (point >= 0x1E00) & (point < 0x1F00)
        last = codes[np.minimum(at + np.maximum(length, 1) - 1, len(codes) - 1)]
        behind = np.minimum(at + length, len(codes) - 1)
        small = (at + length < offsets[row + 1]) & _small()[np.minimum(codes[behind], 0x24F)] & (codes[behind] < 0x250)
        sign = np.minimum(last, 0xFFFF)
        allowed = latin & wide & (~_signs(_BEHIND)[sign] | small & ~_signs(_BETWEEN)[sign])
        good &= ~lone | allowed
    return at[good], length[good], point[good]


def decode_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes with all garbled spans decoded, the new offsets, and which rows held such a span."""
    hit = np.zeros(len(offsets) - 1, dtype=bool)
    changed = True
    while changed:  # each round shortens the text
        changed = False
        for codec, wide in PASSES:
            if wide and changed:
                break  # only where no usual character is left to decode
            start, length, point = multibyte_spans(codes, offsets, codec, wide)
            if not len(start):
                continue
            changed = True
            hit[row_of(offsets, start)] = True
            codes = codes.copy()
            keep = np.ones(len(codes), dtype=bool)
            codes[start] = point
            for k in (1, 2, 3):
                keep[(start + k)[length > k]] = False
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            codes = codes[keep]
    return codes, offsets, hit


def span_mask(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which code points belong to a garbled multibyte span."""
    mask = np.zeros(len(codes), dtype=bool)
    for codec, wide in PASSES:
        start, length, _ = multibyte_spans(codes, offsets, codec, wide)
        for k in range(4):
            mask[(start + k)[length > k]] = True
    return mask


def bare(word: str) -> str:
    """A word without punctuation at its edges."""
    return word.strip(EDGES)


def high_words(text: str | None) -> list[str]:
    """The words of a text that hold a character beyond ASCII."""
    return [w for w in map(bare, _WORD.findall(text)) if w] if text and not text.isascii() else []


@lru_cache
def _reread(codec: str) -> dict[int, str]:
    """Characters of `codec` beyond ASCII, and the western Windows character of the same byte."""
    table = {}
    for b in range(0x80, 0x100):
        char, western = bytes([b]).decode(codec, "ignore"), bytes([b]).decode("cp1252", "ignore")
        if char and western:
            table[ord(char)] = western
    return table


class WordJudge:
    """Decides for a word whether it was read in the wrong single-byte encoding, and what it was."""

    #: quotation marks that open and close
    PAIRS = (("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"))
    RATIO, LEAST = 4, 3

    @staticmethod
    def readings(word: str) -> list[str]:
        """What the word would be in the encodings whose characters it is made of."""
        high = [ord(c) for c in word if ord(c) > 0x7F]
        tables = [t for t in map(_reread, SINGLE_BYTE) if all(c in t for c in high)]
        return [other for other in (word.translate(t) for t in tables) if other != word]

    def asked(self, word: str) -> set[str]:
        """The words whose counts decide on a word; none if it has no other reading."""
        others = {bare(other) for other in self.readings(word)}
        return others | {word} if others else set()

    def original(self, word: str, counts: dict[str, int]) -> str | None:
        """The word as it was before, or None if it is sound."""
        best = None
        for other in self.readings(word):
            if any(c.isalpha() for c in bare(other)) or any(c.isalpha() for c in word):
                mine, its = counts.get(word, 0), counts.get(bare(other), 0)
                if its >= self.LEAST and its >= self.RATIO * mine and (best is None or its > best[0]):
                    best = (its, other)
            if best is None and self._quoted(word, other):
                best = (0, other)
            if best is None and len(word) > 2 and self._broken(word, other):
                best = (0, other)
        return best[1] if best else None

    def _quoted(self, word: str, other: str) -> bool:
        """The re-reading stands in quotation marks where the word has other signs."""
        return any(other.startswith(a) and other.rstrip(EDGES).endswith(b) and len(other) > 4 and word[0] != a for a, b in self.PAIRS)

    @staticmethod
    def _foreign(word: str, i: int) -> bool:
        """The character at i, between small letters or behind a first capital, belongs to no word of the languages of
        filings; exponents of units do."""
        following = word[i + 1 : i + 2]
        if not (word[i - 1].islower() or word[i - 1].isupper() and not word[: i - 1][-1:].isalpha()):
            return False
        unit = word[i] in "¹³" and not word[i + 2 : i + 3].isalpha() and _METRES.search(word[:i])
        return word[i] in _FOREIGN and following.islower() and following not in _FOREIGN[word[i]] and not unit

    @staticmethod
    def _broken(word: str, other: str) -> bool:
        """A capital with an accent, a sign, or a letter of no language of filings stands behind a small letter, and the
        re-reading has a small letter there."""
        for i, c in enumerate(word[: len(other)]):
            if ord(c) <= 0x7F or not i or i + 1 >= len(word) and not c.isupper():
                continue
            if word[i - 1].islower() and (i + 1 >= len(word) or word[i + 1].islower()) and (c.isupper() or not c.isalnum() and c not in "’‘-–­·" and c.isprintable()) and (other[i].islower() or other[i] == "’"):
                return True
            if other[i].islower() and WordJudge._foreign(word, i):
                return True
        return False


def wrong_words(df: DataFrame, columns: list[str]) -> DataFrame:
    """(item, result): the words of `columns` that were read in the wrong single-byte encoding, and what they were."""
    values = [df.select(F.col(c).alias("value")).where(F.octet_length("value") > F.length("value")) for c in columns]
    counts = stored(count_words(reduce(DataFrame.unionAll, values).distinct(), "value", high_words))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = WordJudge()
        for batch in batches:
            pairs = [(w, asked) for w in batch.column(0).to_pylist() for asked in judge.asked(w)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*pairs)], names=["item", "word"])

    return decided(counts.select("word").mapInArrow(ask, "item string, word string"), counts, lambda word, held: WordJudge().original(word, held))


_BOX = re.compile(r"[^\W_][─-▟]|[─-▟][^\W_]|[─-▟][^\x00-\x7f─-▟\s]|[^\x00-\x7f─-▟\s][─-▟]")


def _box(text: str) -> bool:
    """A box-drawing character directly beside a letter or another sign beyond ASCII: an accent or a quotation mark once stood
    there. Frames drawn of them stand apart from words."""
    return _BOX.search(text) is not None


def garbled_fields(df: DataFrame, key: str, columns: list[str], most_sent: int = MOST_SENT) -> DataFrame:
    """(key, field, repaired): one row for each of `columns` of each row that holds a garbled stretch.

    repaired is the text with all recoverable stretches restored; characters lost for good (U+FFFD) stay. Nulls, empty texts
    and sound texts give no row; repeated rows are judged each by itself; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()

    def read(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The column with its spans decoded, which rows to look at, and which of them hold a span or a lost character."""
        codes, offsets = to_codes(column)
        hit = np.zeros(len(column), dtype=bool)
        hit[row_of(offsets, np.flatnonzero(codes == 0xFFFD))] = True
        fixed, ends, spans = decode_spans(codes, offsets)
        high = hit | spans
        high[row_of(ends, np.flatnonzero(fixed > 0x7F))] = True
        return from_codes(fixed, ends), np.flatnonzero(high), hit | spans

    def needed(batch: pa.RecordBatch) -> list[set[str]]:
        items: list[set[str]] = [set() for _ in range(len(batch))]
        for field in names:
            texts, rows, _ = read(batch.column(field))
            for i in rows:
                items[i].update(high_words(texts[i].as_py()))
        return items

    def judge(batch: pa.RecordBatch, known: Callable[[int], dict[str, str]]) -> pa.RecordBatch | None:
        at, fields, repaired = [], [], []
        for name, field in zip(names, columns):
            texts, rows, sure = read(batch.column(name))
            for i, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()):
                bad = {w: was for w in set(high_words(text)) if (was := known(i).get(w)) is not None}
                if sure[i] or bad or _box(text):
                    if bad:
                        text = re.sub("|".join(re.escape(w) for w in sorted(bad, key=len, reverse=True)), lambda m: bad[m.group()], text)
                    at.append(i)
                    fields.append(field)
                    repaired.append(text)
        return pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at, pa.int64())), pa.array(fields), pa.array(repaired)], names=[key, "field", "repaired"]) if at else None

    names = [f"v{i}" for i in range(len(columns))]
    rows = df.select(F.col(key).alias("k"), *[F.col(c).alias(v) for c, v in zip(columns, names)])
    return with_decisions(rows, wrong_words(df, columns), needed, judge, f"`{key}` {kind}, field string, repaired string", most_sent)
