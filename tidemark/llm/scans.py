"""Problem 2: noise in text from scanned pages.

An averaged perceptron edits characters: at each character of a word an operation keeps it, replaces it, deletes one of two or
inserts one, and at a hyphen before white space an operation keeps the break or joins the lines. A word's hypotheses are its
sequences of operations with at most two that are not `keep`; they are scored by each operation with the characters around it
and by how often the word and its edited form occur in the whole collection. A second set of weights judges lines, and
stretches shaped like a page number or header, as page furniture by their shape, their position on the page and whether they
repeat the company or kind of filing. All are trained here on a bounded sample of sound contexts (`sample_rows`, in an order
that a hash of the id fixes), into which the usual damage is put.

The counts are exact and cover every distinct context: copies of a context do not vote for its noise. A word's operations are
chosen once for the whole collection, where its counts are; the texts then only take over what was decided.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.llm.counts import MOST_SENT, WordFilter, count_words, counts_of, decided, with_decisions

# What scanners read, and what stood there.
MISREAD = {
    "1": "l", "0": "o", "5": "s", "9": "g", "6": "b", "8": "b", "!": "i", "@": "a", "ii": "u", "cl": "d", "rn": "m", "m": "rn", "m ": "nn",
    "f": "t", "c": "e", "l": "i", "li": "h", "vv": "w", "t": "f", "e": "c", "nn": "m",
}
# Conjunctions and prepositions that may follow a suspended hyphen.
CONJUNCTIONS = {"and", "or", "to", "und", "oder", "bis", "bzw", "sowie", "et", "ou", "y", "e", "o", "u", "as", "nor", "ni", "noch"}
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿœŒß"
WORD = re.compile(rf"(?<![^\s\"“„«(>'’‘\-/–])[{_LETTERS}0-9!@]*[{_LETTERS}0-9@](?![^\s.,;:!?)\"”“»<'’\-/–%…])")
COMPOUND = re.compile(rf"(?<![^\s\"“„«(>])[{_LETTERS}]+(?:-[{_LETTERS}]+)+")
BREAK = re.compile(rf"(?<![^\s\"“„«(>'’\-])((?:[{_LETTERS}0-9!@]+['’\-])*)([{_LETTERS}0-9!@]+)([-¬\xad])([ \t]*(?:\r?\n[ \t]*)+|[ \t]+)([{_LETTERS}0-9!@]+)")
#: What every break holds.
HYPHEN = re.compile(r"[-¬\xad][ \t\r\n]")
INLINE = re.compile(
    r"\[p\. ?\d+\]|\b[Pp]age \d+ of \d+\b|\b\d{1,4} \| [A-Z0-9!@][A-Z0-9!@ ]*(?: \d{4})?(?![a-z])|\b[A-ZÀ-Ý0-9!@][A-ZÀ-Ý0-9!@ ]+ \| \d{1,4}\b"
    r"|(?<=\S) - \d{1,4} - (?=\S)|(?<=[.!?»”…\w,;]) \d{1,4} (?=[A-ZÀ-Ý«“„])|[A-Z][\w!@]+(?: [A-Z][\w!@]+)*  \d{1,4}(?=\s)"
)
_NUMBER, _WORDS, _CAPITALS = re.compile(r"\d+"), re.compile(r"[A-Za-zÀ-ÿœß]+"), re.compile(r"[A-ZÀ-Ý]{2,}")
_SHORT = re.compile(r"\d{1,4}")
_OPENS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ«“„") | {chr(c) for c in range(0xC0, 0xDE)}
PAGE = re.compile(r"\W*\d{1,4}\W*|\[p\. ?\d+\]|[Pp]age \d+ of \d+|\d{1,4} \| .*|.* \| \d{1,4}|.*  \d{1,4}")


def may_hold_furniture(text: str) -> bool:
    """Whether any number in a text stands as every form of INLINE needs it: a cheap test before that pattern."""
    for m in _SHORT.finditer(text):
        before, after = text[max(0, m.start() - 3) : m.start()], text[m.end() : m.end() + 4]
        if before.endswith(("p.", "p. ", "| ", "  ")) or after.startswith((" |", " of ")) or after[:1] == " " and (before.endswith(" ") and after[1:2] in _OPENS or before == " - " and after.startswith(" - ")):
            return True
    return False


def counted(text: str) -> list[str]:
    """The words and the hyphenated compounds of a text; words broken at a hyphen are left out."""
    found = []
    if "-" in text:
        found = COMPOUND.findall(text)
    if HYPHEN.search(text):
        text = BREAK.sub(" ", text)
    return found + WORD.findall(text)


class Perceptron:
    """Averaged perceptron over candidates, each a list of feature names."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)
        self._sums: dict[str, float] = defaultdict(float)
        self._at: dict[str, int] = defaultdict(int)
        self._step = 0

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def choose(self, candidates: list[list[str]]) -> int:
        return max(range(len(candidates)), key=lambda i: (self.score(candidates[i]), -i))

    def _add(self, feature: str, change: float) -> None:
        self._sums[feature] += (self._step - self._at[feature]) * self.weights[feature]
        self._at[feature] = self._step
        self.weights[feature] += change

    def train(self, cases: list[tuple[list[list[str]], int]], rounds: int, seed: int = 7) -> None:
        order = random.Random(seed)
        for _ in range(rounds):
            order.shuffle(cases)
            for candidates, gold in cases:
                self._step += 1
                guess = self.choose(candidates)
                if guess != gold:
                    for f in candidates[gold]:
                        self._add(f, 1.0)
                    for f in candidates[guess]:
                        self._add(f, -1.0)
        for f in list(self.weights):
            self._add(f, 0.0)
        self.weights = {f: s / max(1, self._step) for f, s in self._sums.items() if s}
        self._sums, self._at = {}, {}


def _bucket(n: int) -> int:
    return int(n).bit_length()


#: What makes a word more than letters: signs that scanners put for letters.
_SIGNS = frozenset("0156789!@")
#: A form is a candidate from this many occurrences on, unless it alone explains signs inside a word.
LEAST = 6
_SEP = "\x00"


class Editor:
    """The trained editor. It asks for counts by name and judges when they are there."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.model = Perceptron()
        self.model.weights.update(weights or {})

    # words

    @staticmethod
    def operations(word: str) -> list[tuple[int, str, str]]:
        """(place, characters read, characters meant) of every operation other than `keep` that a character may take."""
        return [(i, odd.strip(), was) for i in range(len(word)) for odd, was in MISREAD.items() if word.startswith(odd.strip(), i)]

    @classmethod
    def hypotheses(cls, word: str) -> Iterator[tuple[str, tuple[tuple[int, str, str], ...]]]:
        """The edited forms of a word with one and, in words of over four letters, two operations."""
        single = cls.operations(word)
        for i, odd, was in single:
            yield word[:i] + was + word[i + len(odd) :], ((i, odd, was),)
        if len(word) > 4:
            for x, (i, odd, was) in enumerate(single):
                for j, odd2, was2 in single[x + 1 :]:
                    if j >= i + len(odd):
                        yield word[:i] + was + word[i + len(odd) : j] + was2 + word[j + len(odd2) :], ((i, odd, was), (j, odd2, was2))

    @staticmethod
    def mixed(word: str) -> bool:
        return not _SIGNS.isdisjoint(word[1:]) and any(c.isalpha() for c in word)

    @classmethod
    def asked(cls, word: str, frequent: WordFilter) -> set[str]:
        """The words whose counts decide on a word; none if it has no candidate. No form is longer than the longest frequent
        word, so a run of thousands of letters is not edited."""
        if len(word) > frequent.longest + 2 or not any(c.isalpha() for c in word):
            return set()
        mixed = cls.mixed(word)
        forms = {form.lower() for form, _ in cls.hypotheses(word) if mixed and form.isalpha() or form.lower() in frequent}
        return forms | {word.lower()} if forms else set()

    @classmethod
    def candidates(cls, word: str, counts: dict[str, int]) -> tuple[list[str], list[list[str]]]:
        """The word itself and its edited forms that may explain it, with their features; forms with two operations if one
        does not do."""
        mine, mixed = counts.get(word.lower(), 0), cls.mixed(word)
        forms, features = [word], [["keep", f"keep:{min(_bucket(mine), 8)}", f"keep:mixed{mixed}"]]
        enough, seen = False, {word}
        for form, done in cls.hypotheses(word):
            its = counts.get(form.lower(), 0)
            if len(done) == 1:
                enough |= its > 4 * mine + 4
            elif enough and not mixed:
                break
            if form in seen or not (mixed and form.isalpha()) and (its < LEAST or its < 4 * mine):
                continue  # without a sign inside, only a far more frequent word explains a misreading
            seen.add(form)
            lead = _bucket(its) - _bucket(mine)
            f = [f"lead:{max(-4, min(lead, 12))}", f"its:{min(_bucket(its), 12)}", f"mine:{min(_bucket(mine), 8)}", f"mixed{mixed}:{form.isalpha()}", f"len{min(len(word), 6)}", f"capital{word[:1].isupper()}", f"edits{len(done)}"]
            for i, odd, was in done:
                kind = "replace" if len(odd) == len(was) else "delete" if len(odd) > len(was) else "insert"
                op = f"{odd}>{was}"
                f += [f"{kind}:{op}", f"{op}:{word[i - 1 : i] if i else '^'}", f"{op}:{word[i + len(odd) : i + len(odd) + 1] or '$'}:after", f"{op}:lead{max(-2, min(lead, 8))}"]
            forms.append(form)
            features.append(f)
        return forms, features

    def fix(self, word: str, counts: dict[str, int]) -> str | None:
        """The word that was misread as `word`, or None if it is sound; a number is never a misread word."""
        forms, features = self.candidates(word, counts)
        best = self.model.choose(features) if len(forms) > 1 and any(c.isalpha() for c in word) else 0
        return forms[best] if best else None

    # joins

    @staticmethod
    def parts(head: str, left: str, right: str) -> tuple[str, str, str, str]:
        """What a break asks for: the joined word, the compound, and both sides."""
        return (left + right).lower(), f"{head}{left}-{right}".replace("’", "").replace("'", "").lower(), left.lower(), right.lower()

    @classmethod
    def join_features(cls, head: str, left: str, sign: str, gap: str, right: str, counts: dict[str, int]) -> list[list[str]]:
        """Features of keeping the hyphen and of joining."""
        joined, compound, before, behind = (_bucket(counts.get(w, 0)) for w in cls.parts(head, left, right))
        f = [
            f"join:{min(joined, 9)}", f"compound:{min(compound, 9)}", f"more:{max(-5, min(joined - compound, 5))}", f"conjunction:{right.lower() in CONJUNCTIONS}", f"small:{right[:1].islower()}", f"sign:{sign}", f"line:{chr(10) in gap}",
            f"left:{min(before, 9)}", f"right:{min(behind, 9)}", f"head:{bool(head)}",
        ]
        return [["joinkeep"], [f"j:{x}" for x in f]]

    def judge(self, item: str, counts: dict[str, int]) -> str | None:
        """The decision on an item: a word's sound form, or `join` for a break; None where nothing changes."""
        if _SEP not in item:
            return self.fix(item, counts)
        return "join" if self.model.choose(self.join_features(*item.split(_SEP), counts)) else None

    # furniture

    @staticmethod
    def line_features(text: str, before: str, after: str, own_line: bool, company: str, doc_type: str) -> list[list[str]]:
        """Features of keeping a stretch and of dropping it as furniture; before and after are the nearest text beside it."""
        bare = text.strip()
        low = bare.lower()
        shape = _WORDS.sub("a", _NUMBER.sub("9", _CAPITALS.sub("A", bare[:120])))[:14]
        name, digits = company.lower().split(), len(bare) - len(_NUMBER.sub("", bare))
        named = sum(w in low for w in name) * 2 // len(name) if name else 0
        kind, held = doc_type.lower(), PAGE.fullmatch(bare) is not None
        only = bool(kind) and low == kind
        f = [
            f"l:shape:{shape}", f"l:own:{own_line}", f"l:shape:{shape}:{own_line}", f"l:page:{digits > 0 and 'page' in low}", f"l:short:{min(len(bare) // 12, 8)}",
            f"l:company:{named}", f"l:type:{bool(kind) and kind in low}", f"l:onlytype:{only}", f"l:end:{bare[-1:] in '.,;:!?<'}",
            f"l:first:{not before}:last:{not after}", f"l:digits:{digits * 4 // max(1, len(bare))}", f"l:blank:{'  ' in bare}", f"l:bar:{' | ' in bare}", f"l:small:{bare[:1].islower()}", f"l:beforestop:{before[-1:] in '.!?»”'}",
            f"l:whole:{held}:{own_line}", f"l:whole:{held}:company{named}:type{only}",
        ]
        return [["linekeep"], f]

    def furniture(self, text: str, company: str, doc_type: str) -> list[tuple[int, int]]:
        """The stretches of page furniture in a text."""
        found = []
        names = [w for w in (doc_type.lower(), *company.lower().split()) if w]
        if "\n" in text:
            at, lines = 0, text.split("\n")
            end, before = max((i for i, line in enumerate(lines) if line.strip()), default=0), ""
            for i, line in enumerate(lines):
                if line.strip():
                    # a header, a footer or a page number holds a number, the company or the kind of filing
                    if (_SHORT.search(line) or any(w in line.lower() for w in names)) and self.model.choose(self.line_features(line, before, lines[end] if i < end else "", True, company, doc_type)):
                        found.append((at, at + len(line) + 1))
                    before = line.rstrip()
                at += len(line) + 1
        for m in INLINE.finditer(text) if may_hold_furniture(text) else ():
            if not any(a <= m.start() < b for a, b in found):
                if self.model.choose(self.line_features(m.group(), text[max(0, m.start() - 20) : m.start()].rstrip(), text[m.end() : m.end() + 20].strip(), False, company, doc_type)):
                    found.append(m.span())
        return sorted(found)

    def cleared(self, text: str, company: str, doc_type: str) -> str:
        """The text without page furniture."""
        if "\n" in text or _SHORT.search(text):
            for a, b in reversed(self.furniture(text, company, doc_type)):
                text = text[:a].rstrip() + "\n" + text[b:].lstrip()
        return text

    @staticmethod
    def breaks(text: str) -> tuple[set[str], set[str]]:
        """The breaks at hyphens in a cleared text as items, and the words that joining them may make. A fragment may end in a
        hyphen itself, so breaks are looked for again when all are joined."""
        items, made = set(), set()
        for _ in range(2 if HYPHEN.search(text) else 0):
            for m in BREAK.finditer(text):
                items.add(_SEP.join(m.groups()))
                made.add(m.group(2) + m.group(5))
            text = BREAK.sub(r"\1\2\5", text)
        return items, made

    # whole texts

    def items(self, text: str, company: str, doc_type: str) -> set[str]:
        """All that a text may need a decision on."""
        text = self.cleared(text, company, doc_type)
        breaks, made = self.breaks(text)
        return breaks | made | set(WORD.findall(text)) | set(WORD.findall(BREAK.sub(r"\1\2\5", text)))

    def repair(self, text: str, company: str, doc_type: str, decided: dict[str, str]) -> str | None:
        """The repaired text, or None where nothing was noise."""
        whole = self.cleared(text, company, doc_type)
        noisy = whole != text
        text = whole
        if HYPHEN.search(text):

            def join(m: re.Match) -> str:
                return m.group(1) + m.group(2) + m.group(5) if _SEP.join(m.groups()) in decided else m.group()

            for _ in range(2):
                text = BREAK.sub(join, text)
            noisy |= text != whole
        end, bad = text.rfind("..."), set()
        for m in WORD.finditer(text):
            was = decided.get(m.group())
            if was is not None and not (end >= 0 and m.end() == end) and not (was[:1].islower() and m.group()[:1].isupper()):
                bad.add(m.group())
        if bad:
            noisy = True
            text = WORD.sub(lambda m: decided[m.group()] if m.group() in bad else m.group(), text)
        if not noisy:
            return None
        return re.sub(r"[ \t]*\r?\n[ \t]*(?!\s*\n)", " ", re.sub(r"(?:[ \t]*\r?\n){2,}", "\n", text)).strip() if "\n" in text else text


class Lessons:
    """Sound (context, company, doc_type) rows with the usual damage put in; `asked` are the words whose counts they need."""

    def __init__(self, sample: list[tuple[str, str, str]], frequent: WordFilter, seed: int = 11):
        rng = random.Random(seed)
        self.words: Counter[str] = Counter()
        self.lines: list[tuple[list[list[str]], int]] = []
        self.sound_breaks: list[tuple[str, ...]] = []
        self.damaged: list[tuple[str, str]] = []
        self.made_breaks: list[tuple[tuple[str, ...], int, str]] = []
        read: set[str] = set()
        for text, company, doc_type in sample:
            if not text or text in read:
                continue
            read.add(text)
            self.words.update(WORD.findall(BREAK.sub(" ", text)))
            self.sound_breaks += [m.groups() for m in BREAK.finditer(text)]
            self._lines(text, company or "", doc_type or "", rng)
        conjunctions = sorted(CONJUNCTIONS)
        inverse: dict[str, list[str]] = defaultdict(list)
        for odd, was in MISREAD.items():
            inverse[was].append(odd.strip())
        for w in sorted(w for w in self.words if len(w) > 3 and w.isalpha() and w.lower() in frequent):
            own = random.Random(f"{seed} {w}")
            places = [(i, was, odd) for was, odds in inverse.items() for i in range(len(w)) if w.startswith(was, i) for odd in odds]
            self.damaged += [(w, w[:i] + odd + w[i + len(was) :]) for i, was, odd in own.sample(places, min(3, len(places)))]
            if w[0].islower() and len(w) > 4:
                for gap in own.sample(["\n", " \n", "\r\n", "\n ", "\n\n", " "], 2):
                    cut = own.randint(2, len(w) - 2)
                    self.made_breaks.append((("", w[:cut], own.choice("---¬"), gap, w[cut:]), 1, w))
                # suspended hyphens, with whole words and with parts of words before them
                self.made_breaks.append((("", w[: own.randint(2, len(w))], "-", own.choice([" ", " ", "\n"]), own.choice(conjunctions)), 0, w))
        self.asked = {w.lower() for w in self.words}
        for w in [*self.words, *(d for _, d in self.damaged)]:
            self.asked |= Editor.asked(w, frequent)
        for head, left, _, _, right in [*self.sound_breaks, *(b for b, _, _ in self.made_breaks)]:
            self.asked |= set(Editor.parts(head, left, right))

    def _lines(self, text: str, company: str, doc_type: str, rng: random.Random) -> None:
        """Lines of sound text, wrapped at some width, and furniture between them."""
        flat, width = re.sub(r"\s*\n\s*", " ", text), rng.choice((46, 60, 66, 80, 90))
        lines, line = [], ""
        for w in flat.split(" "):
            if line and len(line) + len(w) > width:
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        lines.append(line)
        beside = lambda i: (lines[i - 1] if i else "", lines[i] if i < len(lines) else "")
        for i, own in enumerate(lines):
            if own:
                self.lines.append((Editor.line_features(own, beside(i)[0], beside(i + 1)[1], True, company, doc_type), 0))
        for m in INLINE.finditer(flat):
            self.lines.append((Editor.line_features(m.group(), flat[: m.start()].rstrip(), flat[m.end() :].strip(), False, company, doc_type), 0))
        n, total = rng.randint(1, 240), rng.randint(240, 400)
        name, kind = company or "Group", doc_type or "Annual Report"
        made = rng.choice((f"{n}", f"- {n} -", f"[p. {n}]", f"Page {n} of {total}", kind, f"{n} | {kind.upper()} {rng.randint(2014, 2026)}", f"{name.upper()} | {n}", f"{name}  {n}"))
        self.lines.append((Editor.line_features(made, *beside(rng.randint(0, len(lines))), True, company, doc_type), 1))
        if re.search(r"\d", made) and not made.isdigit():  # inside a sentence nothing explains a lone number before a capital
            for at in {len(flat) // 2, rng.choice([m.end() for m in re.finditer(r"[.!?»”] ", flat)] or [0])}:  # also between sentences
                self.lines.append((Editor.line_features(f" {made} " if made[0] == "-" else made, flat[:at].rstrip(), flat[at:].strip(), False, company, doc_type), 1))

    def cases(self, counts: dict[str, int]) -> list[tuple[list[list[str]], int]]:
        """Candidates' features with the number of the right one."""
        count = lambda w: counts.get(w.lower(), 0)
        cases = list(self.lines)
        for groups in self.sound_breaks:  # sound hyphens before white space
            if groups[4].lower() in CONJUNCTIONS or not count(groups[1] + groups[4]):
                cases.append((Editor.join_features(*groups, counts), 0))
        for w, damaged in self.damaged:
            forms, features = Editor.candidates(damaged, counts)
            if count(w) >= 8 and w in forms[1:] and count(damaged) * 8 < count(w):
                cases.append((features, forms.index(w)))
        cases += [(Editor.join_features(*groups, counts), right) for groups, right, w in self.made_breaks if count(w) >= 8]
        for w, n in self.words.items():
            forms, features = Editor.candidates(w, counts)
            if len(forms) > 1 and (n > 1 or _SIGNS.isdisjoint(w)):
                # a much rarer word in the sample may be noise itself, unless it recurs there
                if n >= 8 or count(w) * 16 > max(count(f) for f in forms[1:]):
                    cases.append((features, 0))
        return cases


def sound_sample(rows: DataFrame, key: str, group: str, sound_groups: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """At most `sample_rows` of `rows` whose `group` is in `sound_groups`, in the order of a hash of the id. Ids are chosen first,
    so that texts are not shuffled."""
    ids = rows.select(key, group).join(sound_groups, group, "left_semi").orderBy(F.xxhash64(key)).limit(sample_rows).select(key)
    return rows.join(F.broadcast(ids), key, "left_semi")  # `sample_rows` ids


def repaired_scans(df: DataFrame, key: str, text: str, company: str, doc_type: str, sound: DataFrame, sample_rows: int = 3000, most_sent: int = MOST_SENT) -> DataFrame:
    """(key, repaired): every row whose text held scan noise, repaired into continuous paragraphs.

    `sound` has the columns text, company and doc_type of rows thought free of noise, of which at most `sample_rows` are
    trained on. Null, empty and sound texts give no row, and so stay untouched; repeated rows are judged each by itself;
    other columns are ignored. A table without sound rows leaves an untrained editor, which changes nothing.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.trim(F.coalesce(company, F.lit(""))).alias("c"), F.coalesce(doc_type, F.lit("")).alias("d")).where("length(t) > 0")
    vocabulary = stored(count_words(rows.select("t").distinct(), "t", counted))
    counts = stored(vocabulary.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")))
    frequent = WordFilter.of(counts, LEAST)
    chosen = sound.select(text, company, doc_type).where(f"`{text}` is not null").orderBy(F.xxhash64(text, company, doc_type)).limit(sample_rows).collect()
    lessons = Lessons([tuple(r) for r in chosen], frequent)
    editor = Editor()
    editor.model.train(lessons.cases(counts_of(spark, lessons.asked, counts)), 6)
    weights = dict(editor.model.weights)
    shared = spark.sparkContext.broadcast(frequent)

    def find_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Editor(weights)
        for batch in batches:
            items, made = set(), set()
            for t, c, d in zip(*(x.to_pylist() for x in batch.columns)):
                x, y = own.breaks(own.cleared(t, c, d))
                items |= x
                made |= y
            yield pa.RecordBatch.from_arrays([pa.array([*items, *made], pa.string())], names=["item"])

    broken = stored(rows.select("t", "c", "d").where(F.col("t").rlike(HYPHEN.pattern)).mapInArrow(find_breaks, "item string").distinct())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for item in batch.column(0).to_pylist():
                asked = Editor.asked(item, shared.value) if _SEP not in item else Editor.parts(*(item.split(_SEP)[i] for i in (0, 1, 4)))
                pairs += [(item, w) for w in set(asked)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*pairs)], names=["item", "word"])

    items = vocabulary.select(F.col("word").alias("item")).unionByName(broken).distinct()
    decisions = decided(items.mapInArrow(ask, "item string, word string"), counts, editor.judge)

    def needed(batch: pa.RecordBatch) -> list[set[str]]:
        own = Editor(weights)
        return [own.items(t, c, d) for t, c, d in zip(*(batch.column(x).to_pylist() for x in "tcd"))]

    def repair(batch: pa.RecordBatch, known) -> pa.RecordBatch | None:
        own, at, out = Editor(weights), [], []
        for i, (t, c, d) in enumerate(zip(*(batch.column(x).to_pylist() for x in "tcd"))):
            fixed = own.repair(t, c, d, known(i))
            if fixed is not None:
                at.append(i)
                out.append(fixed)
        return pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=[key, "repaired"]) if at else None

    return with_decisions(rows, decisions, needed, repair, f"`{key}` {df.schema[key].dataType.simpleString()}, repaired string", most_sent)
