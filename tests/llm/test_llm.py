"""The training-data operators against brute force, exact round trips and held-out damage, with the awkward cases of each."""

import glob
import os
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.encode import Replay, token_ids
from tidemark.llm.frequency import block_counts, category_terms, detection_terms, term_frequency
from tidemark.llm.garbled import garbled_fields
from tidemark.llm.leaks import leaked_passages
from tidemark.llm.lookalikes import consistent_text
from tidemark.llm.nearcopies import similar_pairs
from tidemark.llm.scans import repaired_scans
from tidemark.llm.spans import shared_share, sharing_pairs
from tidemark.llm.survivors import preferred_rows, true_values
from tidemark.llm.topn import LoserTree, top_n
from tidemark.llm.words import words

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum " * 30_000


# 1


def test_ngram_counts_match_brute_force():
    rng = random.Random(3)
    records = [[rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(60)]
    weights = [rng.randint(1, 4) for _ in records]
    occurrences, holders = Counter(), Counter()
    for r, w in zip(records, weights):
        grams = [tuple(r[i : i + n]) for n in (1, 2, 3) for i in range(len(r) - n + 1)]
        occurrences.update({g: grams.count(g) * w for g in set(grams)})
        holders.update({g: w for g in set(grams)})
    got = {tuple(g): (o, n) for _, g, o, n in block_counts(records, weights, 3)}
    assert got == {g: (occurrences[g], holders[g]) for g in occurrences}


def test_ngrams_of_all_lengths_are_counted(spark):
    from tidemark.sources.tables import table

    occurrences, holders = Counter(), Counter()
    for r in table(spark, SF, "mentions", "detection_method").where("detection_method is not null").collect():
        terms = detection_terms(r[0])
        grams = [(n, " | ".join(terms[i : i + n])) for n in range(1, len(terms) + 1) for i in range(len(terms) - n + 1)]
        occurrences.update(grams)
        holders.update(set(grams))
    got = {(r.n, r.ngram): (r.occurrences, r.records) for r in queries.p1_ngrams(spark, SF).collect()}
    assert got == {g: (occurrences[g], holders[g]) for g in occurrences} and max(n for n, _ in got) > 3


def test_terms_of_awkward_values(spark):
    assert detection_terms("A | reasons= x ,Y,, x|") == ["a", "x", "y", "x"] and category_terms("  ") == []
    rows = spark.createDataFrame([(" B1 ", "r"), ("b1", "r"), (None, "r"), ("", "r"), (LONG, "r")], "category_a string, records string")
    got = {r.ngram[0]: (r.occurrences, r.records) for r in term_frequency(rows, {"category_a": category_terms}).collect()}
    assert got["b1"] == (2, 2) and got[LONG.strip()] == (1, 1) and len(got) == 2
    assert term_frequency(rows.limit(0), {"category_a": category_terms}).count() == 0


# 2


def _sound(spark, n=400):
    rng = random.Random(5)
    subject, verb, thing, place = ["The research lab", "Our pricing team", "The customer desk", "Each regional unit"], ["connected", "measured", "extended", "published"], ["the forecast engine", "a quality dashboard", "the claims reader", "the energy balance tool"], ["in the northern plants", "across rural districts", "under close supervision", "with modest spending"]
    texts = [" ".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} {rng.choice(place)}." for _ in range(5)) for _ in range(n)]
    return texts, spark.createDataFrame([(i, t, "Acme Group", "Annual Report") for i, t in enumerate(texts)], "id long, context string, company string, doc_type string")


def test_scan_noise_is_found_and_repaired(spark):
    texts, sound = _sound(spark)
    clean = "The research lab connected the forecast engine in the northern plants. Our pricing team measured a quality dashboard."
    wrapped = clean.replace("forecast engine", "forecast\nengine")
    cases = {
        1000: clean.replace("forecast", "forecasf"), 1001: clean.replace("northern", "nor-\nthern"), 1002: wrapped + "\n[p. 12]\nEach regional unit published the claims reader.", 1003: clean.replace("quality", "qua1ity"),
        1004: wrapped, 1005: clean + " It covers pre- and post-sales, see page 12 of this report.", 1006: None, 1007: "", 1008: LONG, 1009: clean.replace("plants", "p1ants").replace("lab", "1ab"),
    }
    rows = sound.unionByName(spark.createDataFrame([(k, t, "Acme Group", "Annual Report") for k, t in cases.items()] * 2, sound.schema)).withColumn("repaired", F.lit("clash"))
    got = {r.id: r.repaired for r in repaired_scans(rows, "id", "context", "company", "doc_type", sound, 300).collect()}
    assert set(got) == {1000, 1001, 1002, 1003, 1009}
    assert got[1000] == clean and got[1001] == clean and got[1003] == clean
    assert "12" not in got[1002] and "\n" not in got[1002]
    assert repaired_scans(rows.limit(0), "id", "context", "company", "doc_type", sound.limit(0)).count() == 0


def test_copies_of_a_scan_do_not_vote_for_their_noise(spark):
    _, sound = _sound(spark)
    clean = "The research lab connected the forecast engine in the northern plants. Our pricing team measured a quality dashboard."
    copies = [(1000 + i, clean.replace("forecast", "forecasf"), "Acme Group", "Annual Report") for i in range(200)]  # a third of the rows
    rows = sound.unionByName(spark.createDataFrame(copies, sound.schema))
    got = {r.id: r.repaired for r in repaired_scans(rows, "id", "context", "company", "doc_type", sound, 300).collect()}
    assert got == {i: clean for i, *_ in copies}


def test_two_misreadings_in_a_word_are_repaired_at_every_count(spark):
    for size, share in ((400, 15), (1600, 60)):
        texts, sound = _sound(spark, size)
        hit = [(10_000 + i, t) for i, t in enumerate([t for t in texts if "customer" in t][:share])]
        noisy = spark.createDataFrame([(i, t.replace("customer", "cusfomcr"), "Acme Group", "Annual Report") for i, t in hit], sound.schema)
        got = {r.id: r.repaired for r in repaired_scans(sound.unionByName(noisy), "id", "context", "company", "doc_type", sound, 300).collect()}
        assert got == dict(hit)


@pytest.mark.parametrize("size", [400, 4000])
def test_damage_is_repaired_whatever_the_vocabulary(spark, size):
    rng = random.Random(41)
    syllables = ["ba", "con", "der", "ter", "lem", "mar", "nis", "por", "tra", "vel", "sen", "gal", "mi", "ro", "fen"]
    vocabulary = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(2 * size)})[:size]
    texts = []
    for _ in range(12):  # every word some dozen times, in another order each time
        order = rng.sample(vocabulary, len(vocabulary))
        texts += [" ".join(order[i : i + 50]).capitalize() + "." for i in range(0, len(order), 50)]
    odd = {"m": "rn", "d": "cl", "o": "0", "l": "1", "s": "5", "g": "9", "b": "6", "t": "f", "e": "c"}
    noisy, clean = [], {}
    for k, t in enumerate(rng.sample(texts, 80)):
        parts = t.split(" ")
        at = [i for i, w in enumerate(parts) if 1 < i < 48 and len(w) > 5 and any(c in w[1:-1] for c in odd)]
        if k % 2 and at:
            i = rng.choice(at)
            j = rng.choice([j for j in range(1, len(parts[i]) - 1) if parts[i][j] in odd])
            parts[i] = parts[i][:j] + odd[parts[i][j]] + parts[i][j + 1 :]
        else:
            i = next(i for i, w in enumerate(parts) if i > 2 and len(w) > 5)
            parts[i] = f"{parts[i][:3]}-\n{parts[i][3:]}"
        noisy.append((10_000 + k, " ".join(parts), "Acme Group", "Annual Report"))
        clean[10_000 + k] = t
    sound = spark.createDataFrame([(i, t, "Acme Group", "Annual Report") for i, t in enumerate(texts)], "id long, context string, company string, doc_type string")
    got = {r.id: r.repaired for r in repaired_scans(sound.unionByName(spark.createDataFrame(noisy, sound.schema)), "id", "context", "company", "doc_type", sound, 300).collect()}
    right = sum(got.get(i) == t for i, t in clean.items())
    assert right >= 0.95 * len(clean) and len(set(got) - set(clean)) <= 0.01 * len(texts)


def test_many_decisions_are_joined_and_change_no_result(spark):
    _, sound = _sound(spark, 200)
    clean = "The research lab connected the forecast engine in the northern plants."
    noisy = spark.createDataFrame([(900, clean.replace("forecast", "forecasf"), "", ""), (901, clean.replace("northern", "nor-\nthern"), "", ""), (901, clean, "", ""), (902, None, "", "")], sound.schema)
    rows = sound.unionByName(noisy)
    few, many = ({(r.id, r.repaired) for r in repaired_scans(rows, "id", "context", "company", "doc_type", sound, 200, most_sent=m).collect()} for m in (10**6, 0))
    assert few == many == {(900, clean), (901, clean)}
    wrong = spark.createDataFrame([(i, t.encode("cp1252").decode("cp850")) for i, t in enumerate(["Die Kapazitäten wachsen", "dafür ﬁn é"[:5], "le comité"])] + [(7, "plain"), (8, None), (9, "ｆull")], "id long, context string")
    for run in (lambda m: garbled_fields(wrong, "id", ["context"], m), lambda m: consistent_text(wrong, "id", "context", m)):
        few, many = (sorted(map(str, run(m).collect())) for m in (10**6, 0))
        assert few == many and few


# 3


def test_marks_in_any_order_and_singletons_become_one_form(spark):
    forms = [["a\u0302\u0323", "a\u0323\u0302", "\u00e2\u0323", "\u1ea1\u0302", "\u1ead"], ["\u212b", "\u00c5", "A\u030a"], ["\u212a", "K"], ["q\u0323\u0307", "q\u0307\u0323"], ["a\u0316\u0301", "\u00e1\u0316"]]
    rows = spark.createDataFrame([(i, f"x{t}y {t}") for i, group in enumerate(forms) for t in group], "id long, text string")
    got = {}
    for r in consistent_text(rows, "id", "text").collect():
        got.setdefault(r.id, set()).add(r.normal)
    assert all(len(x) == 1 for x in got.values()) and got[0] == {"x\u1eady \u1ead"} and got[1] == {"x\u00c5y \u00c5"}


def test_consistent_forms(spark):
    cases = {
        1: ("pa​rts of it", "parts of it", True), 2: ("ｓｅｒｖｉｃｅ oﬃce", "service office", True), 3: ("comité", "comité", True), 4: ("knоwlеdge", "knowledge", True),
        5: ("Велторна α m² ™ “x” – é", None, False), 6: (None, None, False), 7: ("", "", False), 8: (LONG, LONG, False), 9: ("prÃ  Â«", None, False), 10: ("é̂", None, True),
    }
    rows = spark.createDataFrame([(k, v[0], "x") for k, v in cases.items()] + [(1, cases[1][0], "x")], "id long, text string, normal string")
    got = consistent_text(rows, "id", "text").collect()
    assert len(got) == len(cases) + 1
    for r in got:
        text, normal, changed = cases[r.id]
        assert r.changed == changed, r
        assert r.normal == (text if normal is None and not changed else normal if normal is not None else r.normal)
    assert consistent_text(rows.limit(0), "id", "text").count() == 0


def test_variation_selectors_tags_and_letterlike_signs(spark):
    cases = [
        ("re\ufe00port \ufe0fof", "report of", True), ("da\U000e0061\U000e007fta", "data", True), ("t\u210ee \U0001d461\u210e\U0001d452", "the the", True), ("fo\U000e0101rm", "form", True),
        ("I \u2764\ufe0f it, 1\ufe0f\u20e3, \u00ae\ufe0f", None, False), ("\U0001f3f4\U000e0067\U000e0062\U000e007f and \U0001f469\u200d\U0001f4bb", None, False), ("\u2122 \u2116 \u00b2 \u2103 \u2126 \U00020000", None, False),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "id long, text string")
    got = {r.id: (r.normal, r.changed) for r in consistent_text(rows, "id", "text").collect()}
    assert got == {i: (t if normal is None else normal, changed) for i, (t, normal, changed) in enumerate(cases)}


# 4


def test_preferred_rows_ties_and_nulls(spark):
    rows = spark.createDataFrame([(5, "a", "xx", 1), (3, "a", "yy", 1), (9, "a", None, 7), (1, "b", "z", 1), (2, None, "z", 1), (4, None, "z", 1), (6, "c", None, 1), (7, "c", "", 1)], "id long, k string, v string, group_id int")
    got = {r.group_id: r.best for r in preferred_rows(rows, [F.col("k")], "id", {"best": (F.length("v") > 0, [F.length("v")])}).collect()}
    assert got == {3: 3, 6: 0}


def test_true_values_recovers_the_better_claimer(spark):
    rng, rows = random.Random(2), []
    for g in range(400):
        truth = rng.choice("AB")
        for claimer, right in (("good", 0.95), ("fair", 0.85), ("also", 0.85), ("bad", 0.35)):
            rows.append((g, claimer, truth if rng.random() < right else "AB"[truth == "A"], truth))
    df = spark.createDataFrame(rows + [(1, None, "A", "A"), (2, "good", None, "A")], "g int, c string, v string, truth string")
    values, quality = true_values(df, ["g"], "c", "v")
    assert quality["good"][0] > quality["bad"][0] and quality["good"][1] > quality["bad"][1]
    truth = {r[0]: r[3] for r in rows}
    right = sum(r.is_true == (truth[r.g] == r.value) for r in values.collect())
    assert right > 0.85 * values.count()
    assert true_values(df.limit(0), ["g"], "c", "v")[0].count() == 0


# 5


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in (1, 2, 3, 7):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        at, tree, out = [0] * k, LoserTree([(r[0],) if r else None for r in runs]), []
        while tree.heads[tree.winner] is not None:
            w = tree.winner
            out.append(tree.heads[w][0])
            at[w] += 1
            tree.replace(w, (runs[w][at[w]],) if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_top_n_matches_sorting(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "y", "hot", "hot", "hot", None]), rng.choice([1.0, 2.0, 3.0, None, float("nan")]), rng.choice(["b", "a", "é", None]), 1) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, s double, t string, pos int").repartition(7)
    got = sorted((r.g, r.pos, r.id) for r in top_n(df, ["g"], "s", ["t", "id"], ["id"], 4).collect())
    want = []
    for g in ("x", "y", "hot"):
        best = sorted((r for r in rows if r[1] == g and r[2] is not None and r[2] == r[2]), key=lambda r: (-r[2], r[3] is None, r[3] or "", r[0]))[:4]
        want += [(g, k + 1, r[0]) for k, r in enumerate(best)]
    assert got == sorted(want)
    assert top_n(df.limit(0), ["g"], "s", ["t"], ["id"], 4).count() == 0


# 6


def test_garbled_spans_decode_exactly(spark):
    sound = ["Véase la página 12: el área «Norte» creció – según el comité", "Für die Prüfung “x” wurden € 12 gezahlt™", "L’équipe a réservé un cœur"]
    rows, want = [], {}
    for i, t in enumerate(sound * 4):
        codec = ["cp1252", "mac_roman", "cp850", "latin-1"][i // 3]
        rows.append((i, t.encode("utf-8").decode(codec, "replace" if codec == "cp1252" else "strict"), t))
        want[i] = t
    rows += [(100, "SÃO Ñandel ÂGE β α ½ m² ±0.5 °C √n § 株式会社 Âge", "x"), (101, None, "x"), (102, "", ""), (103, "telef�nica", "x"), (104, LONG, "x"), (105, "le comitÈ rÈgulateur a testÈ", "x")]
    df = spark.createDataFrame(rows, "id long, context string, field string")
    got = {r.id: r.repaired for r in garbled_fields(df, "id", ["context"]).collect()}
    assert {i for i in got if i < 100} == set(want)
    assert all(got[i] == want[i] for i in want if "�" not in rows[i][1])
    assert {i for i in got if i >= 100} == {103, 105} and got[105] == "le comité régulateur a testé"
    assert garbled_fields(df.limit(0), "id", ["context"]).count() == 0


def test_scripts_of_all_kinds_and_frames(spark):
    sound = ["Kovać", "Tiếng Việt của hợp tác", "שלום עולם", "안녕하세요", "Ελλάδα", "Привет", "日本の会社", "naïve café", "Łódź i Gdańsk", "Šiaulių žmonės"]
    rows = [(i, t.encode("utf-8").decode("latin-1")) for i, t in enumerate(sound)]
    wide = [(20, "Kovać".encode().decode("cp1252"))]
    legal = ["└────┘ a │ b", "│ Total │ 12 │", "«Está»… y más", "Spaß” sagt", "CAFÉ® É™ ÉTÉ»", "A–Z, Ä–Ö", *sound]
    rows += wide + [(100 + i, t) for i, t in enumerate(legal)] + [(200, "Unternehmen f├╝r Kunden".replace("├╝", "┬ü"))]
    got = {r.id: r.repaired for r in garbled_fields(spark.createDataFrame(rows, "id long, context string"), "id", ["context"]).collect()}
    assert {i: got.get(i) for i in range(len(sound))} == dict(enumerate(sound)) and got[20] == "Kovać"
    assert [i for i in got if 100 <= i < 200] == [] and 200 in got


def test_copies_and_rare_words_of_a_wrong_code_page_are_found(spark):
    wrong = lambda t: t.encode("cp1252").decode("cp850")
    copied, rare = "Die Kapazitäten wachsen", ["Der Rückbau läuft", "un goût fort", "la adopción avanza", "une leçon utile", "dafür"]
    rows = [(i, wrong(copied)) for i in range(100)] + [(100 + i, wrong(t)) for i, t in enumerate(rare)]
    rows += [(150 + i, wrong("más")) for i in range(50)] + [(200 + i, f"más {i}") for i in range(12)]
    sound = ["comissões e milhões", "Alþingi", "Verbrauch in kWh/m²a", "10 m³h", "Umsatz¹ und Gewinn³", "groß, größer", "São Paulo", "müssen"]
    rows += [(300 + i, t) for i, t in enumerate(sound)]
    got = {r.id: r.repaired for r in garbled_fields(spark.createDataFrame(rows, "id long, context string"), "id", ["context"]).collect()}
    want = {i: copied for i in range(100)} | {100 + i: t for i, t in enumerate(rare)} | {150 + i: "más" for i in range(50)}
    assert got == want


# 7


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(90)]
    base = [rng.sample(pool, 40) for _ in range(12)]
    rows = []
    for i in range(150):
        chosen = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            chosen[rng.randrange(len(chosen))] = rng.choice(pool)
        rng.shuffle(chosen)
        rows.append((i, rng.choice([" AI ", "ai", "LLM"]), " ".join(chosen)))
    rows += [(200, None, rows[0][2]), (201, "ai", None), (202, "ai", ""), (203, "ai", "too few words"), (204, "ai", LONG), (205, "ai", rows[0][2]), (206, "ai", rows[0][2])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, context string, class int")
    held = [(i, t.strip(" ").lower(), set(words(c))) for i, t, c in rows if t is not None and c and len(set(words(c))) >= 30]
    want = {(a[0], b[0]) for a, b in combinations(held, 2) if a[1] == b[1] and len(a[2] & b[2]) * 10 >= 7 * len(a[2] | b[2])}
    got = [(r.a, r.b) for r in similar_pairs(df, "id", "text", "context").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (205, 206) in want
    assert similar_pairs(df.limit(0), "id", "text", "context").count() == 0


def test_large_shards_are_cut_into_blocks(spark, monkeypatch):
    from tidemark.llm import nearcopies

    rng = random.Random(9)
    columns = [f"k{i}" for i in range(60)]
    rows = [(i, "ai", " ".join(rng.sample(columns, 45))) for i in range(120)]
    sets = {i: set(c.split()) for i, _, c in rows}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}
    cells = nearcopies.bounded_pairs
    assert cells is not None and want
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame(rows, "id long, text string, context string"), "id", "text", "context").collect()}
    assert got == want


def test_spread_texts_blocks_and_links_match_brute_force(spark):
    from tidemark.llm.nearcopies import similar_counts

    rng = random.Random(21)
    columns = [f"k{i}" for i in range(64)]
    rows = [(i, rng.choice(["AI ", "ai", "llm"]), " ".join(rng.sample(columns, 46))) for i in range(150)]
    rows += [(1000 + i, "ai", rows[i][2]) for i in range(0, 30, 2)] + [(2000 + i, "ai", rows[3][2]) for i in range(40)]  # copies, one in many rows
    rows += [(3000, "ai", " ".join(f"long{i}" for i in range(70_000))), (3001, "ai", " ".join(f"long{i}" for i in range(80_000)))]
    held = {i: (t.strip(" ").lower(), set(c.split())) for i, t, c in rows}
    want = {(a, b) for a, b in combinations(sorted(held), 2) if held[a][0] == held[b][0] and len(held[a][1] & held[b][1]) * 10 >= 7 * len(held[a][1] | held[b][1])}
    links = Counter(x for p in want for x in p)
    first = {}
    for i in sorted(held):
        first.setdefault((held[i][0], frozenset(held[i][1])), i)
    df = spark.createDataFrame([*rows, rows[0]], "id long, text string, context string")
    for sizes in ({}, {"local": 60, "shard_rows": 7}):
        got = [(r.a, r.b) for r in similar_pairs(df, "id", "text", "context", **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        counts = {r.id: (r.class_id, r.links) for r in similar_counts(df, "id", "text", "context", **sizes).collect()}
        assert counts == {i: (first[held[i][0], frozenset(held[i][1])], links[i]) for i in held}


def test_rows_of_spread_texts_are_moved_once(spark):
    from tidemark.llm.nearcopies import similar_counts

    rng = random.Random(22)
    columns = [f"k{i}" for i in range(60)]
    rows = [(i, "ai", " ".join(rng.sample(columns, 45))) for i in range(400)]
    rows += [(1000 + i, "ai", rows[7][2]) for i in range(30)] + [(2000 + i, "llm", f"too few {i}") for i in range(60)]
    sets = {i: (t, frozenset(c.split())) for i, t, c in rows if t == "ai"}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a][1] & sets[b][1]) * 10 >= 7 * len(sets[a][1] | sets[b][1])}
    df = spark.createDataFrame(rows, "id long, text string, context string")
    status, empty = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (x.apply(k) for x in (status.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty),) for k in range(x.size()))}
    before = stages()
    got = [(r.a, r.b) for r in similar_pairs(df, "id", "text", "context", local=50, shard_rows=40).collect()]
    moved = sum(n for k, n in stages().items() if k not in before)
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < moved < 2 * len(rows)
    links = Counter(x for p in want for x in p)
    assert {r.id: r.links for r in similar_counts(df, "id", "text", "context", local=50, shard_rows=40).collect()} == {i: links[i] for i in sets}


def test_forest_of_several_levels_loses_no_pair():
    import numpy as np

    from tidemark.llm.nearcopies import GROUPS, bounded_pairs, points_of

    rng = np.random.default_rng(3)
    sets = [rng.choice(300, size=rng.integers(30, 60), replace=False) for _ in range(40)]
    sets = [np.unique(np.concatenate([s[: len(s) - 4], rng.choice(300, size=4)])) for s in sets for _ in range(20)]
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    hashes = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    points = points_of(np.concatenate([hashes[s] for s in sets]), np.repeat(np.arange(len(sets)), sizes), len(sets))
    assert points.shape == (len(sets), GROUPS)
    got = [p for i, j in bounded_pairs(np.zeros(len(sets), dtype=np.int64), sizes, np.zeros(len(sets), dtype=np.int64), points, (7, 10)) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if (common := len(np.intersect1d(sets[i], sets[j]))) * 10 >= 7 * (sizes[i] + sizes[j] - common)}
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < len(sets) * (len(sets) - 1) // 4


# 8


def test_ids_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = [None, "", " ", "   ", "a   b", "a\n b \n\n c", "it's 's", "<|endoftext|> hi", "é é 日本 🙂", "x  y\t z ", "tail ", LONG, "a  b", "one two", "one two"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab 1'é\n\t.,-s") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in token_ids(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (reference.encode(t, add_special_tokens=False).ids if t else []), repr(t)
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_store_may_overflow(monkeypatch):
    from tidemark.llm import encode

    replay = Replay("/opt/tokenizers/byte_bpe_50k.json")
    texts = [f"word{i} other{i} and more{i % 3}" for i in range(50)]
    whole = [x.tolist() for x in replay.encode(texts)]
    monkeypatch.setattr(encode, "REMEMBERED", 20)
    assert [x.tolist() for x in Replay("/opt/tokenizers/byte_bpe_50k.json").encode(texts)] == whole


# 9


def test_leaks_match_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(20)] + [(98, None), (99, "")]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(50)]
        if i % 3 == 0:
            p = items[rng.randrange(20)][1].split()
            a = rng.randint(0, max(0, len(p) - 13))
            text[10:10] = p[a : a + rng.randint(8, 20)]
        docs.append((i, ", ".join(text).upper() if i % 2 else "\n".join(text)))
    docs += [(100, None), (101, ""), (102, LONG), (0, docs[0][1])]
    gram = lambda t: {tuple(w[k : k + 12]) for w in [words(t)] for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, p in items if gram(t) & gram(p)}
    left, right = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, longest int"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r.longest for r in leaked_passages(left, "doc_id", "text", right, "item_id", "passage").collect()}
    assert set(got) == want and min(got.values()) >= 12
    blocks = {(r.doc_id, r.item_id) for r in leaked_passages(left, "doc_id", "text", right, "item_id", "passage", block_items=6).collect()}
    assert blocks == want
    assert leaked_passages(left.limit(0), "doc_id", "text", right, "item_id", "passage").count() == 0 == leaked_passages(left, "doc_id", "text", right.limit(0), "item_id", "passage").count()


def test_near_passages_match_brute_force(spark, monkeypatch):
    from tidemark.llm import leaks

    rng = random.Random(31)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 30)))) for i in range(12)] + [(98, None), (99, "")]
    docs = []
    for i in range(40):
        text = [rng.choice(vocabulary) for _ in range(40)]
        if i % 2:
            p = items[rng.randrange(12)][1].split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], ["other"], [p[k], "more"]])
            text[8:8] = p
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (0, docs[0][1])]

    def near(d, p):
        d, p = words(d), words(p)
        return any(sum(any(0 <= s + j + o < len(d) and d[s + j + o] == p[a + j] for o in range(-2, 3)) for j in range(12)) >= 10 for a in range(len(p) - 11) for s in range(-11, len(d)))

    want = {(i, k) for i, d in docs if d for k, p in items if p and near(d, p)}
    df, tests = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, found int"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r.found for r in leaks.near_passages(df, "doc_id", "text", tests, "item_id", "passage").collect()}
    assert set(got) == want and want and min(got.values()) >= 10
    exact = {(r.doc_id, r.item_id) for r in leaked_passages(df, "doc_id", "text", tests, "item_id", "passage").collect()}
    assert exact < set(got)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 50)
    assert {(r.doc_id, r.item_id) for r in leaks.near_passages(df, "doc_id", "text", tests, "item_id", "passage", block_items=5).collect()} == want


# 10


def test_spans_match_brute_force(spark):
    rng = random.Random(12)
    chars = "abcdefgh é"
    make = lambda n: "".join(rng.choice(chars) for _ in range(n))
    shared, docs = [make(n) for n in (299, 300, 301, 450, 900)], []
    for i in range(40):
        text = make(rng.randint(0, 400))
        if i % 2:
            s = shared[rng.randrange(5)]
            cut = rng.randint(0, 30) if len(s) > 400 else 0
            text = make(rng.randint(0, 200)) + s[cut:] + text
        docs.append((i, text))
    docs += [(50, "-" * 700), (51, "x" + "-" * 400), (52, None), (53, ""), (54, docs[1][1]), (55, LONG), (56, "lorem ipsum " * 40)]
    grams = {i: {t[k : k + 300] for k in range(min(len(t), 3000) - 299)} if t else set() for i, t in docs}
    want = {(a, b) for a, b in combinations(sorted(grams), 2) if grams[a] & grams[b]}
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, id int")
    got = [(r.a, r.b) for r in sharing_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (50, 51) in want
    share = {r.doc_id: r.shared_chars for r in shared_share(df, "doc_id", "text").collect()}
    for i, t in docs:
        if i == 55 or not t:
            continue
        others = set().union(*(g for j, g in grams.items() if j != i))
        covered = {k + d for k in range(len(t) - 299) if t[k : k + 300] in others for d in range(300)}
        assert share.get(i, 0) == len(covered), i
    assert sharing_pairs(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        sharing_pairs(df, "doc_id", "text", least=50)


def test_spans_of_other_lengths_and_split_followers_match_brute_force(spark):
    rng = random.Random(17)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    stock = make(150)  # in a third of all documents
    docs = [(i, make(rng.randint(0, 200)) + (stock[rng.randint(0, 40) :] if i % 3 == 0 else "") + make(rng.randint(0, 90))) for i in range(60)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "=" * 500), (103, "=" * 200), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least, unit in ((120, 2), (70, 20_000)):
        grams = {i: {t[k : k + least] for k in range(len(t) - least + 1)} for i, t in docs if i is not None}
        want = {(a, b) for a, b in combinations(sorted(grams), 2) if grams[a] & grams[b]}
        got = [(r.a, r.b) for r in sharing_pairs(df, "doc_id", "text", least, unit).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (102, 103) in want


def test_spans_come_from_the_automata(spark, monkeypatch):
    from tidemark.llm import spans

    text = "".join(random.Random(18).choice("abcdefgh ") for _ in range(500))
    df = spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")
    assert sharing_pairs(df, "doc_id", "text").count() == 1
    many = spans.compiled([f"{i:05d}" for i in range(spans.AUTOMATON + 1)])
    assert [len(a) for a in many] == [spans.AUTOMATON, 1]
    assert list(spans.core_keys(text, many, 300)) == [] and list(spans.core_keys(text, spans.compiled([text[200:300]]), 300))


# the queries against their SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    result = con.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


def test_no_query_is_cut():
    source = open(queries.__file__).read()
    assert not re.search(r"\.limit\(|\.sample\(|% ?\d", source)


def test_only_the_training_sample_is_bounded():
    folder = os.path.dirname(queries.__file__)
    found = {os.path.basename(p): len(re.findall(r"\.limit\(", open(p).read())) for p in glob.glob(f"{folder}/*.py")}
    assert {n: k for n, k in found.items() if k} == {"scans.py": 2}  # the ids of the sample, and the sample
    assert not any(re.search(r"localCheckpoint|crossJoin|\.sample\((?!places|\[)|\.rdd\b", open(p).read()) for p in glob.glob(f"{folder}/*.py"))
