"""Formulas on worked examples, edge cases, and every query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import predicates, text
from tidemark.operators import classify, detect, index, merge, similarity
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_config_weights_must_sum_to_one(tmp_path):
    with pytest.raises(ValueError):
        Config(weights={"intensity": 1.0})
    Config().save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == Config()
    assert Config.load(str(tmp_path / "none.json")) is None
    (tmp_path / "old.json").write_text('{"fortune500_csv": "m.csv", "of_no_use": 1}')
    assert Config.load(str(tmp_path / "old.json")) == Config(company_metadata_csv="m.csv")
    (tmp_path / "bad.json").write_text("[1]")
    assert Config.load(str(tmp_path / "bad.json")) is None


def test_traditional_robots_are_kept_if_wanted(spark):
    docs = spark.createDataFrame([(1, "Our warehouse robots moved pallets while the analytics team watched the chatbot.", "Annual Report")], "id int, text string, doc_type string")
    found = detect.detect_terms(docs, "id", "text")
    terms = lambda **k: {r.term for r in detect.score_mentions(found, config=Config(**k)).collect()}
    assert terms() == set() and terms(filter_traditional_robotics=False) == {"robots", "chatbot"}


def test_clean_keeps_product_names(spark):
    assert one(spark, text.clean(F.col("t")), t="OpenAI works.Well  done") == "OpenAI works. Well done"
    assert one(spark, text.clean(F.col("t")), t=None) is None


def test_file_name(spark):
    parts = text.file_name(F.col("n"))
    got = [one(spark, parts[k], n="38. Bank of America - 2024 - annual report.pdf") for k in ("position", "company", "year", "doc_type")]
    assert got == [38, "Bank of America", 2024, "Annual Report"]
    assert one(spark, parts["year"], n="x.pdf") == 2024


def test_corruption_and_chinese(spark):
    assert one(spark, text.corruption(F.col("t")), t="short") == "empty"
    assert one(spark, text.corruption(F.col("t")), t="word " * 50) == "valid"
    assert one(spark, text.corruption(F.col("t")), t="1234567 " * 50) == "low_letters"
    assert one(spark, text.is_chinese_version(F.col("t")), t="a - 2020_CN.pdf")
    assert not one(spark, text.is_chinese_version(F.col("t")), t="a - 2020_EN.pdf")


@pytest.mark.parametrize(
    "trigger, semantic, context, doc_type, expected",
    [("hard", 0.0, "we deployed a model with generative ai", "Annual Report", 1.0), ("soft", 0.0, "we explore this for esg", "Annual Report", 0.05), ("semantic", 0.72, "the model is here", "Annual Report", 0.846), ("soft", 0.0, "nothing", "Annual Report", 0.35)],
)
def test_confidence_examples(spark, trigger, semantic, context, doc_type, expected):
    score, _, _ = predicates.confidence(F.col("t"), F.col("s"), F.col("c"), F.col("d"))
    assert one(spark, F.round(score, 6), t=trigger, s=semantic, c=context, d=doc_type) == pytest.approx(expected)


def test_negation(spark):
    assert one(spark, predicates.negation(F.col("c")), c="The group does not use machine learning today.") == "hard"
    assert one(spark, predicates.negation(F.col("c")), c="AI systems may pose new risks to us.") == "soft"
    assert one(spark, predicates.negation(F.col("c")), c="We use AI.") == "none"


def test_detect_first_term_at_each_start(spark):
    docs = spark.createDataFrame([(1, "We like generative AI. RAG-like is no hit, AI-powered is. AI AI"), (2, None), (3, "")], "id int, text string")
    rows = [(r.id, r.sentence_no, r.start, r.term) for r in detect.detect_terms(docs, "id", "text").orderBy("sentence_no", "start").collect()]
    assert rows == [(1, 0, 8, "generative AI"), (1, 0, 19, "AI"), (1, 1, 20, "AI-powered"), (1, 2, 0, "AI"), (1, 2, 3, "AI")]
    marked = detect.detect_terms(docs, "id", "text").orderBy("sentence_no", "start").first()["marked"]
    assert ">>>generative AI<<<" in marked


@pytest.mark.parametrize("n, confidence", [(1, 0.133333), (2, 0.266667), (3, 0.4), (5, 0.666667), (8, 1.0)])
def test_keyword_ladder(spark, n, confidence):
    words = [f"kw{i}" for i in range(8)]
    taxonomy = [("eu", "E1", "D", words, []), ("eu", "E2", "D", ["other"], [])]
    best = classify.best_category(F.col("t"), "eu", None, "Unclassified", taxonomy)
    assert one(spark, F.round(best["confidence"], 6), t=" ".join(words[:n])) == pytest.approx(confidence)
    assert one(spark, best["code"], t="nothing") == "Unclassified"


def _mentions(spark, rows):
    names = "company string, year int, context string, category_a string, category_b string, eu_subdomain string, sentiment_score double, semantic_score double, confidence_score double, reference_strength string"
    return spark.createDataFrame(rows, names)


def test_index_examples(spark):
    rows = [("x", 2020, "", a, "none", "E1", 0.4, s, w, "strong") for a, s, w in (("A1", 0.7, 1.0), ("A2", 0.9, 1.0), ("A3", None, 1.0), ("A4", float("nan"), 1.0))] + [("x", 2020, "", "A5", "none", "E1", 0.4, 0.9, 1.0, "mention_only")]
    pages = spark.createDataFrame([("x", 2020, 50)], "company string, year int, total_pages bigint")
    r = index.adoption_index(_mentions(spark, rows), ["company", "year"], pages).first()
    assert r.intensity_index == pytest.approx(0.8) and r.semantic_index == pytest.approx(0.8) and r.sentiment_index == pytest.approx(0.7)
    assert r.diversity_index == pytest.approx(2 / math.log2(15)) and r.diversity_index_eu == 0 and r.total_refs == 4
    assert r.ai_adoption_index - r.ai_adoption_index_eu == pytest.approx(15 * r.diversity_index)
    nothing = index.adoption_index(_mentions(spark, []), ["company", "year"], pages)
    assert nothing.count() == 0


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 120)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.id: r.component for r in merge.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 120)} == {100} and got[301] == got[300] == 300
    assert merge.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_upsert_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, None, "a", "x", 0.1), (2, None, "b", "", 0.5), (3, "k", None, None, None)], "id int, k string, v string, r string, c double")
    got = {x.k: x for x in merge.upsert(rows, ["k"], [F.col("id")], ["v"], [], ["c"], ["r"]).collect()}
    assert (got[None].v, got[None].c, got[None].r, got[None].occurrence_count) == ("a", 0.5, "x", 2) and got["k"].v is None


def test_similar_in_groups_matches_all_pairs(spark):
    import random

    rng = random.Random(1)
    vectors = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, 0, None), (61, None, [1.0] * 4)]
    got = {(r.a, r.b) for r in similarity.similar_in_groups(spark.createDataFrame(vectors, "id int, g int, v array<double>"), "id", "g", "v", 0.6).collect()}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, _, v in vectors if v}
    want = {(i, j) for i, g, v in vectors for j, h, u in vectors if v and u and i < j and g == h and g is not None and sum(x * y for x, y in zip(unit[i], unit[j])) >= 0.6}
    assert got == want


def test_sources_and_sinks(spark, tmp_path):
    from tidemark.sources import files, sinks

    for n in ("1. A - 2020 - Proxy.pdf", "7. B - 2020_CN.pdf", "300. C.pdf", "none.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = {r.source for r in files.list_filings(spark, str(tmp_path), positions=(1, 200)).collect()}
    assert got == {"1. A - 2020 - Proxy.pdf"}
    (tmp_path / "m.csv").write_text("Name,Rank,Sector,Industry\nAcme,1,S,I\nacme,2,,J\n,3,x,y\n")
    row = files.company_metadata(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.key, r.position, r.sector, r.industry, r.country) for r in row] == [("acme", 2, "Unknown", "J", "Unknown")]
    mapping = files.industry_mapping(spark, str(tmp_path / "m.csv"))
    base = spark.createDataFrame([("ACME", "old"), ("other", "old")], "company string, industry string")
    assert {(r.company, r.industry) for r in files.with_industry(base, mapping).collect()} == {("ACME", "J"), ("other", "old")}
    sinks.write_sheet(spark.createDataFrame([("a\x01b", 1.23456)], "t string, x double"), str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).first()["x"] == "1.235"


@pytest.mark.parametrize(
    "context, made",
    [
        ("Our robots move pallets.", "traditional_robotics"), ("Autonomous robots move pallets.", "ai_robotics"), ("Industrial robots, and intelligent people.", "traditional_robotics"), ("Robots with predictive control.", "ai_robotics"),
        ("Robots that use AI.", "ai_robotics"), ("We said that robots were repaired.", "traditional_robotics"), ("No machines here.", "not_robotics"),
    ],
)
def test_robotics(spark, context, made):
    assert one(spark, predicates.robotics_class(F.col("c")), c=context) == made


@pytest.mark.parametrize(
    "context, made",
    [("RPA runs the invoices.", "traditional_rpa"), ("RPA with machine learning runs them.", "ai_rpa"), ("Hyperautomation.", "not_rpa"), ("RPA beside cognitive tools.", "not_rpa"), ("Cognitive staff run robotic process automation.", "traditional_rpa"), ("Nothing.", "not_rpa")],
)
def test_rpa(spark, context, made):
    assert one(spark, predicates.rpa_class(F.col("c")), c=context) == made


@pytest.mark.parametrize(
    "context, kind",
    [("We have no plans to use AI in stores.", "hard"), ("None of our products currently use any AI.", "hard"), ("AI is not material to us.", "hard"), ("If our AI should fail, we may lose clients.", "soft"), ("Legal uncertainty around AI persists.", "soft"), ("AI may not prove useful.", "soft"), ("We trained bias-free models with AI.", "none")],
)
def test_negation_rules(spark, context, kind):
    assert one(spark, predicates.negation(F.col("c")), c=context) == kind


def test_exclusions(spark):
    false = lambda term, context: one(spark, predicates.false_positive(F.col("t"), F.col("c")), t=term, c=context)
    assert false("AI", "The AI lab.") and not false("AI", "The AI lab trains a chatbot.") and not false("AI", "The main AI chatbot gained users.") and false("AI", "MAIN AI chatbot.")
    assert false("ML", "9.5 ML of water for a chatbot.") and false("AI", "A chatbot at example.ai now.") and false("AI", "Directors have experience with AI and a chatbot.") and false("embedding", "embedding sustainability in all we do")


def test_maturity_needs_the_term_beside_the_verb(spark):
    rows = [("x", 2020, t, "A1", "none", "E1", None, None, 1.0, "strong") for t in ("We deployed trucks. Elsewhere, far from there, people talk about many other things and AI.", "We deployed AI in claims.")]
    pages = spark.createDataFrame([("x", 2020, 50)], "company string, year int, total_pages bigint")
    assert index.adoption_index(_mentions(spark, rows[:1]), ["company", "year"], pages).first().maturity_index == 0
    assert index.adoption_index(_mentions(spark, rows), ["company", "year"], pages).first().maturity_index == pytest.approx(0.6)


def test_context_keeps_its_term_in_long_sentences(spark):
    docs = spark.createDataFrame([(1, "word " * 900 + "a generative AI model " + "word " * 900)], "id int, text string")
    rows = detect.detect_terms(docs, "id", "text").collect()
    assert rows and all("generative AI" in r.context and "word word" in r.context for r in rows)


def test_semantic_paragraphs(spark):
    from tidemark.operators import semantic

    near = "deep learning neural network neural networks " * 4
    docs = spark.createDataFrame([(1, near + "\n\n" + "plain words about nothing at all " * 6, "x"), (2, None, "x"), (3, "", "x")], "id int, text string, doc_type string")
    rows = semantic.detect_paragraphs(docs, "id", "text").collect()
    assert [(r.id, r.sentence_no, r.trigger) for r in rows] == [(1, 0, "semantic")] and rows[0].semantic_score > 0.68


def test_extraction_cascade(spark):
    from tidemark.sources import extraction

    good = ("A readable page with enough words to be sound. " * 6).encode()

    def broken(content: bytes) -> list[str]:
        raise ValueError("damaged")

    ocr = lambda content: ["Recognised words of a scanned page, one after the other. " * 5] * 30
    files = spark.createDataFrame([("good", good), ("none", b""), ("digits", b"12345 " * 60), ("null", None)], "source string, content binary")
    got = {r.source: r for r in extraction.extract_texts(files, [broken, extraction.read_plain], ocr).collect()}
    assert (got["good"].text_status, got["none"].text_status, got["null"].text_status, got["digits"].text_status) == ("valid", "empty", "empty", "corrupted_ocr_success")
    assert got["digits"].text.count("\n") == extraction.OCR_PAGES - 1
    assert {r.source: r.text_status for r in extraction.extract_texts(files, [extraction.read_plain]).collect()}["digits"] == "corrupted_ocr_failed"
    assert extraction.error_rows(files.select("source"), "x").where("text_status = 'error'").count() == 4


def test_tables_and_replacement(spark):
    from tidemark.sources import schemas

    kind = schemas.TABLES["adoption_index_industry"].columns
    row = lambda mean, year: ("i", year, mean, 1, 1, 0.0, 0.0, 0.0, "c", 1)
    old, new = spark.createDataFrame([row(1.0, 2020), row(2.0, 2021)], kind), spark.createDataFrame([row(3.0, 2020)], kind)
    got = {r.year: r.ai_adoption_index_avg for r in schemas.replaced(old, new, "adoption_index_industry", "num_companies").collect()}
    assert got == {2020: 3.0, 2021: 2.0}
    assert all(set(t.key) | set(t.partitions) <= {f.name for f in spark.createDataFrame([], t.columns).schema} for t in schemas.TABLES.values())


def test_modes_of_a_run(spark):
    from tidemark.plans import pipeline

    filings = spark.createDataFrame([("1. A - 2020.pdf",), ("7. B - 2021.pdf",), ("C.pdf",)], "source string")
    done = filings.where("source = 'C.pdf'")
    names = lambda **k: {r.source for r in pipeline.chosen(filings, processed=done, **k).collect()}
    assert len(names()) == 3 and names(mode="range", positions=(2, 9)) == {"7. B - 2021.pdf"} and names(mode="again") == {"C.pdf"} and names(mode="new") == {"1. A - 2020.pdf", "7. B - 2021.pdf"} and names(mode="batch", batch=1) == {"7. B - 2021.pdf"}
    with pytest.raises(ValueError):
        pipeline.chosen(filings, "some")


def test_sentiment_of_short_texts_and_other_scorers(spark):
    from tidemark.operators import sentiment

    rows = spark.createDataFrame([(1, "risk"), (2, "The risk of delays and defects grows."), (3, None), (4, "A decline in fairness, and delays."), (5, "A decline and a lawsuit about delays.")], "id int, t string")
    got = {r.id: (r.label, r.flag) for r in sentiment.corrected(sentiment.scored(rows, "t"), "t").collect()}
    assert got == {1: ("neutral", "standard"), 2: ("negative", "standard"), 3: ("neutral", "standard"), 4: ("negative", "governance_adjusted"), 5: ("negative", "confirmed_negative")}
    got = {r.id: r.label for r in sentiment.scored(rows, "t", lambda texts: [1.0] * len(texts)).collect()}
    assert got == {1: "neutral", 2: "positive", 3: "neutral", 4: "positive", 5: "positive"}


def test_workbook_log_and_anchors(spark, tmp_path):
    from tidemark.config import setup_logging
    from tidemark.sources import sinks

    rows = spark.createDataFrame([("x", 2020, "i", 55.5, 3), ("y", 2020, "Unknown", None, 4)], "company string, year int, industry string, ai_adoption_index double, total_refs int")
    sinks.write_workbook(sinks.index_workbook(rows, sinks.provenance({"a": 1}, "abc")), str(tmp_path / "book"))
    read = lambda n: spark.read.csv(str(tmp_path / "book" / n), header=True).collect()
    assert {(r.company, r.band) for r in read("index")} == {("x", "green"), ("y", "none")} and read("by_year")[0].top_company == "x" and [r.industry for r in read("by_industry")] == ["i"] and {r["name"] for r in read("metadata")} == {"generated_at", "git_commit", "settings"}
    log = setup_logging(str(tmp_path / "run.log"))
    assert len(setup_logging(str(tmp_path / "run.log")).handlers) == len(log.handlers) == 2
    vectors = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5 - 2), 1.0]) for i in range(40)] + [(99, None)], "id bigint, v array<double>")
    one, many = ({(r.id, r.anchor, round(r.similarity, 9)) for r in similarity.nearest_anchor(vectors, "id", "v", vectors.where("id < 30"), "id", "v", n).collect()} for n in (1000, 4))
    assert one == many and len(one) == 40 and similarity.nearest_anchor(vectors, "id", "v", vectors.limit(0), "id", "v").count() == 0


def test_whole_pipeline_merges_repeats(spark):
    from tidemark.operators.semantic import hashed_vectors
    from tidemark.plans import pipeline

    text = "We deployed a generative AI chatbot in claims handling, which trained staff now use every day of the week. It answers most questions."
    rows = [("a.pdf", text, "X", 2020, "Annual Report", 10), ("b.pdf", text + " Truly.", "X", 2020, "Proxy", 5), ("c.pdf", None, "X", 2020, "Proxy", 5)]
    made = pipeline.run(spark.createDataFrame(rows, "source string, text string, company string, year int, doc_type string, total_pages int"), embed=hashed_vectors)
    merged = made.merged().collect()
    assert made.mentions.count() > len(merged) == 1 and merged[0].sources == "Annual Report;Proxy"
    assert {r.source: r.total_refs for r in made.counters.collect()}["c.pdf"] == 0 and made.by_doc_type.count() == 2 and made.index.first().total_pages == 20


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, abs=1e-6)
    return a == b


def test_codes_of_both_axes_are_counted(spark, duck):
    want = {}
    for axis in "ab":
        held = [(x or "").strip(" ").upper() for (x,) in duck.execute(f"select category_{axis} from mentions").fetchall()]
        want |= {(axis, code): held.count(code) for (code,) in duck.execute(f"select code from taxonomy_codes where axis = '{axis}'").fetchall()}
    got = {(r.axis, r.code): r.n for r in catalogue.QUERIES["keyword_lookup"](spark, SF).collect()}
    assert got == want and got["b", "B1"] > 0


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda row: [("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in row]
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
