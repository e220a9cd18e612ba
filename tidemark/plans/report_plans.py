"""Queries of joins, merges, indices, roll-ups, ranks and pivots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark import vocabulary as v
from tidemark.functions import text as t
from tidemark.operators import index, merge, sentiment, similarity
from tidemark.sources.tables import spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


c = F.col
_CODE = lambda x: F.coalesce(F.nullif(F.nullif(F.upper(F.trim(x)), F.lit("")), F.lit("NONE")), F.lit("none"))


# merges


@_query("""
SELECT company, year, doc_type, page, text, count(*) AS occurrence_count, arg_min_null(context, mention_id) AS context, arg_min_null(category_a, mention_id) AS category_a, arg_max_null(CASE WHEN isnan(semantic_score) THEN NULL ELSE semantic_score END, mention_id) AS semantic_score,
  max(confidence_score) AS confidence_score, arg_max(confidence_reasons, mention_id) FILTER (confidence_reasons <> '') AS confidence_reasons FROM mentions GROUP BY company, year, doc_type, page, text""")
def upsert_merge(spark: SparkSession, base: str) -> DataFrame:
    keys = ["company", "year", "doc_type", "page", "text"]
    rows = table(spark, base, "mentions", *keys, "mention_id", "context", "category_a", "semantic_score", "confidence_score", "confidence_reasons")
    rows = rows.withColumns({x: F.nanvl(x, F.lit(None).cast("double")) for x in ("semantic_score", "confidence_score")})
    return merge.upsert(rows, keys, [c("mention_id")], ["context", "category_a"], ["semantic_score"], ["confidence_score"], ["confidence_reasons"])


@_query("SELECT user_id, event_type, count(*) AS occurrence_count, arg_min_null(event_id, (ts, event_id)) AS event_id, arg_max_null(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY ALL")
def upsert_merge_events(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events", "user_id", "event_type", "event_id", "value", "ts")
    return merge.upsert(rows, ["user_id", "event_type"], [c("ts"), c("event_id")], ["event_id"], ["value"], ["ts"])


@_query("SELECT source, count(*) AS times, sum(process_count) AS process_count, arg_max(file_hash, last_processed_at) FILTER (file_hash IS NOT NULL) AS file_hash, arg_max_null(refs_found, last_processed_at) AS refs_found, min(first_processed_at) AS first_processed_at FROM processed_documents GROUP BY source")
def process_count_merge(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "processed_documents", "source", "process_count", "file_hash", "refs_found", "first_processed_at", "last_processed_at")
    return rows.groupBy("source").agg(
        F.count("*").alias("times"), F.sum("process_count").alias("process_count"), F.max(F.when(c("file_hash").isNotNull(), F.struct("last_processed_at", "file_hash")))["file_hash"].alias("file_hash"),
        F.max_by(F.struct("refs_found"), "last_processed_at")["refs_found"].alias("refs_found"), F.min("first_processed_at").alias("first_processed_at"),
    )


@_query("SELECT company, year, context, mention_id FROM (SELECT *, row_number() OVER (PARTITION BY company, year, context ORDER BY mention_id) AS k FROM mentions) WHERE k = 1")
def insert_ignore(spark: SparkSession, base: str) -> DataFrame:
    return merge.first_of_each(table(spark, base, "mentions", "company", "year", "context", "mention_id"), ["company", "year", "context"], [c("mention_id")])


# joins


@_query("SELECT DISTINCT m.company, m.year FROM mentions m WHERE m.company IS NOT NULL AND NOT EXISTS (SELECT 1 FROM adoption_index a WHERE a.company = m.company AND a.year = m.year)")
def pending_index_anti(spark: SparkSession, base: str) -> DataFrame:
    wanted = table(spark, base, "mentions", "company", "year").where("company is not null").distinct()
    return wanted.join(table(spark, base, "adoption_index", "company", "year"), ["company", "year"], "left_anti")


@_query("SELECT source, count(*) AS n FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM processed_documents p WHERE p.source = m.source) AND source IS NOT NULL GROUP BY source")
def orphan_sources(spark: SparkSession, base: str) -> DataFrame:
    counts = table(spark, base, "mentions", "source").dropna().groupBy("source").agg(F.count("*").alias("n"))
    return counts.join(table(spark, base, "processed_documents", "source"), "source", "left_anti")


@_query("""
WITH m AS (SELECT lower(trim(company, ' ')) AS k, arg_max_null(sector, line_no) AS sector, arg_max_null(industry, line_no) AS industry, arg_max_null(country, line_no) AS country, arg_max_null(position, line_no) AS position FROM company_metadata WHERE company IS NOT NULL GROUP BY 1)
SELECT index_id, company, coalesce(m.sector, 'Unknown') AS sector, coalesce(m.industry, a.industry, 'Unknown') AS industry, coalesce(m.country, 'Unknown') AS country, coalesce(m.position, 0) AS position FROM adoption_index a LEFT JOIN m ON lower(trim(a.company, ' ')) = m.k""")
def metadata_overlay_join(spark: SparkSession, base: str) -> DataFrame:
    meta = table(spark, base, "company_metadata").where("company is not null").groupBy(F.lower(F.trim("company")).alias("k"))
    last = meta.agg(F.max_by(F.struct("sector", "industry", "country", "position"), "line_no").alias("m"))
    rows = table(spark, base, "adoption_index", "index_id", "company", "industry").withColumn("k", F.lower(F.trim("company")))
    unknown = F.lit("Unknown")
    return rows.join(last, "k", "left").select("index_id", "company", F.coalesce("m.sector", unknown).alias("sector"), F.coalesce("m.industry", "industry", unknown).alias("industry"), F.coalesce("m.country", unknown).alias("country"), F.coalesce("m.position", F.lit(0)).alias("position"))


@_query("""
WITH f AS (SELECT DISTINCT source, lower(regexp_replace(source, '(?i)\\.pdf$', '')) AS stem FROM documents WHERE source IS NOT NULL),
k AS (SELECT lower(trim(company, ' ')) AS k, min(line_no) AS line FROM company_metadata WHERE trim(company, ' ') <> '' GROUP BY 1),
n AS (SELECT source, arg_min(k, line) AS company_key, min(line) AS line, 'name' AS how FROM f JOIN k ON contains(stem, k) GROUP BY source),
ft AS (SELECT DISTINCT source, unnest(string_split_regex(stem, '[ _-]')) AS token FROM f WHERE source NOT IN (SELECT source FROM n)), kt AS (SELECT k, line, unnest(string_split(k, ' ')) AS token FROM k),
t AS (SELECT source, arg_min(k, line) AS company_key, min(line) AS line, 'token' AS how FROM ft JOIN kt USING (token) WHERE length(token) > 3 GROUP BY source)
SELECT * FROM n UNION ALL SELECT * FROM t""")
def company_substring_match(spark: SparkSession, base: str) -> DataFrame:
    """The first company, in order of the file, whose name stands in a file name; else the first that has a word of more than
    three letters among the words of the file name. Names are found by their first four characters, so that nothing is
    compared with everything."""
    names = table(spark, base, "company_metadata", "company", "line_no").where(F.trim("company") != "").groupBy(F.lower(F.trim("company")).alias("k")).agg(F.min("line_no").alias("line"))
    stems = table(spark, base, "documents", "source").dropna().distinct().withColumn("stem", F.lower(F.regexp_replace("source", r"(?i)\.pdf$", "")))
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: c("stem").substr(i, n))))
    pairs = stems.where("length(stem) > 0").select("source", "stem", F.explode(F.array_distinct(starts)).alias("start")).join(names.withColumn("start", F.substring("k", 1, 4)), "start").where(c("stem").contains(c("k")))
    first = lambda rows, how: rows.groupBy("source").agg(F.min(F.struct("line", "k")).alias("m")).select("source", c("m.k").alias("company_key"), c("m.line").alias("line"), F.lit(how).alias("how"))
    found = first(pairs, "name")
    token = lambda rows, text, split: rows.withColumn("token", F.explode(F.array_distinct(F.split(text, split)))).where(F.length("token") > 3)
    rest = token(stems.join(found, "source", "left_anti"), "stem", "[ _-]").select("source", "token").join(token(names, "k", " "), "token")
    return found.unionByName(first(rest, "token"))


@_query("""
WITH m AS (SELECT lower(trim(company, ' ')) AS k, arg_max(industry, line_no) AS industry FROM company_metadata WHERE company IS NOT NULL AND industry IS NOT NULL GROUP BY 1)
SELECT index_id, company, coalesce(m.industry, a.industry) AS industry, m.industry IS NOT NULL AND m.industry IS DISTINCT FROM a.industry AS changed FROM adoption_index a LEFT JOIN m ON lower(trim(a.company, ' ')) = m.k""")
def industry_update(spark: SparkSession, base: str) -> DataFrame:
    from tidemark.sources.files import with_industry

    mapping = table(spark, base, "company_metadata", "company", "industry", "line_no").dropna().groupBy(F.lower(F.trim("company")).alias("key")).agg(F.max_by("industry", "line_no").alias("industry"))
    rows = table(spark, base, "adoption_index", "index_id", "company", "industry").withColumn("before", c("industry"))
    return with_industry(rows, mapping).select("index_id", "company", "industry", (~c("industry").eqNullSafe(c("before"))).alias("changed"))


@_query("SELECT DISTINCT d.company, d.year FROM documents d WHERE d.company IS NOT NULL AND d.year IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.company = d.company AND m.year = d.year)")
def pending_dedup_anti(spark: SparkSession, base: str) -> DataFrame:
    wanted = table(spark, base, "documents", "company", "year").dropna().distinct()
    return wanted.join(table(spark, base, "mentions", "company", "year"), ["company", "year"], "left_anti")


@_query("SELECT DISTINCT source FROM documents d WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM processed_documents p WHERE p.source = d.source) ORDER BY source DESC LIMIT 25")
def batch_newest(spark: SparkSession, base: str) -> DataFrame:
    """The last 25 filings, by name, that were not processed: the size of the batch is the feature."""
    names = table(spark, base, "documents", "source").dropna().distinct().join(table(spark, base, "processed_documents", "source"), "source", "left_anti")
    return names.orderBy(c("source").desc()).limit(25)


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def customers_without_urgent(spark: SparkSession, base: str) -> DataFrame:
    urgent = table(spark, base, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority like '1%'")
    return table(spark, base, "customer", "c_custkey").join(urgent, c("c_custkey") == c("o_custkey"), "left_anti")


# similarity


@_query("""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.3""")
def cosine_pairs(spark: SparkSession, base: str) -> DataFrame:
    return similarity.similar_in_groups(table(spark, base, "embeddings"), "vec_id", "label", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


@_query("""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), s AS (
  SELECT u.vec_id, x.vec_id AS anchor, list_dot_product(u.v, x.v) AS s FROM u JOIN (SELECT * FROM u WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) x ON true
), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, anchor) AS k FROM s)
SELECT vec_id, anchor, round(s, 6) AS similarity, s >= CASE WHEN anchor % 2 = 0 THEN 0.60 ELSE 0.68 END AS is_hit FROM r WHERE k = 1""")
def anchor_max_similarity(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "embeddings")
    anchors = rows.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("a")).select("a.vec_id", "a.embedding")
    best = similarity.nearest_anchor(rows, "vec_id", "embedding", anchors, "vec_id", "embedding")
    threshold = F.when(c("anchor") % 2 == 0, 0.60).otherwise(0.68)
    return best.select("vec_id", "anchor", F.round("similarity", 6).alias("similarity"), (c("similarity") >= threshold).alias("is_hit"))


_COMPONENTS = """
WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.3),
r AS (SELECT vec_id AS id, vec_id AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE r.root < e.b),
k AS (SELECT id AS vec_id, min(root) AS component FROM r GROUP BY id)
"""


def _components(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "embeddings")
    pairs = similarity.similar_in_groups(rows, "vec_id", "label", "embedding", 0.3)
    joined = merge.components(pairs)
    return rows.select("vec_id", "label").join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))


@_query(_COMPONENTS + "SELECT vec_id, component FROM k")
def dedup_components(spark: SparkSession, base: str) -> DataFrame:
    return _components(spark, base).select("vec_id", "component")


@_query(_COMPONENTS + "SELECT count(*) AS n_rows, count(DISTINCT component) AS n_clusters, round(1 - count(DISTINCT component) / count(*), 6) AS reduction FROM k")
def dedup_reduction(spark: SparkSession, base: str) -> DataFrame:
    return _components(spark, base).agg(F.count("*").alias("n_rows"), F.countDistinct("component").alias("n_clusters")).withColumn("reduction", F.round(1 - c("n_clusters") / c("n_rows"), 6))


_CLUSTERS = """
WITH RECURSIVE w AS (SELECT mention_id, company, year, unnest(regexp_extract_all(lower(regexp_replace(context, '>>>(.*?)<<<', '\\1', 'g')), '[\\p{L}\\p{N}]+')) AS word FROM mentions WHERE company IS NOT NULL AND context IS NOT NULL),
t AS (SELECT mention_id, company, year, word, count(*)::DOUBLE AS n FROM w GROUP BY ALL), z AS (SELECT mention_id, sqrt(sum(n * n)) AS z FROM t GROUP BY 1),
d AS (SELECT a.mention_id AS a, b.mention_id AS b, sum(a.n * b.n) AS d FROM t a JOIN t b ON a.company = b.company AND a.year = b.year AND a.word = b.word AND a.mention_id < b.mention_id GROUP BY ALL),
e0 AS (SELECT d.a, d.b FROM d JOIN z x ON x.mention_id = d.a JOIN z y ON y.mention_id = d.b WHERE d.d / (x.z * y.z) >= 0.85 - 1e-12), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
v AS (SELECT mention_id FROM mentions WHERE company IS NOT NULL AND year IS NOT NULL), r AS (SELECT mention_id AS id, mention_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE r.root < e.b),
k AS (SELECT id AS mention_id, min(root) AS cluster FROM r GROUP BY 1)
"""


def _clusters(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    from tidemark.plans.pipeline import with_clusters

    rows = table(spark, base, "mentions", "mention_id", "company", "year", "context", *columns).where("company is not null and year is not null")
    return with_clusters(rows.withColumn("plain", t.unmarked(c("context"))), "mention_id", ["company", "year"], "plain", 0.85).drop("plain")


@_query(_CLUSTERS + "SELECT mention_id, cluster FROM k")
def dedup_clusters(spark: SparkSession, base: str) -> DataFrame:
    return _clusters(spark, base).select("mention_id", "cluster")


_MERGED = _CLUSTERS + """, x AS (
SELECT cluster, arg_max_null(m.mention_id, (CASE WHEN isnan(confidence_score) THEN -1 ELSE coalesce(confidence_score, -1) END, CASE WHEN isnan(semantic_score) THEN -1 ELSE coalesce(semantic_score, -1) END, coalesce(length(context), 0), -m.mention_id)) AS representative,
  array_to_string(list_sort(list_distinct(list(doc_type))), ';') AS sources, count(DISTINCT doc_type) AS doc_count, sum(occurrence_count)::BIGINT AS total_occurrences, avg(CASE WHEN NOT isnan(sentiment_score) THEN sentiment_score END) AS avg_sentiment_score,
  coalesce(avg(CASE WHEN semantic_score > 0 AND NOT isnan(semantic_score) THEN semantic_score END), 0) AS avg_semantic_score, avg(CASE WHEN NOT isnan(confidence_score) THEN confidence_score END) AS avg_confidence_score, count(*) AS n_rows
FROM k JOIN mentions m USING (mention_id) GROUP BY cluster)"""


def _merged(spark: SparkSession, base: str) -> DataFrame:
    rows = _clusters(spark, base, "doc_type", "occurrence_count", "sentiment_score", "semantic_score", "confidence_score")
    return merge.merge_clusters(rows, "cluster", "mention_id", "confidence_score", "semantic_score", "context", "doc_type", "occurrence_count", "sentiment_score")


_SCORES = ("avg_sentiment_score", "avg_semantic_score", "avg_confidence_score")


@_query(_MERGED + f" SELECT cluster, representative, sources, doc_count, total_occurrences, n_rows, {', '.join(f'round({x}, 6) AS {x}' for x in _SCORES)} FROM x")
def dedup_merge(spark: SparkSession, base: str) -> DataFrame:
    return _merged(spark, base).select("cluster", "representative", "sources", "doc_count", "total_occurrences", "n_rows", *[F.round(x, 6).alias(x) for x in _SCORES])


@_query(_MERGED + """ SELECT m.company, m.year, m.text, 'aggregated' AS reference_strength, 0.0::DOUBLE AS confidence_score, x.doc_count, x.total_occurrences, round(x.avg_sentiment_score, 6) AS avg_sentiment_score, round(x.avg_semantic_score, 6) AS avg_semantic_score FROM x JOIN mentions m ON m.mention_id = x.representative""")
def export_dedup_rows(spark: SparkSession, base: str) -> DataFrame:
    named = table(spark, base, "mentions", "mention_id", "company", "year", "text").withColumnRenamed("mention_id", "representative")
    constant = [F.lit("aggregated").alias("reference_strength"), F.lit(0.0).alias("confidence_score")]
    return _merged(spark, base).join(named, "representative").select("company", "year", "text", *constant, "doc_count", "total_occurrences", F.round("avg_sentiment_score", 6).alias("avg_sentiment_score"), F.round("avg_semantic_score", 6).alias("avg_semantic_score"))


# the index


def _index_rows(spark: SparkSession, base: str) -> DataFrame:
    rows = spread(table(spark, base, "mentions", "company", "year", "doc_type", "source", "context", "category_a", "category_b", "eu_subdomain", "sentiment_score", "semantic_score", "confidence_score", "reference_strength", "detection_method")).where("company is not null")
    decoded = t.decoded_detection(c("detection_method"))["strength"]
    return rows.withColumns({"category_a": _CODE("category_a"), "category_b": _CODE("category_b"), "context": F.regexp_replace(t.unmarked(c("context")), r"\s+", " "), "reference_strength": F.coalesce(F.nullif("reference_strength", F.lit("unknown")), decoded, F.lit("unknown"))})


def _pages(spark: SparkSession, base: str, keys: list[str]) -> DataFrame:
    once = table(spark, base, "processed_documents", "source", "total_pages", "last_processed_at").groupBy("source").agg(F.max("total_pages").alias("total_pages"))
    sources = table(spark, base, "mentions", "source", *keys).where("company is not null and source is not null").distinct()
    return sources.join(once, "source").groupBy(*keys).agg(F.sum("total_pages").cast("bigint").alias("total_pages"))


_DIMS = [f"{d}_index" for d in index.DIMENSIONS] + ["diversity_index_eu", "ai_adoption_index", "ai_adoption_index_eu"]
_COUNTS = ["total_refs", "total_pages", "categories_used", "categories_used_eu"]


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(d, 6).alias(d) for d in _DIMS], *[c(x).cast("bigint").alias(x) for x in _COUNTS])


def _q(s: str) -> str:
    return s.replace("'", "''")


def _n(cores: list[str]) -> str:
    return f"len(regexp_extract_all(ctx, '{_q(v.exists(*cores))}'))"


def _index_sql(keys: list[str], rows: str = "mentions", first: str = "", page_rows: str = "") -> str:
    k = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in keys)
    stages = ", ".join(f"{_n(cores)} AS m_{n}" for n, (_, cores) in v.MATURITY.items())
    stage_sum = " + ".join(f"sum(m_{n} * w)" for n in v.MATURITY)
    scored = " + ".join(f"{s}::DOUBLE * sum(m_{n} * w)" for n, (s, _) in v.MATURITY.items())
    commit = " + ".join(f"{_n(cores)} * {w}::DOUBLE" for w, cores in v.COMMITMENT.values())
    ent = lambda label, n, none, name: f"""{name} AS (SELECT {k}, greatest(0, (log2(sum(w)) - sum(w * log2(w)) / sum(w)) / log2({n})) AS e, count(*) AS labels FROM (SELECT {k}, label, sum(w) AS w FROM (SELECT {k}, w, {label} AS label FROM r) WHERE label IS NOT NULL AND label NOT IN ({none}) GROUP BY ALL) GROUP BY ALL)"""
    page_sql = page_rows or f"p AS (SELECT {k}, sum(total_pages)::BIGINT AS pages FROM (SELECT DISTINCT source, {k} FROM mentions WHERE company IS NOT NULL AND source IS NOT NULL) JOIN (SELECT source, max(total_pages) AS total_pages FROM processed_documents GROUP BY source) USING (source) GROUP BY ALL)"
    rate = lambda x, f: f"CASE WHEN coalesce(p.pages, 0) > 0 THEN least(1.0::DOUBLE, {x} / p.pages * {f}) ELSE 0 END"
    comp = lambda d: " + ".join(f"{w * 100}::DOUBLE * {d if n == 'diversity' else n + '_index'}" for n, w in (("intensity", .15), ("semantic", .2), ("diversity", .15), ("sentiment", .15), ("maturity", .15), ("future", .1), ("commitment", .1)))
    return f"""
WITH {first} r0 AS (SELECT {k}, regexp_replace(regexp_replace(coalesce(context, ''), '>>>(.*?)<<<', '\\1', 'g'), '\\s+', ' ', 'g') AS ctx, coalesce(nullif(nullif(upper(trim(category_a, ' ')), ''), 'NONE'), 'none') AS ca, coalesce(nullif(nullif(upper(trim(category_b, ' ')), ''), 'NONE'), 'none') AS cb, eu_subdomain,
  CASE WHEN isnan(sentiment_score) THEN NULL ELSE sentiment_score END AS x, CASE WHEN isnan(semantic_score) THEN 0 ELSE semantic_score END AS s, CASE WHEN confidence_score > 0 THEN confidence_score ELSE 1.0 END AS w,
  coalesce(nullif(reference_strength, 'unknown'), nullif(regexp_extract(detection_method, '(?:^|\\|)strength=([a-z_]+)', 1), ''), 'unknown') AS strength FROM {rows} WHERE company IS NOT NULL),
r AS (SELECT *, {stages}, regexp_matches(ctx, '{_q(v.exists(*v.FUTURE))}') AS fut, {commit} AS com FROM r0 WHERE strength <> 'mention_only'),
{ent("unnest([ca, cb])", 15, "'none', ''", "d")}, {ent("eu_subdomain", 12, "'Unclassified', ''", "eu")}, {page_sql},
b AS (SELECT {k}, count(*) AS total_refs, sum(w) AS w_sum, sum(s * w) FILTER (s > 0.6) / sum(w) FILTER (s > 0.6) AS sem, sum(x * w) / sum(w) FILTER (x IS NOT NULL) AS sent, ({scored}) / nullif({stage_sum}, 0) AS mat, sum(CASE WHEN fut THEN w ELSE 0 END) AS fut, sum(com * w) AS com FROM r GROUP BY ALL),
i AS (SELECT {", ".join("b." + x for x in keys)}, {rate("w_sum", 10)} AS intensity_index, coalesce(sem, 0) AS semantic_index, coalesce(d.e, 0) AS diversity_index, coalesce((sent + 1) / 2, 0.5) AS sentiment_index, coalesce(mat, 0) AS maturity_index, {rate("fut", 30)} AS future_index, {rate("com", "2.5::DOUBLE")} AS commitment_index,
  coalesce(eu.e, 0) AS diversity_index_eu, total_refs, coalesce(p.pages, 0)::BIGINT AS total_pages, coalesce(d.labels, 0)::BIGINT AS categories_used, coalesce(eu.labels, 0)::BIGINT AS categories_used_eu
  FROM b LEFT JOIN d ON {same("b", "d")} LEFT JOIN eu ON {same("b", "eu")} LEFT JOIN p ON {same("b", "p")})
SELECT {k}, {", ".join(f"round({x}, 6) AS {x}" for x in [f"{n}_index" for n in index.DIMENSIONS] + ["diversity_index_eu"])}, round({comp("diversity_index")}, 6) AS ai_adoption_index, round({comp("diversity_index_eu")}, 6) AS ai_adoption_index_eu, total_refs, total_pages, categories_used, categories_used_eu FROM i"""


@_query(_index_sql(["company", "year"]))
def adoption_index_documented(spark: SparkSession, base: str) -> DataFrame:
    keys = ["company", "year"]
    return _rounded(index.adoption_index(_index_rows(spark, base), keys, _pages(spark, base, keys)), keys)


@_query(_index_sql(["company", "year", "doc_type"]))
def adoption_index_by_doctype(spark: SparkSession, base: str) -> DataFrame:
    keys = ["company", "year", "doc_type"]
    return _rounded(index.adoption_index(_index_rows(spark, base), keys, _pages(spark, base, keys)), keys)


_POOLED = _MERGED + """, p AS (SELECT company, year, m.context, m.category_a, m.category_b, m.eu_subdomain, x.avg_sentiment_score AS xs, x.avg_semantic_score AS ss, x.doc_count FROM x JOIN mentions m ON m.mention_id = x.representative),
g AS (SELECT company, year, count(*) AS total_refs, sum(doc_count)::BIGINT AS total_pages, avg(ss) FILTER (ss > 0.6) AS sem, avg(xs) AS sent, count(*) FILTER (regexp_matches(regexp_replace(regexp_replace(coalesce(context, ''), '>>>(.*?)<<<', '\\1', 'g'), '\\s+', ' ', 'g'), '""" + _q(v.exists(*v.FUTURE)) + """')) AS fut FROM p GROUP BY ALL)
SELECT company, year, total_refs, total_pages, CASE WHEN total_pages > 0 THEN least(1.0::DOUBLE, total_refs / total_pages * 10) ELSE 0 END AS intensity_index, round(coalesce(sem, 0), 6) AS semantic_index, round(coalesce((sent + 1) / 2, 0.5), 6) AS sentiment_index,
  round(CASE WHEN total_pages > 0 THEN least(1.0::DOUBLE, fut / total_pages * 30) ELSE 0 END, 6) AS future_index FROM g"""


@_query(_POOLED)
def adoption_index_compat(spark: SparkSession, base: str) -> DataFrame:
    """The pooled index as the shipped code computes it: merged mentions, all of weight 1, none left out as mention_only, and
    the number of filings in place of pages."""
    named = table(spark, base, "mentions", "mention_id", "company", "year", "context", "category_a", "category_b", "eu_subdomain").withColumnRenamed("mention_id", "representative")
    rows = _merged(spark, base).join(named, "representative").withColumns({"category_a": _CODE("category_a"), "category_b": _CODE("category_b"), "context": F.regexp_replace(t.unmarked(c("context")), r"\s+", " "), "sentiment_score": c("avg_sentiment_score"), "semantic_score": c("avg_semantic_score")})
    rows = rows.withColumns({"confidence_score": F.lit(None).cast("double"), "reference_strength": F.lit("unknown")})
    pages = rows.groupBy("company", "year").agg(F.sum("doc_count").alias("total_pages"))
    made = index.adoption_index(rows, ["company", "year"], pages)
    return made.select("company", "year", "total_refs", "total_pages", "intensity_index", *[F.round(x, 6).alias(x) for x in ("semantic_index", "sentiment_index", "future_index")])


# ranks, roll-ups, pivots on the stored index

_ONCE = "WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY created_at DESC, index_id DESC) AS k FROM adoption_index) WHERE k = 1 AND ai_adoption_index IS NOT NULL AND NOT isnan(ai_adoption_index))"


def _once(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "adoption_index")
    last = rows.groupBy("company", "year").agg(F.max_by(F.struct(*[x for x in rows.columns if x not in ("company", "year")]), F.struct("created_at", "index_id")).alias("r"))
    return last.select("company", "year", "r.*").where("ai_adoption_index is not null and not isnan(ai_adoption_index)")


@_query(_ONCE + " SELECT index_id, year, CAST(row_number() OVER (PARTITION BY year ORDER BY ai_adoption_index DESC, company) AS INTEGER) AS rank_in_year FROM o")
def rank_in_year(spark: SparkSession, base: str) -> DataFrame:
    """The whole rank order of each year. The year is sorted by range over all tasks; each range then needs only how many
    rows of its year the ranges before it hold, so no year is gathered in one task."""
    rows = _once(spark, base).select("index_id", "company", "year", "ai_adoption_index")
    order = [c("year"), c("ai_adoption_index").desc(), c("company")]
    ranged = merge.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    local = W.Window.partitionBy("part", "year").orderBy(c("ai_adoption_index").desc(), "company")
    sizes = ranged.groupBy("year", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(W.Window.partitionBy("year").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    return ranged.withColumn("k", F.row_number().over(local)).join(before.select("year", "part", "ahead"), ["year", "part"]).select("index_id", "year", (c("k") + c("ahead")).cast("int").alias("rank_in_year"))


@_query(_ONCE + " SELECT index_id, company, year, round(ai_adoption_index, 6) AS ai_adoption_index FROM o WHERE year = (SELECT max(year) FROM o) ORDER BY o.ai_adoption_index DESC, company LIMIT 20")
def top20_latest_year(spark: SparkSession, base: str) -> DataFrame:
    rows = _once(spark, base).select("index_id", "company", "year", "ai_adoption_index")
    latest = rows.agg(F.max("year").alias("year"))
    return rows.join(F.broadcast(latest), "year").orderBy(c("ai_adoption_index").desc(), "company").limit(20).select("index_id", "company", "year", F.round("ai_adoption_index", 6).alias("ai_adoption_index"))  # one row is sent


@_query(_ONCE + " SELECT company, round(avg(ai_adoption_index), 6) AS mean_index FROM o GROUP BY company ORDER BY avg(ai_adoption_index) DESC, company LIMIT 10")
def topn_by_mean(spark: SparkSession, base: str) -> DataFrame:
    means = _once(spark, base).groupBy("company").agg(F.avg("ai_adoption_index").alias("m"))
    return means.orderBy(c("m").desc(), "company").limit(10).select("company", F.round("m", 6).alias("mean_index"))


@_query(_ONCE + " SELECT company, max(year) AS year, round(arg_max(ai_adoption_index, year), 6) AS ai_adoption_index, round(arg_max_null(CASE WHEN isnan(ai_adoption_index_eu) THEN NULL ELSE ai_adoption_index_eu END, year), 6) AS ai_adoption_index_eu FROM o GROUP BY company")
def latest_per_company(spark: SparkSession, base: str) -> DataFrame:
    rows = _once(spark, base).groupBy("company").agg(F.max("year").alias("year"), F.max_by(F.struct("ai_adoption_index", "ai_adoption_index_eu"), "year").alias("r"))
    return rows.select("company", "year", F.round("r.ai_adoption_index", 6).alias("ai_adoption_index"), F.round(F.nanvl("r.ai_adoption_index_eu", F.lit(None).cast("double")), 6).alias("ai_adoption_index_eu"))


@_query(_ONCE + " SELECT year, round(avg(ai_adoption_index), 6) AS mean_index, count(*) AS n, sum(total_refs)::BIGINT AS total_refs, arg_max(company, (ai_adoption_index, -index_id)) AS top_company FROM o GROUP BY year")
def year_summary(spark: SparkSession, base: str) -> DataFrame:
    return _once(spark, base).groupBy("year").agg(F.round(F.avg("ai_adoption_index"), 6).alias("mean_index"), F.count("*").alias("n"), F.sum("total_refs").alias("total_refs"), F.max_by("company", F.struct("ai_adoption_index", -c("index_id"))).alias("top_company"))


def _group_summary(group: str):
    @_query(_ONCE + f" SELECT {group} AS group_name, count(DISTINCT company) AS n_companies, round(avg(ai_adoption_index), 6) AS mean_index, sum(total_refs)::BIGINT AS total_refs FROM o WHERE {group} NOT IN ('', 'Unknown') GROUP BY 1", f"group_summary_{group}")
    def summary(spark: SparkSession, base: str) -> DataFrame:
        rows = _once(spark, base).where(~c(group).isin("", "Unknown")).groupBy(c(group).alias("group_name"))
        return rows.agg(F.countDistinct("company").alias("n_companies"), F.round(F.avg("ai_adoption_index"), 6).alias("mean_index"), F.sum("total_refs").alias("total_refs"))


for _g in ("industry", "sector", "country"):
    _group_summary(_g)


_DIM7 = [f"{d}_index" for d in index.DIMENSIONS]
_CLEAN = lambda x: F.nanvl(x, F.lit(None).cast("double"))
_CLEAN_SQL = lambda x: f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"
_ROLL = f"SELECT industry, year, {', '.join(f'round(avg({_CLEAN_SQL(d)}), 9) AS avg_{d}' for d in _DIM7)}, round(avg(ai_adoption_index), 9) AS ai_adoption_index_avg, count(*) AS num_companies, sum(total_refs)::BIGINT AS total_refs, round(min(ai_adoption_index), 6) AS min_index, round(max(ai_adoption_index), 6) AS max_index, round(stddev_pop(ai_adoption_index), 6) AS std_deviation, md5(array_to_string(list_sort(list_distinct(list(company))), ', ')) AS companies_md5 FROM o WHERE industry NOT IN ('', 'Unknown') GROUP BY ALL"


def _roll(spark: SparkSession, base: str) -> DataFrame:
    rows = _once(spark, base).where(~c("industry").isin("", "Unknown")).groupBy("industry", "year")
    return rows.agg(
        *[F.round(F.avg(_CLEAN(d)), 9).alias(f"avg_{d}") for d in _DIM7], F.round(F.avg("ai_adoption_index"), 9).alias("ai_adoption_index_avg"), F.count("*").alias("num_companies"), F.sum("total_refs").alias("total_refs"),
        F.round(F.min("ai_adoption_index"), 6).alias("min_index"), F.round(F.max("ai_adoption_index"), 6).alias("max_index"), F.round(F.stddev_pop("ai_adoption_index"), 6).alias("std_deviation"), F.md5(F.array_join(F.sort_array(F.collect_set("company")), ", ")).alias("companies_md5"),
    )


@_query(_ONCE + " " + _ROLL)
def group_year_rollup(spark: SparkSession, base: str) -> DataFrame:
    return _roll(spark, base)


@_query(_ONCE + f", g AS ({_ROLL}) SELECT industry, year, ai_adoption_index_avg, CAST(row_number() OVER (PARTITION BY year ORDER BY ai_adoption_index_avg DESC, industry) AS INTEGER) AS rank_in_year FROM g")
def group_rank(spark: SparkSession, base: str) -> DataFrame:
    order = W.Window.partitionBy("year").orderBy(c("ai_adoption_index_avg").desc(), "industry")  # one row for each industry
    return _roll(spark, base).select("industry", "year", "ai_adoption_index_avg", F.row_number().over(order).alias("rank_in_year"))


@_query(_ONCE + f" SELECT {', '.join(f'round(avg({_CLEAN_SQL(d)}), 6) AS avg_{d}' for d in _DIM7)} FROM o")
def radar_averages(spark: SparkSession, base: str) -> DataFrame:
    return _once(spark, base).agg(*[F.round(F.avg(_CLEAN(d)), 6).alias(f"avg_{d}") for d in _DIM7])


@_query(_ONCE + ", t AS (SELECT year, avg(ai_adoption_index) AS m, stddev_samp(ai_adoption_index) AS s, count(*) AS n FROM o GROUP BY year) SELECT year, round(m, 6) AS mean_index, round(s, 6) AS std_index, n, round(m - s, 6) AS low, round(m + s, 6) AS high FROM t")
def yearly_trend(spark: SparkSession, base: str) -> DataFrame:
    rows = _once(spark, base).groupBy("year").agg(F.avg("ai_adoption_index").alias("m"), F.stddev_samp("ai_adoption_index").alias("s"), F.count("*").alias("n"))
    return rows.select("year", F.round("m", 6).alias("mean_index"), F.round("s", 6).alias("std_index"), "n", F.round(c("m") - c("s"), 6).alias("low"), F.round(c("m") + c("s"), 6).alias("high"))


@_query(_ONCE + " SELECT industry, round(quantile_cont(ai_adoption_index, 0.25), 6) AS q1, round(quantile_cont(ai_adoption_index, 0.5), 6) AS q2, round(quantile_cont(ai_adoption_index, 0.75), 6) AS q3, round(avg(ai_adoption_index), 6) AS mean_index FROM o WHERE industry NOT IN ('', 'Unknown') GROUP BY industry")
def group_box_stats(spark: SparkSession, base: str) -> DataFrame:
    rows = _once(spark, base).where(~c("industry").isin("", "Unknown")).groupBy("industry").agg(F.percentile("ai_adoption_index", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("ai_adoption_index").alias("m"))
    return rows.select("industry", *[F.round(c("q")[i], 6).alias(f"q{i + 1}") for i in range(3)], F.round("m", 6).alias("mean_index"))


YEARS = list(range(2015, 2027))


@_query(_ONCE + f" SELECT company, {', '.join(f'round(coalesce(avg(ai_adoption_index) FILTER (year = {y}), 0), 6) AS y{y}' for y in YEARS)}, count(*) FILTER (year NOT IN ({', '.join(map(str, YEARS))})) AS other_years, round(avg(ai_adoption_index), 6) AS row_mean, CAST(row_number() OVER (ORDER BY round(avg(ai_adoption_index), 6) DESC, company) AS INTEGER) AS row_order FROM o GROUP BY company")
def heatmap_pivot(spark: SparkSession, base: str) -> DataFrame:
    """A column for each of YEARS, how many years lie outside them, and the place of the row by its mean over all years."""
    once = _once(spark, base)
    cells = once.groupBy("company").pivot("year", YEARS).agg(F.avg("ai_adoption_index"))
    means = once.groupBy("company").agg(F.count_if(~c("year").isin(YEARS)).alias("other_years"), F.round(F.avg("ai_adoption_index"), 6).alias("row_mean"))
    placed = _placed(means, [c("row_mean").desc(), c("company")], "row_order")
    return cells.join(placed, "company").select("company", *[F.round(F.coalesce(c(str(y)), F.lit(0.0)), 6).alias(f"y{y}") for y in YEARS], "other_years", "row_mean", "row_order")


def _placed(rows: DataFrame, order: list, name: str) -> DataFrame:
    """The rows with their place in a total order, by ranges and offsets: no task holds all of them."""
    ranged = merge.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    ahead = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    local = F.row_number().over(W.Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_k", local).join(ahead.select("_part", "_ahead"), "_part").withColumn(name, (c("_k") + c("_ahead")).cast("int")).drop("_k", "_ahead", "_part")


KINDS = ["Annual Report", "Sustainability", "Proxy", "Quarterly Report"]
_CELLS = [(k, y, f"{k.split()[0].lower()}_{y}") for k in KINDS for y in YEARS]
_COVERED = "SELECT position, upper(trim(company, ' ')) AS company, doc_type, year FROM processed_documents WHERE company IS NOT NULL"
_HELD = ", ".join(f"max(CASE WHEN doc_type = '{k}' AND year = {y} THEN 1 ELSE 0 END)::BIGINT AS {n}" for k, y, n in _CELLS)
_TOTALS = ", ".join(f"sum({n})::BIGINT" for _, _, n in _CELLS)


@_query(f"WITH m AS (SELECT position, company, {_HELD} FROM ({_COVERED}) GROUP BY 1, 2) SELECT * FROM m UNION ALL SELECT NULL, 'TOTAL', {_TOTALS} FROM m")
def coverage_matrix(spark: SparkSession, base: str) -> DataFrame:
    """Which kinds of filing of which year there are, 0 or 1 in a column for each of KINDS and YEARS, with a row of totals; others
    are in coverage_cells."""
    names = [n for _, _, n in _CELLS]
    label = F.concat_ws("_", F.lower(F.split("doc_type", " ")[0]), "year")
    rows = table(spark, base, "processed_documents", "position", "company", "doc_type", "year").where("company is not null").withColumn("cell", F.when(c("doc_type").isin(KINDS), label))
    held = rows.groupBy("position", F.upper(F.trim("company")).alias("company")).pivot("cell", names).agg(F.max(F.lit(1)))
    cells = held.select("position", "company", *[F.coalesce(c(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    total = cells.agg(*[F.sum(n).alias(n) for n in names]).select(F.lit(None).cast("int").alias("position"), F.lit("TOTAL").alias("company"), *names)
    return cells.unionByName(total)


@_query(f"WITH m AS (SELECT DISTINCT * FROM ({_COVERED})) SELECT position, company, doc_type, year, 1::BIGINT AS n FROM m UNION ALL SELECT NULL, 'TOTAL', doc_type, year, count(*) FROM m GROUP BY doc_type, year")
def coverage_cells(spark: SparkSession, base: str) -> DataFrame:
    """The same as rows, whatever kinds and years there are."""
    rows = table(spark, base, "processed_documents", "position", "company", "doc_type", "year").where("company is not null").select("position", F.upper(F.trim("company")).alias("company"), "doc_type", "year").distinct()
    total = rows.groupBy("doc_type", "year").agg(F.count("*").alias("n")).select(F.lit(None).cast("int").alias("position"), F.lit("TOTAL").alias("company"), "doc_type", "year", "n")
    return rows.withColumn("n", F.lit(1).cast("bigint")).unionByName(total)


_TOP = _ONCE + ", t AS (SELECT company FROM o GROUP BY company ORDER BY avg(ai_adoption_index) DESC, company LIMIT 10)"


@_query(_TOP + " SELECT company, year, round(ai_adoption_index, 6) AS ai_adoption_index FROM o WHERE company IN (SELECT company FROM t)")
def timeline_top(spark: SparkSession, base: str) -> DataFrame:
    """All years of the ten companies with the highest means."""
    rows = _once(spark, base).select("company", "year", "ai_adoption_index")
    top = rows.groupBy("company").agg(F.avg("ai_adoption_index").alias("m")).orderBy(c("m").desc(), "company").limit(10)
    return rows.join(top, "company", "left_semi").select("company", "year", F.round("ai_adoption_index", 6).alias("ai_adoption_index"))


@_query(_ONCE + " SELECT index_id, company, year, round(ai_adoption_index, 2) AS ai_adoption_index, CAST(row_number() OVER (ORDER BY year DESC, round(ai_adoption_index, 2) DESC, company, index_id) AS INTEGER) AS row_no FROM o")
def index_rows_sorted(spark: SparkSession, base: str) -> DataFrame:
    rows = _once(spark, base).select("index_id", "company", "year", F.round("ai_adoption_index", 2).alias("ai_adoption_index"))
    return _placed(rows, [c("year").desc(), c("ai_adoption_index").desc(), c("company"), c("index_id")], "row_no")


# counts and reports


@_query("SELECT coalesce(text_status, 'unknown') AS status, count(*) AS n, count(*) FILTER (refs_found = 0) AS n_without_refs, count(*) FILTER (process_count > 1) AS n_again FROM processed_documents GROUP BY 1")
def status_counts(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "processed_documents", "text_status", "refs_found", "process_count").groupBy(F.coalesce("text_status", F.lit("unknown")).alias("status"))
    return rows.agg(F.count("*").alias("n"), F.count_if(c("refs_found") == 0).alias("n_without_refs"), F.count_if(c("process_count") > 1).alias("n_again"))


@_query("SELECT source, arg_max_null(text_status, last_processed_at) AS text_status FROM processed_documents GROUP BY source HAVING arg_max_null(text_status, last_processed_at) IN ('corrupted_ocr_failed', 'ocr_needed', 'empty') OR max(refs_found) = 0")
def reprocess_selection(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "processed_documents", "source", "text_status", "refs_found", "last_processed_at").groupBy("source").agg(F.max_by(F.struct("text_status"), "last_processed_at")["text_status"].alias("text_status"), F.max("refs_found").alias("refs"))
    return rows.where(c("text_status").isin("corrupted_ocr_failed", "ocr_needed", "empty") | (c("refs") == 0)).select("source", "text_status")


@_query("SELECT year, count(DISTINCT company) AS n_companies, count(*) AS n_refs FROM mentions GROUP BY year")
def companies_per_year(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mentions", "year", "company").groupBy("year").agg(F.countDistinct("company").alias("n_companies"), F.count("*").alias("n_refs"))


@_query("SELECT count(*) AS n_refs, count(DISTINCT company) AS n_companies, count(DISTINCT source) AS n_sources, min(year) AS first_year, max(year) AS last_year, sum(occurrence_count)::BIGINT AS occurrences FROM mentions")
def report_summary(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mentions", "company", "source", "year", "occurrence_count").agg(F.count("*").alias("n_refs"), F.countDistinct("company").alias("n_companies"), F.countDistinct("source").alias("n_sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("occurrence_count").alias("occurrences"))


@_query("SELECT code, count(*) AS n FROM (SELECT coalesce(nullif(nullif(upper(trim(category_a, ' ')), ''), 'NONE'), 'none') AS code FROM mentions UNION ALL SELECT coalesce(nullif(nullif(upper(trim(category_b, ' ')), ''), 'NONE'), 'none') FROM mentions) WHERE code <> 'none' GROUP BY code")
def category_distribution(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mentions", "category_a", "category_b").select(F.explode(F.array(_CODE("category_a"), _CODE("category_b"))).alias("code")).where("code <> 'none'").groupBy("code").agg(F.count("*").alias("n"))


@_query("WITH g AS (SELECT eu_domain, eu_subdomain, count(*) AS n FROM mentions GROUP BY 1, 2) SELECT eu_domain, eu_subdomain, n, round(100.0 * n / (SELECT sum(n) FROM g), 2) AS share FROM g UNION ALL SELECT eu_domain, '*', sum(n)::BIGINT, round(100.0 * sum(n) / (SELECT sum(n) FROM g), 2) FROM g GROUP BY 1")
def eu_distribution(spark: SparkSession, base: str) -> DataFrame:
    counts = table(spark, base, "mentions", "eu_domain", "eu_subdomain").groupBy("eu_domain", "eu_subdomain").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.groupBy("eu_domain").agg(F.sum("n").alias("n")).select("eu_domain", F.lit("*").alias("eu_subdomain"), "n"))
    total = counts.agg(F.sum("n")).scalar()
    return both.select("eu_domain", "eu_subdomain", "n", F.round(F.lit(100.0) * c("n") / total, 2).alias("share"))


@_query("SELECT eu_domain, eu_subdomain, count(*) AS n FROM mentions WHERE eu_domain IS NOT NULL AND eu_subdomain IS NOT NULL AND eu_domain <> 'Unclassified' AND eu_subdomain <> 'Unclassified' GROUP BY 1, 2")
def eu_sunburst(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mentions", "eu_domain", "eu_subdomain").where("eu_domain <> 'Unclassified' and eu_subdomain <> 'Unclassified'").groupBy("eu_domain", "eu_subdomain").agg(F.count("*").alias("n"))


@_query("""
WITH a AS (SELECT coalesce(nullif(upper(trim(category_a, ' ')), ''), 'Unclassified') AS code, count(*) AS n FROM mentions GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM a)
SELECT code, n, round(share, 6) AS share FROM s WHERE NOT (code IN ('Unclassified', 'NONE') AND share > 0.5)""")
def category_shares(spark: SparkSession, base: str) -> DataFrame:
    """Shares of the categories; what is unclassified is left out if it is more than half."""
    code = F.coalesce(F.nullif(F.upper(F.trim("category_a")), F.lit("")), F.lit("Unclassified"))
    counts = table(spark, base, "mentions", "category_a").groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", c("n") / counts.agg(F.sum("n")).scalar())
    return shares.where(~(c("code").isin("Unclassified", "NONE") & (c("share") > 0.5))).select("code", "n", F.round("share", 6).alias("share"))


@_query("SELECT industry, count(DISTINCT company) AS n_companies, count(*) AS n_refs FROM mentions WHERE coalesce(industry, '') NOT IN ('', 'Unknown') GROUP BY industry")
def companies_per_industry(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "industry", "company").where(~F.coalesce("industry", F.lit("")).isin("", "Unknown"))
    return rows.groupBy("industry").agg(F.countDistinct("company").alias("n_companies"), F.count("*").alias("n_refs"))


@_query("""
WITH m AS (SELECT count(*) AS total FROM mentions), q AS (SELECT count(*) AS new_refs FROM (SELECT DISTINCT company, year, doc_type, page, text FROM mentions)), d AS (SELECT source, count(*) AS times, arg_max_null(refs_found, last_processed_at) AS refs, arg_max_null(text_status, last_processed_at) AS status FROM processed_documents GROUP BY source)
SELECT (SELECT new_refs FROM q) AS new_refs, (SELECT total FROM m) - (SELECT new_refs FROM q) AS updated_refs, count(*) FILTER (times = 1) AS new_docs, count(*) FILTER (times > 1) AS reanalysed_docs, count(*) FILTER (refs = 0) AS no_ref_docs, count(*) FILTER (status = 'error') AS errors FROM d""")
def run_stats(spark: SparkSession, base: str) -> DataFrame:
    """What a run over everything would report. A mention is new where its key is, else an update."""
    keys = ["company", "year", "doc_type", "page", "text"]
    per_key = table(spark, base, "mentions", *keys).groupBy(*keys).agg(F.count("*").alias("n"))
    new, updated = per_key.agg(F.count("*")).scalar(), per_key.agg(F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).scalar()
    last = table(spark, base, "processed_documents", "source", "refs_found", "text_status", "last_processed_at").groupBy("source").agg(F.count("*").alias("times"), F.max_by(F.struct("refs_found", "text_status"), "last_processed_at").alias("r"))
    docs = last.agg(F.count_if(c("times") == 1).alias("new_docs"), F.count_if(c("times") > 1).alias("reanalysed_docs"), F.count_if(c("r.refs_found") == 0).alias("no_ref_docs"), F.count_if(c("r.text_status") == "error").alias("errors"))
    return docs.select(new.alias("new_refs"), updated.alias("updated_refs"), "*")


@_query("""
SELECT 'mentions_without_company' AS check_name, count(*) AS n FROM mentions WHERE company IS NULL UNION ALL SELECT 'mentions_of_unknown_source', count(*) FROM mentions WHERE source NOT IN (SELECT source FROM processed_documents)
UNION ALL SELECT 'index_of_unknown_industry', count(*) FROM adoption_index WHERE coalesce(industry, 'Unknown') = 'Unknown' UNION ALL SELECT 'mentions_without_hash', count(*) FROM mentions WHERE ref_hash IS NULL""")
def integrity_checks(spark: SparkSession, base: str) -> DataFrame:
    m, a = table(spark, base, "mentions", "company", "source", "ref_hash"), table(spark, base, "adoption_index", "industry")
    unknown = m.dropna(subset=["source"]).join(table(spark, base, "processed_documents", "source"), "source", "left_anti")
    parts = [("mentions_without_company", m.where("company is null")), ("mentions_of_unknown_source", unknown), ("index_of_unknown_industry", a.where("coalesce(industry, 'Unknown') = 'Unknown'")), ("mentions_without_hash", m.where("ref_hash is null"))]
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("check_name"), "n") for n, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_R = lambda x, d: f"CAST(round(CAST(CASE WHEN isnan({x}) THEN NULL ELSE {x} END AS DECIMAL(18, 8)), {d}) AS DOUBLE)"


@_query(f"SELECT index_id, {_R('ai_adoption_index', 2)} AS ai_adoption_index, {_R('intensity_index', 3)} AS intensity_index, CASE WHEN ai_adoption_index IS NULL OR isnan(ai_adoption_index) THEN 'none' WHEN ai_adoption_index >= 50 THEN 'green' WHEN ai_adoption_index >= 30 THEN 'amber' ELSE 'red' END AS band FROM adoption_index")
def index_export_banded(spark: SparkSession, base: str) -> DataFrame:
    """Every row; a missing index has no band."""
    rows = table(spark, base, "adoption_index", "index_id", "ai_adoption_index", "intensity_index").withColumns({x: _CLEAN(x) for x in ("ai_adoption_index", "intensity_index")})
    band = F.when(c("ai_adoption_index").isNull(), "none").when(c("ai_adoption_index") >= 50, "green").when(c("ai_adoption_index") >= 30, "amber").otherwise("red")
    return rows.select("index_id", F.round("ai_adoption_index", 2).alias("ai_adoption_index"), F.round("intensity_index", 3).alias("intensity_index"), band.alias("band"))


@_query("SELECT index_id, json_object('company', company, 'year', year, 'refs', total_refs, 'index', " + _R("ai_adoption_index", 2) + ", 'dimensions', json_object(" + ", ".join(f"'{d}', {_R(d + '_index', 3)}" for d in index.DIMENSIONS) + ")) AS doc FROM adoption_index")
def json_export_nested(spark: SparkSession, base: str) -> DataFrame:
    """One object for every row, its dimensions nested; missing values are null."""
    rows = table(spark, base, "adoption_index", "index_id", "company", "year", "total_refs", "ai_adoption_index", *[f"{d}_index" for d in index.DIMENSIONS])
    dimensions = F.struct(*[F.round(_CLEAN(f"{d}_index"), 3).alias(d) for d in index.DIMENSIONS])
    doc = F.struct("company", "year", c("total_refs").alias("refs"), F.round(_CLEAN("ai_adoption_index"), 2).alias("index"), dimensions.alias("dimensions"))
    return rows.select("index_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@_query("SELECT index_id, json_object('company', company, 'year', year, 'refs', total_refs) AS doc FROM adoption_index WHERE total_refs IS NOT NULL AND company IS NOT NULL AND year IS NOT NULL")
def json_export_flat(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "adoption_index", "index_id", "company", "year", "total_refs").dropna()
    return rows.select("index_id", F.to_json(F.struct("company", "year", c("total_refs").alias("refs"))).alias("doc"))


@_query("SELECT industry, json_object('industry', industry, 'companies', count(DISTINCT company), 'rows', count(*)) AS doc FROM adoption_index WHERE industry IS NOT NULL GROUP BY industry")
def json_export_industries(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "adoption_index", "industry", "company").where("industry is not null").groupBy("industry").agg(F.countDistinct("company").alias("companies"), F.count("*").alias("rows"))
    return rows.select("industry", F.to_json(F.struct("industry", "companies", "rows")).alias("doc"))


_RAW = ["mention_id", "company", "year", "position", "industry", "sector", "country", "doc_type", "page", "text", "category_a", "category_b", "eu_domain", "eu_subdomain", "sentiment", "detection_method", "source", "reference_strength"]


@_query(
    f"SELECT {', '.join(_RAW)}, regexp_replace(context, '>>>(.*?)<<<', '\\1', 'g') AS context, {_R('sentiment_score', 3)} AS avg_sentiment_score, {_R('semantic_score', 3)} AS avg_semantic_score, {_R('confidence_score', 3)} AS confidence_score, 1 AS doc_count, 1 AS total_occurrences, coalesce(is_negated_context, false) AS is_negated_context FROM mentions"
)
def export_raw_rows(spark: SparkSession, base: str) -> DataFrame:
    """The sheet of all mentions: scores rounded, marks removed, one filing and one occurrence each."""
    rows = table(spark, base, "mentions", *_RAW, "context", "sentiment_score", "semantic_score", "confidence_score", "is_negated_context")
    scores = [F.round(_CLEAN(x), 3).alias(n) for x, n in (("sentiment_score", "avg_sentiment_score"), ("semantic_score", "avg_semantic_score"), ("confidence_score", "confidence_score"))]
    return rows.select(*_RAW, t.unmarked(c("context")).alias("context"), *scores, F.lit(1).alias("doc_count"), F.lit(1).alias("total_occurrences"), F.coalesce("is_negated_context", F.lit(False)).alias("is_negated_context"))


@_query("SELECT mention_id, coalesce(nullif(page, 0), 1) AS page, CASE WHEN isnan(semantic_score) THEN 0 ELSE coalesce(semantic_score, 0) END AS semantic_score, CASE WHEN isnan(sentiment_score) THEN 0 ELSE coalesce(sentiment_score, 0) END AS sentiment_score, CASE WHEN isnan(confidence_score) THEN 0 ELSE coalesce(confidence_score, 0) END AS confidence_score, coalesce(reference_strength, 'unknown') AS reference_strength, coalesce(category_a, 'none') AS category_a, coalesce(eu_subdomain, 'Unclassified') AS eu_subdomain FROM mentions")
def rows_with_defaults(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "page", "semantic_score", "sentiment_score", "confidence_score", "reference_strength", "category_a", "eu_subdomain")
    zero = F.lit(0.0)
    return rows.select("mention_id", F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)).alias("page"), *[F.coalesce(F.nanvl(x, zero), zero).alias(x) for x in ("semantic_score", "sentiment_score", "confidence_score")], F.coalesce("reference_strength", F.lit("unknown")).alias("reference_strength"), F.coalesce("category_a", F.lit("none")).alias("category_a"), F.coalesce("eu_subdomain", F.lit("Unclassified")).alias("eu_subdomain"))


@_query("SELECT mention_id, company, year, ref_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY company, year, text ORDER BY mention_id) - 1 AS INTEGER) AS ref_no FROM mentions WHERE company IS NOT NULL AND text IS NOT NULL)")
def ordinal_in_group(spark: SparkSession, base: str) -> DataFrame:
    order = W.Window.partitionBy("company", "year", "text").orderBy("mention_id")
    rows = table(spark, base, "mentions", "mention_id", "company", "year", "text").where("company is not null and text is not null")
    return rows.select("mention_id", "company", "year", (F.row_number().over(order) - 1).alias("ref_no"))


# sentiment


_LEX = ", ".join(f"('{k}', {s}::DOUBLE)" for k, s in (v.POSITIVE | v.NEGATIVE).items())
_SENTIMENT = f"""
WITH lex(word, score) AS (VALUES {_LEX}), w AS (SELECT mention_id, unnest(regexp_extract_all(lower(context), '[\\p{{L}}]+')) AS word FROM mentions WHERE context IS NOT NULL),
p AS (SELECT mention_id, avg(score) AS score FROM w JOIN lex USING (word) GROUP BY 1), x AS (SELECT m.mention_id, lower(context) AS low, CASE WHEN length(trim(context, ' ')) >= 10 THEN coalesce(p.score, 0) ELSE 0 END AS score FROM mentions m LEFT JOIN p USING (mention_id) WHERE context IS NOT NULL),
s AS (SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM x)
"""
_has = lambda terms: f"regexp_matches(low, '{_q(v.exists(v.any_of(terms)))}')"


def _sentiment(spark: SparkSession, base: str) -> DataFrame:
    return sentiment.scored(table(spark, base, "mentions", "mention_id", "context").where("context is not null"), "context")


@_query(_SENTIMENT + "SELECT mention_id, label, round(score, 6) AS score FROM s")
def sentiment_lexicon(spark: SparkSession, base: str) -> DataFrame:
    return _sentiment(spark, base).select("mention_id", "label", F.round("score", 6).alias("score"))


@_query(_SENTIMENT + f"""SELECT mention_id, CASE WHEN label = 'negative' AND {_has(v.GOVERNANCE)} AND NOT {_has(v.TRULY_NEGATIVE)} THEN CASE WHEN score * 0.3 > -0.1 THEN 'neutral' ELSE label END ELSE label END AS label,
  round(CASE WHEN label = 'negative' AND {_has(v.GOVERNANCE)} AND NOT {_has(v.TRULY_NEGATIVE)} THEN score * 0.3 ELSE score END, 6) AS score,
  CASE WHEN {_has(v.TRULY_NEGATIVE)} THEN 'confirmed_negative' WHEN label = 'negative' AND {_has(v.GOVERNANCE)} THEN 'governance_adjusted' ELSE 'standard' END AS flag FROM s""")
def sentiment_governance_adjust(spark: SparkSession, base: str) -> DataFrame:
    return sentiment.corrected(_sentiment(spark, base), "context").select("mention_id", "label", F.round("score", 6).alias("score"), "flag")


# streaming and the whole pipeline


@_query("""
SELECT company, year, doc_type, page, text, count(*) AS occurrence_count, arg_min_null(context, mention_id) AS context, arg_min_null(category_a, mention_id) AS category_a, arg_max_null(CASE WHEN isnan(semantic_score) THEN NULL ELSE semantic_score END, mention_id) AS semantic_score, max(confidence_score) AS confidence_score
FROM mentions GROUP BY company, year, doc_type, page, text""")
def incremental_replay(spark: SparkSession, base: str) -> DataFrame:
    """The table read as a stream of files and folded batch by batch: the same as one merge of all rows."""
    import uuid

    from tidemark.functions.storage import ensure_checkpoint_dir
    from tidemark.streaming.incremental import KEYS, stream_mentions

    folder = f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    wanted = [*KEYS, "mention_id", "context", "category_a", "semantic_score", "confidence_score"]
    kinds = {f.name: f for f in table(spark, base, "mentions").schema.fields}
    schema = type(table(spark, base, "mentions").schema)([kinds[n] for n in wanted])
    return stream_mentions(spark, f"{base}/mentions.parquet*", schema, folder)


@_query("SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, base: str) -> DataFrame:
    from tidemark.streaming.incremental import windowed_events

    return windowed_events(table(spark, base, "events", "ts", "event_type", "value")).withColumn("value", F.round("value", 6))


def _pipeline_sql() -> str:
    from tidemark.plans import detection_plans as d

    found = d.SCORED.strip()[len("WITH ") :].replace("FROM documents WHERE", "FROM documents WHERE company IS NOT NULL AND length(text) >= 100 AND")
    best = lambda axis, gate, none: d.best_sql(axis, gate, none)
    classified = f"""{found}, low AS (SELECT *, lower(term || ' ' || context) AS low FROM scored), made AS (
  SELECT company, year, context, confidence_score, reference_strength, {best('a', 0.25, '')} AS category_a, {best('b', 0.25, '')} AS category_b, {best('eu', None, 'Unclassified')} AS eu_subdomain, NULL::DOUBLE AS sentiment_score, NULL::DOUBLE AS semantic_score, '' AS detection_method FROM low),"""
    pages = """p AS (SELECT company, year, sum(total_pages)::BIGINT AS pages FROM documents JOIN (SELECT source, max(total_pages) AS total_pages FROM processed_documents GROUP BY source) USING (source) JOIN (SELECT source, min(doc_id) AS doc_id FROM documents WHERE company IS NOT NULL GROUP BY source) USING (source, doc_id) GROUP BY ALL)"""
    made = _index_sql(["company", "year"], "made", classified, pages)
    return f"SELECT company, year, total_refs, ai_adoption_index FROM ({made})"


@_query(_pipeline_sql())
def pipeline_index(spark: SparkSession, base: str) -> DataFrame:
    from tidemark.plans.pipeline import run

    docs = table(spark, base, "documents", "doc_id", "text", "source", "company", "year", "doc_type").where("company is not null")
    once = table(spark, base, "processed_documents", "source", "total_pages").groupBy("source").agg(F.max("total_pages").alias("total_pages"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).join(once, "source")  # a filing's pages count once
    filings = docs.join(first, ["source", "doc_id"], "left").withColumn("source", F.concat_ws("#", "source", "doc_id"))
    return run(filings).index.select("company", "year", "total_refs", F.round("ai_adoption_index", 6).alias("ai_adoption_index"))
