"""The queries of the training-data problems, pN_..., and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.encode import token_ids
from tidemark.llm.frequency import category_terms, detection_terms, mark_useless, term_frequency
from tidemark.llm.garbled import garbled_fields
from tidemark.llm.leaks import leaked_passages, near_passages
from tidemark.llm.lookalikes import consistent_text
from tidemark.llm.nearcopies import similar_counts, similar_pairs
from tidemark.llm.scans import repaired_scans, sound_sample
from tidemark.llm.spans import shared_share, sharing_pairs
from tidemark.llm.survivors import preferred_rows, true_values
from tidemark.llm.topn import top_n
from tidemark.sources.tables import table

FIELDS = {"category_a": category_terms, "category_b": category_terms, "detection_method": detection_terms}


def _terms(spark: SparkSession, base: str) -> DataFrame:
    mentions = table(spark, base, "mentions", *FIELDS)
    counts = term_frequency(mentions, FIELDS).select("field", F.col("ngram")[0].alias("term"), "occurrences", "records")
    return mark_useless(counts, mentions, list(FIELDS))


def p1_terms(spark: SparkSession, base: str) -> DataFrame:
    return _terms(spark, base).drop("in_rows")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return _terms(spark, base).select("field", "term", F.explode(marks).alias("mark"))


def p1_ngrams(spark: SparkSession, base: str) -> DataFrame:
    counts = term_frequency(table(spark, base, "mentions", "detection_method"), {"detection_method": detection_terms}, n_max=None)
    return counts.select("n", F.array_join("ngram", " | ").alias("ngram"), "occurrences", "records")


def p2_repaired(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "context", "company", "doc_type", "source")
    status = table(spark, base, "processed_documents", "source", "text_status").groupBy("source").agg(F.min(F.coalesce("text_status", F.lit("?")) == "valid").alias("sound"))
    sound = sound_sample(rows, "mention_id", "source", status.where("sound"))
    return repaired_scans(rows, "mention_id", "context", "company", "doc_type", sound)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return p2_repaired(spark, base).select("mention_id")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return p3_consistent(spark, base).where("changed").select("mention_id")


def p3_consistent(spark: SparkSession, base: str) -> DataFrame:
    return consistent_text(table(spark, base, "mentions", "mention_id", "context"), "mention_id", "context")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "source", "page", "text", "context", "semantic_score", "sentiment_score", "sentiment_confidence", "confidence_score", "created_at")
    c = F.col
    trust = F.when(c("sentiment_confidence") == "confirmed_negative", 3).when(c("sentiment_confidence") == "governance_adjusted", 2).when(c("sentiment_confidence") == "standard", 1).otherwise(0)
    return preferred_rows(
        rows,
        [c("source"), c("page"), F.lower(F.trim("text"))],
        "mention_id",
        {
            "context_id": (F.length("context") > 0, [F.length("context"), c("created_at")]),
            "semantic_id": ((c("semantic_score") > 0) & ~F.isnan("semantic_score"), [c("created_at"), F.nanvl("confidence_score", F.lit(None).cast("double"))]),
            "sentiment_id": (c("sentiment_score").isNotNull(), [trust, c("created_at")]),
        },
    )


def _claimer() -> F.Column:
    """Who states a row's values: the kind and strength of its detection. The rows of a group have one source, so that sources
    cannot be told apart inside it."""
    method = F.coalesce(F.col("detection_method"), F.lit(""))
    return F.concat_ws("/", F.regexp_extract(method, "^[a-z]*", 0), F.regexp_extract(method, "strength=([a-z_]+)", 1))


def p4_categories(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "source", "page", "text", "category_a", "detection_method")
    claims = rows.select("source", "page", F.lower(F.trim("text")).alias("term"), _claimer().alias("claimer"), F.upper(F.trim("category_a")).alias("value"))
    values, _ = true_values(claims, ["source", "page", "term"], "claimer", "value")
    return values.select("source", "page", "term", "value", F.round("probability", 6).alias("probability"), "is_true")


def p4_values(spark: SparkSession, base: str) -> DataFrame:
    """All values of context, semantic_score and sentiment_score judged by the two-sided model. Contexts that differ only in
    case, marks around the term and white space state one value."""
    rows = table(spark, base, "mentions", "mention_id", "source", "page", "text", "context", "semantic_score", "sentiment_score", "detection_method")
    c = F.col
    squeezed = F.nullif(F.trim(F.regexp_replace(F.lower(F.regexp_replace("context", ">>>|<<<", "")), r"\s+", " ")), F.lit(""))
    number = lambda x, digits: F.when(~F.isnan(x), F.format_number(F.round(x, digits), digits))
    stated = {"context": F.md5(squeezed), "semantic_score": F.when(c("semantic_score") > 0, number("semantic_score", 2)), "sentiment_score": number("sentiment_score", 1)}
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.concat_ws(":", F.lit(k), _claimer()).alias("claimer"), v.alias("value")) for k, v in stated.items()])
    claims = rows.select("source", "page", F.lower(F.trim("text")).alias("term"), F.inline(fields))
    values, _ = true_values(claims, ["source", "page", "term", "field"], "claimer", "value")
    return values.select("source", "page", "term", "field", "value", F.round("probability", 6).alias("probability"), "is_true")


def _adoption_once(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "adoption_index", "index_id", "company", "year", "industry", "ai_adoption_index", "created_at")
    last = rows.groupBy("company", "year").agg(F.max(F.struct("created_at", "index_id", "industry", "ai_adoption_index")).alias("r"))
    return last.select("company", "year", "r.index_id", "r.industry", "r.ai_adoption_index")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return top_n(_adoption_once(spark, base), ["year", "industry"], "ai_adoption_index", ["company"], ["index_id"], 5).select("year", "industry", "pos", "index_id")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_repaired(spark, base).select("mention_id", "field")


def p6_repaired(spark: SparkSession, base: str) -> DataFrame:
    return garbled_fields(table(spark, base, "mentions", "mention_id", "context", "text"), "mention_id", ["context", "text"])


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return similar_pairs(table(spark, base, "mentions", "mention_id", "text", "context"), "mention_id", "text", "context").toDF("mention_a", "mention_b")


def p7_links(spark: SparkSession, base: str) -> DataFrame:
    counts = similar_counts(table(spark, base, "mentions", "mention_id", "text", "context"), "mention_id", "text", "context")
    return counts.select(F.col("id").alias("mention_id"), "class_id", "links")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return token_ids(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text")


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return leaked_passages(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", table(spark, base, "eval_items", "item_id", "passage"), "item_id", "passage")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).select("doc_id", "item_id")


def p9_longest(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base)


def p9_near(spark: SparkSession, base: str) -> DataFrame:
    return near_passages(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", table(spark, base, "eval_items", "item_id", "passage"), "item_id", "passage")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return sharing_pairs(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text").toDF("doc_a", "doc_b")


def p10_share(spark: SparkSession, base: str) -> DataFrame:
    return shared_share(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_ngrams, p2_found, p2_repaired, p3_found, p3_consistent, p4_found, p4_categories, p4_values, p5_found, p6_found, p6_repaired, p7_found, p7_links, p8_ids, p9_found, p9_longest, p9_near, p10_found, p10_share)}

_P1 = """
WITH v AS (
  SELECT mention_id, 'category_a' AS field, lower(trim(category_a, ' ')) AS term FROM mentions WHERE category_a IS NOT NULL
  UNION ALL SELECT mention_id, 'category_b', lower(trim(category_b, ' ')) FROM mentions WHERE category_b IS NOT NULL
  UNION ALL
  SELECT mention_id, 'detection_method', trim(unnest(CASE WHEN piece LIKE 'reasons=%' THEN string_split(substr(piece, 9), ',') ELSE [piece] END), ' ')
  FROM (SELECT mention_id, trim(unnest(string_split(lower(detection_method), '|')), ' ') AS piece FROM mentions WHERE detection_method IS NOT NULL)
), n AS (
  SELECT 'category_a' AS field, count(category_a) AS in_rows FROM mentions
  UNION ALL SELECT 'category_b', count(category_b) FROM mentions
  UNION ALL SELECT 'detection_method', count(detection_method) FROM mentions
), t AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT mention_id) AS records FROM v WHERE term <> '' GROUP BY ALL
), m AS (
  SELECT field, term, occurrences, records, records <= 3 AS is_rare, records > 0.4 * in_rows AS is_common FROM t JOIN n USING (field)
)
"""

ORACLE = {
    "p1_terms": _P1 + "SELECT * FROM m",
    "p1_found": _P1 + "SELECT field, term, 'rare' AS mark FROM m WHERE is_rare UNION ALL SELECT field, term, 'common' FROM m WHERE is_common",
    "p4_found": """
WITH r AS (
  SELECT *, lower(trim(text, ' ')) AS term,
    CASE sentiment_confidence WHEN 'confirmed_negative' THEN 3 WHEN 'governance_adjusted' THEN 2 WHEN 'standard' THEN 1 ELSE 0 END AS trust
  FROM mentions WHERE source IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL
), w AS (
  SELECT source, page, term, mention_id,
    coalesce(length(context), 0) > 0 AS c_ok, coalesce(semantic_score > 0 AND NOT isnan(semantic_score), false) AS s_ok, sentiment_score IS NOT NULL AS t_ok,
    row_number() OVER (PARTITION BY source, page, term ORDER BY coalesce(length(context), 0) > 0 DESC, length(context) DESC, created_at DESC NULLS LAST, mention_id) AS c,
    row_number() OVER (PARTITION BY source, page, term ORDER BY coalesce(semantic_score > 0 AND NOT isnan(semantic_score), false) DESC, created_at DESC NULLS LAST, confidence_score DESC NULLS LAST, mention_id) AS s,
    row_number() OVER (PARTITION BY source, page, term ORDER BY sentiment_score IS NOT NULL DESC, trust DESC, created_at DESC NULLS LAST, mention_id) AS t
  FROM r
)
SELECT min(mention_id) AS group_id, coalesce(max(mention_id) FILTER (c = 1 AND c_ok), 0) AS context_id,
  coalesce(max(mention_id) FILTER (s = 1 AND s_ok), 0) AS semantic_id, coalesce(max(mention_id) FILTER (t = 1 AND t_ok), 0) AS sentiment_id
FROM w GROUP BY source, page, term HAVING count(*) > 1""",
    "p5_found": """
WITH once AS (
  SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY created_at DESC, index_id DESC) AS k FROM adoption_index
), ranked AS (
  SELECT year, industry, index_id, row_number() OVER (PARTITION BY year, industry ORDER BY ai_adoption_index DESC, company) AS pos
  FROM once WHERE k = 1 AND industry IS NOT NULL AND ai_adoption_index IS NOT NULL AND NOT isnan(ai_adoption_index)
)
SELECT year, industry, CAST(pos AS INTEGER) AS pos, index_id FROM ranked WHERE pos <= 5""",
    "p7_found": """
WITH w AS (
  SELECT mention_id, lower(trim(text, ' ')) AS t, list_distinct(regexp_extract_all(lower(context), '[\\p{L}\\p{N}]+')) AS w FROM mentions WHERE text IS NOT NULL AND context IS NOT NULL
), k AS (
  SELECT * FROM w WHERE len(w) >= 30
), p AS (
  SELECT a.mention_id AS mention_a, b.mention_id AS mention_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb
  FROM k a JOIN k b ON a.t = b.t AND a.mention_id < b.mention_id AND len(a.w) * 10 >= len(b.w) * 7 AND len(b.w) * 10 >= len(a.w) * 7
)
SELECT mention_a, mention_b FROM p WHERE i * 10 >= 7 * (na + nb - i)""",
    "p7_links": """
WITH w AS (
  SELECT mention_id, lower(trim(text, ' ')) AS t, context, list_distinct(regexp_extract_all(lower(context), '[\\p{L}\\p{N}]+')) AS w FROM mentions WHERE text IS NOT NULL AND context IS NOT NULL
), k AS (
  SELECT * FROM w WHERE len(w) >= 30
), p AS (
  SELECT a.mention_id, count(*) AS n FROM k a JOIN k b ON a.t = b.t AND a.mention_id <> b.mention_id AND 10 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) GROUP BY 1
)
SELECT mention_id, min(mention_id) OVER (PARTITION BY t, context) AS class_id, coalesce(n, 0)::BIGINT AS links FROM k LEFT JOIN p USING (mention_id)""",
    "p9_found": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL
), dg AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)
), ig AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)
)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_longest": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL
), dg AS (
  SELECT doc_id, k AS dk, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)
), ig AS (
  SELECT item_id, k AS ik, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)
), hit AS (
  SELECT DISTINCT doc_id, item_id, dk, dk - ik AS shift FROM dg JOIN ig USING (g)
), run AS (
  SELECT doc_id, item_id, shift, dk - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY dk) AS part FROM hit
)
SELECT doc_id, item_id, max(n + 11)::BIGINT AS longest FROM (SELECT doc_id, item_id, count(*) AS n FROM run GROUP BY doc_id, item_id, shift, part) GROUP BY doc_id, item_id""",
    "p1_ngrams": """
WITH p AS (
  SELECT mention_id, list_filter(flatten(list_transform(string_split(lower(detection_method), '|'), lambda x: CASE WHEN trim(x, ' ') LIKE 'reasons=%' THEN list_transform(string_split(substr(trim(x, ' '), 9), ','), lambda y: trim(y, ' ')) ELSE [trim(x, ' ')] END)), lambda t: t <> '') AS w FROM mentions WHERE detection_method IS NOT NULL
), s AS (
  SELECT mention_id, w, unnest(range(1, len(w) + 1)) AS a FROM p
), g AS (
  SELECT mention_id, n, array_to_string(w[a:a + n - 1], ' | ') AS ngram FROM (SELECT mention_id, w, a, unnest(range(1, len(w) - a + 2)) AS n FROM s)
)
SELECT n::INTEGER AS n, ngram, count(*) AS occurrences, count(DISTINCT mention_id) AS records FROM g GROUP BY n, ngram""",
    "p10_found": """
WITH g AS (
  SELECT DISTINCT doc_id, hash(substr(text, i, 300)) AS h1, md5(substr(text, i, 300)) AS h2
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)
)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.h1 = b.h1 AND a.h2 = b.h2 AND a.doc_id < b.doc_id""",
    "p10_share": """
WITH g AS (
  SELECT doc_id, i, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)
), s AS (
  SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1)
), c AS (
  SELECT doc_id, sum(least(300, coalesce(next - i, 300))) AS shared_chars FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM s) GROUP BY doc_id
)
SELECT doc_id, length(text) AS n_chars, CAST(shared_chars AS BIGINT) AS shared_chars, round(shared_chars / length(text), 6) AS share FROM c JOIN documents USING (doc_id)""",
}
