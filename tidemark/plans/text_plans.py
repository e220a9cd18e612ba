"""Queries of text scalars, file names and encoded metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import vocabulary as v
from tidemark.functions import text as t
from tidemark.operators.detect import mark_priority_term
from tidemark.sources.tables import table


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents", "doc_id", "text")


def text_clean(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", F.md5(t.clean(F.col("text"))).alias("clean_md5"), F.length(t.clean(F.col("text"))).cast("bigint").alias("clean_chars"))


def text_corruption(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", t.corruption(F.col("text")).alias("reason"))


def text_boilerplate(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", F.md5(t.without_boilerplate(F.col("text"))).alias("stripped_md5"))


def text_page_estimate(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).where("text is not null").select("doc_id", t.page_estimate(F.col("text")).alias("page"))


def text_sanitize(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", F.md5(t.sanitized(F.col("text"))).alias("sane_md5"))


def text_strip_markers(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mentions", "mention_id", "context").select("mention_id", t.unmarked(F.col("context")).alias("plain"))


def text_segments(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "context").select("mention_id", F.posexplode(t.segments(F.col("context"))).alias("seq", "s"))
    return rows.select("mention_id", "seq", "s.text", "s.marked")


def sentence_split_counts(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).where("text is not null").select("doc_id", F.size(t.sentences(F.col("text"))).alias("n_sentences"))


def paragraph_explode(spark: SparkSession, base: str) -> DataFrame:
    rows = _docs(spark, base).where("text is not null").select("doc_id", F.posexplode(t.paragraphs(F.col("text"), "\n", 100)).alias("seq", "paragraph"))
    return rows.select("doc_id", "seq", F.length("paragraph").cast("bigint").alias("n_chars"), F.md5("paragraph").alias("paragraph_md5"))


PRIORITY = [r"generative ai", r"large language models?", r"machine learning", r"deep learning", r"artificial intelligence", r"ai"]


def mark_priority(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "context").where("context is not null").withColumn("plain", t.unmarked(F.col("context")))
    term, marked = mark_priority_term(F.col("plain"), PRIORITY)
    return rows.select("mention_id", term.alias("term"), (marked != F.col("plain")).alias("is_marked"))


def ref_hash(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "company", "year", "doc_type", "page", "text")
    return rows.select("mention_id", t.reference_hash(*[F.col(c) for c in ("company", "year", "doc_type", "page", "text")]).alias("made_hash"))


def meta_decode(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mentions", "mention_id", "detection_method").select("mention_id", *[c.alias(n) for n, c in t.decoded_detection(F.col("detection_method")).items()])


def meta_encode(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "mentions", "mention_id", "reference_strength", "confidence_score", "confidence_reasons").dropna()
    made = t.encoded_detection(F.lit("pattern"), F.lit("soft"), F.col("reference_strength"), F.col("confidence_score"), F.col("confidence_reasons"))
    return rows.select("mention_id", made.alias("encoded"))


def filename_parse(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents", "source").distinct().select("source", *[c.alias(n) for n, c in t.file_name(F.col("source")).items()])


def chinese_filter(spark: SparkSession, base: str) -> DataFrame:
    names = table(spark, base, "customer", "c_custkey", "c_mktsegment").select("c_custkey", F.concat(F.lit("7. "), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "_CN.pdf").when(F.col("c_custkey") % 3 == 1, " cn.pdf").otherwise("-EN.pdf")).alias("name"))
    return names.where(~t.is_chinese_version(F.col("name"))).select("c_custkey", "name")


def position_range(spark: SparkSession, base: str) -> DataFrame:
    at = F.regexp_extract("source", r"^(\d{1,3})\.", 1)
    return table(spark, base, "processed_documents", "source").where((at != "") & at.cast("int").between(50, 250)).select("source", at.cast("int").alias("position")).distinct()


_W = v.WORD_CHARS
_T = "string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def _nested(source: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        source = f"regexp_replace({source}, '{pattern}', '{to}', 'g')"
    return source


_CLEAN_RULES = (
    [(rf"(?i)\b{''.join(f'({c})' for c in n)}\b", "".join(f"\ue000\\{i + 1}" for i in range(len(n))) + "\ue000") for n in t.COMPOUND_NAMES if len(n) < 10]
    + [(r"([a-z])([A-Z][a-z])", r"\1 \2"), (r"([a-z])([A-Z]{2,})", r"\1 \2"), (r"([A-Z]{2,})([a-z])", r"\1 \2"), (r"(\.)([A-Z])", r"\1 \2"), (r"(,)([a-zA-Z])", r"\1 \2"), ("\ue000", ""), (" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"^\s+|\s+$", "")]
)


def clean_sql(source: str) -> str:
    """The text cleaner as SQL over an expression."""
    return _nested(source, _CLEAN_RULES)


def boilerplate_sql(source: str) -> str:
    """The boilerplate strip as SQL over an expression."""
    return _nested(source, [(p, " ") for p in t.BOILERPLATE])


_CLEAN = clean_sql("text")
_KIND = "CASE " + " ".join(f"WHEN contains(lower(stem), '{n}') THEN '{label}'" for n, label in t.DOC_TYPES) + " ELSE 'Annual Report' END"
_MARK = "coalesce(" + ", ".join(f"nullif(regexp_extract(plain, '(?i)(^|[^{_W}])({c})([^{_W}-]|$)', 2), '')" for c in PRIORITY) + ")"

QUERIES = {f.__name__: f for f in (text_clean, text_corruption, text_boilerplate, text_page_estimate, text_sanitize, text_strip_markers, text_segments, sentence_split_counts, paragraph_explode, mark_priority, ref_hash, meta_decode, meta_encode, filename_parse, chinese_filter, position_range)}

ORACLE = {
    "text_clean": f"SELECT doc_id, md5(c) AS clean_md5, length(c) AS clean_chars FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)",
    "text_corruption": """
SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 100 THEN 'empty' WHEN (length(text) - length(replace(text, '�', ''))) / length(text) > 0.05 THEN 'replacement_chars'
  WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) < 0.40 THEN 'low_letters'
  WHEN length(text) > 500 AND (length(text) - length(replace(text, ' ', ''))) / length(text) < 0.08 THEN 'no_spaces' ELSE 'valid' END AS reason FROM documents""",
    "text_boilerplate": f"SELECT doc_id, md5({boilerplate_sql('text')}) AS stripped_md5 FROM documents",
    "text_page_estimate": "SELECT doc_id, CAST((length(text) - length(replace(text, chr(10), ''))) // 50 + 1 AS INTEGER) AS page FROM documents WHERE text IS NOT NULL",
    "text_sanitize": r"""
SELECT doc_id, md5(CASE WHEN length(s) > 32000 THEN substr(s, 1, 32000) || '...' ELSE s END) AS sane_md5 FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(translate(coalesce(text, ''), '“”„«»‘’‚–—' || chr(160), '''''' || ''), '…', '...'), '€', 'EUR'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), ' +', ' ', 'g'), ' ') AS s FROM documents)""".replace("'''''' || ''", "'\"\"\"\"\"''''''-- '"),
    "text_strip_markers": "SELECT mention_id, regexp_replace(context, '>>>(.*?)<<<', '\\1', 'g') AS plain FROM mentions",
    "text_segments": """
SELECT mention_id, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY i) - 1 AS INTEGER) AS seq, p[i] AS text, i % 2 = 0 AS marked
FROM (SELECT mention_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT mention_id, string_split_regex(context, '>>>|<<<') AS p FROM mentions WHERE context IS NOT NULL)) WHERE length(p[i]) > 0""",
    "sentence_split_counts": f"SELECT doc_id, CAST(len({_T}) AS INTEGER) AS n_sentences FROM documents WHERE text IS NOT NULL",
    "paragraph_explode": """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, length(p[i]) AS n_chars, md5(p[i]) AS paragraph_md5 FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 100) AS p FROM documents WHERE text IS NOT NULL))""",
    "mark_priority": f"SELECT mention_id, coalesce(term, substr(plain, 1, 50)) AS term, term IS NOT NULL AS is_marked FROM (SELECT mention_id, plain, {_MARK} AS term FROM (SELECT mention_id, regexp_replace(context, '>>>(.*?)<<<', '\\1', 'g') AS plain FROM mentions WHERE context IS NOT NULL))",
    "ref_hash": """
SELECT mention_id, substr(sha256(coalesce(company, '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || coalesce(doc_type, '') || '|' || coalesce(CAST(page AS VARCHAR), '') || '|' || coalesce(substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 200), '')), 1, 32) AS made_hash FROM mentions""",
    "meta_decode": """
SELECT mention_id, nullif(regexp_extract(detection_method, '(?:^|\\|)strength=([a-z_]+)', 1), '') AS strength, CAST(nullif(regexp_extract(detection_method, '(?:^|\\|)conf=([0-9.]+)', 1), '') AS DOUBLE) AS confidence,
  nullif(regexp_extract(detection_method, '(?:^|\\|)reasons=([^|]*)', 1), '') AS reasons FROM mentions""",
    "meta_encode": "SELECT mention_id, 'pattern|trigger=soft|strength=' || reference_strength || '|conf=' || printf('%.3f', confidence_score) || '|reasons=' || substr(confidence_reasons, 1, 250) AS encoded FROM mentions WHERE reference_strength IS NOT NULL AND confidence_score IS NOT NULL AND confidence_reasons IS NOT NULL",
    "filename_parse": f"""
SELECT source, CAST(coalesce(nullif(regexp_extract(stem, '^(\\d{{1,3}})\\.', 1), ''), '0') AS INTEGER) AS position,
  coalesce(nullif(trim(string_split_regex(regexp_replace(stem, '^\\d{{1,3}}\\.\\s*', ''), '\\s+-\\s+')[1], ' '), ''), 'Unknown') AS company,
  CAST(coalesce(nullif(regexp_extract(stem, '(?:^|[ _-])(20(?:1[5-9]|2[0-5]))(?:$|[ _-])', 1), ''), '2024') AS INTEGER) AS year, {_KIND} AS doc_type
FROM (SELECT DISTINCT source, regexp_replace(source, '(?i)\\.pdf$', '') AS stem FROM documents)""",
    "chinese_filter": """
SELECT c_custkey, name FROM (SELECT c_custkey, '7. ' || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN '_CN.pdf' WHEN 1 THEN ' cn.pdf' ELSE '-EN.pdf' END AS name FROM customer)
WHERE NOT (regexp_matches(regexp_replace(name, '(?i)\\.pdf$', ''), '[ _-]CN$') OR upper(regexp_replace(name, '(?i)\\.pdf$', '')) LIKE '% CN')""",
    "position_range": "SELECT DISTINCT source, CAST(regexp_extract(source, '^(\\d{1,3})\\.', 1) AS INTEGER) AS position FROM processed_documents WHERE TRY_CAST(nullif(regexp_extract(source, '^(\\d{1,3})\\.', 1), '') AS INTEGER) BETWEEN 50 AND 250",
}
