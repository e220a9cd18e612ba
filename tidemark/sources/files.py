"""Sources: folders of filings, company files, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t


def list_filings(spark: SparkSession, folder: str, processed: DataFrame | None = None, positions: tuple[int, int] | None = None, skip_chinese: bool = True) -> DataFrame:
    """(path, source, length) of the PDF files below a folder, without Chinese versions, files outside the range of leading
    positions, and those in `processed` (source). Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    files = files.withColumn("source", F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B")))
    if skip_chinese:
        files = files.where(~t.is_chinese_version(F.col("source")))
    if positions:
        at = F.nullif(F.regexp_extract("source", r"^(\d{1,3})\.", 1), F.lit("")).cast("int")
        files = files.where(at.between(*positions))
    if processed is not None:
        files = files.join(processed.select("source"), "source", "left_anti")
    return files.select("path", "source", "length")


def _matching(columns: list[str], names: tuple[str, ...], part: bool) -> str | None:
    found = [c for c in columns if (any(n in c.strip().lower() for n in names) if part else c.strip().lower() in names)]
    return (found[-1] if part else found[0]) if found else None


def company_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, company, position, sector, industry, country) of a CSV file with these headers in any case; name and rank are
    other words for company and position. Later lines win; missing values become 0 and Unknown."""
    rows = spark.read.csv(path, header=True)
    wanted = {"company": ("company", "name"), "position": ("rank", "position"), "sector": ("sector",), "industry": ("industry",), "country": ("country",)}
    held = {k: _matching(rows.columns, n, False) for k, n in wanted.items()}
    if held["company"] is None:
        raise ValueError("the file has no column company or name")
    value = lambda k: F.col(f"`{held[k]}`") if held[k] else F.lit(None).cast("string")
    rows = rows.select(F.trim(value("company")).alias("company"), F.coalesce(F.expr("try_cast(null as int)") if not held["position"] else value("position").try_cast("int"), F.lit(0)).alias("position"), *[F.coalesce(value(k), F.lit("Unknown")).alias(k) for k in ("sector", "industry", "country")], F.monotonically_increasing_id().alias("line"))
    last = rows.where("company <> ''").groupBy(F.lower("company").alias("key")).agg(F.max_by(F.struct("company", "position", "sector", "industry", "country"), "line").alias("r"))
    return last.select("key", "r.*")


def industry_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, industry) of a CSV file: the last column whose header contains company or name, and industry or sector."""
    rows = spark.read.csv(path, header=True)
    company, industry = _matching(rows.columns, ("company", "name"), True), _matching(rows.columns, ("industry", "sector"), True)
    if not company or not industry:
        raise ValueError("the file needs a company and an industry column")
    pairs = rows.select(F.lower(F.trim(F.col(f"`{company}`"))).alias("key"), F.trim(F.col(f"`{industry}`")).alias("industry"), F.monotonically_increasing_id().alias("line")).dropna()
    return pairs.groupBy("key").agg(F.max_by("industry", "line").alias("industry"))


def with_industry(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """`rows` with the industry of the mapping where it has the company, in any case."""
    named = mapping.select(F.col("key").alias("_k"), F.col("industry").alias("_new"))
    return rows.join(named, F.lower(F.trim("company")) == F.col("_k"), "left").withColumn("industry", F.coalesce("_new", "industry")).drop("_k", "_new")
