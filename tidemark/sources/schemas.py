"""The tables of the engine: columns, keys and partitions, and the statements that make them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MENTION = "company string, year int, position int, industry string, sector string, country string, doc_type string, page int, text string, context string, category_a string, category_b string, category_a_confidence double, category_b_confidence double, eu_domain string, eu_subdomain string, eu_confidence double, sentiment string, sentiment_score double, sentiment_confidence string, semantic_score double, detection_method string, source string, robotics_type string, rpa_type string, reference_strength string, confidence_score double, confidence_reasons string"
_INDEX = "position int, industry string, sector string, country string, intensity_index double, semantic_index double, diversity_index double, sentiment_index double, maturity_index double, future_index double, commitment_index double, ai_adoption_index double, diversity_index_eu double, ai_adoption_index_eu double, rank_in_year int, total_refs int, total_pages int, categories_used int, categories_used_eu int"


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...]
    partitions: tuple[str, ...] = ("year",)


TABLES = {
    "mentions_raw": Table(f"{_MENTION}, occurrence_count bigint, ref_hash string", ("company", "year", "doc_type", "page", "text")),
    "mentions_merged": Table("company string, year int, context string, representative bigint, sources string, doc_count bigint, total_occurrences bigint, avg_sentiment_score double, avg_semantic_score double, avg_confidence_score double", ("company", "year", "context")),
    "adoption_index": Table(f"company string, year int, {_INDEX}", ("company", "year")),
    "adoption_index_by_doctype": Table(f"company string, year int, doc_type string, {_INDEX}", ("company", "year", "doc_type")),
    "adoption_index_industry": Table("industry string, year int, ai_adoption_index_avg double, num_companies bigint, total_refs bigint, min_index double, max_index double, std_deviation double, companies string, rank_in_year int", ("industry", "year")),
    "processed_documents": Table("source string, company string, year int, position int, industry string, doc_type string, total_pages int, text_length int, refs_found int, process_count int, file_hash string, text_status string, first_processed_at timestamp, last_processed_at timestamp", ("source",), ()),
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Makes the tables that are missing, and adds the columns that an older one lacks; nothing is dropped."""
    for name, made in TABLES.items():
        full = f"`{database}`.`{name}`"
        if not spark.catalog.tableExists(f"{database}.{name}"):
            parts = f" PARTITIONED BY ({', '.join(made.partitions)})" if made.partitions else ""
            spark.sql(f"CREATE TABLE {full} ({made.columns}) USING parquet{parts}")
            continue
        held = {f.name for f in spark.table(f"{database}.{name}").schema}
        missing = [f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], made.columns).schema if f.name not in held]
        if missing:
            spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({', '.join(missing)})")


def replaced(old: DataFrame, new: DataFrame, name: str, order: str) -> DataFrame:
    """Insert-or-replace: the rows of both with one for each key, the last by `order`, a new one before an old one at ties."""
    columns = [c for c in old.columns if c not in TABLES[name].key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*TABLES[name].key).agg(F.max_by(F.struct(*columns), F.struct(order, "_new")).alias("_r")).select(*TABLES[name].key, "_r.*").select(*old.columns)
