"""Sinks: tables, CSV sheets, JSON and text reports. Everything is written by the executors."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import sanitized


def write_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Insert-or-replace by partition: only the partitions that `df` has are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_sheet(df: DataFrame, path: str, digits: int = 3) -> None:
    """A CSV sheet: numbers rounded, texts without control characters."""
    columns = [F.round(c, digits).alias(c) if kind in ("double", "float") else sanitized(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_index_json(index: DataFrame, path: str) -> None:
    """One JSON object a company and year, its dimensions nested."""
    dimensions = [c for c in index.columns if c.endswith("_index") and not c.startswith("ai_")]
    index.select(*[c for c in index.columns if c not in dimensions], F.struct(*dimensions).alias("dimensions")).write.mode("overwrite").json(path)


def write_workbook(sheets: dict[str, DataFrame], path: str, digits: int = 3) -> None:
    """A folder with a sheet for each table: the index, its summaries, the distribution, and what it was made with."""
    for name, df in sheets.items():
        write_sheet(df, f"{path}/{name}", digits)


def index_workbook(index: DataFrame, settings: str) -> dict[str, DataFrame]:
    """The sheets of an index (company, year, industry, sector, country, ai_adoption_index, total_refs): all rows with their
    band, summaries by year and group, metadata."""
    band = F.when(F.col("ai_adoption_index").isNull(), "none").when(F.col("ai_adoption_index") >= 50, "green").when(F.col("ai_adoption_index") >= 30, "amber").otherwise("red")
    means = [F.avg("ai_adoption_index").alias("mean_index"), F.count("*").alias("n"), F.sum("total_refs").alias("total_refs")]
    by = lambda g: index.where(~F.coalesce(g, F.lit("")).isin("", "Unknown")).groupBy(g).agg(F.countDistinct("company").alias("n_companies"), *means)
    groups = {f"by_{g}": by(g) for g in ("industry", "sector", "country") if g in index.columns}
    top = F.max_by("company", F.struct("ai_adoption_index", "company")).alias("top_company")
    meta = index.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in sorted(json.loads(settings).items())], "name string, value string")
    return {"index": index.withColumn("band", band), "by_year": index.groupBy("year").agg(*means, top), **groups, "metadata": meta}


def write_text_report(rows: DataFrame, path: str, template: str, *columns: str) -> None:
    """One line of text a row, made by a printf template."""
    rows.select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)


def provenance(settings: dict, commit: str = "") -> str:
    """What a result was made with, as JSON for a file beside it."""
    return json.dumps({"generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "git_commit": commit[:12], "settings": settings}, sort_keys=True)
