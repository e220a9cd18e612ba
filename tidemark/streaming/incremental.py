"""Incremental processing with Structured Streaming: new files are mentions to fold into the table of merged mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import ship

#: Columns of the running state of a mention: sums and extremes, so that folding batches in any split gives one result.
KEYS = ["company", "year", "doc_type", "page", "text"]


def partial(rows: DataFrame) -> DataFrame:
    """The state of a set of mentions: occurrences, the largest confidence, and the first and last row by id; NaN is null."""
    rows = rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("semantic_score", "confidence_score")})
    first = F.min(F.struct("mention_id", "context", "category_a"))
    last = F.max(F.struct("mention_id", "semantic_score"))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("occurrence_count"), F.max("confidence_score").alias("confidence_score"), first.alias("first_row"), last.alias("last_row"))


def fold(state: DataFrame, other: DataFrame) -> DataFrame:
    """Two states as one."""
    both = state.unionByName(other).groupBy(*KEYS)
    return both.agg(F.sum("occurrence_count").alias("occurrence_count"), F.max("confidence_score").alias("confidence_score"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"))


def merged(state: DataFrame) -> DataFrame:
    """The merged mentions of a state."""
    return state.select(*KEYS, "occurrence_count", "confidence_score", F.col("first_row.context").alias("context"), F.col("first_row.category_a").alias("category_a"), F.col("last_row.semantic_score").alias("semantic_score"))


def stream_mentions(spark: SparkSession, inbox: str, schema, folder: str) -> DataFrame:
    """Folds every file of `inbox` that was not seen before into the state below `folder`, and returns the merged mentions.

    The file source keeps track of files in the checkpoint, so each is read once, also after a failure. A batch writes its own
    partial state under its number, which makes a repeated batch harmless; states are folded when they are read.
    """
    ship(spark)

    def keep(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    stream = spark.readStream.schema(schema).parquet(inbox)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    state = spark.read.parquet(f"{folder}/state").drop("batch")
    return merged(fold(state, state.limit(0)))


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events a window and type; with a stream, rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("begin"), "event_type", "n", "value")
