"""The whole pipeline: filings to mentions, merged mentions, index and ranks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import text as t
from tidemark.operators import classify, detect, index, merge, semantic, similarity

MODES = ("all", "range", "new", "again", "batch")


@dataclass(frozen=True)
class Result:
    mentions: DataFrame
    upserted: DataFrame
    index: DataFrame
    by_doc_type: DataFrame
    merged: Callable[[], DataFrame]
    counters: DataFrame


def chosen(filings: DataFrame, mode: str = "all", processed: DataFrame | None = None, positions: tuple[int, int] | None = None, batch: int | None = None) -> DataFrame:
    """The filings of a run: all; those in a `range` of leading positions; `new` ones, that are not in `processed`; those to be
    done `again`; or a `batch` of the last new ones by name."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "range":
        if positions is None:
            raise ValueError("mode range needs positions")
        return filings.where(F.nullif(F.regexp_extract("source", r"^(\d{1,3})\.", 1), F.lit("")).cast("int").between(*positions))
    if processed is not None and mode in ("new", "again", "batch"):
        filings = filings.join(processed.select("source"), "source", "left_semi" if mode == "again" else "left_anti")
    if mode == "batch":
        names = filings.select("source").distinct().orderBy(F.col("source").desc()).limit(batch or 10)
        filings = filings.join(names, "source", "left_semi")
    return filings


def with_clusters(rows: DataFrame, row_id: str, groups: list[str], text: str, threshold: float = 0.85) -> DataFrame:
    """`rows` with the cluster of each: rows of a group whose word vectors have a cosine of at least `threshold`, directly or by
    way of others, named by the smallest id. Rows with a null or wordless text are clusters of their own. Equal texts are
    compared once, so copies do not multiply the work."""
    once = rows.dropna(subset=[*groups, text]).groupBy(*groups, text).agg(F.min(row_id).alias("_id"))
    pairs = similarity.similar_in_groups(once, "_id", groups, text, threshold, 500, similarity.word_vectors).select("a", "b")
    worded = rows.where(F.col(text).rlike(r"[\p{L}\p{N}]")).join(once, [*groups, text]).select(F.col("_id").alias("a"), F.col(row_id).alias("b"))
    joined = merge.components(pairs.unionByName(worded.where("a <> b")))
    return rows.join(joined.select(F.col("id").alias(row_id), F.col("component").alias("cluster")), row_id, "left").withColumn("cluster", F.coalesce("cluster", row_id))


def run(filings: DataFrame, config: Config | None = None, processed: DataFrame | None = None, mode: str = "all", positions: tuple[int, int] | None = None, batch: int | None = None, embed: Callable[[list[str]], np.ndarray] | None = None) -> Result:
    """Mentions, upserted and merged mentions, and indices of `filings` (source, text, company, year, doc_type, total_pages).

    With `embed`, paragraphs near an anchor are mentions too. Everything stays lazy; `merged`, whose clusters take several
    jobs, is a function.
    """
    config = config or Config()
    filings = chosen(filings, mode, processed, positions, batch)
    texts = filings.where(F.length("text") >= config.min_text_length)
    found = detect.detect_terms(texts, "source", "text", config).drop("text").withColumn("semantic_score", F.lit(None).cast("double"))
    if embed is not None:
        found = found.unionByName(semantic.detect_paragraphs(texts, "source", "text", config, embed))
    scored = detect.score_mentions(found, config=config)
    both = F.concat_ws(" ", "term", "context")
    a, b, eu = classify.best_category(both, "a"), classify.best_category(both, "b"), classify.best_category(both, "eu", None, "Unclassified")
    mentions = scored.withColumns({"_a": a, "_b": b, "_eu": eu}).withColumns(
        {"category_a": F.col("_a.code"), "category_b": F.col("_b.code"), "eu_subdomain": F.col("_eu.code"), "eu_domain": F.col("_eu.domain"), "sentiment_score": F.lit(None).cast("double"), "mention_id": F.xxhash64("source", "sentence_no", "start", "trigger")}
    )
    mentions = mentions.drop("_a", "_b", "_eu")
    keys = ["company", "year", "doc_type", "term"]
    upserted = merge.upsert(mentions, keys, [F.col("source"), F.col("sentence_no"), F.col("start")], ["context", "category_a", "category_b", "eu_subdomain"], ["reference_strength"], ["confidence_score"])
    pages = lambda by: filings.groupBy(*by).agg(F.sum("total_pages").cast("bigint").alias("total_pages"))

    def merged() -> DataFrame:
        rows = mentions.select("mention_id", "company", "year", "doc_type", "context", "confidence_score", "semantic_score", "sentiment_score").withColumns({"occurrence_count": F.lit(1), "plain": t.unmarked(F.col("context"))})
        return merge.merge_clusters(with_clusters(rows, "mention_id", ["company", "year"], "plain", config.deduplication_threshold), "cluster", "mention_id", "confidence_score", "semantic_score", "context", "doc_type", "occurrence_count", "sentiment_score")

    counters = mentions.groupBy("source").agg(F.count("*").alias("total_refs"), F.count_if(F.col("trigger") == "semantic").alias("semantic_refs"), F.count_if(F.col("reference_strength") == "mention_only").alias("mention_only_refs"))
    by = ["company", "year"]
    return Result(mentions, upserted, index.adoption_index(mentions, by, pages(by), config), index.adoption_index(mentions, [*by, "doc_type"], pages([*by, "doc_type"]), config), merged, filings.select("source").join(counters, "source", "left").fillna(0))
