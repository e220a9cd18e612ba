"""Detection of paragraphs by meaning: the cosine of their vectors with those of a fixed set of anchor texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocabulary as v
from tidemark.config import Config
from tidemark.functions import predicates as p
from tidemark.functions import text as t
from tidemark.operators.detect import mark_priority_term

#: Anchors of our own: what the categories of the taxonomy are about.
ANCHORS = [" ".join(keywords) for _, _, _, keywords, _ in v.TAXONOMY]
#: Terms that name a paragraph, in order of preference.
PRIORITY = [v.core(x) for x in ("generative AI", "large language model(s)", "machine learning", "deep learning", "artificial intelligence", "computer vision", "chatbot(s)", "AI")]
BATCH = 32


def hashed_vectors(texts: list[str], size: int = 512) -> np.ndarray:
    """Word counts hashed into `size` places: a stand-in where no sentence model is at hand."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        for w in re.findall(r"[^\W_]{3,}", text.lower()):
            out[i, zlib.crc32(w.encode()) % size] += 1
    return out


def detect_paragraphs(docs: DataFrame, key: str, text: str, config: Config | None = None, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, anchors: list[str] | None = None, separator: str = "\n\n") -> DataFrame:
    """The columns of `detect_terms` and semantic_score for each paragraph near enough to an anchor.

    Paragraphs of more than 100 characters are embedded in batches; one with a hard term or a cue of implementation needs
    `semantic_threshold`, any other `semantic_strict_threshold`. sentence_no is the paragraph's number, start 0, the trigger
    `semantic`. Null and empty texts give no rows; a vector of length 0 is near nothing.
    """
    config, anchors = config or Config(), anchors or ANCHORS
    columns = [c for c in docs.columns if c != text]
    rows = docs.select(*columns, F.posexplode(t.paragraphs(F.col(text), separator)).alias("sentence_no", "_p"))

    def unit(m: np.ndarray) -> np.ndarray:
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.zeros_like(m, dtype=float), where=length > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = unit(embed(anchors))
        for batch in batches:
            held = batch.column("_p").to_pylist()
            best = [unit(embed(held[i : i + BATCH])) @ fixed.T for i in range(0, len(held), BATCH)]
            yield batch.append_column("semantic_score", pa.array(np.concatenate(best).max(axis=1) if best else np.empty(0), pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", semantic_score double"
    scored = rows.mapInArrow(score, schema)
    cue = p.holds(F.col("_p"), *v.HARD) | p.holds(F.col("_p"), *v.IMPLEMENTATION)
    near = scored.where(F.col("semantic_score") >= F.when(cue, config.semantic_threshold).otherwise(config.semantic_strict_threshold))
    term, marked = mark_priority_term(F.col("_p"), PRIORITY)
    return near.select(*columns, "sentence_no", F.lit(0).alias("start"), F.lit("semantic").alias("trigger"), term.alias("term"), F.col("_p").alias("context"), marked.alias("marked"), "semantic_score")
