"""Sentiment of contexts: a lexicon or a scorer of the user's, and the correction for texts on governance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocabulary as v

SHORTEST, CUT, SOFTENED = 10, 0.1, 0.3


def polarity(text: Column) -> Column:
    """The mean score of the lexicon's words in a text, 0 without any."""
    lexicon = F.create_map(*[x for k, s in (v.POSITIVE | v.NEGATIVE).items() for x in (F.lit(k), F.lit(s))])
    scores = F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: lexicon[w]), lambda s: s.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores)).otherwise(0.0)


def label_of(score: Column) -> Column:
    return F.when(score > CUT, "positive").when(score < -CUT, "negative").otherwise("neutral")


def scored(rows: DataFrame, text: str, scorer: Callable[[list[str]], list[float]] | None = None) -> DataFrame:
    """`rows` with score and label. Null texts and texts of fewer than ten characters are neutral; the others are scored by the
    lexicon, or by `scorer` for a batch of texts at a time (a model is loaded where it is called, once a worker)."""
    enough = F.coalesce(F.length(F.trim(text)) >= SHORTEST, F.lit(False))
    if scorer is None:
        made = rows.withColumn("score", F.when(enough, polarity(F.col(text))).otherwise(0.0))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, judged = batch.column(text).to_pylist(), batch.column("score").to_pylist()
                at = [i for i, j in enumerate(judged) if j]
                scores = [0.0] * len(texts)
                for i, s in zip(at, scorer([texts[i] for i in at]) if at else []):
                    scores[i] = float(s)
                yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(scores, pa.float64()))

        marked = rows.withColumn("score", enough)
        made = marked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double")
    return made.withColumn("label", label_of(F.col("score")))


def corrected(rows: DataFrame, text: str) -> DataFrame:
    """`rows` of `scored` with the correction: a negative text on governance that says nothing truly negative keeps three tenths
    of its score; flag is confirmed_negative, governance_adjusted or standard."""
    stands = lambda terms: F.coalesce(F.lower(text).rlike(v.exists(v.any_of(terms))), F.lit(False))
    negative, governance, truly = F.col("label") == "negative", stands(v.GOVERNANCE), stands(v.TRULY_NEGATIVE)
    softened = negative & governance & ~truly
    score = F.when(softened, F.col("score") * SOFTENED).otherwise(F.col("score"))
    flag = F.when(truly, "confirmed_negative").when(softened, "governance_adjusted").otherwise("standard")
    return rows.withColumns({"label": F.when(softened & (score > -CUT), "neutral").otherwise(F.col("label")), "score": score, "flag": flag})
