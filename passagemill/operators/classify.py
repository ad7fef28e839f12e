"""Zero-shot labels for chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import options as opt
from passagemill import schemas
from passagemill.functions import vectors as vec

MAX_LABELS = 10_000

# Texts and labels to one row of scores per text.
LabelScorer = Callable[[list[str], list[str]], list[list[float]]]


def label_table(spark, labels: list[str] | None = None) -> DataFrame:
    names = opt.DEFAULT_LABELS if labels is None else labels
    return spark.createDataFrame([(x,) for x in names], "label string")


def classify_zero_shot(
    chunks: DataFrame,
    labels: DataFrame,
    *,
    multi_label: bool = True,
    scorer: LabelScorer | None = None,
    dim: int = 64,
    batch: int = 16,
) -> DataFrame:
    """Adds labels and scores, best first, with the top label and a status.

    Without a caller's ``scorer`` a label fits as its hashed vector fits the
    chunk's: ``(1 + cos) / 2``, or a softmax over the labels. The label list is
    checked to be small and goes to every task; chunks are not moved.
    """
    names = [r["label"] for r in labels.select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(names) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not names:
        return with_status(chunks, "skipped_no_labels")
    if scorer is None:
        own = labels.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, label string")
        vectors = [r["v"] for r in own.select("i", vec.hashed_vector(F.col("label"), dim).alias("v")).orderBy("i").collect()]
        raw = _hashed_scores(np.array(vectors, dtype=float), multi_label)(vec.hashed_vector(F.col("text"), dim))
        error = F.lit(None).cast("string")
        named = chunks.withColumn("__scores", raw)
    else:
        named = chunks.withColumn("__scored", _model_scores(scorer, names, batch)("text"))
        named = named.withColumn("__scores", F.col("__scored.scores")).withColumn("__error", F.col("__scored.error"))
        error = F.col("__error")
    pairs = F.arrays_zip(F.col("__scores").alias("s"), F.array(*[F.lit(n) for n in names]).alias("l"))
    # By score downwards, then by label.
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["s"]).alias("s"), p["l"].alias("l"))))
    # A filter on labels or scores would else be pushed down and score and sort a second time.
    done = schemas.computed_once(named, "__pairs", F.when(F.col("__scores").isNotNull(), ordered))
    return (
        done.withColumn("labels", F.transform("__pairs", lambda p: p["l"]))
        .withColumn("scores", F.transform("__pairs", lambda p: -p["s"] + F.lit(0.0)))
        .withColumn("top_label", top_label(F.col("labels")))
        .withColumn("top_label_score", top_score(F.col("scores")))
        .withColumn(
            "classification_status",
            F.when(F.col("__scores").isNotNull(), F.lit("success")).otherwise(
                F.lit("error_in_bulk_pipeline_call")
            ),
        )
        .withColumn("classification_error", error)
        .drop("__pairs", "__scores", "__scored", "__error")
    )


def _hashed_scores(labels: np.ndarray, multi_label: bool):
    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        cosines = vec.score_block("cosine", vec.matrix_of(vectors), labels)
        if multi_label:
            return vec.lists_of((1.0 + cosines) / 2.0, pa.float64())
        powers = np.exp(cosines)
        share = powers / powers.sum(axis=1, keepdims=True)
        return vec.lists_of(np.round(share, vec.SCORE_DECIMALS), pa.float64())

    return score


def _model_scores(scorer: LabelScorer, names: list[str], batch: int):
    schema = T.StructType(
        [T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]
    )

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        scores: list = []
        errors: list = []
        values = texts.fillna("").tolist()
        for at in range(0, len(values), batch):
            given = values[at : at + batch]
            try:
                got = [[float(x) for x in row] for row in scorer(given, names)]
                if len(got) != len(given) or any(len(row) != len(names) for row in got):
                    raise ValueError("one score per text and label is needed")
                scores.extend(got)
                errors.extend([None] * len(given))
            except Exception as e:  # noqa: BLE001 - recorded on the rows
                scores.extend([None] * len(given))
                errors.extend([str(e)[:200]] * len(given))
        return pd.DataFrame({"scores": pd.Series(scores, dtype=object), "error": pd.Series(errors, dtype=object)})

    return score


def top_label(labels: Column) -> Column:
    return F.coalesce(F.get(labels, F.lit(0)), F.lit("N/A"))


def top_score(scores: Column) -> Column:
    return F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0))


def with_status(chunks: DataFrame, status: str) -> DataFrame:
    """Unclassified chunks with the reason."""
    return chunks.withColumn("classification_status", F.lit(status))


def skip_reason(enabled: bool, has_classifier: bool | None, labels: list[str] | None) -> str | None:
    """Why chunks are not classified; null when they are, or when it is off."""
    if not enabled:
        return None
    if has_classifier is None:
        return "skipped_no_model_name"
    if not has_classifier:
        return "skipped_classifier_init_failed"
    if labels is not None and not labels:
        return "skipped_no_labels"
    return None


def merge_classification(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Results joined to chunks by id; a chunk without one is marked."""
    fields = [c for c in results.columns if c != "chunk_id"]
    base = chunks.drop(*fields)
    merged = base.join(results, "chunk_id", "left")
    return merged.withColumn(
        "classification_status",
        F.coalesce("classification_status", F.lit("error_missing_pipeline_output_item")),
    )


def label_histogram(selected: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent top labels per query, ``N/A`` left out, ties by first rank."""
    counts = (
        selected.filter(F.coalesce(F.col("top_label"), F.lit("N/A")) != "N/A")
        .groupBy("query_id", F.col("top_label").alias("label"))
        .agg(F.count(F.lit(1)).alias("chunks"), F.min("rank").alias("first_rank"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("chunks").desc(), "first_rank")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
