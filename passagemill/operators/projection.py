"""Two-dimensional layout of vectors for plots."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill import schemas
from passagemill.functions.text import snippet
from passagemill.session import materialize


def pca_reduce(df: DataFrame, k: int, vector_col: str = "vector", out: str = "reduced") -> DataFrame:
    """The ``k`` leading components of a vector column.

    The fit adds up one small matrix per task. Each component is turned so that
    its largest loading is positive, so runs agree.
    """
    prepared = df.withColumn("__v", array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(prepared.select("__v"))
    loadings = model.pc.toArray()
    largest = abs(loadings).argmax(axis=0)
    signs = [1.0 if loadings[row, j] >= 0 else -1.0 for j, row in enumerate(largest)]
    turned = F.zip_with(
        vector_to_array("__pc"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s
    )
    return model.transform(prepared).withColumn(out, turned).drop("__v", "__pc")


def project_2d(points: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Adds ``x`` and ``y``. A single point has no layout and is left out.

    The points are written first, since the fit goes over them several times.
    """
    points = materialize(points, "points")
    alone = points.limit(2).count() < 2
    if alone:
        return points.limit(0).withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    flat = pca_reduce(points, 2, vector_col, "__xy")
    return flat.withColumn("x", F.get("__xy", F.lit(0))).withColumn("y", F.get("__xy", F.lit(1))).drop("__xy")


def viz_points(chunks: DataFrame) -> DataFrame:
    """Plot points of chunks that already have ``x`` and ``y`` (if any)."""
    place = [c for c in ("x", "y") if c in chunks.columns]

    def named(name: str):
        return F.coalesce(schemas.optional(chunks, name), F.lit("N/A"))

    return chunks.select(
        F.col("chunk_id").alias("id"),
        *place,
        named("source_file").alias("source_file"),
        named("display_source_name").alias("display_source"),
        named("top_label").alias("classification"),
        snippet(F.coalesce(F.col("text"), F.lit(""))).alias("snippet"),
    )
