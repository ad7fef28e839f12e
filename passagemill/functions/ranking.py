"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import new_path


def distributed_row_number(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based row number per ``keys``, also when one group holds most rows.

    A window would put a whole group into one task. Here the rows are range
    partitioned and written in order to the shared folder; a row's number is
    its place in its file, less where its group begins there, plus the group's
    rows in the files before. Only one row per group and file meets a window.
    """
    spark = df.sparkSession
    path = new_path(spark, "ranked")
    ordering = [F.col(k) for k in keys] + order
    df.repartitionByRange(*ordering).sortWithinPartitions(*ordering).write.parquet(path)
    name = F.col("_metadata.file_name")
    back = spark.read.schema(df.schema).parquet(path).select(
        *df.columns,
        (
            F.regexp_extract(name, r"part-(\d+)", 1).cast("bigint") * 1_000_000
            + F.regexp_extract(name, r"-c(\d+)", 1).cast("bigint")
        ).alias("__file"),
        F.col("_metadata.row_index").alias("__index"),
    )
    before = Window.partitionBy(*keys).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        back.groupBy(*keys, "__file")
        .agg(F.min("__index").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    on = [F.col("a.__file") == F.col("b.__file")]
    on += [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return back.alias("a").join(spans.alias("b"), on).select(
        *[F.col(f"a.{c}") for c in df.columns],
        (F.col("b.__start") + F.col("a.__index") - F.col("b.__first") + 1).alias(out),
    )
