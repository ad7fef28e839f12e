"""Shuffling a table into shards in two passes.

The first pass scatters the records over buckets by a seeded hash; a bucket is
small enough for the memory of one task. The second pass shuffles each bucket
(Spark's ``shuffle`` of an array is Fisher and Yates' algorithm) and writes
it. The buckets one after the other are a random order of all records; shards
are equal slices of it, so their row counts are at most one apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import prefix_sums, text_of
from passagemill.session import materialize, new_path


@dataclass(frozen=True)
class ShardOptions:
    shards: int = 40
    seed: int = 20_011
    bucket_bytes: int = 16 << 20


def plan_buckets(docs: DataFrame, keys: list[str], text: str, options: ShardOptions) -> tuple[DataFrame, int]:
    """Number of rows of each bucket with the rows before it, and how many buckets there are."""
    size = F.octet_length(text_of(text)).cast("bigint") + F.lit(64)
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // options.bucket_bytes))
    counts = docs.groupBy(bucket(keys, buckets, options.seed)).agg(F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts, "bucket-rows")
    return prefix_sums(counts, "__bucket", "rows", "before"), buckets


def bucket(keys: list[str], buckets: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).alias("__bucket")


def write_shards(
    docs: DataFrame, path: str, options: ShardOptions | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> str:
    """Write all rows and columns of ``docs`` below ``path`` as ``shard=<n>`` folders, with a ``slot`` in each.

    ``keys`` name a row, so the scatter does not depend on how the input is
    partitioned; rows that repeat a key stay whole but share a bucket. Null
    keys hash like any value. A null text has no bytes. A record longer than
    ``bucket_bytes`` makes its bucket larger by itself. An empty table writes
    an empty folder. Columns named ``shard``, ``slot`` or ``__bucket`` are
    replaced.
    """
    options = options or ShardOptions()
    docs = docs.drop("shard", "slot", "__bucket")
    offsets, buckets = plan_buckets(docs, list(keys), text, options)
    total = offsets.agg(F.sum("rows")).first()[0] or 0
    columns = docs.columns
    scattered = docs.withColumn("__bucket", bucket(list(keys), buckets, options.seed))
    gathered = (
        scattered.repartition(buckets, "__bucket")
        .groupBy("__bucket")
        .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(options.seed), *keys).alias("__key"), *columns))).alias("__rows"))
    )
    shuffled = (
        gathered.join(offsets.select("__bucket", "before"), "__bucket")
        .sortWithinPartitions("__bucket")
        .select("before", F.posexplode(F.shuffle("__rows", options.seed)).alias("__at", "__row"))
    )
    place = F.col("before") + F.col("__at")
    first, extra = total // options.shards, total % options.shards
    # The first `extra` shards have one row more.
    wide = F.lit(extra * (first + 1))
    shard = F.when(place < wide, F.expr("0L") + F.floor(place / F.lit(first + 1))).otherwise(
        F.lit(extra) + F.floor((place - wide) / F.lit(max(first, 1)))
    )
    start = F.when(F.col("shard") <= extra, F.col("shard") * (first + 1)).otherwise(F.col("shard") * first + extra)
    (
        shuffled.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (place - start).cast("bigint"))
        .select(*[F.col(f"__row.{c}").alias(c) for c in columns], "slot", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return path


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The rows of :func:`write_shards`; ``docs`` gives their columns."""
    spark = docs.sparkSession
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("shard", "slot"))
    return spark.read.schema(f"{kept}, slot bigint, shard int").parquet(path)


def shard_table(docs: DataFrame, options: ShardOptions | None = None, **names) -> DataFrame:
    return read_shards(docs, write_shards(docs, new_path(docs.sparkSession, "shards"), options, **names))
