"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical without white space. Every text gets
a 64-bit hash. The directory of the index doubles: a bucket is the set of
hashes that begin with the same bits, and one that holds more hashes than
its capacity is split by the next bit, until none does. Buckets are key
ranges; each is filled by one owner task and written to the shared folder in
the order of its hashes. Texts that share a hash are chained: their bytes are
compared, and each different text is an entry of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import BROADCAST_ROWS, SPACES, broadcast_if_small, lookup, salted, shielded, text_of, with_row_id
from passagemill.session import materialize


@dataclass(frozen=True)
class ExactOptions:
    bucket_entries: int = 8192
    broadcast_hashes: int = 500_000
    salts: int = 16


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), SPACES, "")


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One light row per document: hash, digest and size, without the text."""
    plain = normalised(text)
    return docs.select(
        "__row",
        F.col(id_col).alias("doc_id"),
        F.xxhash64(plain).alias("h"),
        F.sha2(plain, 256).alias("text_sha256"),
        F.char_length(text_of(text)).alias("n"),
    )


def directory(hashes: DataFrame, capacity: int) -> DataFrame:
    """Buckets (depth, prefix, entries): the directory after all doublings.

    ``hashes`` has one row per hash. Each doubling looks only at the halves of
    the buckets that were overfull before, by sums over counts of fine
    prefixes; the driver learns no more than whether one is still overfull.
    A bucket at the finest depth is kept as it is: its entries are chained.
    """
    finest = (hashes.count() // capacity + 1).bit_length() + 6
    leaf = F.shiftrightunsigned("h", 64 - finest).alias("leaf")
    leaves = materialize(hashes.groupBy(leaf).agg(F.count(F.lit(1)).alias("n")), "leaves")
    settled: list[DataFrame] = []
    for depth in range(finest + 1):
        halves = leaves.groupBy(F.shiftright("leaf", finest - depth).alias("prefix")).agg(F.sum("n").alias("entries"))
        halves = materialize(halves, "doubling")
        fits = (F.col("entries") <= capacity) | F.lit(depth == finest)
        settled.append(halves.filter(fits).select(F.lit(depth).alias("depth"), "prefix", "entries"))
        overfull = halves.filter(~fits).select("prefix")
        if overfull.isEmpty():
            break
        leaves = leaves.withColumn("prefix", F.shiftright("leaf", finest - depth)).join(overfull, "prefix", "left_semi")
        leaves = leaves.select("leaf", "n")
    buckets = settled[0]
    for more in settled[1:]:
        buckets = buckets.union(more)
    return buckets


def with_bucket(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each hash with its bucket: just one entry of the directory begins it."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # 64 rows at most
    if not depths:
        return entries.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("bigint")})
    first = lambda d: F.shiftrightunsigned("h", 64 - d) if d else F.lit(0).cast("bigint")
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), first(d).alias("prefix")) for d in depths])
    tried = entries.withColumn("__at", F.explode(tries)).select("*", "__at.depth", "__at.prefix").drop("__at")
    return tried.join(buckets.drop("entries"), ["depth", "prefix"])


def compared(docs: DataFrame, shared: DataFrame, options: ExactOptions, text: str) -> DataFrame:
    """Chains: one row per different text among rows whose hash is shared.

    The grouping compares the bytes of the texts. Copies meet map-side first,
    so a text that a third of all rows hold is shuffled once per task.
    """
    plain = normalised(text)
    rows = docs.select(plain.alias("plain"), F.xxhash64(plain).alias("h"))
    hashes, small = broadcast_if_small(shared, options.broadcast_hashes, "shared-hashes")
    if small:
        rows = rows.join(hashes, "h", "left_semi")
    chains = rows.groupBy("h", "plain").agg(F.count(F.lit(1)).alias("copies"))
    return chains.filter("copies > 1").select("h", F.sha2("plain", 256).alias("text_sha256"), "copies")


def build_index(docs: DataFrame, keys: DataFrame, options: ExactOptions, text: str) -> DataFrame:
    """Entries (depth, prefix, h, chain, text_sha256, keep_id, keep_row, group_size) of texts that rows share."""
    # The longest original text first, then the smallest id (null last), then the first row.
    known = F.col("doc_id").isNotNull()
    rank = F.struct("n", known.alias("known"), F.bitwise_not("doc_id").alias("by_id"), F.bitwise_not("__row").alias("by_row"))
    groups = keys.groupBy("h", "text_sha256").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.filter("group_size > 1"), "groups")
    shared = groups.select("h").distinct()
    chains = compared(docs, shared, options, text)
    entries = groups.join(chains, ["h", "text_sha256"]).select(
        "h",
        "text_sha256",
        F.bitwise_not("best.by_id").alias("keep_id"),
        F.bitwise_not("best.by_row").alias("keep_row"),
        F.col("copies").alias("group_size"),
    )
    entries = materialize(entries, "entries")
    owned = with_bucket(entries, directory(entries.select("h").distinct(), options.bucket_entries))
    owned = owned.repartition("depth", "prefix").withColumn(
        "chain", F.row_number().over(Window.partitionBy("depth", "prefix", "h").orderBy("text_sha256"))
    )
    return materialize(owned.sortWithinPartitions("depth", "prefix", "h", "chain"), "index")


def copies(docs: DataFrame, options: ExactOptions | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 and the row's number.

    Of equal texts the row with the most code points stays, then the smallest
    id, null ids last, then the first of repeated rows, so one row of a group
    stays. A null text counts as empty; empty texts are equal to each other.
    Texts of any length are compared whole. An empty table gives an empty
    table. ``docs`` needs the column ``__row`` (``with_row_id``, written).
    """
    options = options or ExactOptions()
    keys = materialize(keyed(docs, id_col, text), "keys")
    index = build_index(docs, keys, options, text).select("h", "text_sha256", "keep_id", "keep_row", "group_size")
    found = salted(keys, index, ["h", "text_sha256"], "left", options.salts)
    lone = F.col("keep_row").isNull()
    return found.select(
        "__row",
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (lone | (F.col("keep_row") == F.col("__row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, options: ExactOptions | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, see :func:`copies`; columns of any name stay as they are."""
    own = shielded(docs, id_col, text)
    numbered = materialize(with_row_id(own), "numbered")
    dropped = copies(numbered, options, id_col, text).filter("NOT kept").select("__row")
    return lookup(numbered, dropped, ["__row"], "left_anti", BROADCAST_ROWS, 1).select(*own.columns).toDF(*docs.columns)
