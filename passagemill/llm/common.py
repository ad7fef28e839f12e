"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.session import materialize

# White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 500_000  # row numbers, about 16 MB
WORDS = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """A text, or the empty string for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_row_id(df: DataFrame, name: str = "__row") -> DataFrame:
    """A number for each row; stable once the result has been written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def shielded(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with names of its own for all columns but the needed ones, so none clashes with what an operator makes.

    ``toDF(*docs.columns)`` on the result's columns, in their order, gives the names back.
    """
    return docs.toDF(*(c if c in needed else f"given_column_{i}" for i, c in enumerate(docs.columns)))


def broadcast_if_small(df: DataFrame, max_rows: int, label: str) -> tuple[DataFrame, bool]:
    """The table, written once, as a broadcast if it has at most ``max_rows`` rows.

    A larger one is told to be sorted: its files are so small that Spark would else broadcast it by itself.
    """
    kept = materialize(df, label)
    small = kept.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(kept) if small else kept.hint("merge")), small


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str, max_rows: int, salts: int = 32) -> DataFrame:
    """Join many rows with a table of one row per key, whatever a key's share of the rows.

    Up to ``max_rows`` rows the table is broadcast. A larger one is repeated
    ``salts`` times, and the many rows are dealt to the repeats by a hash of
    all their columns that are not keys, so a key that holds a third of the
    rows is met by ``salts`` tasks.
    """
    table, is_small = broadcast_if_small(small, max_rows, "lookup")
    if is_small:
        return big.join(table, keys, how)
    return salted(big, table, keys, how, salts)


def salted(big: DataFrame, small: DataFrame, keys: list[str], how: str, salts: int = 16) -> DataFrame:
    """The join of :func:`lookup` for a table of any size, which is never broadcast."""
    if salts == 1:
        return big.join(small.hint("merge"), keys, how)
    rest = [c for c in big.columns if c not in keys]
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark judges the repeated table by the size of its files, so it would broadcast millions of rows.
    return dealt.join(repeated.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def sized(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """The result of a shuffle in as many tasks as its rows ask for, and no fewer than the cluster runs at a time.

    ``rows`` is a count or an upper bound of one. Shuffles keep their number of
    partitions; a task reads several small ones and writes one file for them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // per_task)))


def beside(big: DataFrame, table: DataFrame, keys: list[str], how: str, max_rows: int, salts: int = 16) -> DataFrame:
    """The join of :func:`lookup` for a table that has been written already."""
    if table.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(table), keys, how)
    return salted(big, table, keys, how, salts)


def prefix_sums(counts: DataFrame, order: str, value: str, out: str, width: int = 1000) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``order`` (a gapless long from 0).

    Rows are summed in blocks of ``width`` first, so the window over everything
    sees one row per block, and no task more than its share.
    """
    from pyspark.sql import Window

    block = counts.withColumn("__block", F.expr(f"{order} div {width}"))
    sums = block.groupBy("__block").agg(F.sum(value).alias("__sum"))
    if_before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__block", F.coalesce(F.sum("__sum").over(if_before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        block.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, "__block")
        .select(*counts.columns, (F.col("__start") + F.col("__inside")).alias(out))
    )


def hot_and_cold(table: DataFrame, n: str, least: int = 1000, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """A table of one row per key, in two parts by ``n``, the number of rows that will ask for each key.

    The first part is broadcast: keys with more than ``least`` and more than a
    ``most``-th of all rows, so at most ``most`` keys. No key of the second part
    has more than that many rows, so a shuffle by key gives no task an unbounded
    share. ``table`` is read three times and should be a written one.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    limit = max(least, total // most)
    return F.broadcast(table.filter(F.col(n) > limit)), table.filter(F.col(n) <= limit)


def matched(big: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of many rows with :func:`hot_and_cold` parts; only rows of cold keys are shuffled."""
    hot, cold = hot_and_cold(table, n)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return big.join(hot, key).unionByName(rest.join(cold.hint("merge"), key))


def placed_beside(docs: DataFrame, columns: list[str] | None, made: list[str]) -> list[str]:
    """The input columns that a result carries: those asked for, less the names that the operator makes itself."""
    return [c for c in (docs.columns if columns is None else columns) if c not in made]
