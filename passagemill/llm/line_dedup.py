"""Lines that many documents hold, kept in one of them only.

Every line is brought to a key (outer white space off, A-Z in lower case),
keys are hashed and exploded, and the documents of each hash are counted. The
lines of a key above the threshold go, except in the document with the
smallest id. A text is put together again from the places that are left.

Only hashes, ids and places are shuffled by line. A hash that many lines share
is counted with partial sums and met again through a broadcast of bounded
size, so a line that a third of all documents hold is no task's own load.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import bound, matched, placed_beside, text_of
from passagemill.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MADE = ["n_lines", "n_dropped", "kept"]


@dataclass(frozen=True)
class LineOptions:
    min_chars: int = 10  # shorter keys are never dropped
    min_docs: int = 2  # documents that must hold a key


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), CAPITALS, CAPITALS.lower())


def key_hash(line: Column, options: LineOptions) -> Column:
    """128 bits of a line's key; null for a key that is too short to count."""
    return bound(
        line_key(line),
        lambda key: F.when(F.char_length(key) >= options.min_chars, F.unhex(F.md5(key.cast("binary")))),
    )


def repeated_lines(rows: DataFrame, options: LineOptions) -> DataFrame:
    """Hashes that at least ``min_docs`` rows of (id, text) hold: ``h``, ``n``, and ``owner``, the smallest id."""
    hashes = F.array_compact(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: key_hash(x, options))))
    held = rows.select("id", F.explode(hashes).alias("h"))
    return held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("owner")).filter(F.col("n") >= options.min_docs)


def drop_repeated_lines(
    docs: DataFrame,
    options: LineOptions | None = None,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """Each row with ``n_lines``, ``n_dropped`` and ``kept``, the text without the dropped lines.

    A text is split at line feeds; null counts as empty, and an empty text is
    one empty line. A key that only one row holds keeps all its lines, however
    often it is repeated there, and so does the row with the smallest id. Rows
    that share the smallest id all keep theirs; a null id comes after all
    others. Lines of any number and length are taken whole. ``columns`` of the
    input (all, if not given) come along; one that is named like a column made
    here is replaced. An empty table gives an empty table.
    """
    options = options or LineOptions()
    carried = placed_beside(docs, columns, MADE)
    rows = docs.select(
        F.col(id_col).alias("id"), text_of(text).alias("text"), F.struct(*[F.col(c) for c in carried], F.lit(0).alias("__")).alias("row")
    )
    repeated = materialize(repeated_lines(rows, options), "lines")
    # Equal texts with equal ids lose the same places, so these two stand for a row.
    same = F.xxhash64("text").alias("t")
    held = rows.select("id", same, F.posexplode(F.transform(lines_of(F.col("text")), lambda x: key_hash(x, options))).alias("at", "h"))
    gone = matched(held.filter("h IS NOT NULL"), repeated, "h", "n").filter(~F.col("owner").eqNullSafe(F.col("id")))
    places = gone.groupBy("id", "t").agg(F.collect_set("at").alias("gone"))
    left, right = rows.select("*", same).alias("a"), places.alias("b")
    joined = left.join(right, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.t") == F.col("b.t")), "left")
    lines = lines_of(F.col("a.text"))
    without = lambda all_lines: F.array_except(
        F.sequence(F.lit(0), F.size(all_lines) - 1), F.coalesce(F.col("b.gone"), F.array().cast("array<int>"))
    )
    split = bound(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"),
            bound(
                without(x),
                lambda left_places: F.struct(
                    F.size(left_places).cast("bigint").alias("n"),
                    F.array_join(F.transform(left_places, lambda i: F.get(x, i)), "\n").alias("text"),
                ),
            ).alias("left"),
        ),
    )
    done = joined.select("a.row", split.alias("s"))
    return done.select(
        *[F.col("row").getField(c).alias(c) for c in carried],
        F.col("s.n").alias("n_lines"),
        (F.col("s.n") - F.col("s.left.n")).alias("n_dropped"),
        F.col("s.left.text").alias("kept"),
    )
