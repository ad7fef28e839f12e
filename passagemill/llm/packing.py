"""Packing documents into sequences of a fixed length, best fit first.

A document longer than a window is first cut into full windows; what is left
of it, or a shorter document, is one piece. The pieces are dealt to groups by
a hash. In each group the longest piece comes first and goes to the open
window with the least room that still takes it, which a segment tree over the
remaining capacities finds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import text_of, with_row_id
from passagemill.llm.tokenizing import encoder, in_slices
from passagemill.session import new_path

PIECE = ["doc_id", "start", "length", "doc_tokens", "offset"]


@dataclass(frozen=True)
class PackOptions:
    vocabulary: str
    end_id: int = 2
    window: int = 4096
    group_pieces: int = 2048
    pad_id: int = 0


class OpenWindows:
    """A segment tree whose leaves are remaining capacities and hold the windows that have them."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.some = bytearray(2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = capacity + self.base
        while node and not self.some[node]:
            self.some[node] = 1
            node //= 2

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out a window of the least capacity that is at least ``length``."""
        some, node = self.some, length + self.base
        while not some[node]:
            # To the next subtree on the right.
            while node & 1:
                node //= 2
            if node <= 1:
                return None
            node += 1
        while node < self.base:
            node = 2 * node if some[2 * node] else 2 * node + 1
        capacity = node - self.base
        found = self.windows[capacity].pop()
        if not self.windows[capacity]:
            some[node] = 0
            node //= 2
            while node and not some[2 * node] and not some[2 * node + 1]:
                some[node] = 0
                node //= 2
        return capacity, found


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; the lengths must not increase."""
    numbers, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, used = OpenWindows(window), 0
    for i, length in enumerate(lengths.tolist()):
        place = tree.tightest(length) if length < window else None
        if place is None:
            capacity, number = window, used
            used += 1
        else:
            capacity, number = place
        numbers[i], offsets[i] = number, window - capacity
        if capacity > length:
            tree.add(capacity - length, number)
    return numbers, offsets


def narrow(ids: bytes) -> bytes:
    """32-bit ids in 16 bits if all fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else bytes(ids)


def widened(ids: bytes, count: int) -> bytes:
    """The 32-bit ids of :func:`narrow`."""
    return ids if len(ids) == 4 * count else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def cut(docs: DataFrame, options: PackOptions, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (__row, doc_id, start, length, doc_tokens, ids) of all documents, written to the shared folder.

    ``ids`` are little-endian unsigned numbers of 16 bits where a piece has none above 65,535, and else of 32.
    """
    window, end = options.window, np.array([options.end_id], "<u4").tobytes()
    vocabulary = options.vocabulary
    kind = dict(docs.dtypes)[id_col]
    names = ["__row", "doc_id", "start", "length", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, texts = itertools.tee(in_slices(batches, 2))
        encoded = encoder(vocabulary).encode_batches(b.column(2) for b in texts)
        for batch, found in zip(given, encoded):
            which, starts, totals, pieces = [], [], [], []
            for i, ids in enumerate(found):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    which.append(i)
                    starts.append(start)
                    totals.append(total)
                    pieces.append(narrow(ids[4 * start : 4 * (start + window)]))
            taken = batch.select([0, 1]).take(pa.array(which, pa.int32()))
            columns = [
                *taken.columns,
                pa.array(starts, pa.int64()),
                pa.array([min(window, n - at) for at, n in zip(starts, totals)], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array(pieces, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text")))
    schema = f"__row bigint, doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"
    pieces = rows.select("__row", "doc_id", "text").mapInArrow(run, schema)
    path = new_path(docs.sparkSession, "pieces")
    pieces.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def build(pieces: DataFrame, options: PackOptions) -> DataFrame:
    """The sequences, written: sequence_id, ids padded to the window, length, and the pieces in them in order.

    A group has about ``group_pieces`` pieces at any size of the input, since
    they are dealt by a hash of their place, not of anything they share; its ids
    take some 32 MB at most. The ids of all pieces are shuffled once.
    """
    window, pad = options.window, np.array([options.pad_id], "<u4").tobytes()
    groups = max(1, -(-pieces.count() // options.group_pieces))
    kind = dict(pieces.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        order = np.lexsort((table["start"].to_numpy(), table["__row"].to_numpy(), -length))
        numbers, offsets = best_fit(length[order], window)
        inside = np.lexsort((offsets, numbers))
        order, numbers, offsets = order[inside], numbers[inside], offsets[inside]
        heads = np.flatnonzero(np.diff(numbers, prepend=-1))
        ends = np.append(heads[1:], len(order))
        table = table.take(pa.array(order))
        ids = [widened(each, n) for each, n in zip(table["ids"].to_pylist(), length[order].tolist())]
        held = pa.StructArray.from_arrays([*(table[c].combine_chunks() for c in PIECE[:-1]), pa.array(offsets)], PIECE)
        sums = np.add.reduceat(length[order], heads)
        group = table["__group"][0].as_py()
        return pa.table(
            {
                "sequence_id": numbers[heads] * groups + group,
                "ids": [b"".join(ids[a:b]) + pad * (window - n) for a, b, n in zip(heads.tolist(), ends.tolist(), sums.tolist())],
                "length": sums,
                "pieces": pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), held),
            }
        )

    group = F.pmod(F.xxhash64("__row", "start"), F.lit(groups)).cast("bigint").alias("__group")
    piece = f"doc_id: {kind}, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint"
    schema = f"sequence_id bigint, ids binary, length bigint, pieces array<struct<{piece}>>"
    built = pieces.select("*", group).groupBy("__group").applyInArrow(run, schema)
    path = new_path(pieces.sparkSession, "sequences")
    built.write.option("compression", "zstd").parquet(path)
    return pieces.sparkSession.read.schema(schema).parquet(path)


def write_sequences(docs: DataFrame, options: PackOptions, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences of all documents: sequence_id, ids padded to the window, length of the real ones, pieces.

    A null or empty text is just the end id. Repeated rows and null ids are
    packed row by row; an empty table gives an empty table. No piece is longer
    than a window, however long the text. Other columns of ``docs`` are not read.
    """
    return build(cut(docs, options, id_col, text), options)


def pack(docs: DataFrame, options: PackOptions, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, read from :func:`write_sequences`: its places, its ids and their checksum."""
    written = write_sequences(docs, options, id_col, text)
    held = written.select("sequence_id", F.col("ids").alias("__ids"), F.explode("pieces").alias("p"))
    own = F.substring("__ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return held.select("p.*", "sequence_id", own.alias("ids")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"
    )


def sequences(packed: DataFrame, options: PackOptions) -> DataFrame:
    """The sequences of :func:`pack` rows that were filtered or changed since: ids padded to the window, how many are real."""
    window, pad = options.window, np.array([options.pad_id], "<u4").tobytes()

    @F.pandas_udf("binary")
    def padded(parts):
        return parts.map(lambda p: b"".join(p) + pad * (window - sum(map(len, p)) // 4))

    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(pieces.alias("pieces"), F.sum("length").alias("length"))
        .select("sequence_id", padded(F.col("pieces.ids")).alias("ids"), "length")
    )
