"""Token ids in binary files, in the order of their documents.

A file is a run of blocks. In a block the ids are replaced by their rank of
frequency, so the frequent ones take one byte; the bytes of all ranks follow
each other, and control bytes apart from them hold two bits per rank: its
number of bytes less one. Reading looks the 16 bits "which of 4 x 4 bytes are
there" of a control byte up in a table and fills them from the data, without
a loop over the ids.

Block, all numbers little-endian:
    magic "PMT1", documents u32, vocabulary u32, ids u64, data bytes u64
    document ids i64, 1 byte each: is null, ids per document u64
    vocabulary u32 by rank, control bytes (ids / 4, rounded up), data bytes
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.common import prefix_sums, text_of
from passagemill.llm.files import fresh_file, open_file
from passagemill.llm.tokenizing import encoder, in_slices
from passagemill.session import materialize, new_path

HEAD = struct.Struct("<4sIIQQ")
MAGIC = b"PMT1"
# For each control byte, which of the four bytes of its four numbers are there.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
PRESENT = (np.arange(4) <= _LENGTHS[:, :, None]).reshape(256, 16)


@dataclass(frozen=True)
class TokenFileOptions:
    vocabulary: str
    end_id: int = 2
    file_bytes: int = 32 << 20  # of text
    block_ids: int = 2_000_000


def pack_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    length = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    fours = np.zeros(-(-len(length) // 4) * 4, np.uint8)
    fours[: len(length)] = length
    fours = fours.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    wide = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) <= length[:, None]].tobytes()


def unpack_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    there = PRESENT[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    wide = np.zeros((n, 4), np.uint8)
    wide[there] = np.frombuffer(data, np.uint8)
    return wide.reshape(-1).view("<u4")


def pack_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A block of documents; ids are little-endian unsigned 32-bit numbers."""
    every = np.frombuffer(b"".join(ids), "<u4")
    counts = np.bincount(every)  # as long as the vocabulary
    known = np.flatnonzero(counts)
    by_rank = known[np.argsort(-counts[known], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack_numbers(rank[every])
    return b"".join(
        [
            HEAD.pack(MAGIC, len(doc_ids), len(known), len(every), len(data)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array([len(x) // 4 for x in ids], "<u8").tobytes(),
            by_rank.astype("<u4").tobytes(),
            control,
            data,
        ]
    )


def read_blocks(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, ids per document and all ids of each block of a file."""
    with open_file(path) as stream:
        while head := stream.read(HEAD.size):
            magic, docs, vocabulary, n, size = HEAD.unpack(head)
            if magic != MAGIC:
                raise ValueError(f"not a token file: {path}")
            doc_ids = np.frombuffer(stream.read(8 * docs), "<i8").tolist()
            null = stream.read(docs)
            lengths = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
            by_rank = np.frombuffer(stream.read(4 * vocabulary), "<u4")
            control = stream.read(-(-n // 4))
            ranks = unpack_numbers(control, stream.read(size), n)
            yield [None if x else d for d, x in zip(doc_ids, null)], lengths, by_rank[ranks]


def write_token_files(
    docs: DataFrame, folder: str, options: TokenFileOptions, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the ids of all documents in ascending order of ``id_col``; return the files that count.

    The result (file_no, path, docs, ids) is a written table: a file of a task
    attempt that was lost is not in it. Documents with a null id come first;
    rows that repeat an id stay together, in any order. A null or empty text
    is just the end id. An empty table has files without documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    files = max(1, -(-total // options.file_bytes))
    end, vocabulary, limit = np.array([options.end_id], "<u4").tobytes(), options.vocabulary, options.block_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batches = encoder(vocabulary).encode_batches
        path, stream = fresh_file(folder, ".tokens")
        docs_written = ids_written = 0
        with stream:
            doc_ids, ids, waiting = [], [], 0

            def flush():
                nonlocal waiting
                stream.write(pack_block(doc_ids, ids))
                doc_ids.clear(), ids.clear()
                waiting = 0

            given, texts = itertools.tee(in_slices(batches, 1))
            for batch, encoded in zip(given, encode_batches(b.column(1) for b in texts)):
                for doc_id, found in zip(batch.column(0).to_pylist(), encoded):
                    found += end
                    doc_ids.append(doc_id)
                    ids.append(found)
                    waiting += len(found) // 4
                    docs_written += 1
                    ids_written += len(found) // 4
                    if waiting >= limit:
                        flush()
            if doc_ids:
                flush()
        yield pa.RecordBatch.from_pydict(
            {"file_no": [TaskContext.get().partitionId()], "path": [path], "docs": [docs_written], "ids": [ids_written]}
        )

    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first()
    )
    written = ordered.mapInArrow(run, "file_no bigint, path string, docs bigint, ids bigint")
    return materialize(written, "token-files")


def read_token_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    placed = prefix_sums(files.filter("docs > 0"), "file_no", "ids", "start")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                for doc_ids, lengths, ids in read_blocks(path):
                    ends = np.cumsum(lengths)
                    raw = ids.astype("<u4").tobytes()
                    parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                    columns = [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        pa.array(parts, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                    start += int(ends[-1])

    tasks = max(1, files.count())
    return placed.select("path", "start").repartition(tasks).mapInArrow(run, schema)


def token_table(docs: DataFrame, options: TokenFileOptions, **names) -> DataFrame:
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, new_path(spark, "tokens"), options, **names))
