"""Frames the registered queries share, all derived from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators.chunking import chunk_documents
from passagemill.operators.embedding import embed_hashed
from passagemill.operators.search import search
from passagemill.plans.answer import retrieve
from passagemill.session import configure, delete_paths, load_table, materialize, new_path, spread
from passagemill.sources.documents import parts_from_table
from passagemill.sources.walk import qualified, store_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(load_table(configure(spark), folder, name))


def document_parts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return parts_from_table(docs, name, F.col("text"))


def token_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_documents(document_parts(spark, folder), "token")


def store(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents with their vectors."""
    return embed_hashed(token_chunks(spark, folder))


def written_store(spark: SparkSession, folder: str) -> DataFrame:
    """The store as a job would read it: from a written table."""
    kept = ["chunk_id", "chunk_order", "source_file", "display_source_name", "text", "vector"]
    return materialize(store(spark, folder).select(*kept), "store")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` as queries."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), tx.clean_text(F.col("text")).alias("query")
    )


def question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embed_hashed(questions(spark, folder), "query")


def found(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Top 30 hits of every question, without text."""
    return search(question_vectors(spark, folder), store(spark, folder), **options)


def rich_hits(spark: SparkSession, folder: str, stored: DataFrame | None = None) -> DataFrame:
    return retrieve(questions(spark, folder), written_store(spark, folder) if stored is None else stored)


def points(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as a store."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label"
    )


def as_files(df: DataFrame, source_file: Column, content: Column) -> DataFrame:
    """Rows as files of a folder, in the shape the file readers take."""
    return df.select(
        source_file.alias("source_file"),
        F.concat(F.lit("file:/data/"), source_file).alias("path"),
        F.timestamp_seconds(F.lit(0)).alias("modificationTime"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.cast("binary").alias("content"),
    )


def written_files(rows: DataFrame, root: str | None = None) -> str:
    """Real files in the shared folder: (source_file, content), content null for a file to delete; returns the folder."""
    spark = rows.sparkSession
    root = qualified(spark, root or new_path(spark, "folder"))

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = store_of(f"{root}/{name}")
                if content is None:
                    if store.get_file_info(path).type == fs.FileType.File:
                        store.delete_file(path)
                    continue
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path, compression=None) as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    rows.select("source_file", F.col("content").cast("binary")).mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
    return root


def written_lines(lines: DataFrame, name: str, head: str = "", tail: str = "", root: str | None = None) -> str:
    """One real file of all ``line`` values in ``place`` order; returns the folder.

    Every task writes a range of places as a file of its own, then copies it to its place in the whole file. A store whose
    files cannot be written from the middle gets them from one task, as a stream.
    """
    spark = lines.sparkSession
    root, parts = qualified(spark, root or new_path(spark, "folder")), qualified(spark, new_path(spark, "line-parts"))
    whole = f"{root}/{name}"

    def write(batches):
        number, n = TaskContext.get().partitionId(), 0
        store, path = store_of(f"{parts}/{number}")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path, compression=None) as stream:
            for batch in batches:
                data = "".join(batch.column(0).to_pylist()).encode()
                stream.write(data)
                n += len(data)
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int64()), "bytes": pa.array([n], pa.int64())})

    def blocks(number):
        store, path = store_of(f"{parts}/{number}")
        with store.open_input_stream(path, compression=None) as stream:
            while block := stream.read(1 << 22):
                yield block

    def copy(batches):
        n = 0
        for batch in batches:
            for number, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(inside, "r+b") as out:
                    out.seek(begin)
                    for block in blocks(number):
                        out.write(block)
                n += 1
        yield pa.RecordBatch.from_pydict({"parts": pa.array([n], pa.int64())})

    def stream_all(batches):
        with store_of(whole)[0].open_output_stream(inside, compression=None) as out:
            out.write(head.encode())
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    for block in blocks(number):
                        out.write(block)
            out.write(tail.encode())
        yield pa.RecordBatch.from_pydict({"parts": pa.array([1], pa.int64())})

    ordered = lines.repartitionByRange("place").sortWithinPartitions("place").select("line")
    sizes = sorted(tuple(r) for r in ordered.mapInArrow(write, "part bigint, bytes bigint").collect())
    store, inside = store_of(whole)
    store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    at, placed = len(head.encode()), []
    for number, size in sizes:
        if size:
            placed.append((number, at))
            at += size
    rows = spark.createDataFrame(placed, "part bigint, begin bigint")
    if whole.startswith("file:"):
        with open(inside, "wb") as out:
            out.write(head.encode())
            out.seek(at)
            out.write(tail.encode())
        if placed:
            rows.repartitionByRange(len(placed), "part").mapInArrow(copy, "parts bigint").agg(F.sum("parts")).collect()
    else:
        rows.repartition(1).sortWithinPartitions("part").mapInArrow(stream_all, "parts bigint").collect()
    delete_paths(spark, [parts])
    return root


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
