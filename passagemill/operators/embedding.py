"""Vectors for texts: hashed, static token vectors, or a caller's encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import schemas
from passagemill.functions import vectors as vec
from passagemill.functions.text import joined_terms
from passagemill.session import new_path
from passagemill.sources.walk import children, qualified, store_of

# Largest token-vector table sent to every executor.
STATIC_BROADCAST_BYTES = 256 << 20
# Terms of texts that a task holds while it goes through a larger table, and tokens of that table it reads at a time.
HELD_TERM_BYTES = 32 << 20
READ_TOKENS = 1 << 19


def embed_hashed(df: DataFrame, text_col: str = "text", dim: int = 64, out: str = "vector") -> DataFrame:
    # A filter on the vector would else be pushed down and work all of them out a second time.
    return schemas.computed_once(df, out, vec.hashed_vector(F.col(text_col), dim))


def l2_normalized(vector: Column) -> Column:
    norm = F.sqrt(vec.dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def embed_static(
    df: DataFrame,
    id_col: str,
    text_col: str,
    token_vectors: DataFrame,
    *,
    normalize: bool = True,
    out: str = "vector",
    broadcast_bytes: int = STATIC_BROADCAST_BYTES,
) -> DataFrame:
    """Mean of the weighted vectors of a text's known tokens.

    ``token_vectors(token, weight, vector)``. A table within ``broadcast_bytes``
    goes to the executors. A larger one is written to the shared folder, and
    tasks read it there in parts, once for many texts. Either way texts are
    embedded where they lie, and no text or token is shuffled.
    """
    size = token_vectors.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"),
        F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("chars"),
    ).first()
    if size["n"] == 0:
        raise ValueError("the token vector table is empty")
    if size["n"] * size["dim"] * 8 + size["chars"] <= broadcast_bytes:
        vector = _static_by_lookup(df, text_col, token_vectors)
        with_vector = df.withColumn(out, vector)
    else:
        with_vector = _static_by_files(df, text_col, token_vectors, size["dim"], out)
    shaped = l2_normalized(F.col(out)) if normalize else F.col(out)
    return with_vector.withColumn(out, shaped.cast("array<float>"))


def _weighted(token_vectors: DataFrame) -> DataFrame:
    return token_vectors.select(
        "token", F.transform("vector", lambda x: x.cast("double") * F.col("weight")).alias("vector")
    )


def _static_terms(text_col: str) -> Column:
    return joined_terms(F.coalesce(F.col(text_col), F.lit("")))


def _means(lengths: np.ndarray, ids: np.ndarray, found: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean of the vectors of each text's terms; ``lengths`` terms belong to a text, ``found`` tells those that have an id."""
    rows, ids = np.repeat(np.arange(len(lengths)), lengths)[found], ids[found]
    total = np.zeros((len(lengths), vectors.shape[1]))
    # In slices of rows, to bound the gathered vectors.
    step = 65536
    for at in range(0, len(ids), step):
        r = rows[at : at + step]
        firsts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        total[r[firsts]] += np.add.reduceat(vectors[ids[at : at + step]], firsts, axis=0)
    return total / np.maximum(np.bincount(rows, minlength=len(lengths))[:, None], 1)


def _static_by_lookup(df: DataFrame, text_col: str, token_vectors: DataFrame) -> Column:
    table = _weighted(token_vectors).toArrow()
    tokens = table.column("token").combine_chunks()
    matrix = vec.matrix_of(table.column("vector").combine_chunks())
    shared = df.sparkSession.sparkContext.broadcast((tokens, matrix))

    @F.arrow_udf("array<double>")
    def average(texts: pa.Array) -> pa.Array:
        known, vectors = shared.value
        lengths, flat = vec.term_lists(texts)
        ids = pc.index_in(flat, value_set=known)
        found = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return vec.lists_of(_means(lengths, ids, found, vectors), pa.float64())

    return average(_static_terms(text_col))


def _static_by_files(df: DataFrame, text_col: str, token_vectors: DataFrame, dim: int, out: str) -> DataFrame:
    """A token's first row counts. A task holds the terms of some texts and a part of the table at a time."""
    spark = df.sparkSession
    root = qualified(spark, new_path(spark, "token-vectors"))
    _weighted(token_vectors).write.parquet(root)
    held_bytes, read_tokens = HELD_TERM_BYTES, READ_TOKENS
    kept = [c for c in df.columns if c != out]
    # The terms come last.
    given = df.select(*kept, _static_terms(text_col).alias("__terms"))

    def table() -> Iterator[tuple[pa.Array, np.ndarray]]:
        store, inside = store_of(root)
        for name in sorted(x.path for x in children(store, inside) if x.path.endswith(".parquet")):
            with store.open_input_file(name) as stream:
                for part in pq.ParquetFile(stream).iter_batches(read_tokens):
                    yield part.column(0), vec.matrix_of(part.column(1))

    def embedded(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, flat = vec.term_lists(pa.concat_arrays([b.column(len(kept)) for b in batches]))
        coded = flat.dictionary_encode()
        vectors, known = np.zeros((len(coded.dictionary), dim)), np.zeros(len(coded.dictionary), bool)
        for tokens, matrix in table() if len(known) else ():
            at = pc.index_in(coded.dictionary, value_set=tokens)
            new = at.is_valid().to_numpy(zero_copy_only=False) & ~known
            vectors[new] = matrix[at.fill_null(0).to_numpy(zero_copy_only=False)[new]]
            known |= new
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        means, first = _means(lengths, ids, known[ids], vectors), 0
        for b in batches:
            mean = vec.lists_of(means[first : first + b.num_rows], pa.float64())
            first += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], mean], [*kept, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(len(kept)))).as_py() or 0
            if size >= held_bytes:
                yield from embedded(held)
                held, size = [], 0
        if held:
            yield from embedded(held)

    fields = [f for f in df.schema.fields if f.name != out]
    return given.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def embed_with_model(
    df: DataFrame,
    text_col: str,
    encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    *,
    batch: int = 128,
    out: str = "vector",
) -> DataFrame:
    """A caller's encoder, built once per worker and fed ``batch`` texts at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_factory()
        for series in texts:
            rows: list[np.ndarray] = []
            values = series.tolist()
            for at in range(0, len(values), batch):
                given = values[at : at + batch]
                got = np.asarray(encoder(given), dtype=np.float32)
                rows.extend(got.reshape(len(given), -1))
            yield pd.Series(rows, dtype=object)

    # Whatever the column holds, encoders only see strings.
    return df.withColumn(out, encode(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def dimension_report(df: DataFrame, expected: int | None = None, vector_col: str = "vector") -> DataFrame:
    """Rows, smallest and largest width, and whether all agree with ``expected``."""
    low, high = F.min(F.size(vector_col)), F.max(F.size(vector_col))
    agrees = F.lit(True) if expected is None else F.coalesce(high == expected, F.lit(True))
    return df.filter(F.col(vector_col).isNotNull()).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.coalesce(low, F.lit(0)).alias("min_dim"),
        F.coalesce(high, F.lit(0)).alias("max_dim"),
        F.coalesce(low == high, F.lit(True)).alias("uniform"),
        agrees.alias("as_expected"),
    )


def validate_dimensions(df: DataFrame, expected: int | None = None, vector_col: str = "vector") -> int:
    """The width of all vectors. It wins over ``expected``; mixed widths fail."""
    row = dimension_report(df, expected, vector_col).first()
    if not row["uniform"]:
        raise ValueError(f"vectors of {row['min_dim']} to {row['max_dim']} dimensions")
    return row["max_dim"]


def sparse_rows(df: DataFrame, id_col: str, sparse_col: str) -> DataFrame:
    """One row per stored value: (id, idx, val)."""
    return df.select(F.col(id_col), F.explode(sparse_col).alias("idx", "val"))


def sparse_similarity(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Inner products of sparse vectors, as an inverted-index join.

    Both sides are ``(id, idx, val)`` rows, named ``query_id`` and ``chunk_id``.
    Only pairs with a common index appear.
    """
    return (
        queries.select("query_id", "idx", F.col("val").alias("__q"))
        .join(store.select("chunk_id", "idx", F.col("val").alias("__s")), "idx")
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("__q").cast("double") * F.col("__s")), vec.SCORE_DECIMALS).alias("score"))
    )
