"""Vector columns: hashed text vectors, similarity, sparse and dense forms."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import joined_terms

METRICS = ("cosine", "inner_product", "euclidean")
# Scores are kept to nine decimals, so that ranks do not depend on the order
# in which a sum was added up.
SCORE_DECIMALS = 9
# Terms that are added up at once.
SLICE_TERMS = 1 << 20


def check_metric(name: str | None, default: str = "cosine") -> str:
    """The metric to use: an unknown or missing name gives ``default``."""
    wanted = (name or default).lower()
    return wanted if wanted in METRICS else default


# -- hashed text vectors -------------------------------------------------


def term_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many terms each of the ``joined_terms`` texts has (null has none), and all of them in order."""
    lengths = np.zeros(len(texts), np.int64)
    filled = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    split = pc.split_pattern(texts.filter(filled), " ")
    lengths[filled.to_numpy(zero_copy_only=False)] = split.value_lengths().to_numpy(zero_copy_only=False)
    return lengths, split.flatten()


def term_codes(terms: pa.Array, dim: int) -> np.ndarray:
    """Each term as ``bucket`` (plus ``dim`` when its sign is negative).

    The first 32 bits of the term's MD5 give the bucket (mod ``dim``) and, by
    the parity of the quotient, the sign. Each different term is hashed once.
    """
    coded = terms.dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    digests = b"".join([hashlib.md5(t).digest() for t in known])
    codes = (np.frombuffer(digests, ">u4")[::4] % (2 * dim)).astype(np.int64)
    return codes[coded.indices.to_numpy(zero_copy_only=False)]


def code_matrix(lengths: np.ndarray, codes: np.ndarray, dim: int) -> np.ndarray:
    """Sum of signed unit vectors per row; ``lengths`` codes belong to each row."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    signs = np.where(codes < dim, 1.0, -1.0)
    flat = np.bincount(rows * dim + codes % dim, weights=signs, minlength=len(lengths) * dim)
    return flat.reshape(len(lengths), dim)


def term_matrix(texts: pa.Array, dim: int) -> np.ndarray:
    """Signed counts of the terms of each ``joined_terms`` text, as whole numbers in float32.

    Texts are taken in slices of some ``SLICE_TERMS`` terms, so only the result grows with the batch.
    """
    done = np.zeros((len(texts), dim), np.float32)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + 4 * SLICE_TERMS, "right")))
        lengths, terms = term_lists(texts.slice(at, stop - at))
        done[at:stop] = code_matrix(lengths, term_codes(terms, dim), dim)
        at = stop
    return done


def list_parts(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists (null is empty) and their flat values."""
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, array.flatten()


def matrix_of(array: pa.Array) -> np.ndarray:
    """A column of equally long lists as a float64 matrix."""
    lengths, flat = list_parts(array)
    if len(lengths) == 0:
        return np.zeros((0, 0))
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of mixed length")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), lengths[0])


def lists_of(matrix: np.ndarray, dtype: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width) if width else np.zeros(rows + 1), type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), type=dtype))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Text as a ``dim``-wide vector of signed term counts, without a model.

    Tokens are found by built-in functions; one vectorised step hashes and
    adds them up per row, so embedding needs no shuffle.
    """

    @F.arrow_udf("array<float>")
    def add_up(texts: pa.Array) -> pa.Array:
        return lists_of(term_matrix(texts, dim), pa.float32())

    return add_up(joined_terms(F.coalesce(text.cast("string"), F.lit(""))))


# -- similarity ----------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Score of a pair, higher is better: cosine, inner product or -distance."""
    if metric == "inner_product":
        raw = dot(a, b)
    elif metric == "euclidean":
        squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
        raw = -F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    else:
        norms = dot(a, a) * dot(b, b)
        raw = F.when(norms > 0, dot(a, b) / F.sqrt(norms)).otherwise(F.lit(0.0))
    return F.round(raw, SCORE_DECIMALS)


def distance(metric: str, score: Column) -> Column:
    return F.round(F.lit(1.0) - score, SCORE_DECIMALS) if metric == "cosine" else -score


def score_block(metric: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of all rows of ``left`` against all rows of ``right``."""
    if metric == "euclidean":
        # Column by column: subtracting first keeps close pairs exact.
        total = np.zeros((len(left), len(right)))
        for j in range(left.shape[1]):
            total += (left[:, j, None] - right[None, :, j]) ** 2
        return np.round(-np.sqrt(total), SCORE_DECIMALS) + 0.0
    dots = left @ right.T
    if metric == "cosine":
        norms = np.outer((left * left).sum(axis=1), (right * right).sum(axis=1))
        dots = np.divide(dots, np.sqrt(norms), out=np.zeros_like(dots), where=norms > 0)
    return np.round(dots, SCORE_DECIMALS) + 0.0


def score_pairs(metric: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of each row of ``left`` with the row of ``right`` in its place."""
    if metric == "euclidean":
        total = np.zeros(len(left))
        for j in range(left.shape[1]):
            total += (left[:, j] - right[:, j]) ** 2
        return np.round(-np.sqrt(total), SCORE_DECIMALS) + 0.0
    dots = np.einsum("ij,ij->i", left, right)
    if metric == "cosine":
        norms = (left * left).sum(axis=1) * (right * right).sum(axis=1)
        dots = np.divide(dots, np.sqrt(norms), out=np.zeros_like(dots), where=norms > 0)
    return np.round(dots, SCORE_DECIMALS) + 0.0


# -- sparse vectors ------------------------------------------------------


def sparse_to_dense(sparse: Column, dim: int) -> Column:
    """A ``map<int, float>`` as an array; indices outside ``0..dim-1`` are ignored.

    Stored values in index order, each after the zeros of its gap.
    """
    zero = F.lit(0.0).cast("float")
    inside = F.filter(F.map_entries(sparse), lambda e: (e["key"] >= 0) & (e["key"] < dim))

    def filled(entries: Column) -> Column:
        key = lambda i: F.coalesce(F.get(entries, i)["key"], F.lit(-1))
        runs = F.transform(
            entries,
            lambda e, i: F.concat(
                F.array_repeat(zero, e["key"] - F.when(i > 0, key(i - 1)).otherwise(F.lit(-1)) - 1),
                F.array(e["value"].cast("float")),
            ),
        )
        last = F.when(F.size(entries) > 0, key(F.size(entries) - 1)).otherwise(F.lit(-1))
        return F.concat(F.flatten(runs), F.array_repeat(zero, F.lit(dim - 1) - last))

    return F.element_at(F.transform(F.array(F.array_sort(inside)), filled), 1)
