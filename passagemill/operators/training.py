"""Fitting a static token-vector model to a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill import options as opt
from passagemill.functions import vectors as vec
from passagemill.functions.text import terms
from passagemill.operators.embedding import STATIC_BROADCAST_BYTES, embed_with_model
from passagemill.session import materialize


def build_vocabulary(df: DataFrame, text_col: str = "text", size: int = opt.VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` most frequent terms with counts; 0 gives an empty vocabulary."""
    counts = df.select(F.explode(terms(F.col(text_col))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    # A sort with a limit keeps only the leaders of each task.
    return counts.orderBy(F.col("n").desc(), "token").limit(size)


def featurize_corpus(
    passages: DataFrame,
    encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] | None,
    out_path: str,
    *,
    max_means: int | None = None,
    batch: int = 64,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Teacher vectors per passage, averaged over its token vectors by the
    encoder, of all passages or the first ``max_means`` by id; passages already
    written are skipped.

    ``passages(passage_id, text)``; ``embed`` may replace the encoder.
    """
    spark = passages.sparkSession
    chosen = passages.select("passage_id", "text")
    if max_means is not None:
        # Passages are taken by id, so that a resumed run picks the same ones;
        # only ids are sorted to find the last.
        last = chosen.select("passage_id").orderBy("passage_id").limit(max_means).agg(F.max("passage_id")).scalar()
        chosen = chosen.filter(F.col("passage_id") <= last)
    try:
        done = spark.read.parquet(out_path).select("passage_id")
        todo = chosen.join(done, "passage_id", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = chosen
    if embed is not None:
        vectors = embed(todo)
    else:
        vectors = embed_with_model(todo, "text", encoder_factory, batch=batch)
    vectors.select("passage_id", "text", F.col("vector").cast("array<double>").alias("vector")).write.mode(
        "append"
    ).parquet(out_path)
    return spark.read.parquet(out_path)


def token_weights(vocabulary: DataFrame, a: float = 1e-3) -> DataFrame:
    """Frequent tokens count less: ``a / (a + p(token))``."""
    total = vocabulary.agg(F.sum("n").alias("n")).scalar()
    return vocabulary.withColumn("weight", F.lit(a) / (F.lit(a) + F.col("n") / total))


def train_static_model(
    features: DataFrame,
    vocabulary: DataFrame,
    *,
    iterations: int = 3,
    ridge: float = 1.0,
    a: float = 1e-3,
) -> tuple[DataFrame, list[float]]:
    """Token vectors whose weighted mean per passage meets the passage's target.

    ``features(passage_id, text, vector)``. Each round gives every token the
    weighted mean of what its passages still miss (a ridge step), found by two
    aggregations; rounds are written to the shared folder. Returns
    ``token_vectors(token, weight, vector)`` and the mean squared error after
    each round, the first entry being that of the start.

    With a vocabulary that fits a broadcast, passages are written once, a row
    each with its token numbers, and a round adds up one small table per task.
    """
    weights = materialize(token_weights(vocabulary, a), "weights")
    n, known, chars = weights.agg(F.count(F.lit(1)), F.count_distinct("token"), F.coalesce(F.sum(F.length("token")), F.lit(0))).first()
    dim = features.agg(F.max(F.size("vector"))).first()[0] or 0
    if n == known and 0 < n * dim * 8 + chars <= STATIC_BROADCAST_BYTES:
        return _train_by_lookup(features, weights, dim, iterations, ridge)
    counts = (
        features.select("passage_id", F.explode(terms(F.col("text"))).alias("token"))
        .groupBy("passage_id", "token")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .join(weights.select("token", "weight"), "token")
    )
    # Share of a token in its passage's mean.
    totals = counts.groupBy("passage_id").agg(F.sum("n").alias("total"))
    shares = materialize(
        counts.join(totals, "passage_id").select(
            "passage_id", "token", (F.col("weight") * F.col("n") / F.col("total")).alias("share")
        ),
        "shares",
    )
    targets = features.select("passage_id", array_to_vector("vector").alias("target"))
    residual = materialize(targets.select("passage_id", vector_to_array("target").alias("missing")), "missing")
    losses = [_mean_square(residual)]
    vectors = None
    for _ in range(iterations):
        step = _ridge_step(shares, residual, ridge)
        if vectors is None:
            vectors = step
        else:
            both = vectors.join(step.withColumnRenamed("vector", "__step"), "token", "full")
            zero = F.transform(F.coalesce("vector", "__step"), lambda x: x * 0)
            vectors = both.select(
                "token",
                F.zip_with(F.coalesce("vector", zero), F.coalesce("__step", zero), lambda x, y: x + y).alias("vector"),
            )
        vectors = materialize(vectors, "token-vectors")
        residual = materialize(_residuals(shares, vectors, targets), "missing")
        losses.append(_mean_square(residual))
    model = vectors.join(weights.select("token", "weight"), "token").select("token", "weight", "vector")
    return model, losses


def _numbered_passages(features: DataFrame, tokens: pa.Array) -> DataFrame:
    """A row ``(vector, ids, counts)`` per row of ``features``, written: the numbers of its passage's tokens, and how often each is there."""
    shared = features.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        lengths, flat = vec.list_parts(texts)
        ids = pc.index_in(flat, value_set=shared.value)
        found = ids.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lengths)), lengths)[found]
        ends = np.cumsum(np.bincount(rows, minlength=len(lengths)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), ids.drop_null())

    @F.arrow_udf("struct<ids array<int>, counts array<int>>")
    def counted(lists: pa.Array) -> pa.Array:
        lengths, flat = vec.list_parts(lists)
        keys = np.repeat(np.arange(len(lengths)), lengths) * len(shared.value) + flat.to_numpy(zero_copy_only=False)
        keys, counts = np.unique(keys, return_counts=True)
        rows, ids = np.divmod(keys, len(shared.value))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lengths)))]), pa.int32())
        made = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, counts)]
        return pa.StructArray.from_arrays(made, ["ids", "counts"])

    # Rows that repeat an id are one passage of all their tokens.
    told = features.filter(F.col("passage_id").isNotNull()).select("passage_id", numbers(terms(F.col("text"))).alias("ids"))
    passages = told.groupBy("passage_id").agg(F.flatten(F.collect_list("ids")).alias("ids")).select(
        "passage_id", counted("ids").alias("held")
    )
    targets = features.select("passage_id", F.col("vector").cast("array<double>").alias("vector"))
    return materialize(targets.join(passages, "passage_id", "left").select("vector", "held.ids", "held.counts"), "passages")


def _train_by_lookup(
    features: DataFrame, weights: DataFrame, dim: int, iterations: int, ridge: float
) -> tuple[DataFrame, list[float]]:
    """:func:`train_static_model` with all token vectors in every task."""
    spark = features.sparkSession
    table = weights.select("token", F.col("weight").cast("double")).toArrow()
    tokens, weight = table.column("token").combine_chunks(), table.column("weight").to_numpy()
    passages = _numbered_passages(features, tokens)
    # Every task tells one table, so their number does not grow with the passages.
    passages = passages.coalesce(2 * spark.sparkContext.defaultParallelism)
    vectors, seen, losses = np.zeros((len(tokens), dim)), np.zeros(len(tokens), bool), []
    for at in range(iterations + 1):
        sums, mass, loss = _missing_sums(passages, weight, vectors)
        losses.append(loss)
        if at < iterations:
            vectors = vectors + sums / (ridge + mass)[:, None]
            seen |= mass > 0
    rows = pa.table({"token": tokens, "weight": weight, "vector": vec.lists_of(vectors, pa.float64())})
    model = spark.createDataFrame(rows.filter(pa.array(seen)), "token string, weight double, vector array<double>")
    return materialize(model, "token-vectors"), losses


def _missing_sums(passages: DataFrame, weight: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Per token ``sum(share * missing)`` and ``sum(share)``, and the mean square of what passages miss."""
    shared = passages.sparkSession.sparkContext.broadcast((weight, vectors))
    step = 65536  # tokens gathered at once, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, vectors = shared.value
        sums, mass, square, n = np.zeros_like(vectors), np.zeros(len(weight)), 0.0, 0
        for batch in batches:
            lengths, flat = vec.list_parts(batch.column("ids"))
            ids, counts = (x.to_numpy(zero_copy_only=False) for x in (flat, batch.column("counts").flatten()))
            targets = vec.matrix_of(batch.column("vector"))
            ends = np.cumsum(lengths)
            first = 0
            while first < len(lengths):
                begin = ends[first] - lengths[first]
                last = max(first + 1, int(np.searchsorted(ends, begin + step, "right")))
                rows = np.repeat(np.arange(last - first), lengths[first:last])
                t, times = ids[begin : ends[last - 1]], counts[begin : ends[last - 1]].astype(float)
                share = weight[t] * times / np.bincount(rows, times, last - first)[rows]
                missing = targets[first:last].copy()
                heads = np.flatnonzero(np.diff(rows, prepend=-1))
                if len(heads):
                    missing[rows[heads]] -= np.add.reduceat(share[:, None] * vectors[t], heads, axis=0)
                    order = np.argsort(t, kind="stable")
                    own = np.flatnonzero(np.diff(t[order], prepend=-1))
                    sums[t[order][own]] += np.add.reduceat((share[:, None] * missing[rows])[order], own, axis=0)
                    mass += np.bincount(t, share, len(weight))
                square += float((missing * missing).sum())
                n += last - first
                first = last
        told = np.flatnonzero(mass > 0)
        # The row of no token holds the squares and the number of passages.
        head = np.zeros((1, vectors.shape[1]))
        columns = [
            pa.array(np.concatenate([[-1], told]), pa.int32()),
            vec.lists_of(np.vstack([head, sums[told]]), pa.float64()),
            pa.array(np.concatenate([[square], mass[told]])),
            pa.array(np.concatenate([[n], np.zeros(len(told))]).astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "total", "mass", "n"])

    told = passages.mapInArrow(run, "id int, total array<double>, mass double, n bigint")
    added = told.groupBy("id").agg(
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("mass").alias("mass"), F.sum("n").alias("n")
    ).toArrow()
    ids, n = added.column("id").to_numpy(), added.column("n").to_numpy().sum()
    values, totals = added.column("mass").to_numpy(), vec.matrix_of(added.column("total").combine_chunks())
    own = ids >= 0
    sums, mass = np.zeros_like(vectors), np.zeros(len(weight))
    sums[ids[own]], mass[ids[own]] = totals[own], values[own]
    return sums, mass, float(values[~own].sum() / n) if n else None


def _ridge_step(shares: DataFrame, residual: DataFrame, ridge: float) -> DataFrame:
    """Per token: sum(share * missing) / (ridge + sum(share))."""
    joined = shares.join(residual, "passage_id").withColumn("__m", array_to_vector("missing"))
    sums = joined.groupBy("token").agg(
        vector_to_array(Summarizer.mean(F.col("__m"), F.col("share"))).alias("mean"),
        F.sum("share").alias("mass"),
    )
    scale = F.col("mass") / (F.col("mass") + ridge)
    return sums.select("token", F.transform("mean", lambda x: x * scale).alias("vector"))


def _residuals(shares: DataFrame, vectors: DataFrame, targets: DataFrame) -> DataFrame:
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    # Frequent tokens would gather in few tasks of a shuffled join.
    if size["n"] * size["d"] * 8 <= STATIC_BROADCAST_BYTES:
        vectors = F.broadcast(vectors)
    predicted = (
        shares.join(vectors, "token")
        .withColumn("__v", array_to_vector("vector"))
        .groupBy("passage_id")
        .agg(
            vector_to_array(Summarizer.mean(F.col("__v"), F.col("share"))).alias("mean"),
            F.sum("share").alias("mass"),
        )
        .select("passage_id", F.transform("mean", lambda x: x * F.col("mass")).alias("guess"))
    )
    target = vector_to_array("target")
    missing = F.zip_with(
        target, F.coalesce("guess", F.transform(target, lambda x: x * 0)), lambda t, g: t - g
    )
    return targets.join(predicted, "passage_id", "left").select("passage_id", missing.alias("missing"))


def _mean_square(residual: DataFrame) -> float:
    square = F.aggregate("missing", F.lit(0.0), lambda acc, x: acc + x * x)
    return residual.agg(F.avg(square).alias("loss")).first()["loss"]
