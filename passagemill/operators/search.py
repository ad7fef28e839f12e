"""Exact nearest-neighbour search for whole tables of queries.

Two ways, chosen by the checked size of the query side:

* broadcast: queries that fit go to every task, which scores its share of the
  store block by block and keeps a running top k. The store is not shuffled.
* partitioned: for more queries both sides are cut into cells around pivots,
  as many as the root of the store. For the top k a query first searches its
  own cell and then only the cells that can still hold something better; for a
  threshold it visits the cells that come near enough. The bounds are exact.
  Cells are written once, in blocks that the tasks of the queries read.

Inner products have no triangle inequality. With one more coordinate, which
fills every stored vector up to the largest norm and is zero for queries, the
greatest inner product becomes the least distance, and the same bounds hold.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import options as opt
from passagemill.functions import vectors as vec
from passagemill.functions.ranking import distributed_row_number
from passagemill.session import materialize, new_path
from passagemill.sources.walk import open_file, qualified, store_of

# Limits for sending the query side to every task.
BROADCAST_BYTES = 64 << 20
BROADCAST_RESULTS = 2_000_000
# Scores held at once by a task.
BLOCK_SCORES = 4_000_000
# Pairs scored and sent at once.
PAIRS = 65536
# Groups of tasks whose results are merged before the last merge.
MERGE_GROUPS = 64
# More than half of the last decimal that scores keep.
ROUNDING = 1e-9


def search(
    queries: DataFrame,
    store: DataFrame,
    *,
    metric: str = "cosine",
    k: int = opt.SEARCH_K,
    threshold: float | None = None,
    exclude_same_id: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """Hits ``(query_id, rank, chunk_id, score, distance)``.

    ``queries(query_id, vector)``, ``store(chunk_id, vector)``. A ``threshold``
    replaces ``k``: every item scoring at least that much is a hit. Queries that
    do not fit into the limits of a broadcast are always searched partitioned.
    """
    metric = vec.check_metric(metric)
    if k < 1 or (threshold is not None and metric == "cosine" and not -1 <= threshold <= 1):
        raise ValueError("k must be positive, and a threshold of cosines within -1..1")
    queries = queries.select("query_id", "vector")
    store = store.select("chunk_id", "vector")
    if strategy != "partitioned":
        size = queries.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")
        ).first()
        results = size["n"] * (k if threshold is None else 1)
        fits = size["n"] * size["dim"] * 8 <= BROADCAST_BYTES and results <= BROADCAST_RESULTS
        strategy = "broadcast" if fits else "partitioned"
    if threshold is not None:
        way = _score_all if strategy == "broadcast" else range_join
        scored = way(queries, store, metric, threshold, exclude_same_id)
        order = [F.col("score").desc(), F.col("chunk_id")]
        hits = distributed_row_number(scored, ["query_id"], order, "rank")
    elif strategy == "broadcast":
        hits = _topk_broadcast(queries, store, metric, k, exclude_same_id)
    else:
        hits = knn_join(queries, store, metric, k, exclude_same_id)
    return hits.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "chunk_id",
        "score",
        vec.distance(metric, F.col("score")).alias("distance"),
    )


def top_per_query(df: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Best ``k`` per query; ties go to the smaller id."""
    w = Window.partitionBy(*(keys or ["query_id"])).orderBy(F.col("score").desc(), F.col("chunk_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _hit_schema(queries: DataFrame, store: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", store.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


class Met:
    """Queries of a task, and the best ``k`` of what they have met, or all from a threshold up.

    A matrix product tells, within its rounding, which pairs can be good
    enough; only these are scored. Held pairs are cut to the best ``k`` now and then.
    """

    def __init__(self, metric: str, vectors: np.ndarray, k: int | None, threshold: float | None = None):
        self.metric, self.vectors, self.k = metric, vectors, k
        self.squares = (vectors * vectors).sum(axis=1)
        self.left = _unit(vectors, metric)
        self.floor = np.full(len(vectors), -np.inf if threshold is None else float(threshold))
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held, self.most = 0, 2 * len(vectors) * (k or 0)

    def _slack(self, rows: np.ndarray, largest: float) -> np.ndarray:
        """What rounding may change of the product of each query with a vector whose square is at most ``largest``."""
        unit = 4.0 * (self.vectors.shape[1] + 4) * np.finfo(float).eps
        if self.metric == "cosine":
            return np.full(len(rows), 2.0 * unit + ROUNDING)
        both = self.squares[rows] + largest
        return unit * both + ROUNDING * (1.0 if self.metric == "inner_product" else np.sqrt(2.0 * both))

    def pairs(
        self, vectors: np.ndarray, rows: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, place in ``vectors``, score) of pairs that may be among the best, all of a threshold's.

        ``rows`` are the queries to compare; pairs in ``same``, sorted by query, are left out, for which ``rows`` must be all.
        """
        if not len(vectors) or not len(rows):
            return
        squares, right = (vectors * vectors).sum(axis=1), _unit(vectors, self.metric).T
        largest, step = squares.max(), max(1, BLOCK_SCORES // len(vectors))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            rough, slack, floor = self.left[some] @ right, self._slack(some, largest), self.floor[some]
            if self.metric == "euclidean":
                # Half of what the squared distance lacks.
                rough -= squares[None, :] / 2.0
                least = (self.squares[some] - np.maximum(-floor, 0.0) ** 2) / 2.0 - slack
            else:
                least = floor - slack
            if same is not None:
                first, stop = np.searchsorted(same[0], [at, at + len(some)])
                rough[same[0][first:stop] - at, same[1][first:stop]] = -np.inf
            unset = np.flatnonzero(np.isneginf(floor))
            if self.k is not None and len(vectors) > self.k and len(unset):
                least[unset] = np.partition(rough[unset], -self.k, axis=1)[:, -self.k] - 2.0 * slack[unset]
            q, s = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
            for i in range(0, len(q), PAIRS):
                qs, ss = some[q[i : i + PAIRS]], s[i : i + PAIRS]
                score = vec.score_pairs(self.metric, self.vectors[qs], vectors[ss])
                good = score >= self.floor[qs]
                yield qs[good], ss[good], score[good]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        for q, s, score in self.pairs(vectors, rows, same):
            self.held.append((q, ids[s], score))
            self.n_held += len(q)
        if self.n_held >= self.most:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best so far; ties go to the smaller id."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        q, ids, score = (np.concatenate(x) for x in zip(*self.held))
        codes = ids if ids.dtype.kind in "iu" else pd.factorize(ids, sort=True)[0]
        order = np.lexsort((codes, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = score[last]
        self.held = [(q[kept], ids[kept], score[kept])]
        self.n_held = int(kept.sum())
        # Room for as many again, so that cutting is seldom.
        self.most = max(self.most, self.n_held + len(self.vectors) * self.k)
        return self.held[0]


def _equal_ids(query_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids on both sides, by query."""
    asked = pd.DataFrame({"id": query_ids, "q": np.arange(len(query_ids))})
    both = asked.merge(pd.DataFrame({"id": ids, "s": np.arange(len(ids))}), on="id").sort_values("q")
    return both.q.to_numpy(), both.s.to_numpy()


def _topk_broadcast(
    queries: DataFrame, store: DataFrame, metric: str, k: int, exclude_same_id: bool
) -> DataFrame:
    table = queries.toArrow()
    ids = table.column("query_id").to_pandas().to_numpy()
    if len(ids) == 0:
        return top_per_query(store.sparkSession.createDataFrame([], _hit_schema(queries, store)), k)
    matrix = vec.matrix_of(table.column("vector").combine_chunks())
    shared = store.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, wanted = shared.value
        met, every = Met(metric, wanted, k), np.arange(len(wanted))
        for batch in batches:
            chunk_ids = batch.column("chunk_id").to_pandas().to_numpy()
            same = _equal_ids(query_ids, chunk_ids) if exclude_same_id else None
            met.meet(chunk_ids, vec.matrix_of(batch.column("vector")), every, same)
        q, found, score = met.best()
        for at in range(0, len(q), PAIRS):
            here = slice(at, at + PAIRS)
            yield _hits_batch(query_ids[q[here]], found[here], score[here], schema)

    hit_schema = _hit_schema(queries, store)
    schema = pa.schema(
        [
            table.schema.field("query_id"),
            pa.field("chunk_id", _arrow_type(store, "chunk_id")),
            pa.field("score", pa.float64()),
        ]
    )
    # Every task gives up to k rows per query. Groups of tasks are merged first,
    # so that no query's final merge grows with the number of tasks.
    candidates = store.mapInArrow(scan, hit_schema).withColumn("__tasks", F.spark_partition_id() % MERGE_GROUPS)
    merged = top_per_query(candidates, k, ["query_id", "__tasks"]).drop("__tasks", "rank")
    return top_per_query(merged, k)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _hits_batch(query_ids: np.ndarray, chunk_ids: np.ndarray, scores: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids.tolist(), type=schema.field(0).type),
            pa.array(chunk_ids.tolist(), type=schema.field(1).type),
            pa.array(scores, type=pa.float64()),
        ],
        schema=schema,
    )


# -- partitioned search ----------------------------------------------------


def _score_all(
    queries: DataFrame, store: DataFrame, metric: str, threshold: float, exclude_same_id: bool
) -> DataFrame:
    """Every pair scoring at least ``threshold``; the queries go to every task."""
    table = queries.toArrow()
    ids = table.column("query_id").to_pandas().to_numpy(dtype=object)
    if len(ids) == 0:
        return store.sparkSession.createDataFrame([], _hit_schema(queries, store))
    matrix = vec.matrix_of(table.column("vector").combine_chunks())
    shared = store.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = pa.schema(
        [
            table.schema.field("query_id"),
            pa.field("chunk_id", _arrow_type(store, "chunk_id")),
            pa.field("score", pa.float64()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, wanted = shared.value
        met, every = Met(metric, wanted, None, threshold), np.arange(len(wanted))
        for batch in batches:
            chunk_ids = batch.column("chunk_id").to_pandas().to_numpy()
            for q, s, score in met.pairs(vec.matrix_of(batch.column("vector")), every):
                yield _hits_batch(query_ids[q], chunk_ids[s], score, schema)

    scored = store.mapInArrow(scan, _hit_schema(queries, store))
    return scored.filter(F.col("query_id") != F.col("chunk_id")) if exclude_same_id else scored


def range_join(
    queries: DataFrame,
    store: DataFrame,
    metric: str,
    threshold: float,
    exclude_same_id: bool = False,
    *,
    pivots: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """Every pair ``(query_id, chunk_id, score)`` from ``threshold`` up, when both sides are large.

    A query meets the rows of a cell only if the cell's pivot is no farther
    away than the cell's radius and the distance that the threshold allows.
    """
    space = Space.of(store, "chunk_id", metric, pivots)
    if space is None:
        return store.sparkSession.createDataFrame([], _hit_schema(queries, store))
    rows = space.placed(store.select(F.col("chunk_id").alias("s"), "vector"), stored=True, label="cells")
    asked = space.placed(queries.select(F.col("query_id").alias("q"), "vector"), stored=False, label="placed")
    near = _scan_cells(asked, rows, space, None, threshold, block_rows)
    scored = near.select(F.col("q").alias("query_id"), F.col("s").alias("chunk_id"), "score")
    return scored.filter(F.col("query_id") != F.col("chunk_id")) if exclude_same_id else scored


def _write_cells(rows: DataFrame, block_rows: int) -> list[tuple[int, str, int, int, float]]:
    """Write ``rows(s, vector, cell, gap)`` cell by cell to the shared folder: (cell, file, begin, bytes, radius) of each block.

    One small row per cell and ``block_rows`` rows.
    """
    spark = rows.sparkSession
    root = qualified(spark, new_path(spark, "cell-blocks"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is tried again writes another file.
        path, at, told = f"{root}/{uuid.uuid4().hex}", 0, []
        store, inside = store_of(path)
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inside, compression=None) as out:
            for batch in batches:
                cells, gaps = batch.column("cell").to_numpy(), batch.column("gap").to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])[: len(cells)])
                for begin, end in zip(starts, [*starts[1:], len(cells)]):
                    for b in range(begin, end, block_rows):
                        e = min(end, b + block_rows)
                        sink = pa.BufferOutputStream()
                        some = batch.select(["s", "vector"]).slice(b, e - b)
                        with pa.ipc.new_stream(sink, some.schema) as stream:
                            stream.write_batch(some)
                        data = sink.getvalue()
                        out.write(data)
                        told.append((int(cells[b]), path, at, data.size, float(gaps[b:e].max())))
                        at += data.size
        names = ["cell", "path", "begin", "bytes", "radius"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in told], schema=index)

    index = pa.schema([("cell", pa.int32()), ("path", pa.string()), ("begin", pa.int64()), ("bytes", pa.int64()), ("radius", pa.float64())])
    ordered = rows.select("s", "vector", "cell", "gap").repartitionByRange("cell", F.xxhash64("s")).sortWithinPartitions("cell")
    blocks = ordered.mapInArrow(write, "cell int, path string, begin bigint, bytes bigint, radius double")
    return sorted(tuple(r) for r in blocks.collect())


def _scan_cells(
    asked: DataFrame, rows: DataFrame, space: Space, k: int | None, threshold: float | None = None, block_rows: int = 4096
) -> DataFrame:
    """``(q, s, score)`` of ``asked(q, vector, cell)`` among ``rows(s, vector, cell, gap)``: the best ``k``, or all from ``threshold`` up.

    A task holds about ``block_rows`` queries that lie near each other and goes
    through the cells, nearest first, reading a block of them at a time from the
    shared folder, as long as a cell can still hold something better for some
    query. Neither pairs nor copies of vectors are written, so the disk holds
    both sides once, whatever the bounds rule out.
    """
    spark = asked.sparkSession
    blocks = _write_cells(rows, block_rows)
    schema = T.StructType(
        [
            T.StructField("q", asked.schema["q"].dataType),
            T.StructField("s", rows.schema["s"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not blocks:
        return spark.createDataFrame([], schema)
    cells = np.unique([b[0] for b in blocks])
    places = _by_cell(blocks)
    radius = np.array([max(x) for x in _by_cell(blocks, 4)])
    index = spark.sparkContext.broadcast((cells, places, radius))
    bare, pivots = space.bare(), space.shared
    arrow = pa.schema([pa.field("q", _arrow_type(asked, "q")), pa.field("s", _arrow_type(rows, "s")), pa.field("score", pa.float64())])

    def searched(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells, places, radius = index.value
        points = bare.points(vectors, False)
        gaps = _least_gaps(points, pivots.value[np.maximum(cells, 0)], radius)
        gaps[:, cells == -1] = -np.inf
        met = Met(bare.metric, vectors, k, threshold)
        for c in np.argsort(gaps.min(axis=0), kind="stable"):
            near = np.flatnonzero(gaps[:, c] <= bare.reach(vectors, points, met.floor))
            if not len(near):
                continue
            for path, begin, size in places[c]:
                with open_file(path) as stream:
                    stream.seek(begin)
                    block = pa.ipc.open_stream(stream.read(size)).read_next_batch()
                found, stored = block.column("s").to_pandas().to_numpy(), vec.matrix_of(block.column("vector"))
                if k is not None:
                    met.meet(found, stored, near)
                    continue
                for q, s, score in met.pairs(stored, near):
                    yield _hits_batch(ids[q], found[s], score, arrow)
        if k is not None:
            q, found, score = met.best()
            for at in range(0, len(q), PAIRS):
                here = slice(at, at + PAIRS)
                yield _hits_batch(ids[q[here]], found[here], score[here], arrow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(at, block_rows))
                n += held[-1].num_rows
                if n >= block_rows:
                    yield from searched(*_ids_and_vectors(held))
                    held, n = [], 0
        if n:
            yield from searched(*_ids_and_vectors(held))

    # As few tiles as their size allows, but work for every core.
    n = asked.count()
    tasks = max(-(-n // block_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // 256)), 1)
    dealt = asked.select("q", "vector", "cell").repartitionByRange(tasks, "cell", F.xxhash64("q")).sortWithinPartitions("cell")
    return dealt.mapInArrow(scan, schema)


def _by_cell(blocks: list[tuple], field: int | None = None) -> list[list]:
    """The places of each cell's blocks, or one field of them, in the order of cells."""
    found: dict[int, list] = {}
    for b in blocks:
        found.setdefault(b[0], []).append(b[1:4] if field is None else b[field])
    return [found[c] for c in sorted(found)]


def _ids_and_vectors(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return table.column("q").to_pandas().to_numpy(), vec.matrix_of(table.column("vector").combine_chunks())


def _distinct_vectors(df: DataFrame, key: str, ids: int) -> DataFrame:
    """One row per distinct vector: its smallest id and its first ``ids`` ids.

    Only these can be among the best of any query, since ties go to the smaller
    id. Copies are cut down before the shuffle, so a vector that makes up a
    third of the table costs a few rows per task.
    """
    first = Window.partitionBy("vector").orderBy(key)
    kept = df.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= ids)
    return kept.groupBy("vector").agg(F.array_sort(F.collect_list(key)).alias("ids")).select(
        F.element_at("ids", 1).alias("rep"), "ids", "vector"
    )


def knn_join(
    queries: DataFrame,
    store: DataFrame,
    metric: str,
    k: int,
    exclude_same_id: bool = False,
    *,
    pivots: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """Exact k nearest neighbours when both sides are large.

    After the pivot-based kNN join of Lu et al. (VLDB 2012), with copies of a
    vector handled once.
    """
    want = k + 1 if exclude_same_id else k
    items = materialize(_distinct_vectors(store, "chunk_id", want), "items")
    asked = materialize(_distinct_vectors(queries, "query_id", 1).select(F.col("rep").alias("q"), "vector"), "asked")
    space = Space.of(items, "rep", metric, pivots)
    if space is None:
        return top_per_query(store.sparkSession.createDataFrame([], _hit_schema(queries, store)), k)
    near = _pruned_neighbours(asked, items, want, space, block_rows)
    best = top_per_query(
        near.select(F.col("q").alias("query_id"), F.col("s").alias("chunk_id"), "score"), want
    ).drop("rank")
    # From distinct vectors back to ids, on both sides.
    full = best.join(items.select(F.col("rep").alias("chunk_id"), "ids"), "chunk_id").select(
        "query_id", F.explode("ids").alias("chunk_id"), "score"
    )
    lists = (
        top_per_query(full, want)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("found"))
    )
    owner = asked.select(F.col("q").alias("__rep"), "vector")
    every = queries.join(owner, "vector").join(lists.withColumnRenamed("query_id", "__rep"), "__rep")
    found = F.col("found")
    if exclude_same_id:
        found = F.filter(found, lambda h: h["chunk_id"] != F.col("query_id"))
    return every.select("query_id", F.posexplode(F.slice(found, 1, k)).alias("__i", "hit")).select(
        "query_id", (F.col("__i") + 1).alias("rank"), "hit.chunk_id", "hit.score"
    )


def _pruned_neighbours(
    asked: DataFrame, items: DataFrame, want: int, space: Space, block_rows: int
) -> DataFrame:
    """The best ``want`` neighbours ``(q, s, score)``, written."""
    rows = space.placed(items.select(F.col("rep").alias("s"), "vector"), stored=True, label="cells")
    placed = space.placed(asked, stored=False, label="placed").drop("gap")
    return materialize(_scan_cells(placed, rows, space, want, block_rows=block_rows), "near")


class Space:
    """Cells around pivots, in a space where a higher score is a smaller distance.

    Cosine: unit vectors. Inner product: stored vectors filled up to the
    largest norm by one more coordinate, and queries of that length. Euclidean: the vectors themselves.
    """

    def __init__(self, spark, metric: str, pivots: np.ndarray, limit: float):
        self.metric, self.limit = metric, limit
        self.shared = spark.sparkContext.broadcast(self.points(pivots, True))

    @classmethod
    def of(cls, items: DataFrame, key: str, metric: str, pivots: int | None) -> Space | None:
        """Pivots are items drawn by a hash of their ids: as many as the root of their number, within the limit of a broadcast."""
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, norm, dim = items.agg(F.count(F.lit(1)), F.max(F.sqrt(square)), F.max(F.size("vector"))).first()
        if n == 0:
            return None
        if pivots is None:
            pivots = min(max(16, math.isqrt(n)), max(16, BROADCAST_BYTES // (8 * (dim + 1))))
        chosen = items.orderBy(F.xxhash64(key), key).limit(pivots).select("vector").toArrow()
        return cls(items.sparkSession, metric, vec.matrix_of(chosen.column("vector").combine_chunks()), norm * (1 + 1e-9))

    def points(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        if self.metric != "inner_product":
            return _unit(vectors, self.metric)
        if not stored:
            # The length of a query does not change the order of its scores.
            return np.hstack([_unit(vectors, "cosine") * self.limit, np.zeros((len(vectors), 1))])
        rest = np.sqrt(np.maximum(self.limit**2 - (vectors * vectors).sum(axis=1), 0.0))
        return np.hstack([vectors, rest[:, None]])

    def placed(self, df: DataFrame, *, stored: bool, label: str) -> DataFrame:
        """Rows with their ``cell`` and ``gap``, the distance to its pivot; written."""
        shared, points_of, metric = self.shared, self.bare().points, self.metric

        @F.arrow_udf("struct<cell int, gap double>")
        def nearest(vectors: pa.Array) -> pa.Array:
            points = points_of(vec.matrix_of(vectors), stored)
            cell, gap = np.empty(len(points), np.int64), np.empty(len(points))
            step = max(1, BLOCK_SCORES // len(shared.value))
            for at in range(0, len(points), step):
                gaps = _distances(points[at : at + step], shared.value)
                cell[at : at + step] = gaps.argmin(axis=1)
                gap[at : at + step] = gaps.min(axis=1)
            if metric == "cosine":
                # A zero vector has no direction: a cell of its own, never pruned.
                cell = np.where((points == 0).all(axis=1), -1, cell)
            return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(gap)], ["cell", "gap"])

        return materialize(df.withColumn("__at", nearest("vector")).select(*df.columns, "__at.cell", "__at.gap"), label)

    def bare(self) -> Space:
        """The space without the handle of the session."""
        bare = object.__new__(Space)
        bare.metric, bare.limit = self.metric, self.limit
        return bare

    def reach(self, vectors: np.ndarray, points: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from each query a vector may be that scores ``score``; a score that is not known means any."""
        # Scores are rounded: a true score may be this much below the one it ties with.
        least = score - ROUNDING
        if self.metric == "cosine":
            bound = np.sqrt(np.maximum(2.0 - 2.0 * least, 0.0))
            bound[(points == 0).all(axis=1)] = np.inf
        elif self.metric == "inner_product":
            norm = np.linalg.norm(vectors, axis=1)
            scaled = np.divide(least * self.limit, norm, out=np.zeros_like(norm), where=norm > 0)
            bound = np.where(norm > 0, np.sqrt(np.maximum(2.0 * self.limit**2 - 2.0 * scaled, 0.0)), np.inf)
        else:
            bound = -least
        return np.where(np.isnan(bound), np.inf, bound)

    def visits(self, asked: DataFrame, rows: DataFrame, low: Column) -> DataFrame:
        """A row ``(q, vector, cell)`` for each cell, but the own one, that may hold a score of ``low`` or more.

        No ``low`` means every cell.
        """
        # One row per pivot.
        reach = {r["cell"]: r["radius"] for r in rows.groupBy("cell").agg(F.max("gap").alias("radius")).collect()}
        cells = sorted(reach)
        radius = np.array([reach[c] for c in cells])
        shared, bare = self.shared, self.bare()

        def reached(vectors: np.ndarray, score: np.ndarray, own: np.ndarray) -> np.ndarray:
            points = bare.points(vectors, False)
            gaps = _least_gaps(points, shared.value[np.maximum(cells, 0)], radius)
            keep = (gaps <= bare.reach(vectors, points, score)[:, None]) | (np.array(cells) == -1)[None, :]
            return keep & (np.array(cells)[None, :] != own[:, None])

        @F.arrow_udf("array<int>")
        def others(vectors: pa.Array, own: pa.Array, lows: pa.Array) -> pa.Array:
            given = vec.matrix_of(vectors)
            score = lows.to_numpy(zero_copy_only=False).astype(float)
            own = own.fill_null(-2).to_numpy(zero_copy_only=False)
            step = max(1, BLOCK_SCORES // len(cells))
            keep = [
                reached(given[at : at + step], score[at : at + step], own[at : at + step])
                for at in range(0, len(given), step)
            ]
            i, j = np.nonzero(np.concatenate(keep) if keep else np.zeros((0, len(cells)), bool))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(given)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(cells, dtype=np.int32)[j]))

        return asked.select("q", "vector", F.explode(others("vector", "cell", low)).alias("cell"))


def _unit(points: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return points
    norms = np.sqrt((points * points).sum(axis=1, keepdims=True))
    return np.divide(points, norms, out=np.zeros_like(points), where=norms > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def _least_gaps(points: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The least distance that each point may have from anything in each cell, rounding allowed for."""
    gaps = _distances(points, centres) - radius[None, :]
    own_norm, centre_norm = np.linalg.norm(points, axis=1)[:, None], np.linalg.norm(centres, axis=1)[None, :]
    farthest, dim = centre_norm + radius[None, :], points.shape[1]
    slack = _distance_error(own_norm, centre_norm, dim) + _distance_error(farthest, centre_norm, dim)
    return gaps - slack - 2.0 * _distance_error(own_norm, farthest, dim)


def _distance_error(a_norm: np.ndarray, b_norm: np.ndarray, dim: int) -> np.ndarray:
    """What cancellation may add to or take from :func:`_distances` of vectors of these norms."""
    squares = a_norm * a_norm + b_norm * b_norm
    return np.sqrt(4.0 * (dim + 4) * np.finfo(float).eps * squares)


# -- after the search --------------------------------------------------------


def hydrate_hits(hits: DataFrame, chunks: DataFrame, *, row_bound: int | None = None) -> DataFrame:
    """Attach text and metadata by ``chunk_id``; unknown ids keep a note.

    With a known ``row_bound`` on the hits that is small enough, their ids are
    sent to the chunk scan, so the store is filtered instead of shuffled.
    """
    extra = [c for c in chunks.columns if c not in hits.columns]
    details = chunks.select("chunk_id", *extra).withColumn("__known", F.lit(True))
    if row_bound is not None and row_bound <= BROADCAST_RESULTS:
        details = details.join(F.broadcast(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    note = F.when(F.col("__known").isNull(), F.lit("chunk data missing for id"))
    return hits.join(details, "chunk_id", "left").withColumn("hydration_error", note).drop("__known")


def get_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Details of the wanted ids, with ``found`` telling unknown ids apart and
    ``consistent`` false where an id lacks its text."""
    wanted = ids.select("chunk_id").distinct()
    known = chunks.join(wanted, "chunk_id", "left_semi").withColumn("__known", F.lit(True))
    return wanted.join(known, "chunk_id", "left").select(
        "*",
        F.col("__known").isNotNull().alias("found"),
        (F.col("__known").isNull() | F.col("text").isNotNull()).alias("consistent"),
    ).drop("__known")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk by id; the filter reaches the Parquet scan."""
    return chunks.filter(F.col("chunk_id") == chunk_id)


def knn_graph(
    points: DataFrame, *, asked: DataFrame | None = None, k: int = opt.PLOT_NEIGHBORS, metric: str = "cosine"
) -> DataFrame:
    """Nearest others of each point, or of those ``asked``; fewer than ``k`` in tiny inputs."""
    queries = (points if asked is None else asked).select(F.col("chunk_id").alias("query_id"), "vector")
    return search(queries, points, metric=metric, k=k, exclude_same_id=True)

