from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passagemill.functions import vectors as vec
from passagemill.functions.ranking import distributed_row_number
from passagemill.operators import embedding as emb
from passagemill.operators.context import pack_context
from passagemill.operators.search import Space, get_chunk, hydrate_hits, knn_graph, knn_join, range_join, search


def _vectors(n=240, dim=6, seed=3):
    """A third of the rows is one vector; some are zero."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)) + 4 * rng.integers(0, 3, size=(n, 1))
    m[: n // 3] = m[0]
    m[n // 3 : n // 3 + 3] = 0
    return [(int(i), [float(np.float32(x)) for x in row]) for i, row in enumerate(m)]


def _brute(rows, metric, k, same):
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows])
    scores = vec.score_block(metric, m, m)
    out = {}
    for i, q in enumerate(ids):
        order = sorted((-scores[i, j], s) for j, s in enumerate(ids) if same or s != q)
        out[int(q)] = [(int(s), round(-v + 0.0, 6)) for v, s in order[:k]]
    return out


@pytest.mark.parametrize("metric", vec.METRICS)
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("strategy", ["broadcast", "partitioned"])
def test_search_is_exact(spark, metric, same, strategy):
    rows = _vectors()
    store = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>").repartition(5)
    queries = store.select(F.col("chunk_id").alias("query_id"), "vector")
    if strategy == "broadcast":
        hits = search(queries, store, metric=metric, k=9, exclude_same_id=not same, strategy=strategy)
    else:
        hits = knn_join(queries, store, metric, 9, not same, pivots=8, block_rows=16)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"] + 0.0, 6)))
    assert got == _brute(rows, metric, 9, same)


def test_graph_of_some_points(spark):
    rows = _vectors()
    store = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>")
    hits = knn_graph(store, asked=store.filter("chunk_id % 100 = 0"), k=5)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"] + 0.0, 6)))
    every = _brute(rows, "cosine", 5, False)
    assert got == {q: every[q] for q in (0, 100, 200)}


def test_threshold_ways_agree(spark):
    rows = _vectors()
    store = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>")
    queries = store.select(F.col("chunk_id").alias("query_id"), "vector")
    a, b = (
        sorted(map(tuple, search(queries, store, threshold=0.9, strategy=s).drop("distance").collect()))
        for s in ("broadcast", "partitioned")
    )
    assert a == b and len(a) > 80 * 80
    with pytest.raises(ValueError):
        search(queries, store, threshold=1.5)
    with pytest.raises(ValueError):
        search(queries, store, k=0)


def test_empty_queries(spark):
    store = spark.createDataFrame(_vectors(12), "chunk_id bigint, vector array<double>")
    queries = store.select(F.col("chunk_id").alias("query_id"), "vector").limit(0)
    for strategy in ("broadcast", "partitioned"):
        assert search(queries, store, strategy=strategy).count() == 0


def test_pair_similarity_matches_blocks(spark):
    rows = _vectors(20)
    m = np.array([r[1] for r in rows])
    df = spark.createDataFrame([(a[1], b[1]) for a, b in zip(rows, rows[1:])], "a array<double>, b array<double>")
    for metric in vec.METRICS:
        got = [r[0] for r in df.select(vec.similarity(metric, F.col("a"), F.col("b"))).collect()]
        want = [vec.score_block(metric, m[i : i + 1], m[i + 1 : i + 2])[0, 0] for i in range(len(m) - 1)]
        assert np.allclose(got, want, atol=2e-9)


def test_static_embedding_ways_agree(spark):
    tokens = [(f"t{i}", 1.0 / (i + 1), [float(i % 3), float(i % 5), 1.0]) for i in range(20)]
    table = spark.createDataFrame(tokens, "token string, weight double, vector array<double>")
    texts = [(i, " ".join(f"T{(i * j) % 25}" for j in range(1, 9))) for i in range(30)] + [(99, "unknown only"), (100, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    a, b = (
        {r["id"]: r["vector"] for r in emb.embed_static(df, "id", "text", table, broadcast_bytes=limit).collect()}
        for limit in (1 << 20, 0)
    )
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    assert a[99] == [0.0, 0.0, 0.0] == a[100]


def test_sparse_to_dense(spark):
    df = spark.sql("select map(3, 2.0f, 0, 1.0f, 9, 7.0f, -1, 5.0f) m union all select map() union all select null")
    got = [r[0] for r in df.select(vec.sparse_to_dense(F.col("m"), 5)).collect()]
    assert got == [[1.0, 0.0, 0.0, 2.0, 0.0], [0.0] * 5, None]


def test_mixed_widths_fail(spark):
    df = spark.sql("select array(1.0d) vector union all select array(1.0d, 2.0d)")
    with pytest.raises(ValueError):
        emb.validate_dimensions(df)


def test_row_numbers_of_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.xxhash64("id").alias("o"),
    )
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("bigint"))
    got = distributed_row_number(df, ["k"], [F.col("o")], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_packing_stops_at_first_overflow(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a", "one two"), (1, 2, "b", " "), (1, 3, "c", "w " * 50), (1, 4, "d", "fits"), (2, 1, "e", "w " * 99)],
        "query_id int, rank int, chunk_id string, text string",
    )
    contexts, citations = pack_context(hits, 10)
    assert [tuple(r)[:3] for r in contexts.collect()] == [(1, "[Source 1]\n\none two", 4)]
    assert [(r["tag_id"], r["chunk_id"]) for r in citations.collect()] == [(1, "a")]


def test_hydrate_unknown_ids(spark):
    chunks = spark.createDataFrame([("a", "text a")], "chunk_id string, text string")
    hits = spark.createDataFrame([(1, "a"), (1, "zz")], "query_id int, chunk_id string")
    for bound in (None, 2):
        got = {r["chunk_id"]: r for r in hydrate_hits(hits, chunks, row_bound=bound).collect()}
        assert got["a"]["text"] == "text a" and got["a"]["hydration_error"] is None
        assert got["zz"]["text"] is None and got["zz"]["hydration_error"]
    assert get_chunk(chunks, "zz").count() == 0


@pytest.mark.parametrize("metric, scale, spread", [("cosine", 1.0, 1e-6), ("euclidean", 6e5, 1.0)])
def test_large_search_with_near_ties_and_large_norms(spark, metric, scale, spread):
    rng = np.random.default_rng(5)
    m = (scale + spread * rng.normal(size=(600, 8))).tolist()
    store = spark.createDataFrame([(i, v) for i, v in enumerate(m)], "chunk_id bigint, vector array<double>")
    queries = store.withColumnRenamed("chunk_id", "query_id").filter("query_id % 4 = 0")
    both = [
        [(r.query_id, r["rank"], r.chunk_id) for r in search(queries, store, metric=metric, k=5, strategy=s).collect()]
        for s in ("broadcast", "partitioned")
    ]
    assert sorted(both[0]) == sorted(both[1])


def _clusters(n, dim=8, seed=11):
    rng = np.random.default_rng(seed)
    centres = 20 * rng.normal(size=(30, dim))
    m = centres[rng.integers(0, 30, n)] + 0.2 * rng.normal(size=(n, dim))
    m[: n // 3] = m[0]  # a third of the rows is one vector
    m[n // 3 : n // 3 + 4] = 0
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(m)]


def _pairs_scored(space, asked, rows, threshold):
    sizes = rows.groupBy("cell").count()
    return space.visits(asked, rows, F.lit(threshold)).join(sizes, "cell").agg(F.sum("count")).first()[0]


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.95), ("cosine", -0.2), ("euclidean", -1.5), ("inner_product", 2500.0)])
def test_range_join(spark, metric, threshold):
    """All pairs above a threshold, with few more pairs scored than found."""
    rows = _clusters(600)
    store = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>").repartition(4)
    queries = store.select(F.col("chunk_id").alias("query_id"), "vector")
    m = np.array([r[1] for r in rows])
    scores = vec.score_block(metric, m, m)
    plain = {(int(i), int(j)): scores[i, j] for i, j in zip(*np.nonzero(scores >= threshold))}
    for same in (False, True):
        got = range_join(queries, store, metric, threshold, same, block_rows=50).collect()
        want = {k: v for k, v in plain.items() if not (same and k[0] == k[1])}
        assert len(got) == len(want) and {(r.query_id, r.chunk_id) for r in got} == want.keys()
        assert all(abs(r.score - want[(r.query_id, r.chunk_id)]) < 2e-9 * max(1, abs(r.score)) for r in got)
    space = Space.of(store, "chunk_id", metric, None)
    placed = space.placed(store.select(F.col("chunk_id").alias("s"), "vector"), stored=True, label="cells")
    asked = queries.select(F.col("query_id").alias("q"), "vector", F.lit(None).cast("int").alias("cell"))
    scored = _pairs_scored(space, asked, placed, threshold)
    assert len(plain) <= scored
    if threshold != -0.2:
        assert scored < 0.6 * 600 * 600


def test_inner_products_are_pruned(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(2).normal(size=(800, 4)) * np.linspace(0.01, 1, 800)[:, None] ** 3)]
    store = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>")
    queries = store.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    hits = knn_join(queries, store, "inner_product", 5, block_rows=64)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"] + 0.0, 6)))
    every = _brute(rows, "inner_product", 5, True)
    assert got == {q: v for q, v in every.items() if q % 10 == 0}
    space = Space.of(store, "chunk_id", "inner_product", None)
    assert len(space.shared.value) == 28 and space.shared.value.shape[1] == 5
    placed = space.placed(store.select(F.col("chunk_id").alias("s"), "vector"), stored=True, label="cells")
    low = spark.createDataFrame([(q, v[-1][1]) for q, v in got.items()], "q bigint, low double")
    asked = queries.select(F.col("query_id").alias("q"), "vector", F.lit(None).cast("int").alias("cell")).join(low, "q")
    sizes = placed.groupBy("cell").count()
    scored = space.visits(asked, placed, F.col("low")).join(sizes, "cell").agg(F.sum("count")).first()[0]
    assert scored < 0.7 * 80 * 800
