"""The searches among the given vectors ask for all of them."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import checks
from checks.compare import differences
from passagemill.functions import vectors as vec
from passagemill.operators.search import search
from passagemill.session import recorded

checks.load_all()

SEARCHES = ["knn_graph", "search_inner_product", "search_euclidean", "search_threshold_ranges", "search_inner_product_cells"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors of which no id is divisible by 100."""
    root = str(tmp_path_factory.mktemp("vectors"))
    m = np.random.default_rng(8).normal(size=(90, 5))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i + 1, [float(x) for x in v], i % 3) for i, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.mark.parametrize("name", SEARCHES)
def test_every_vector_asks(spark, folder, name):
    assert "vec_id %" not in checks.ORACLES[name]
    asked = {r[0] for r in checks.QUERIES[name](spark, folder).select("query_id").distinct().collect()}
    assert asked == set(range(1, 91))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    assert differences(spark, db, name, folder) is None


@pytest.mark.parametrize("metric", vec.METRICS)
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_many_queries_write_no_pairs(spark, metric, kind):
    """Nothing prunes random vectors; the shared folder still holds no more rows than both sides have, beside the result."""
    m = np.random.default_rng(6).normal(size=(700, 16))
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"n{i}")
    store = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(m)], f"chunk_id {kind}, vector array<double>")
    queries = store.withColumnRenamed("chunk_id", "query_id")
    with recorded() as paths:
        hits = search(queries, store, metric=metric, k=6, exclude_same_id=True, strategy="partitioned")
        got = sorted((r.query_id, r["rank"], r.chunk_id) for r in hits.collect())
    written = {p: spark.read.parquet(p).count() for p in paths if "cell-blocks" not in p}
    assert max(written.values()) <= 7 * 700
    assert got == sorted((r.query_id, r["rank"], r.chunk_id) for r in search(queries, store, metric=metric, k=6, exclude_same_id=True).collect())
    scores = vec.score_block(metric, m, m)
    np.fill_diagonal(scores, -np.inf)
    want = [(name(i), k + 1, name(int(j))) for i in range(700) for k, j in enumerate(np.argsort(-scores[i], kind="stable")[:6])]
    assert got == sorted(want)


def test_broadcast_leaves_out_equal_ids_that_repeat(spark):
    rows = [(i % 20, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(60, 3)))]
    store = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>").repartition(3)
    hits = search(store.withColumnRenamed("chunk_id", "query_id").filter("query_id < 5"), store, k=50, exclude_same_id=True)
    assert hits.filter("query_id = chunk_id").count() == 0 and hits.count() > 0
