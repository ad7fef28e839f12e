from __future__ import annotations

import pytest

from passagemill.operators.rerank import rerank, rerank_or_initial


@pytest.fixture
def hits(spark):
    rows = [(1, i, f"c{i}", t) for i, t in enumerate(["a", "bbb", "cc", "dddd"], 1)] + [(2, 1, "c1", "a"), (2, 2, "c9", None)]
    return spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, text string").coalesce(1)


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, "q"), (2, "")], "query_id int, query string")


def test_model_order_and_ties(hits, queries):
    got = rerank(hits, queries, scorer=lambda q, t: [min(len(x), 3) for x in t], top_n=3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["initial_rank"]) for r in got] == [("c2", 2), ("c4", 4), ("c3", 3)]


def test_failed_batches_score_zero(hits, queries):
    def scorer(q, t):
        if "cc" in t:
            raise RuntimeError("batch failed")
        return [1.0] * len(t)

    got = {r["chunk_id"]: r["rerank_score"] for r in rerank(hits, queries, scorer=scorer, top_n=9, batch=1).collect()}
    assert got == {"c1": 1.0, "c2": 1.0, "c3": 0.0, "c4": 1.0}


def test_queries_without_reranked_hits_keep_theirs(hits, queries):
    better = rerank(hits, queries, scorer=lambda q, t: [0.0] * len(t), top_n=1)
    both = rerank_or_initial(better, hits)
    assert sorted((r["query_id"], r["chunk_id"]) for r in both.collect()) == [(1, "c1"), (2, "c1"), (2, "c9")]


def test_top_n_range(hits, queries):
    with pytest.raises(ValueError):
        rerank(hits, queries, scorer=lambda q, t: [0.0], top_n=51)
