"""Search, hydration and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.frames import (
    found,
    points,
    question_vectors,
    questions,
    rich_hits,
    written_store,
)
from checks.twins import terms, topk, twin
from passagemill.operators.rerank import rerank, rerank_or_initial, usable_hits
from passagemill.operators.search import get_chunks, hydrate_hits, knn_graph, search

_HITS = "SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM {}"


def _shown(hits):
    return hits.select("query_id", "rank", "chunk_id", "score")


@check("search_topk", twin(_HITS.format("top"), f"top AS ({topk('scores', 5)})"))
def search_topk(spark, d):
    return _shown(found(spark, d, k=5))


@check(
    "search_threshold",
    twin(
        """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank,
             chunk_id, score FROM scores WHERE score >= 0.6"""
    ),
)
def search_threshold(spark, d):
    return _shown(found(spark, d, threshold=0.6))


@check("search_batch", twin(_HITS.format("hits")))
def search_batch(spark, d):
    return _shown(found(spark, d))


# Searches among the given vectors ask for every vector, against all others.
_PAIRS = """
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


def _queries(store):
    return store.select(F.col("chunk_id").alias("query_id"), "vector")


@check(
    "knn_graph",
    twin(
        _HITS.format("top"),
        _PAIRS,
        "cosines AS (SELECT query_id, chunk_id, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 9) AS score FROM pairs)",
        f"top AS ({topk('cosines', 15)})",
    ),
)
def knn_neighbours(spark, d):
    return _shown(knn_graph(points(spark, d)))


@check(
    "search_inner_product",
    twin(
        _HITS.format("top"), _PAIRS,
        "dots AS (SELECT query_id, chunk_id, round(list_dot_product(x, y), 9) AS score FROM pairs)",
        f"top AS ({topk('dots', 10)})",
    ),
)
def search_inner_product(spark, d):
    return _shown(knn_graph(points(spark, d), k=10, metric="inner_product"))


@check(
    "search_euclidean",
    twin(
        _HITS.format("top"), _PAIRS,
        "gaps AS (SELECT query_id, chunk_id, round(-list_distance(x, y), 9) AS score FROM pairs)",
        f"top AS ({topk('gaps', 10)})",
    ),
)
def search_euclidean(spark, d):
    """The way for two large sides."""
    store = points(spark, d)
    return _shown(
        search(_queries(store), store, metric="euclidean", k=10, exclude_same_id=True, strategy="partitioned")
    )


_RANKED = """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank,
               chunk_id, score FROM ({})"""


@check(
    "search_threshold_ranges",
    twin(_RANKED.format("SELECT * FROM gaps WHERE score >= -1.2"), _PAIRS,
         "gaps AS (SELECT query_id, chunk_id, round(-list_distance(x, y), 9) AS score FROM pairs)"),
)
def search_threshold_ranges(spark, d):
    """A threshold over two large sides: only cells that come near enough are met."""
    store = points(spark, d)
    return _shown(search(_queries(store), store, metric="euclidean", threshold=-1.2, exclude_same_id=True, strategy="partitioned"))


@check(
    "search_inner_product_cells",
    twin(
        _HITS.format("top"), _PAIRS,
        "dots AS (SELECT query_id, chunk_id, round(list_dot_product(x, y), 9) AS score FROM pairs)",
        f"top AS ({topk('dots', 10)})",
    ),
)
def search_inner_product_cells(spark, d):
    """Inner products over two large sides, as distances with one more coordinate."""
    store = points(spark, d)
    return _shown(search(_queries(store), store, metric="inner_product", k=10, exclude_same_id=True, strategy="partitioned"))


@check(
    "hydrate_hits",
    twin(
        """SELECT h.query_id, h.rank::INTEGER AS rank, h.chunk_id, c.text, c.source_file, c.chunk_id IS NULL AS missing
           FROM hits h LEFT JOIN (SELECT * FROM chunks WHERE chunk_order % 2 = 0) c USING (chunk_id)"""
    ),
)
def hydrate(spark, d):
    stored = written_store(spark, d)
    hits = search(question_vectors(spark, d), stored)
    # Half of the store has lost its texts.
    known = stored.filter(F.col("chunk_order") % 2 == 0).select("chunk_id", "text", "source_file")
    return hydrate_hits(hits, known, row_bound=30 * questions(spark, d).count()).select(
        "query_id", "rank", "chunk_id", "text", "source_file", F.col("hydration_error").isNotNull().alias("missing")
    )


@check(
    "get_chunk",
    twin(
        """SELECT q.chunk_id, c.text, c.chunk_id IS NOT NULL AS found, true AS consistent FROM (
             SELECT DISTINCT chunk_id FROM hits UNION SELECT 'no_such_' || item_id FROM benchmark) q
           LEFT JOIN chunks c USING (chunk_id)"""
    ),
)
def get_many_chunks(spark, d):
    stored = written_store(spark, d)
    wanted = search(question_vectors(spark, d), stored).select("chunk_id")
    unknown = questions(spark, d).select(F.concat(F.lit("no_such_"), "query_id").alias("chunk_id"))
    return get_chunks(stored, wanted.unionByName(unknown)).select("chunk_id", "text", "found", "consistent")


# BM25 with statistics over all chunks.
BM25 = f"""
chunk_terms AS (SELECT chunk_id, unnest({terms('text')}) AS term FROM chunks),
term_counts AS (SELECT chunk_id, term, count(*) AS tf FROM chunk_terms GROUP BY ALL),
lengths AS (SELECT chunk_id, len({terms('text')}) AS dl FROM chunks),
idf AS (
  SELECT term, ln(1 + ((SELECT count(*) FROM chunks) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM term_counts GROUP BY term),
wanted AS (SELECT DISTINCT query_id, unnest({terms('query')}) AS term FROM query_ids),
bm25 AS (
  SELECT h.query_id, h.chunk_id, h.rank AS initial_rank, h.text, h.source_file, h.display_source_name,
         round(coalesce(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lengths)))), 0), 9) AS score
  FROM rich_hits h LEFT JOIN wanted w USING (query_id)
  LEFT JOIN term_counts tc ON tc.chunk_id = h.chunk_id AND tc.term = w.term
  LEFT JOIN idf ON idf.term = tc.term
  LEFT JOIN lengths l ON l.chunk_id = h.chunk_id
  GROUP BY ALL),
reranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, initial_rank) AS rank FROM bm25)
  WHERE rank <= 7)"""


@check(
    "rerank",
    twin(
        """SELECT query_id, rank::INTEGER AS rank, initial_rank::INTEGER AS initial_rank, chunk_id, score
           FROM reranked""",
        BM25,
    ),
)
def rerank_bm25(spark, d):
    stored = written_store(spark, d)
    better = rerank(rich_hits(spark, d, stored), questions(spark, d), stored)
    return better.select("query_id", "rank", "initial_rank", "chunk_id", F.col("rerank_score").alias("score"))


@check(
    "rerank_with_model",
    twin(
        """SELECT query_id, chunk_id, rank::INTEGER AS rank FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(text) DESC, initial_rank) AS rank
             FROM (SELECT *, rank AS initial_rank FROM rich_hits) t(query_id, r0, chunk_id, score, text, sf, dn, initial_rank))
           WHERE rank <= 7"""
    ),
)
def rerank_with_model(spark, d):
    scorer = lambda queries, texts: [float(len(t)) for t in texts]
    better = rerank(rich_hits(spark, d), questions(spark, d), scorer=scorer)
    return better.select("query_id", "chunk_id", "rank")


@check(
    "rerank_hydrate",
    twin(
        """SELECT query_id, chunk_id, text, source_file FROM rich_hits
           WHERE rank % 3 <> 0 AND rank % 5 <> 0"""
    ),
)
def rerank_hydrate(spark, d):
    rank = F.col("rank")
    broken = (
        rich_hits(spark, d)
        .withColumn("chunk_id", F.when(rank % 3 != 0, F.col("chunk_id")).otherwise(F.lit("")))
        .withColumn("text", F.when(rank % 5 != 0, F.col("text")))
    )
    return usable_hits(broken).select("query_id", "chunk_id", "text", "source_file")


@check(
    "rerank_or_initial",
    twin(
        """SELECT query_id, rank::INTEGER AS rank, chunk_id FROM reranked WHERE query_id % 2 = 0
           UNION ALL SELECT query_id, rank::INTEGER, chunk_id FROM rich_hits WHERE query_id % 2 = 1""",
        BM25,
    ),
)
def rerank_fallback(spark, d):
    stored = written_store(spark, d)
    hits = rich_hits(spark, d, stored)
    asked = questions(spark, d)
    silent = asked.withColumn("query", F.when(F.col("query_id") % 2 == 0, F.col("query")).otherwise(F.lit("")))
    better = rerank(hits, silent, stored)
    return rerank_or_initial(better, hits).select("query_id", "rank", "chunk_id")
