"""Second scoring of hits: BM25 from the store's own statistics, or a caller's model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import options as opt
from passagemill.functions.text import terms
from passagemill.functions.vectors import SCORE_DECIMALS

K1, B = 1.2, 0.75
# Distinct query terms that may be sent to every task of the statistics scan.
BROADCAST_TERMS = 500_000

PairScorer = Callable[[list[str], list[str]], list[float]]


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits that can be reranked: with an id and a text (which may be empty)."""
    return hits.filter(F.col("chunk_id").isNotNull() & (F.col("chunk_id") != "") & F.col("text").isNotNull())


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def term_statistics(chunks: DataFrame, wanted: DataFrame, total: int) -> DataFrame:
    """``(term, idf)`` of the wanted terms over all ``total`` chunks."""
    vocabulary = wanted.select("term").distinct()
    if vocabulary.count() <= BROADCAST_TERMS:
        vocabulary = F.broadcast(vocabulary)
    # Once per chunk and term; only wanted terms reach the shuffle.
    seen = chunks.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counts = seen.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("term", F.ln(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_scores(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``rerank_score`` to hits ``(query_id, chunk_id, text, ...)``."""
    wanted = query_terms(queries)
    size = chunks.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(terms(F.col("text")))), F.lit(1.0)).alias("mean")
    ).first()
    idf = term_statistics(chunks, wanted, size["n"])
    average = F.lit(max(size["mean"], 1e-9))
    words = hits.select("query_id", "chunk_id", terms(F.col("text")).alias("__terms"))
    counted = (
        words.select("query_id", "chunk_id", F.size("__terms").alias("__length"), F.explode("__terms").alias("term"))
        .groupBy("query_id", "chunk_id", "__length", "term")
        .agg(F.count(F.lit(1)).alias("__tf"))
        .join(wanted, ["query_id", "term"])
        .join(idf, "term")
    )
    tf = F.col("__tf")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__length") / average))
    scores = counted.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(weight), SCORE_DECIMALS).alias("rerank_score")
    )
    joined = hits.join(scores, ["query_id", "chunk_id"], "left")
    return joined.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def model_scores(hits: DataFrame, queries: DataFrame, scorer: PairScorer, batch: int = opt.RERANK_BATCH) -> DataFrame:
    """Adds a caller's pair scores; a batch that fails scores 0."""

    @F.pandas_udf(T.DoubleType())
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        out: list[float] = []
        for at in range(0, len(query), batch):
            q, t = query.iloc[at : at + batch].tolist(), text.iloc[at : at + batch].tolist()
            try:
                got = [float(x) for x in scorer(q, t)]
            except Exception:  # noqa: BLE001 - the batch is kept with a low score
                got = []
            out.extend((got + [0.0] * len(q))[: len(q)])
        return pd.Series(out)

    named = hits.join(queries.select("query_id", F.col("query").alias("__query")), "query_id")
    return named.withColumn("rerank_score", score("__query", "text")).drop("__query")


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    chunks: DataFrame | None = None,
    *,
    scorer: str | PairScorer = "bm25",
    top_n: int = opt.RERANK_TOP_N,
    batch: int = opt.RERANK_BATCH,
) -> DataFrame:
    """Best ``top_n`` hits per query by the new score; equal scores keep their order.

    Text and metadata stay on the row, ``rank`` is the new place and
    ``initial_rank`` the old one. Queries without text give nothing.
    """
    opt.check_top_n(top_n)
    asked = queries.filter(F.coalesce(F.col("query"), F.lit("")) != "")
    usable = usable_hits(hits).join(asked.select("query_id"), "query_id", "left_semi")
    if scorer == "bm25":
        if chunks is None:
            raise ValueError("bm25 needs the chunks its statistics come from")
        scored = bm25_scores(usable, asked, chunks)
    else:
        scored = model_scores(usable, asked, scorer, batch)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    return (
        scored.withColumn("__new", F.row_number().over(order))
        .filter(F.col("__new") <= top_n)
        .withColumnsRenamed({"rank": "initial_rank", "__new": "rank"})
    )


def rerank_or_initial(reranked: DataFrame, hits: DataFrame) -> DataFrame:
    """Reranked hits; queries that have none keep their initial hits."""
    rest = hits.join(reranked.select("query_id").distinct(), "query_id", "left_anti")
    return reranked.unionByName(rest, allowMissingColumns=True)
