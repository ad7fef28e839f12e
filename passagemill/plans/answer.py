"""Tables of questions to prompts, and answers back to sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill import options as opt
from passagemill.functions import text as tx
from passagemill.operators import context as ctx
from passagemill.operators.embedding import embed_hashed
from passagemill.operators.rerank import PairScorer, rerank, rerank_or_initial
from passagemill.operators.search import hydrate_hits, search
from passagemill.session import materialize

Embed = Callable[[DataFrame, str], DataFrame]


def _hashed(df: DataFrame, text_col: str) -> DataFrame:
    return embed_hashed(df, text_col)


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    embed: Embed = _hashed,
    metric: str = "cosine",
    k: int = opt.SEARCH_K,
    threshold: float | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Hits with text and metadata for ``queries(query_id, query)``.

    Hits are written once: they are few, and both their size and their ids are
    needed to read the rest from the store without shuffling it.
    """
    opt.check_search(k, threshold)
    asked = embed(queries, "query")
    hits = materialize(search(asked, chunks, metric=metric, k=k, threshold=threshold), "hits")
    details = chunks.select(*(keep or [c for c in chunks.columns if c != "vector"]))
    return hydrate_hits(hits, details, row_bound=hits.count())


def rag_batch(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    embed: Embed = _hashed,
    metric: str = "cosine",
    k: int = opt.SEARCH_K,
    threshold: float | None = None,
    reranker: str | PairScorer | None = None,
    top_n: int = opt.RERANK_TOP_N,
    max_tokens: int = opt.MAX_CONTEXT_TOKENS,
    template: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(prompts, citations)``: a context, its messages and its sources per query."""
    hits = retrieve(queries, chunks, embed=embed, metric=metric, k=k, threshold=threshold)
    if reranker is not None:
        better = rerank(hits, queries, chunks, scorer=reranker, top_n=top_n)
        hits = rerank_or_initial(better, hits)
    contexts, citations = ctx.pack_context(hits, max_tokens)
    return ctx.with_messages(contexts, queries, template), citations


def chat_requests(
    prompts: DataFrame,
    model: str,
    *,
    max_tokens: int = opt.LLM_MAX_TOKENS,
    temperature: float = opt.LLM_TEMPERATURE,
) -> DataFrame:
    """Request bodies for offline batch inference."""
    body = tx.chat_request_json(F.col("messages"), model, max_tokens, temperature)
    return prompts.select("query_id", body.alias("request"))


def parse_answers(responses: DataFrame) -> DataFrame:
    """``(query_id, response)`` to ``(query_id, answer)``."""
    return responses.select("query_id", tx.parse_chat_response(F.col("response")).alias("answer"))


def explore_batch(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    embed: Embed = _hashed,
    k: int = opt.SEARCH_K,
    m: int = opt.EXPLORE_CHUNKS,
    reranker: str | PairScorer | None = "bm25",
    template: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(prompts, selected)`` for an overview of what the store says on a query."""
    fetch = ctx.explore_fetch_size(k, m, reranker is not None)
    hits = retrieve(queries, chunks, embed=embed, k=fetch)
    better = None
    if reranker is not None:
        better = rerank(hits, queries, chunks, scorer=reranker, top_n=m)
    selected = ctx.select_explore_chunks(hits, m, better)
    contexts = ctx.explore_context(selected)
    prompts = ctx.with_messages(contexts, queries, template or opt.EXPLORE_PROMPT, opt.EXPLORE_USER)
    return prompts, selected
