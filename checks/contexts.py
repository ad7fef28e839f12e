"""Packed contexts, citations, exploration and whole question batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.frames import questions, rich_hits, store, token_chunks, written_store
from checks.searching import BM25
from checks.twins import tokens, twin
from passagemill.operators import context as ctx
from passagemill.operators.rerank import rerank
from passagemill.plans.answer import chat_requests, explore_batch, rag_batch

_CONTEXT = """
contexts AS (
  SELECT query_id, trim(string_agg(block, '' ORDER BY tag_id), ' ' || chr(10)) AS context,
         max(total_tokens)::BIGINT AS context_tokens, count(*) AS sources FROM packed GROUP BY query_id)"""
_PREVIEW = "CASE WHEN len(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS text_preview"
_LEGEND_HEAD = "chr(10) || '--- Sources Referenced in LLM Context ---' || chr(10)"


@check("pack_context", twin("SELECT query_id, context, context_tokens, sources FROM contexts", _CONTEXT))
def pack(spark, d):
    return ctx.pack_context(rich_hits(spark, d))[0]


# Hits of which every fourth is blank, under a small budget: blanks take no
# tag, and the first overflow ends the context.
_TIGHT = f"""
blanked AS (
  SELECT query_id, rank, chunk_id, display_source_name, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS tag_id
  FROM rich_hits WHERE rank % 4 <> 1),
tight AS (
  SELECT * FROM (SELECT *, sum({tokens('text')} + 2) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM blanked)
  WHERE total <= 700)"""


def _tight(spark, d):
    hits = rich_hits(spark, d)
    return hits.withColumn("text", F.when(F.col("rank") % 4 == 1, F.lit(" ")).otherwise(F.col("text")))


@check(
    "context_citations",
    twin(f"SELECT query_id, tag_id::INTEGER AS tag_id, display_source_name, chunk_id, {_PREVIEW} FROM tight", _TIGHT),
)
def citations(spark, d):
    _, cited = ctx.pack_context(_tight(spark, d), 700)
    return cited.drop("text_from_search_result")


# Answers made from the questions: two tags that may exist and one that does not.
_ANSWERS = """
tags AS (
  SELECT DISTINCT query_id, unnest([query_id % 5 + 1, query_id % 3 + 1, 99]) AS tag_id FROM query_ids)"""


def _answers(spark, d):
    n = F.col("query_id")
    tag = lambda v: F.concat(F.lit("[Source "), v.cast("string"), F.lit("]"))
    text = F.concat(F.col("query"), tag(n % 5 + 1), F.lit(" and "), tag(n % 3 + 1), F.lit("."), tag(F.lit(99)))
    return questions(spark, d).select("query_id", text.alias("answer"))


@check(
    "resolve_citations",
    twin(
        """SELECT query_id, tag_id, chunk_id, display_source_name, chunk_id IS NULL AS is_dangling
           FROM tags LEFT JOIN tight USING (query_id, tag_id)""",
        _TIGHT,
        _ANSWERS,
    ),
)
def resolve(spark, d):
    _, cited = ctx.pack_context(_tight(spark, d), 700)
    return ctx.resolve_citations(_answers(spark, d), cited).select(
        "query_id", "tag_id", "chunk_id", "display_source_name", "is_dangling"
    )


@check(
    "cited_full_text",
    twin(
        """SELECT query_id, tag_id, c.text AS full_text,
             CASE WHEN len(c.text) > 500 THEN substr(c.text, 1, 500) || '...' ELSE c.text END AS shown_text
           FROM tags LEFT JOIN tight t USING (query_id, tag_id) LEFT JOIN chunks c USING (chunk_id)""",
        _TIGHT,
        _ANSWERS,
    ),
)
def full_text(spark, d):
    _, cited = ctx.pack_context(_tight(spark, d), 700)
    # Every second citation comes without its text, which the store then has to give.
    lost = cited.withColumn(
        "text_from_search_result", F.when(F.col("tag_id") % 2 == 0, F.col("text_from_search_result"))
    )
    resolved = ctx.resolve_citations(_answers(spark, d), lost)
    return ctx.cited_full_text(resolved, token_chunks(spark, d)).select("query_id", "tag_id", "full_text", "shown_text")


@check(
    "citation_legend",
    twin(
        f"""SELECT query_id, coalesce({_LEGEND_HEAD} || string_agg('[' || tag_id || '] ' || display_source_name, chr(10) ORDER BY tag_id),
             'No sources were cited in the LLM context.') AS legend
            FROM query_ids LEFT JOIN (SELECT * FROM tight WHERE query_id % 3 <> 0) t USING (query_id) GROUP BY query_id""",
        _TIGHT,
    ),
)
def legend(spark, d):
    _, cited = ctx.pack_context(_tight(spark, d), 700)
    return ctx.citation_legend(questions(spark, d), cited.filter(F.col("query_id") % 3 != 0))


@check(
    "select_explore_chunks",
    twin(
        """SELECT query_id, rank::INTEGER AS rank, chunk_id FROM reranked WHERE query_id % 2 = 0
           UNION ALL SELECT query_id, rank::INTEGER, chunk_id FROM rich_hits WHERE query_id % 2 = 1 AND rank <= 7""",
        BM25,
    ),
)
def select_explore(spark, d):
    stored = written_store(spark, d)
    hits = rich_hits(spark, d, stored)
    better = rerank(hits, questions(spark, d).filter(F.col("query_id") % 2 == 0), stored)
    return ctx.select_explore_chunks(hits, 7, better).select("query_id", "rank", "chunk_id")


@check(
    "explore_context",
    twin(
        """SELECT query_id, string_agg('[Source ' || rank || ': ' || display_source_name || ']' || chr(10) || text,
             chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
           FROM rich_hits WHERE rank <= 7 AND rank <> 3 GROUP BY query_id"""
    ),
)
def explore(spark, d):
    hits = rich_hits(spark, d)
    blank = hits.withColumn("text", F.when(F.col("rank") != 3, F.col("text")).otherwise(F.lit("")))
    return ctx.explore_context(ctx.select_explore_chunks(blank))


@check(
    "explore_batch",
    twin(
        """SELECT query_id, count(*) AS sources, string_agg(chunk_id, ',' ORDER BY rank) AS chosen FROM reranked GROUP BY query_id""",
        BM25,
    ),
)
def explore_all(spark, d):
    prompts, selected = explore_batch(questions(spark, d), written_store(spark, d))
    chosen = selected.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ","
        ).alias("chosen"),
    )
    return prompts.select("query_id").join(chosen, "query_id")


_PROMPT_TAIL = "context || chr(10) || '---' || chr(10)"


@check(
    "rag_batch",
    twin(
        f"""SELECT query_id, query, context, sources, {_PROMPT_TAIL} AS prompt_end FROM contexts JOIN query_ids USING (query_id)""",
        _CONTEXT,
    ),
)
def rag(spark, d):
    prompts, _ = rag_batch(questions(spark, d), written_store(spark, d))
    system = F.get("messages", F.lit(0))["content"]
    cut = F.length(F.substring_index(system, "Context:\n---\n", 1)) + F.length(F.lit("Context:\n---\n")) + 1
    return prompts.select("query_id", "query", "context", "sources", F.substring(system, cut, F.length(system)).alias("prompt_end"))


@check("rag_requests")
def rag_requests(spark, d):
    """Reranked contexts as request bodies."""
    prompts, _ = rag_batch(questions(spark, d), written_store(spark, d), reranker="bm25")
    return chat_requests(prompts, "model")


def flagship(spark, d):
    """Cut and embed all documents, answer every benchmark question with a packed context."""
    prompts, _ = rag_batch(questions(spark, d), store(spark, d))
    return prompts.select("query_id", "query", "context", "context_tokens", "sources")
