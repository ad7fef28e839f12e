"""Packed contexts with numbered sources, prompts, and citations in answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill import options as opt
from passagemill import schemas
from passagemill.functions import text as tx
from passagemill.operators.search import BROADCAST_RESULTS

NO_SOURCES = "No sources were cited in the LLM context."
LEGEND_HEAD = "\n--- Sources Referenced in LLM Context ---"


def by_rank():
    return Window.partitionBy("query_id").orderBy("rank")


def packed_hits(
    hits: DataFrame,
    max_tokens: int = opt.MAX_CONTEXT_TOKENS,
    counter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Hits that fit the budget, with ``tag_id`` and the tagged ``block``.

    Blank hits take no tag. The first hit over the budget ends the context; a
    running sum says the same, since counts are not negative.
    """
    usable = hits.filter(~tx.is_blank(F.col("text")))
    tagged = usable.withColumn("tag_id", F.row_number().over(by_rank()))
    if counter is None:
        # A tag is two words and a text at least one, so later hits cannot fit.
        # This lets Spark cut long hit lists before the shuffle.
        tagged = tagged.filter(F.col("tag_id") <= max_tokens // 3 + 1)
    block = tagged.withColumn("block", tx.source_block(F.col("tag_id"), F.col("text")))
    counted = block.withColumn("block_tokens", tx.count_tokens(F.col("block"), counter))
    running = by_rank().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("total_tokens", F.sum("block_tokens").over(running)).filter(
        F.col("total_tokens") <= max_tokens
    )


def contexts_of(packed: DataFrame) -> DataFrame:
    """One context per query: its blocks in tag order, stripped at the ends."""
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("tag_id", "block"))), lambda b: b["block"]), ""
    )
    return packed.groupBy("query_id").agg(
        F.regexp_replace(joined, rf"^{tx.SPACE}+|{tx.SPACE}+$", "").alias("context"),
        F.max("total_tokens").alias("context_tokens"),
        F.count(F.lit(1)).alias("sources"),
    )


def citations_of(packed: DataFrame) -> DataFrame:
    """One citation per packed hit."""
    return packed.select(
        "query_id",
        "tag_id",
        display_name(packed, F.col("tag_id") - 1).alias("display_source_name"),
        "chunk_id",
        tx.text_preview(F.col("text")).alias("text_preview"),
        F.col("text").alias("text_from_search_result"),
    )


def display_name(df: DataFrame, order: Column) -> Column:
    """The stored display name, else one made from the metadata."""
    fields = {k: v for k, v in schemas.LOCATION_FIELDS.items() if k != "epub_item_id"}
    made = tx.display_source_name(
        schemas.optional(df, "source_file"),
        **{k: schemas.optional(df, k, v) for k, v in fields.items()},
        chunk_order=order,
    )
    return F.coalesce(schemas.optional(df, "display_source_name"), made)


def pack_context(
    hits: DataFrame,
    max_tokens: int = opt.MAX_CONTEXT_TOKENS,
    counter: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(contexts, citations)`` of ranked hits."""
    packed = packed_hits(hits, max_tokens, counter)
    return contexts_of(packed), citations_of(packed)


def with_messages(
    contexts: DataFrame, queries: DataFrame, template: str | None = None, user: str | None = None
) -> DataFrame:
    """Contexts with their query and the chat messages."""
    joined = contexts.join(queries.select("query_id", "query"), "query_id")
    query = F.col("query")
    said = None if user is None else tx.fill_template(user, {"query": query})
    return joined.withColumn(
        "messages", tx.build_messages(query, F.col("context"), template or opt.RAG_PROMPT, said)
    )


def answer_tags(answers: DataFrame) -> DataFrame:
    """One row per distinct tag an answer ``(query_id, answer)`` cites."""
    return answers.select("query_id", F.explode(tx.cited_tags(F.col("answer"))).alias("tag_id"))


def resolve_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """The source behind each cited tag; ``is_dangling`` where there is none."""
    known = citations.withColumn("__known", F.lit(True))
    joined = answer_tags(answers).join(known, ["query_id", "tag_id"], "left")
    return joined.withColumn("is_dangling", F.col("__known").isNull()).drop("__known")


def cited_full_text(
    resolved: DataFrame, chunks: DataFrame, shown: int = 500, *, row_bound: int | None = None
) -> DataFrame:
    """Text of a cited source: from its hit, else from the store.

    With a small enough ``row_bound`` on the citations the ids that lack a text
    go to the chunk scan, and the store is not shuffled.
    """
    lacking = resolved.filter(F.col("text_from_search_result").isNull() & F.col("chunk_id").isNotNull())
    wanted = lacking.select("chunk_id").distinct()
    if row_bound is not None and row_bound <= BROADCAST_RESULTS:
        wanted = F.broadcast(wanted)
    stored = chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", F.col("text").alias("__stored"))
    joined = resolved.join(stored, "chunk_id", "left")
    full = F.coalesce("text_from_search_result", "__stored", "text_preview")
    return joined.withColumn("full_text", full).withColumn(
        "shown_text", tx.clip(F.col("full_text"), shown)
    ).drop("__stored")


def citation_legend(queries: DataFrame, citations: DataFrame) -> DataFrame:
    """The sources of each query's context as lines in tag order."""
    line = F.concat(F.lit("["), F.col("tag_id").cast("string"), F.lit("] "), F.col("display_source_name"))
    lines = citations.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("tag_id", line.alias("line")))).alias("__lines")
    )
    text = F.concat(
        F.lit(LEGEND_HEAD + "\n"), F.array_join(F.transform("__lines", lambda x: x["line"]), "\n")
    )
    return queries.select("query_id").join(lines, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit(NO_SOURCES)).alias("legend")
    )


# -- explore mode ----------------------------------------------------------


def explore_fetch_size(k: int = opt.SEARCH_K, m: int = opt.EXPLORE_CHUNKS, reranking: bool = True) -> int:
    """Hits to fetch first: twice the summary size when reranking follows."""
    return max(k, 2 * m) if reranking else k


def select_explore_chunks(hits: DataFrame, m: int = opt.EXPLORE_CHUNKS, reranked: DataFrame | None = None) -> DataFrame:
    """The reranked hits where a query has any, else its first ``m``."""
    first = hits.filter(F.col("rank") <= m)
    if reranked is None:
        return first
    chosen = reranked.filter(F.col("rank") <= m)
    rest = first.join(chosen.select("query_id").distinct(), "query_id", "left_anti")
    return chosen.unionByName(rest, allowMissingColumns=True)


def explore_blocks(selected: DataFrame) -> DataFrame:
    """Numbered blocks; a blank hit is left out but keeps its number."""
    numbered = selected.withColumn("number", F.row_number().over(by_rank()))
    filled = numbered.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    name = display_name(selected, F.col("number") - 1)
    block = F.concat(
        F.lit("[Source "), F.col("number").cast("string"), F.lit(": "), name, F.lit("]\n"), F.col("text")
    )
    return filled.withColumn("display_source_name", name).withColumn("block", block).withColumn(
        "text_preview", tx.text_preview(F.col("text"), always_dots=True)
    )


def explore_context(selected: DataFrame) -> DataFrame:
    """One exploration context per query, blocks set apart by a rule."""
    blocks = F.array_sort(F.collect_list(F.struct("number", "block")))
    return (
        explore_blocks(selected)
        .groupBy("query_id")
        .agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n---\n\n").alias("context"))
    )
