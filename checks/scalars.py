"""Scalar functions over the text and table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.frames import found, document_parts, table, token_chunks
from checks.twins import clean, sanitize, tokens, twin
from passagemill import options as opt
from passagemill.functions import text as tx
from passagemill.operators.chunking import FAILURE, PIECES, chunk_documents, enrich, with_fallback
from passagemill.sources.documents import drop_blank_parts, parts_from_table, table_row_parts
from passagemill.sources.structured import json_leaves

NEWLINE = "chr(10)"


@check("clean_text", f"SELECT doc_id, {clean('text')} AS text FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@check("sanitize_id", f"SELECT page_id, {sanitize('url')} AS id FROM pages")
def sanitize_id(spark, d):
    return table(spark, d, "pages").select("page_id", tx.sanitize_id(F.col("url")).alias("id"))


_turn = "row_number() OVER (PARTITION BY conv_id ORDER BY turn)"


@check(
    "doc_part_id",
    f"""SELECT part_id, source_file FROM (
      SELECT trim(regexp_replace('conv_' || conv_id || '.jsonl_lin' || (turn + 1) || '_jso'
               || substr({sanitize("role || '.[' || turn || '].text value'")}, 1, 15), '_+', '_', 'g'), '_-.') AS part_id,
             'conv/' || conv_id || '.jsonl' AS source_file FROM conversations WHERE {clean('text')} <> ''
      UNION ALL
      SELECT 'notes_' || conv_id || '.txt' || CASE WHEN n > 1 THEN '_docpart' || turn ELSE '' END,
             'notes/' || conv_id || '.txt'
      FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE {clean('text')} <> '')""",
)
def doc_part_id(spark, d):
    talks = table(spark, d, "conversations")
    path = F.concat("role", F.lit(".["), F.col("turn").cast("string"), F.lit("].text value"))
    located = parts_from_table(
        talks,
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".jsonl")),
        F.col("text"),
        locations={"line_number": F.col("turn") + 1, "json_path": path},
        part_order=F.col("turn"),
    )
    plain = parts_from_table(
        talks,
        F.concat(F.lit("notes/"), F.col("conv_id").cast("string"), F.lit(".txt")),
        F.col("text"),
        part_order=F.col("turn"),
    )
    return located.unionByName(plain).select("part_id", "source_file")


@check("chunk_id", twin("SELECT part_id, chunk_order::INTEGER AS chunk_order, chunk_id FROM chunks"))
def chunk_id(spark, d):
    return token_chunks(spark, d).select("part_id", "chunk_order", "chunk_id")


@check(
    "display_source_name",
    """SELECT page_id, name || ' (' || concat_ws(', ', CASE WHEN page_id % 2 = 0 THEN 'P:' || page_id END,
         CASE WHEN page_id % 3 = 0 THEN 'Sht:' || substr(url, 1, 15) END, 'Row:' || (page_id + 1),
         CASE WHEN page_id % 5 = 0 THEN 'L:' || page_id END,
         'Path:' || CASE WHEN len(url) > 20 THEN '...' || right(url, 17) ELSE url END,
         'Epub:' || CASE WHEN len(url) > 20 THEN substr(url, 1, 17) || '...' ELSE url END,
         'Chk:' || (page_id + 1)) || ')' AS shown
       FROM (SELECT *, regexp_extract(url, '[^/]*$') AS name FROM pages)""",
)
def display_source_name(spark, d):
    n, url = F.col("page_id"), F.col("url")
    shown = tx.display_source_name(
        url,
        page_number=F.when(n % 2 == 0, n),
        sheet_name=F.when(n % 3 == 0, url),
        row_index=n,
        line_number=F.when(n % 5 == 0, n),
        json_path=url,
        epub_item_name=url,
        chunk_order=n,
    )
    return table(spark, d, "pages").select("page_id", shown.alias("shown"))


@check("count_tokens", f"SELECT doc_id, {tokens('text')}::INTEGER AS tokens FROM documents")
def count_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@check(
    "row_to_text",
    """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_index,
         concat_ws(' | ', 'p_partkey: ' || p_partkey, 'p_name: ' || p_name, 'p_brand: ' || p_brand,
           'p_type: ' || p_type, 'p_size: ' || p_size, 'p_retailprice: ' || p_retailprice) AS text FROM part""",
)
def row_to_text(spark, d):
    part = table(spark, d, "part")
    rows = table_row_parts(part, F.lit("part.parquet"), F.col("p_partkey"), part.columns)
    return rows.select("row_index", "text")


@check(
    "json_path_flatten",
    "SELECT event_id, 'k' AS json_path, json_extract_string(props, '$.k') AS text FROM events",
)
def json_path_flatten(spark, d):
    leaves = json_leaves(table(spark, d, "events").select("event_id", "props"), F.col("props"))
    return leaves.select("event_id", "json_path", tx.clean_text(F.col("raw_text")).alias("text"))


@check(
    "drop_blank_parts",
    f"SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || {NEWLINE} ELSE text END AS text FROM documents) "
    f"WHERE {clean('text')} <> ''",
)
def drop_blanks(spark, d):
    blanked = F.when(F.col("doc_id") % 3 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return drop_blank_parts(table(spark, d, "documents").select("doc_id", blanked.alias("text")))


@check(
    "text_preview",
    """SELECT doc_id, CASE WHEN len(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview,
         substr(text, 1, 150) || '...' AS explore_preview FROM documents""",
)
def text_preview(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        tx.text_preview(text).alias("preview"),
        tx.text_preview(text, always_dots=True).alias("explore_preview"),
    )


@check("snippet", "SELECT doc_id, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@check(
    "source_tag_format",
    f"SELECT doc_id, '[Source ' || (doc_id + 1) || ']' || {NEWLINE} || {NEWLINE} || text || {NEWLINE} || {NEWLINE} AS block FROM documents",
)
def source_tag_format(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.source_block(F.col("doc_id") + 1, F.col("text")).alias("block")
    )


_TEMPLATE = "Use {{only}} this.\n---\n{context}\n---\nQuestion: {query}\n"


@check(
    "build_messages",
    f"""SELECT doc_id, 'system' AS first_role, 'user' AS second_role, source AS user_text,
         'Use {{only}} this.' || {NEWLINE} || '---' || {NEWLINE} || text || {NEWLINE} || '---' || {NEWLINE}
           || 'Question: ' || source || {NEWLINE} AS system_text FROM documents""",
)
def build_messages(spark, d):
    messages = tx.build_messages(F.col("source"), F.col("text"), _TEMPLATE)
    return (
        table(spark, d, "documents")
        .select("doc_id", messages.alias("m"))
        .select(
            "doc_id",
            F.get("m", F.lit(0))["role"].alias("first_role"),
            F.get("m", F.lit(1))["role"].alias("second_role"),
            F.get("m", F.lit(1))["content"].alias("user_text"),
            F.get("m", F.lit(0))["content"].alias("system_text"),
        )
    )


@check(
    "chat_request_json",
    """SELECT conv_id, turn, 'm' AS model, role AS first_role, text AS content, 1536::BIGINT AS max_tokens,
         0.5::DOUBLE AS temperature, false AS stream FROM conversations""",
)
def chat_request_json(spark, d):
    messages = F.array(F.struct(F.col("role"), F.col("text").alias("content")))
    body = tx.chat_request_json(messages, "m", opt.LLM_MAX_TOKENS, opt.LLM_TEMPERATURE)
    sent = "model string, messages array<struct<role:string,content:string>>, max_tokens bigint, temperature double, stream boolean"
    return (
        table(spark, d, "conversations")
        .select("conv_id", "turn", F.from_json(body, sent).alias("r"))
        .select(
            "conv_id",
            "turn",
            "r.model",
            F.get("r.messages", F.lit(0))["role"].alias("first_role"),
            F.get("r.messages", F.lit(0))["content"].alias("content"),
            "r.max_tokens",
            "r.temperature",
            "r.stream",
        )
    )


@check(
    "parse_chat_response",
    f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 OR text = '' THEN NULL ELSE trim(text, ' ' || {NEWLINE}) END AS answer
        FROM conversations""",
)
def parse_chat_response(spark, d):
    padded = F.concat(F.lit(" "), F.col("text"), F.lit("\n"))
    said = F.struct(F.lit("assistant").alias("role"), padded.alias("content"))
    message = F.to_json(F.struct(F.array(F.struct(said.alias("message"))).alias("choices")))
    delta = F.to_json(F.struct(F.array(F.struct(said.alias("delta"))).alias("choices")))
    empty = F.to_json(F.struct(F.array().cast("array<string>").alias("choices")))
    body = F.when(F.col("turn") % 3 == 0, message).when(F.col("turn") % 3 == 1, delta).otherwise(empty)
    return table(spark, d, "conversations").select("conv_id", "turn", tx.parse_chat_response(body).alias("answer"))


@check(
    "extract_citation_tags",
    """SELECT doc_id, string_agg(n, ',' ORDER BY n::BIGINT) AS tags FROM (
         SELECT DISTINCT doc_id, unnest([(doc_id % 7)::VARCHAR, (doc_id % 3 + 10)::VARCHAR, '2']) AS n FROM documents)
       GROUP BY doc_id""",
)
def extract_citation_tags(spark, d):
    n = F.col("doc_id")
    answer = F.concat(
        F.col("text"), F.lit(" [Source "), (n % 3 + 10).cast("string"), F.lit("] and [SOURCE  "),
        (n % 7).cast("string"), F.lit("], see [source2] [Source x] [Source 2]."),
    )
    tags = F.transform(tx.cited_tags(answer), lambda t: t.cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@check(
    "chunk_fallback",
    twin(
        """SELECT part_id || CASE WHEN doc_id % 4 = 0 THEN '_chunk_0_full_content_fallback'
                                  WHEN doc_id % 4 = 1 THEN '_chunk_0_init_fail' ELSE '_chunk_0' END AS chunk_id,
             CASE WHEN doc_id % 4 = 3 THEN text ELSE substr(text, 1, 1280) END AS text,
             doc_id % 4 <> 3 AS has_error, doc_id % 4 = 0 AS has_notes FROM parts"""
    ),
)
def chunk_fallback(spark, d):
    parts = document_parts(spark, d)
    kind = F.regexp_extract("source_file", r"(\d+)\.txt$", 1).cast("int") % 4
    cut = parts.withColumn(
        PIECES,
        F.when(kind == 0, F.array(F.lit(" "))).when(kind == 3, F.array(F.lit(""), F.col("text"))),
    ).withColumn(FAILURE, F.when(kind == 1, F.lit("no_chunker")).when(kind == 2, F.lit("raised")))
    return enrich(with_fallback(cut, "token", start_only=True), "token").select(
        "chunk_id",
        "text",
        F.col("chunking_error").isNotNull().alias("has_error"),
        F.col("chunking_notes").isNotNull().alias("has_notes"),
    )


@check(
    "chunk_fallback_whole",
    twin(f"SELECT part_id, {tokens('text')} AS n_words, ({tokens('text')} + 255) // 256 AS n_chunks FROM parts"),
)
def chunk_fallback_whole(spark, d):
    """Without a boundary model every word of every part is kept, in windows."""
    chunks = chunk_documents(document_parts(spark, d), "boundary")
    return chunks.groupBy("part_id").agg(
        F.sum(tx.count_tokens(F.col("text"))).alias("n_words"), F.count(F.lit(1)).alias("n_chunks")
    )


@check(
    "similarity_metric",
    twin(
        """SELECT query_id, chunk_id, score, round(1 - score, 9) AS distance FROM scores
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5"""
    ),
)
def similarity_metric(spark, d):
    return found(spark, d, metric="cosine", k=5).select("query_id", "chunk_id", "score", "distance")
