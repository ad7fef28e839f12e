"""Building blocks of the SQL twins."""

from __future__ import annotations

# The white-space class of the engine, spelled out.
_SPACES = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[{_SPACES}]+', ' ', 'g'), '\x00', '', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{_SPACES}]+')"


def tokens(x: str) -> str:
    return f"len({words(x)})"


def terms(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def sanitize(x: str) -> str:
    kept = f"regexp_replace(regexp_replace({x}, '[^0-9a-zA-Z_.-]', '_', 'g'), '_+', '_', 'g')"
    return f"coalesce(nullif(trim({kept}, '_-.'), ''), 'unknown_file_component')"


def hash_of(t: str) -> str:
    return f"('0x' || substr(md5({t}), 1, 8))::BIGINT"


def html(x: str) -> str:
    return clean(
        r"replace(replace(replace(replace(regexp_replace(" + x + r", '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>"
        r"|<style\b[^>]*>.*?</style\s*>|<[!?/a-zA-Z][^>]*>', ' ', 'g'), "
        "'&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    )


def vector(source: str, key: str, text: str, dim: int = 64, name: str | None = None) -> str:
    """Hashed vectors in long form: (key, b, v)."""
    name = name or key
    return f"""
      SELECT {name}, h % {dim} AS b, sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM (SELECT {name}, {hash_of('t')} AS h
            FROM (SELECT {key} AS {name}, unnest({terms(text)}) AS t FROM {source}))
      GROUP BY ALL"""


def cosine(left: str, right: str, left_ids: str, right_ids: str) -> str:
    """All pairs (query_id, chunk_id, score) of two long-form vector tables."""
    return f"""
      SELECT l.query_id, r.chunk_id,
             round(CASE WHEN coalesce(ln.n * rn.n, 0) > 0 THEN coalesce(d.dot, 0) / sqrt(ln.n * rn.n) ELSE 0 END, 9) AS score
      FROM {left_ids} l CROSS JOIN {right_ids} r
      LEFT JOIN (SELECT query_id, chunk_id, sum(a.v * c.v) AS dot FROM {left} a JOIN {right} c USING (b)
                 GROUP BY ALL) d ON d.query_id = l.query_id AND d.chunk_id = r.chunk_id
      LEFT JOIN (SELECT query_id, sum(v * v) AS n FROM {left} GROUP BY ALL) ln ON ln.query_id = l.query_id
      LEFT JOIN (SELECT chunk_id, sum(v * v) AS n FROM {right} GROUP BY ALL) rn ON rn.chunk_id = r.chunk_id"""


def topk(source: str, k: int, score: str = "score") -> str:
    return f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS rank
                     FROM {source}) WHERE rank <= {k}"""


# Shared tables: parts of `documents`, their 256-word chunks, sentences, and
# hits of `benchmark` in the chunks. Unused ones are never evaluated.
SHARED = f"""
parts AS (
  SELECT doc_id, source, source || '/' || doc_id || '.txt' AS source_file,
         {sanitize("source || '/' || doc_id || '.txt'")} AS part_id, {clean('text')} AS text
  FROM documents WHERE {clean('text')} <> ''),
chunks AS (
  SELECT part_id, source_file, st // 256 AS chunk_order, part_id || '_chunk_' || (st // 256) AS chunk_id,
         doc_id || '.txt (Chk:' || (st // 256 + 1) || ')' AS display_source_name,
         array_to_string(ws[st + 1:st + 256], ' ') AS text
  FROM (SELECT *, unnest(range(0, len(ws), 256)) AS st FROM (SELECT *, {words('text')} AS ws FROM parts))),
raw_sentences AS (
  SELECT part_id, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM (
    SELECT part_id, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS s FROM parts)),
sentence_runs AS (
  SELECT part_id, i, s, sum(CASE WHEN i = 1 OR (len(s) >= 12 AND NOT (i = 2 AND first_len < 12)) THEN 1 ELSE 0 END)
           OVER (PARTITION BY part_id ORDER BY i) AS n
  FROM (SELECT *, first_value(len(s)) OVER (PARTITION BY part_id ORDER BY i) AS first_len FROM raw_sentences)),
sentences AS (
  SELECT part_id, n::BIGINT AS i, string_agg(s, ' ' ORDER BY i) AS s FROM sentence_runs GROUP BY part_id, n),
sentence_tokens AS (SELECT *, {tokens('s')} AS t FROM sentences),
query_vec AS ({vector('benchmark', 'item_id', 'text', name='query_id')}),
chunk_vec AS ({vector('chunks', 'chunk_id', 'text')}),
query_ids AS (SELECT item_id AS query_id, {clean('text')} AS query FROM benchmark),
scores AS ({cosine('query_vec', 'chunk_vec', 'query_ids', 'chunks')}),
hits AS ({topk('scores', 30)}),
rich_hits AS (
  SELECT h.query_id, h.rank, h.chunk_id, h.score, c.text, c.source_file, c.display_source_name
  FROM hits h JOIN chunks c USING (chunk_id)),
packed AS (
  SELECT * FROM (
    SELECT *, sum(block_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS total_tokens FROM (
      SELECT *, '[Source ' || rank || ']' || chr(10) || chr(10) || text || chr(10) || chr(10) AS block,
             {tokens('text')} + 2 AS block_tokens, rank AS tag_id FROM rich_hits))
  WHERE total_tokens <= 6800)
"""


def twin(select: str, *ctes: str, recursive: bool = False) -> str:
    """A query over the shared tables and its own ones."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {', '.join([SHARED.strip(), *ctes])} {select}"
