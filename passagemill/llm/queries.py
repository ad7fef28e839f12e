"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import bpe, exact_dedup, line_dedup, minhash, packing, periodic_runs, quality, secret_scan, sharding
from passagemill.llm import suffix_dedup, token_alignment, token_files, warc
from passagemill.llm.common import SPACES, bound, text_of, with_row_id
from passagemill.session import configure, load_table, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(configure(spark), folder, "documents")


def _secret_parts() -> str:
    """Matches of every kind with their places, by the lengths of what lies between them."""
    parts = []
    for no, kind in enumerate(secret_scan.KINDS):
        pattern = secret_scan.rough_pattern(kind).replace("'", "''")
        good = f"length(m) >= {kind.least}"
        if kind.least_value:
            good += f" AND length(regexp_extract(m, '{pattern}', 2)) >= {kind.least_value}"
        if kind.mixed:
            good += " AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"
        parts.append(f"""
          SELECT doc_id, {no} AS kind, '{kind.name}' AS name, e - length(m) AS s, e FROM (
            SELECT doc_id, m, sum(length(m) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
              SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps
                FROM documents) WHERE len(ms) > 0)) WHERE {good}""")
    return " UNION ALL ".join(parts)


def _complete() -> str:
    scope, names = secret_scan.SecretOptions().scope, [k.name for k in secret_scan.KINDS]
    weak = [
        f"(p.name = '{k.name}' AND EXISTS (FROM parts o WHERE o.doc_id = p.doc_id AND o.name IN {k.completed_by} "
        f"AND o.s <= p.e + {scope} AND o.e >= p.s - {scope}))"
        for k in secret_scan.KINDS
        if k.completed_by
    ]
    return " OR ".join([f"p.name IN {tuple(names[: secret_scan.BASE])}", *weak])


@query(
    "op1_secret_scan",
    f"""
    WITH parts AS ({_secret_parts()}),
    told AS (SELECT *, name || ':' || s || ':' || e AS t FROM parts p WHERE {_complete()}),
    grouped AS (
      SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access,
             count(*) FILTER (name = 'hex') AS n_hex, string_agg(t, ',' ORDER BY s, kind) AS spans,
             string_agg(t, ',' ORDER BY s, kind) FILTER (kind < {secret_scan.BASE}) AS base
      FROM told GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN grouped USING (doc_id)""",
)
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(documents(spark, folder))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    placed = sharding.shard_table(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    text = text_of()
    return placed.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(documents(spark, folder))
    return left.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(documents(spark, folder), rank_file, public_tokenizers.PATTERN)


PLAIN = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"


@query(
    "op5_exact_dedup",
    f"""
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
           row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
    FROM (SELECT doc_id, {PLAIN} AS plain, length(coalesce(text, '')) AS n FROM documents)
    WINDOW best AS (PARTITION BY plain ORDER BY n DESC, doc_id)""",
)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_row_id(documents(spark, folder).select("doc_id", "text"))
    return exact_dedup.copies(docs).drop("__row")


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    options = packing.PackOptions(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(documents(spark, folder), options).drop("ids")


@query(
    "op7_warc",
    """
    SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN strlen(html) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(html) >= 100 AND first <> page_id THEN first END AS refers_to
    FROM (SELECT *, min(page_id) OVER (PARTITION BY html) AS first
          FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))""",
)
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.archive_pages(load_table(configure(spark), folder, "pages"))
    return warc.archived_pages(spark, path)


_MEASURES = ", ".join(
    f"({m.name!r}, CASE WHEN {m.base} > 0 THEN {m.top} * 1000 // {m.base} END)" for m in quality.QualityOptions().measures
)
_LEVELS = """
    SELECT {keys} measure, sum(n) AS rows, min(value) FILTER (below * 4 >= total) AS q1,
           min(value) FILTER (below * 4 >= total * 3) AS q3
    FROM (SELECT *, sum(n) OVER ({part} ORDER BY value) AS below, sum(n) OVER ({part}) AS total
          FROM (SELECT {keys} measure, value, sum(n) AS n FROM sketch GROUP BY ALL))
    GROUP BY ALL"""


def _level(*keys: str) -> str:
    return _LEVELS.format(keys="".join(f"{k}, " for k in keys), part=f"PARTITION BY {', '.join([*keys, 'measure'])}")


_FENCES = " UNION ALL ".join(
    f"SELECT {m.name!r} AS measure, {m.slack} AS slack, {str(m.low).lower()} AS low" for m in quality.QualityOptions().measures
)


@query(
    "op8_quality_rules",
    rf"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    split AS (
      SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM texts),
    windows AS (
      SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
    grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM windows),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
    measured AS (
      SELECT s.doc_id, lang, source, len(w) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
    exact AS (
      SELECT doc_id, lang, source, m[1] AS measure, m[2]::BIGINT AS x
      FROM (SELECT *, unnest([{_MEASURES}]) AS m FROM measured WHERE n_words > 0)),
    rough AS (
      SELECT * EXCLUDE (x), x - x % (10 ** greatest(length(x::VARCHAR) - 3, 0))::BIGINT AS value FROM exact WHERE x IS NOT NULL),
    sketch AS (SELECT lang, source, measure, value, count(*) AS n FROM rough GROUP BY ALL),
    own AS ({_level("lang", "source")}), languages AS ({_level("lang")}), every AS ({_level()}),
    fences AS ({_FENCES}),
    bounds AS (
      SELECT lang, source, measure, low, q3 + greatest((q3 - q1) * 3, slack) AS high, q1 - greatest((q3 - q1) * 3, slack) AS least
      FROM (SELECT o.lang, o.source, measure, low, slack,
                   CASE WHEN o.rows >= 200 THEN o.q1 WHEN l.rows >= 200 THEN l.q1 ELSE e.q1 END AS q1,
                   CASE WHEN o.rows >= 200 THEN o.q3 WHEN l.rows >= 200 THEN l.q3 ELSE e.q3 END AS q3
            FROM own o JOIN languages l USING (lang, measure) JOIN every e USING (measure) JOIN fences f USING (measure))),
    outside AS (
      SELECT DISTINCT doc_id FROM rough JOIN bounds USING (lang, source, measure) WHERE value > high OR (low AND value < least))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT EXISTS (FROM outside o WHERE o.doc_id = m.doc_id) AS kept
    FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured) m""",
)
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_quality(documents(spark, folder), columns=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


@query("op10_token_files")
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    options = token_files.TokenFileOptions(public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_table(documents(spark, folder), options).drop("ids")


@query("op9_minhash")
def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = materialize(with_row_id(documents(spark, folder).select("doc_id", "text")), "numbered")
    return minhash.groups(docs, minhash.MinHashOptions(words=2)).drop("__row")


def planted(doc_id: str, text: str) -> Column:
    """A text, made periodic from some word on where the checksum of its id is divisible by ten; no id, no change."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.expr(f"crc32(cast(cast({doc_id} AS string) AS binary)) div 10")

    def periodic(words: Column) -> Column:
        n = F.size(words)

        def repeat(place: Column) -> Column:
            a, p = place["a"], place["p"]
            source = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
            return F.array_join(F.transform(source, lambda i: F.get(words, i)), " ")

        a = F.pmod(g, n).cast("int")
        p = bound(a, lambda at: F.struct(at.alias("a"), (1 + F.floor((n - at) / (3 + F.pmod(g, F.lit(8))))).cast("int").alias("p")))
        return F.when(n > 0, bound(p, repeat)).otherwise("")

    words = F.filter(F.split(text_of(text), SPACES), lambda w: w != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, bound(words, periodic)).otherwise(text_of(text))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", planted("doc_id", "text").alias("text"))
    told = periodic_runs.collapse_runs(docs, columns=["doc_id"])
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return told.select(
        "doc_id",
        "n_runs",
        *[F.col("best").getField(c).alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
    shared AS (
      SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
           sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
    FROM lines LEFT JOIN shared USING (k) GROUP BY doc_id""",
)
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = line_dedup.drop_repeated_lines(documents(spark, folder), columns=["doc_id"])
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    options = token_alignment.AlignOptions(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return token_alignment.align_tokens(documents(spark, folder), options, columns=["doc_id"])
