"""Chunking strategies over all documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import check
from checks.frames import document_parts
from checks.twins import hash_of, terms, twin
from passagemill.functions import text as tx
from passagemill.functions import vectors as vec
from passagemill.operators import sentences as sen
from passagemill.operators.chunking import chunk_documents, threshold_of

_NAMED = "part_id, chunk_order, text"


def _named(chunks):
    return chunks.select("part_id", "chunk_order", "text")


@check(
    "chunk_token",
    twin(
        """SELECT part_id, (st // 40)::INTEGER AS chunk_order, array_to_string(ws[st + 1:st + 50], ' ') AS text
           FROM (SELECT *, unnest(range(0, len(ws), 40)) AS st FROM
                   (SELECT part_id, regexp_extract_all(text, '[^ ]+') AS ws FROM parts))
           WHERE st = 0 OR st + 10 < len(ws)"""
    ),
)
def chunk_token(spark, d):
    return _named(chunk_documents(document_parts(spark, d), "token", chunk_size=50, chunk_overlap=10))


@check("split_sentences", twin("SELECT part_id, (i - 1)::INTEGER AS sentence_order, s AS sentence FROM sentences"))
def split_sentences(spark, d):
    parts = document_parts(spark, d)
    return parts.select("part_id", F.posexplode(sen.sentences(F.col("text"))).alias("sentence_order", "sentence"))


def _greedy(source: str, keys: str, size: int) -> str:
    """Greedy packing of rows (keys, i, s, t) into chunks ``g``, as a recursive table."""
    names = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} = r.{k}" for k in names)
    cols = ", ".join(f"s.{k}" for k in names)
    return f"""
      SELECT {', '.join(names)}, i, s, t, 1 AS g, t AS acc FROM {source} WHERE i = 1
      UNION ALL
      SELECT {cols}, s.i, s.s, s.t, CASE WHEN r.acc + s.t > {size} THEN r.g + 1 ELSE r.g END,
             CASE WHEN r.acc + s.t > {size} THEN s.t ELSE r.acc + s.t END
      FROM greedy r JOIN {source} s ON {on} AND s.i = r.i + 1"""


@check(
    "chunk_sentence",
    twin(
        "SELECT part_id, (g - 1)::INTEGER AS chunk_order, string_agg(s, ' ' ORDER BY i) AS text FROM greedy GROUP BY part_id, g",
        f"greedy AS ({_greedy('sentence_tokens', 'part_id', 256)})",
        recursive=True,
    ),
)
def chunk_sentence(spark, d):
    return _named(chunk_documents(document_parts(spark, d), "sentence"))


@check("chunk_recursive")
def chunk_recursive(spark, d):
    chunks = chunk_documents(document_parts(spark, d), "recursive")
    return _named(chunks).withColumn("tokens", tx.count_tokens(F.col("text")))


# Units of two sentences, their vectors, and their likeness to the one before.
_UNITS = f"""
units AS (SELECT part_id, (i - 1) // 2 AS u, string_agg(s, ' ' ORDER BY i) AS text FROM sentences GROUP BY ALL),
unit_vec AS (
  SELECT part_id, u, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM (SELECT part_id, u, {hash_of('t')} AS h FROM (SELECT part_id, u, unnest({terms('text')}) AS t FROM units))
  GROUP BY ALL),
unit_norm AS (SELECT part_id, u, sum(v * v) AS n FROM unit_vec GROUP BY ALL),
sims AS (
  SELECT a.part_id, a.u, round(CASE WHEN coalesce(na.n * nb.n, 0) > 0
           THEN coalesce(d.dot, 0) / sqrt(na.n * nb.n) ELSE 0 END, 9) AS sim
  FROM units a
  LEFT JOIN (SELECT x.part_id, x.u, sum(x.v * y.v) AS dot FROM unit_vec x
             JOIN unit_vec y ON x.part_id = y.part_id AND x.b = y.b AND y.u = x.u - 1 GROUP BY ALL) d
    ON d.part_id = a.part_id AND d.u = a.u
  LEFT JOIN unit_norm na ON na.part_id = a.part_id AND na.u = a.u
  LEFT JOIN unit_norm nb ON nb.part_id = a.part_id AND nb.u = a.u - 1
  WHERE a.u > 0)"""


def _groups(limits: str) -> str:
    return f"""
limits AS ({limits}),
unit_groups AS (
  SELECT units.part_id, units.u,
         sum(CASE WHEN units.u = 0 OR sim < lim THEN 1 ELSE 0 END) OVER (PARTITION BY units.part_id ORDER BY units.u) AS g
  FROM units LEFT JOIN sims ON sims.part_id = units.part_id AND sims.u = units.u
  LEFT JOIN limits ON limits.part_id = units.part_id)"""


# Size rules over sentences with a group ``g``: small groups join the one
# before, then sentences of each group are packed anew.
def _sized(groups: str) -> str:
    return f"""
grouped AS (
  SELECT st.part_id, st.i, st.s, st.t, gr.g FROM sentence_tokens st
  JOIN {groups} gr ON gr.part_id = st.part_id AND gr.u = (st.i - 1) // 2),
group_size AS (SELECT part_id, g, sum(t) AS t, min(g) OVER (PARTITION BY part_id) AS first_g FROM grouped GROUP BY part_id, g),
merged_groups AS (
  SELECT part_id, g, sum(CASE WHEN g = first_g OR t >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY part_id ORDER BY g) AS m
  FROM group_size),
members AS (
  SELECT a.part_id, m, row_number() OVER (PARTITION BY a.part_id, m ORDER BY i) AS i, s, t
  FROM grouped a JOIN merged_groups b ON a.part_id = b.part_id AND a.g = b.g),
greedy AS ({_greedy('members', 'part_id, m', 256)})"""


_SIZED_RESULT = """
SELECT part_id, (row_number() OVER (PARTITION BY part_id ORDER BY m, g) - 1)::INTEGER AS chunk_order, text
FROM (SELECT part_id, m, g, string_agg(s, ' ' ORDER BY i) AS text FROM greedy GROUP BY part_id, m, g)"""


@check(
    "chunk_semantic",
    twin(
        _SIZED_RESULT, _UNITS, _groups("SELECT DISTINCT part_id, 0.3 AS lim FROM units"), _sized("unit_groups"), recursive=True
    ),
)
def chunk_semantic(spark, d):
    return _named(chunk_documents(document_parts(spark, d), "semantic"))


_AUTO = "SELECT part_id, round(avg(sim) - stddev_pop(sim), 9) AS lim FROM sims GROUP BY part_id"

_SDPM = f"""
group_ids AS (SELECT DISTINCT part_id, g FROM unit_groups),
group_vec AS (
  SELECT part_id, g, b, sum(v) AS v FROM unit_vec JOIN unit_groups USING (part_id, u) GROUP BY ALL),
group_norm AS (SELECT part_id, g, sum(v * v) AS n FROM group_vec GROUP BY ALL),
reach AS (
  SELECT a.part_id, a.g, coalesce(max(CASE WHEN round(CASE WHEN coalesce(na.n * nb.n, 0) > 0
           THEN coalesce(d.dot, 0) / sqrt(na.n * nb.n) ELSE 0 END, 9) >= lim THEN z.g END), a.g) AS e
  FROM group_ids a
  LEFT JOIN group_ids z ON z.part_id = a.part_id AND z.g BETWEEN a.g + 1 AND a.g + 5
  LEFT JOIN (SELECT x.part_id, x.g AS ga, y.g AS gb, sum(x.v * y.v) AS dot FROM group_vec x
             JOIN group_vec y ON x.part_id = y.part_id AND x.b = y.b AND y.g BETWEEN x.g + 1 AND x.g + 5 GROUP BY ALL) d
    ON d.part_id = a.part_id AND d.ga = a.g AND d.gb = z.g
  LEFT JOIN group_norm na ON na.part_id = a.part_id AND na.g = a.g
  LEFT JOIN group_norm nb ON nb.part_id = z.part_id AND nb.g = z.g
  LEFT JOIN limits ON limits.part_id = a.part_id
  GROUP BY a.part_id, a.g),
islands AS (
  SELECT part_id, g, sum(CASE WHEN far IS NULL OR g > far THEN 1 ELSE 0 END) OVER (PARTITION BY part_id ORDER BY g) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY part_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far
        FROM reach)),
island_groups AS (SELECT part_id, u, island AS g FROM unit_groups JOIN islands USING (part_id, g))"""


@check(
    "chunk_sdpm",
    twin(_SIZED_RESULT, _UNITS, _groups(_AUTO), _SDPM, _sized("island_groups"), recursive=True),
)
def chunk_sdpm(spark, d):
    return _named(chunk_documents(document_parts(spark, d)))


@check(
    "resolve_similarity_threshold",
    twin(
        """SELECT part_id, round(round(avg(sim) - stddev_pop(sim), 9), 6) AS auto_limit,
             round(round(quantile_cont(sim, 0.8), 9), 6) AS percentile_limit, 0.3::DOUBLE AS literal_limit
           FROM sims GROUP BY part_id""",
        _UNITS,
    ),
)
def resolve_similarity_threshold(spark, d):
    text = F.col("text")
    units = sen.let(
        sen.sentences(text),
        lambda xs: F.transform(
            sen.positions(F.ceil(F.size(xs) / 2).cast("int")), lambda u: F.array_join(F.slice(xs, u * 2 + 1, 2), " ")
        ),
    )
    rows = document_parts(spark, d).select("part_id", F.posexplode(units).alias("u", "unit"))
    before = Window.partitionBy("part_id").orderBy("u")
    near = rows.withColumn("v", vec.hashed_vector(F.col("unit"))).withColumn("w", F.lag("v").over(before))
    sims = near.filter(F.col("w").isNotNull()).select(
        "part_id", vec.similarity("cosine", F.col("v"), F.col("w")).alias("sim")
    )
    limits = {"auto_limit": "auto", "percentile_limit": 80, "literal_limit": 0.3}
    return sims.groupBy("part_id").agg(
        *[F.round(threshold_of(x, F.col("sim")), 6).alias(name) for name, x in limits.items()]
    )


@check(
    "chunk_by_boundary_model",
    twin(
        """SELECT part_id, (n - 1)::INTEGER AS chunk_order, string_agg(text, ' ' ORDER BY p) AS text FROM (
             SELECT *, sum(CASE WHEN p = 1 OR (len(text) >= 30 AND NOT (p = 2 AND first_len < 30)) THEN 1 ELSE 0 END)
                         OVER (PARTITION BY part_id ORDER BY p) AS n
             FROM (SELECT *, first_value(len(text)) OVER (PARTITION BY part_id ORDER BY p) AS first_len FROM (
               SELECT part_id, p, string_agg(w, ' ' ORDER BY i) AS text FROM (
                 SELECT part_id, i, w, 1 + sum(CASE WHEN i > 1 AND prev LIKE '%.' THEN 1 ELSE 0 END)
                                         OVER (PARTITION BY part_id ORDER BY i) AS p
                 FROM (SELECT *, lag(w) OVER (PARTITION BY part_id ORDER BY i) AS prev FROM (
                   SELECT part_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (
                     SELECT part_id, regexp_extract_all(text, '[^ ]+') AS ws FROM parts))))
               GROUP BY part_id, p)))
           GROUP BY part_id, n"""
    ),
)
def chunk_by_boundary_model(spark, d):
    return _named(chunk_documents(document_parts(spark, d), "boundary", scorer=_after_full_stop))


def _after_full_stop(windows):
    """Stands in for a segmentation model: a chunk may start after a full stop."""
    return [[0.0] + [0.9 if w.endswith(".") else 0.1 for w in window[:-1]] for window in windows]


@check(
    "chunk_enrich",
    twin("SELECT chunk_id, chunk_order::INTEGER AS chunk_order, source_file, display_source_name, text FROM chunks"),
)
def chunk_enrich(spark, d):
    chunks = chunk_documents(document_parts(spark, d), "token")
    return chunks.select("chunk_id", "chunk_order", "source_file", "display_source_name", "text")


@check("chunk_documents")
def chunk_all(spark, d):
    """Every strategy by name over the same parts."""
    parts = document_parts(spark, d)
    out = None
    for strategy in ("token", "sentence", "recursive", "semantic", "sdpm", "boundary"):
        scorer = _after_full_stop if strategy == "boundary" else None
        counted = chunk_documents(parts, strategy, scorer=scorer).groupBy("part_id").agg(
            F.count(F.lit(1)).alias("chunks")
        )
        named = counted.withColumn("strategy", F.lit(strategy))
        out = named if out is None else out.unionByName(named)
    return out
