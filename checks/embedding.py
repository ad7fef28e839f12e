"""Embedding operators over documents, chunks and the given vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import check
from checks.frames import points, questions, rounded, store, table, token_chunks
from checks.twins import hash_of, terms, twin
from passagemill.functions import text as tx
from passagemill.functions import vectors as vec
from passagemill.operators import embedding as emb
from passagemill.session import materialize

_LONG = "SELECT chunk_id, b::INTEGER AS bucket, v AS value FROM chunk_vec WHERE v <> 0"


@check("embed_hashed", twin(_LONG))
def embed_hashed(spark, d):
    rows = store(spark, d).select("chunk_id", F.posexplode("vector").alias("bucket", "value"))
    return rows.filter(F.col("value") != 0).withColumn("value", F.col("value").cast("double"))


# A token-vector table made from the corpus: its vocabulary, weights that fall
# with frequency, and eight components from the token's hash.
_TOKEN_VECTORS = f"""
vocabulary AS (
  SELECT t AS token, count(*) AS n FROM (SELECT unnest({terms('text')}) AS t FROM documents) GROUP BY t),
token_vec AS (
  SELECT token, 0.001 / (0.001 + n / (SELECT sum(n) FROM vocabulary)) AS weight, b,
         (({hash_of('token')} // (16 ** b)::BIGINT) % 16 - 7.5) / 8.0 AS x
  FROM vocabulary CROSS JOIN range(0, 8) r(b)),
token_means AS (
  SELECT chunk_id, b, sum(n * weight * x) / sum(n) AS m
  FROM (SELECT chunk_id, t AS token, count(*) AS n FROM (SELECT chunk_id, unnest({terms('text')}) AS t FROM chunks) GROUP BY ALL)
  JOIN token_vec USING (token) GROUP BY ALL),
token_norms AS (SELECT chunk_id, sqrt(sum(m * m)) AS n FROM token_means GROUP BY chunk_id)"""


def token_vectors(spark, d):
    counts = table(spark, d, "documents").select(F.explode(tx.terms(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).scalar()
    h = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint")
    parts = [(F.shiftright(h, 4 * b) % 16 - 7.5) / 8.0 for b in range(8)]
    return counts.select(
        "token", (F.lit(0.001) / (F.lit(0.001) + F.col("n") / total)).alias("weight"), F.array(*parts).alias("vector")
    )


@check(
    "embed_static",
    twin(
        """SELECT chunk_id, b::INTEGER AS position, round(m / n, 4) + 0.0 AS value FROM token_means JOIN token_norms USING (chunk_id)
           WHERE n > 0""",
        _TOKEN_VECTORS,
    ),
)
def embed_static(spark, d):
    done = emb.embed_static(token_chunks(spark, d), "chunk_id", "text", materialize(token_vectors(spark, d), "tokens"))
    filled = F.exists("vector", lambda x: x != 0)
    rows = done.filter(filled).select("chunk_id", F.posexplode("vector").alias("position", "value"))
    return rows.withColumn("value", rounded(F.col("value").cast("double"), 4) + F.lit(0.0))


def _letter_counts():
    """Stands in for an encoder: how often a text holds each of five letters."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(letter) for letter in "aeiou"] for t in texts], dtype=np.float32)

    return encode


_VOWELS = ", ".join(f"(len(text) - len(replace(text, '{v}', '')))::DOUBLE AS {v}" for v in "aeiou")


@check("embed_with_model", f"SELECT doc_id, {_VOWELS} FROM documents")
def embed_with_model(spark, d):
    done = emb.embed_with_model(table(spark, d, "documents"), "text", _letter_counts)
    return done.select(
        "doc_id", *[F.get("vector", F.lit(i)).cast("double").alias(v) for i, v in enumerate("aeiou")]
    )


@check(
    "embed_batch_cast",
    f"""SELECT event_id, {', '.join(f"(len(t) - len(replace(t, '{c}', '')))::DOUBLE AS n{c}" for c in '0123')}
        FROM (SELECT event_id, user_id::VARCHAR AS t FROM events)""",
)
def embed_batch_cast(spark, d):
    """Numbers are embedded as their text."""

    def factory():
        return lambda texts: np.array([[t.count(c) for c in "0123"] for t in texts], dtype=np.float32)

    done = emb.embed_with_model(table(spark, d, "events"), "user_id", factory)
    return done.select(
        "event_id", *[F.get("vector", F.lit(i)).cast("double").alias(f"n{i}") for i in range(4)]
    )


def _sparse(spark, d):
    """Term counts of the questions and chunks as maps, by hashed index."""

    def counts(df, key, text):
        h = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % 1000).cast("int")
        rows = df.select(key, F.explode(tx.terms(F.col(text))).alias("t")).select(key, h(F.col("t")).alias("idx"))
        per = rows.groupBy(key, "idx").agg(F.count(F.lit(1)).cast("float").alias("val"))
        return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("sparse"))

    return counts(questions(spark, d), "query_id", "query"), counts(token_chunks(spark, d), "chunk_id", "text")


def _sparse_twin(source: str, key: str, text: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, idx, count(*) AS val FROM (
      SELECT {key}, {hash_of('t')} % 1000 AS idx FROM (SELECT {key}, unnest({terms(text)}) AS t FROM {source}))
      GROUP BY ALL)"""


@check(
    "sparse_to_dense",
    twin(
        """SELECT chunk_id, idx::INTEGER AS position, val::DOUBLE AS value FROM sparse_chunks WHERE idx < 600""",
        _sparse_twin("chunks", "chunk_id", "text", "sparse_chunks"),
    ),
)
def sparse_to_dense(spark, d):
    # Indices from 600 up are outside the width and must be ignored.
    dense = _sparse(spark, d)[1].select("chunk_id", vec.sparse_to_dense(F.col("sparse"), 600).alias("v"))
    rows = dense.select("chunk_id", F.posexplode("v").alias("position", "value")).filter(F.col("value") != 0)
    return rows.withColumn("value", F.col("value").cast("double"))


@check(
    "sparse_similarity",
    twin(
        """SELECT query_id, chunk_id, sum(a.val * b.val)::DOUBLE AS score FROM sparse_queries a
           JOIN sparse_chunks b USING (idx) GROUP BY ALL""",
        _sparse_twin("query_ids", "query_id", "query", "sparse_queries"),
        _sparse_twin("chunks", "chunk_id", "text", "sparse_chunks"),
    ),
)
def sparse_similarity(spark, d):
    queries, chunks = _sparse(spark, d)
    return emb.sparse_similarity(
        emb.sparse_rows(queries, "query_id", "sparse"), emb.sparse_rows(chunks, "chunk_id", "sparse")
    )


@check(
    "validate_dimensions",
    """SELECT count(*) AS vectors, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim,
         min(len(embedding)) = max(len(embedding)) AS uniform, max(len(embedding)) = 32 AS as_expected FROM embeddings""",
)
def validate_dimensions(spark, d):
    return emb.dimension_report(points(spark, d), expected=32)
