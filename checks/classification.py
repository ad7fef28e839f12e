"""Zero-shot labels over all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.frames import rich_hits, table, token_chunks
from checks.twins import cosine, twin, vector
from passagemill.operators import classify as cl

# Labels taken from the tables: the part names and types, among others.
_LABELS = f"""
names AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT text FROM benchmark),
name_vec AS ({vector('names', 'label', 'label', name='query_id')}),
name_ids AS (SELECT label AS query_id FROM names),
label_scores AS (
  SELECT chunk_id, query_id AS label, score AS cos, (1 + score) / 2 AS score
  FROM ({cosine('name_vec', 'chunk_vec', 'name_ids', 'chunks')})),
soft AS (
  SELECT chunk_id, label, round(exp(cos) / sum(exp(cos)) OVER (PARTITION BY chunk_id), 9) AS score FROM label_scores),
ordered AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, label) AS place FROM label_scores)"""


def labels(spark, d):
    part = table(spark, d, "part")
    return (
        part.select(F.col("p_name").alias("label"))
        .union(part.select("p_type"))
        .union(table(spark, d, "benchmark").select("text"))
        .distinct()
    )


def classified(spark, d, **options):
    return cl.classify_zero_shot(token_chunks(spark, d), labels(spark, d), **options)


@check(
    "classify_zero_shot",
    twin("SELECT chunk_id, (place - 1)::INTEGER AS place, label, score FROM ordered", _LABELS),
)
def classify_multi(spark, d):
    rows = classified(spark, d).select("chunk_id", F.posexplode(F.arrays_zip("labels", "scores")).alias("place", "x"))
    return rows.select("chunk_id", "place", "x.labels", F.col("x.scores").alias("score")).withColumnRenamed("labels", "label")


@check(
    "classify_single_label",
    twin("SELECT chunk_id, label, score FROM soft", _LABELS),
)
def classify_single(spark, d):
    rows = classified(spark, d, multi_label=False).select("chunk_id", F.explode(F.arrays_zip("labels", "scores")).alias("x"))
    return rows.select("chunk_id", F.col("x.labels").alias("label"), F.col("x.scores").alias("score"))


@check(
    "top_label",
    twin(
        "SELECT chunk_id, label AS top_label, score AS top_label_score FROM ordered WHERE place = 1", _LABELS
    ),
)
def top(spark, d):
    return classified(spark, d).select("chunk_id", "top_label", "top_label_score")


_FAILS = "text LIKE '%ing%'"


@check(
    "classification_status",
    twin(
        f"""SELECT chunk_id, 'built-in' AS classifier, 'success' AS status FROM chunks
            UNION ALL SELECT chunk_id, 'failing', CASE WHEN {_FAILS} THEN 'error_in_bulk_pipeline_call' ELSE 'success' END FROM chunks
            UNION ALL SELECT chunk_id, 'no labels', 'skipped_no_labels' FROM chunks
            UNION ALL SELECT chunk_id, 'no name', 'skipped_no_model_name' FROM chunks
            UNION ALL SELECT chunk_id, 'not built', 'skipped_classifier_init_failed' FROM chunks"""
    ),
)
def statuses(spark, d):
    chunks = token_chunks(spark, d)
    named = labels(spark, d)

    def failing(texts, names):
        if any("ing" in t for t in texts):
            raise RuntimeError("no score")
        return [[0.5] * len(names) for _ in texts]

    runs = {
        "built-in": cl.classify_zero_shot(chunks, named),
        "failing": cl.classify_zero_shot(chunks, named, scorer=failing, batch=1),
        "no labels": cl.classify_zero_shot(chunks, named.limit(0)),
        "no name": cl.with_status(chunks, cl.skip_reason(True, None, None)),
        "not built": cl.with_status(chunks, cl.skip_reason(True, False, None)),
    }
    out = None
    for name, run in runs.items():
        rows = run.select("chunk_id", F.lit(name).alias("classifier"), F.col("classification_status").alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


@check(
    "merge_classification",
    twin(
        """SELECT chunk_id, text, CASE WHEN chunk_order % 2 = 0 THEN label END AS top_label,
             CASE WHEN chunk_order % 2 = 0 THEN 'success' ELSE 'error_missing_pipeline_output_item' END AS classification_status
           FROM chunks LEFT JOIN (SELECT * FROM ordered WHERE place = 1) USING (chunk_id)""",
        _LABELS,
    ),
)
def merge(spark, d):
    chunks = token_chunks(spark, d)
    results = classified(spark, d).filter(F.col("chunk_order") % 2 == 0).select(
        "chunk_id", "top_label", "classification_status"
    )
    return cl.merge_classification(chunks, results).select("chunk_id", "text", "top_label", "classification_status")


@check(
    "label_histogram",
    twin(
        """SELECT query_id, label, chunks, first_rank::INTEGER AS first_rank FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunks DESC, first_rank) AS place FROM (
               SELECT query_id, label, count(*) AS chunks, min(rank) AS first_rank
               FROM rich_hits JOIN (SELECT * FROM ordered WHERE place = 1) o USING (chunk_id) GROUP BY query_id, label))
           WHERE place <= 5""",
        _LABELS,
    ),
)
def histogram(spark, d):
    hits = cl.classify_zero_shot(rich_hits(spark, d), labels(spark, d))
    return cl.label_histogram(hits).select("query_id", "label", "chunks", "first_rank")
