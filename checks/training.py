"""Vocabulary, reduction and training over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.frames import points, table
from checks.twins import terms
from passagemill.operators import training as tr
from passagemill.operators.embedding import embed_hashed
from passagemill.operators.projection import pca_reduce
from passagemill.session import new_path


@check(
    "build_vocabulary",
    f"""SELECT t AS token, count(*) AS n FROM (SELECT unnest({terms('text')}) AS t FROM documents)
        GROUP BY t ORDER BY n DESC, t LIMIT 2000""",
)
def build_vocabulary(spark, d):
    return tr.build_vocabulary(table(spark, d, "documents"), size=2000)


@check("pca_reduce")
def reduce_by_pca(spark, d):
    reduced = pca_reduce(points(spark, d), 8)
    rows = reduced.select("chunk_id", F.posexplode("reduced").alias("component", "value"))
    return rows.withColumn("value", F.round("value", 6))


def _passages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")


def _features(spark, d):
    path = new_path(spark, "features")
    teacher = lambda df: embed_hashed(df, dim=32)
    passages = _passages(spark, d)
    # Half first, then a resumed run over all of them.
    tr.featurize_corpus(passages.filter(F.col("passage_id") % 2 == 0), None, path, embed=teacher)
    return tr.featurize_corpus(passages, None, path, embed=teacher)


@check("featurize_corpus", "SELECT doc_id AS passage_id, 32::INTEGER AS dim FROM documents")
def featurize(spark, d):
    return _features(spark, d).select("passage_id", F.size("vector").alias("dim"))


@check("train_static_model")
def train(spark, d):
    """Token vectors fitted to hashed teacher vectors; the loss must fall."""
    features = _features(spark, d)
    model, losses = tr.train_static_model(features, tr.build_vocabulary(_passages(spark, d)))
    if not all(b < a for a, b in zip(losses, losses[1:])):
        raise RuntimeError(f"the loss did not fall: {losses}")
    return model.select("token", F.round("weight", 6).alias("weight"), F.size("vector").alias("dim"))
