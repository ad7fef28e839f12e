"""Store, manifest, plot points and whole ingest runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.classification import labels
from checks.frames import document_parts, points, store, table, token_chunks, written_files
from checks.sources import _document_files
from checks.twins import clean, topk, twin, words
from passagemill import schemas
from passagemill.operators.classify import classify_zero_shot
from passagemill.operators.embedding import embed_hashed, validate_dimensions
from passagemill.operators.projection import project_2d, viz_points
from passagemill.operators.search import search
from passagemill.plans.ingest import IngestOptions, run_ingest
from passagemill.session import new_path
from passagemill.sources import store as st
from passagemill.streaming.incremental import current_chunks, incremental_ingest, refresh_store

_CHUNKS = twin("SELECT chunk_id, text, source_file FROM chunks")


def _manifest(**more):
    return st.build_manifest(model="hashed", dimension=64, metric="cosine", chunker="token", **more)


def _written(spark, d) -> str:
    path = new_path(spark, "store")
    kept = ["chunk_id", "chunk_order", "source_file", "display_source_name", "text", "vector"]
    st.write_store(store(spark, d).select(*kept), _manifest(source=d), path)
    return path


@check("write_store", _CHUNKS)
def write_store(spark, d):
    return spark.read.parquet(_written(spark, d) + "/chunks").select("chunk_id", "text", "source_file")


@check("write_supporting_data", _CHUNKS)
def write_supporting_data(spark, d):
    path = new_path(spark, "export")
    st.export_supporting_data(store(spark, d), path)
    return spark.read.schema("chunk_id string, text string, source_file string").json(path)


@check(
    "write_manifest",
    """SELECT 'hashed' AS embedding_model, 64::INTEGER AS vector_dimension, 'cosine' AS metric, 'token' AS chunker,
         true AS classification_enabled, count(DISTINCT text)::VARCHAR AS label_count FROM benchmark""",
)
def write_manifest(spark, d):
    names = table(spark, d, "benchmark").select("text").distinct()
    first = [r["text"] for r in names.orderBy("text").limit(st.LABEL_PREVIEW).collect()]
    width = validate_dimensions(store(spark, d))
    path = new_path(spark, "manifest")
    manifest = st.build_manifest(
        model="hashed", dimension=width, metric="COSINE", chunker="token", classifier="hashed", labels=first,
        label_count=names.count(),
    )
    st.write_manifest(spark, manifest, path)
    saved = spark.read.schema(st.MANIFEST_SCHEMA).json(f"{path}/manifest")
    return saved.select(
        "embedding_model", "vector_dimension", "metric", "chunker", "classification_enabled",
        F.col("config_summary").getItem("candidate_labels_count").alias("label_count"),
    )


@check("load_store", twin("SELECT chunk_id, text, 'hashed' AS model, 64::INTEGER AS dim FROM chunks"))
def load_store(spark, d):
    chunks, manifest = st.load_store(spark, _written(spark, d), model="hashed", dimension=64)
    return chunks.select(
        "chunk_id", "text", F.lit(manifest["embedding_model"]).alias("model"), F.size("vector").alias("dim")
    )


@check(
    "store_status",
    twin("SELECT true AS store_loaded, count(*) AS items, 'hashed' AS embedding_model, 'cosine' AS metric, 64::INTEGER AS vector_dimension FROM chunks"),
)
def store_status(spark, d):
    chunks, manifest = st.load_store(spark, _written(spark, d))
    return st.store_status(chunks, manifest, spark)


@check(
    "validate_store",
    """SELECT count(*) AS items, count(DISTINCT label) AS ids, 0::BIGINT AS missing_texts, 0::BIGINT AS missing_vectors,
         64::INTEGER AS min_dim, 64::INTEGER AS max_dim, false AS valid FROM embeddings""",
)
def validate_store(spark, d):
    """A store whose ids are not unique."""
    broken = points(spark, d).select(F.col("label").alias("chunk_id"), "vector", F.lit("x").alias("text"))
    return st.validate_store(broken)


_PLACE = """SELECT chunk_id AS id, source_file, display_source_name AS display_source, 'N/A' AS classification,
  CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM chunks"""


@check("viz_points", twin(_PLACE))
def plot_points(spark, d):
    return viz_points(token_chunks(spark, d))


@check("read_viz_points", twin(_PLACE))
def read_points(spark, d):
    path = new_path(spark, "points")
    st.write_viz_points(viz_points(project_2d(store(spark, d))), path)
    return st.read_viz_points(spark, path).filter(F.col("x").isNotNull() & F.col("y").isNotNull()).drop("x", "y")


@check("project_2d")
def project(spark, d):
    return project_2d(points(spark, d)).select("chunk_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_FILES_TWIN = f"SELECT source || '/' || doc_id || '.txt' AS source_file, {clean('text')} AS text FROM documents"


def _folder(spark, d) -> str:
    """The documents as real text files, one folder per source."""
    path = new_path(spark, "folder")
    docs = table(spark, d, "documents")
    line = F.regexp_replace("text", r"\s+", " ")
    docs.select(line.alias("value"), "source").write.partitionBy("source").text(path)
    return path


@check(
    "run_pipeline",
    f"""SELECT source AS folder, count(*) > 0 AS filled, sum({f"len(regexp_extract_all({clean('text')}, '[^ ]+'))"})::BIGINT AS words
        FROM documents GROUP BY source""",
)
def ingest(spark, d):
    """All documents as files, through the default strategy into a store."""
    out = new_path(spark, "ingested")
    if not run_ingest(spark, _folder(spark, d), out, IngestOptions()):
        raise RuntimeError("nothing was ingested")
    chunks, _ = st.load_store(spark, out)
    return _words_per_folder(chunks)


def _words_per_folder(chunks):
    from passagemill.functions.text import count_tokens

    return chunks.groupBy(F.regexp_extract("source_file", "source=([^/]*)/", 1).alias("folder")).agg(
        (F.count(F.lit(1)) > 0).alias("filled"), F.sum(count_tokens(F.col("text"))).alias("words")
    )


@check(
    "incremental_ingest",
    f"""SELECT source AS folder, count(*) > 0 AS filled, sum({f"len(regexp_extract_all({clean('text')}, '[^ ]+'))"})::BIGINT AS words
        FROM documents GROUP BY source""",
)
def incremental(spark, d):
    """The same folder through the file stream."""
    out = new_path(spark, "streamed")
    query = incremental_ingest(
        spark, _folder(spark, d), out, new_path(spark, "stream-state"), IngestOptions(strategy="sentence")
    )
    query.awaitTermination()
    return _words_per_folder(current_chunks(spark, out))


_VERSIONS = f"""
  SELECT source_file, st // 256 AS chunk_order, array_to_string(ws[st + 1:st + 256], ' ') AS text
  FROM (SELECT *, unnest(range(0, len(ws), 256)) AS st FROM (
    SELECT source_file, {words('t')} AS ws FROM (
      SELECT doc_id || '.txt' AS source_file, {clean("text || CASE WHEN doc_id % 4 = 1 THEN ' and a changed end' ELSE '' END")} AS t
      FROM documents WHERE doc_id % 4 <> 2
      UNION ALL SELECT '_late/' || doc_id || '.txt', {clean('text')} FROM documents WHERE doc_id % 8 = 3
      UNION ALL SELECT 'later/' || doc_id || '.txt', {clean('text')} FROM documents WHERE doc_id % 8 = 5)))"""


@check("store_versions", f"SELECT source_file, chunk_order::INTEGER AS chunk_order, text FROM ({_VERSIONS})")
def store_versions(spark, d):
    """Stream, changed, new and deleted files by refresh, then the stream again, in one store; its newest version."""
    docs = table(spark, d, "documents")
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    name = F.concat(n.cast("string"), F.lit(".txt"))
    file = lambda rows, name, content: rows.select(name.alias("source_file"), F.encode(content, "UTF-8").alias("content"))
    root = written_files(file(docs.filter(n % 4 != 0), name, text))
    out, state, options = new_path(spark, "versions"), new_path(spark, "stream-state"), IngestOptions(strategy="token")
    incremental_ingest(spark, root, out, state, options).awaitTermination()
    changed = F.when(n % 4 == 1, F.concat(text, F.lit(" and a changed end"))).when(n % 4 == 0, text)
    written_files(file(docs.filter(n % 4 != 3), name, changed), root)
    written_files(file(docs.filter(n % 8 == 3), F.concat(F.lit("_late/"), name), text), root)
    refresh_store(spark, root, out, options)
    written_files(file(docs.filter(n % 8 == 5), F.concat(F.lit("later/"), name), text), root)
    incremental_ingest(spark, root, out, state, options).awaitTermination()
    if refresh_store(spark, root, out, options) != -1:
        raise RuntimeError("the store was in line with the folder already")
    chunks, _ = st.load_store(spark, out)
    return chunks.select("source_file", "chunk_order", "text")


@check(
    "unique_part_ids",
    """SELECT conv_id, turn, 'conv_' || conv_id || CASE WHEN turn > 0 THEN '_d' || turn ELSE '' END AS part_id
       FROM conversations""",
)
def unique_ids(spark, d):
    from passagemill.sources.documents import unique_part_ids

    parts = table(spark, d, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("part_id"),
        F.lit("f").alias("source_file"),
        F.col("turn").alias("part_order"),
        "conv_id",
        "turn",
    )
    return unique_part_ids(parts).select("conv_id", "turn", "part_id")


@check("schema_conformance", twin("SELECT count(*) AS chunks, 0::BIGINT AS unlabelled FROM chunks"))
def conformance(spark, d):
    """Chunks in the canonical layout, labelled."""
    full = embed_hashed(classify_zero_shot(token_chunks(spark, d), labels(spark, d)))
    shaped = schemas.conform(full, schemas.CHUNK_FIELDS)
    return shaped.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum(F.col("top_label").isNull().cast("bigint")), F.lit(0)).alias("unlabelled"),
    )
