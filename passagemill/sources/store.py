"""The chunk store: runs of Parquet chunks, and commits that say which of them count.

    chunks/run=R/         the chunks of one run
    files/run=R/          the files the run took, and those it found gone
    parse_errors/run=R/   errors of the run
    commits/N.json        the N-th commit: its run, its manifest, whether it replaces all before

A run writes to a folder of its own, is checked there, and counts from the
moment its commit is there, which is put in place by one rename. So a failed
run changes nothing, a reader sees one version throughout, and older versions
stay readable until :func:`drop_old_runs`. A chunk belongs to a version if no later
commit of that version names its file.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.vectors import check_metric
from passagemill.session import delete_paths

LABEL_PREVIEW = 10
POINT_SCHEMA = (
    "id string, x double, y double, source_file string, display_source string, classification string, snippet string"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds readable text or Parquet files."""
    try:
        spark.read.text(path).schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def build_manifest(
    *,
    model: str,
    dimension: int | None,
    metric: str | None,
    chunker: str,
    chunk_params: dict[str, Any] | None = None,
    source: str = "",
    classifier: str | None = None,
    labels: list[str] | None = None,
    label_count: int | None = None,
    config: dict[str, Any] | None = None,
) -> dict[str, Any]:
    """Run metadata; a label list is only previewed, so its first ones and their number will do."""
    summary = {k: str(v) for k, v in (config or {}).items() if k not in ("candidate_labels", "config_file")}
    if labels:
        count = len(labels) if label_count is None else label_count
        summary["candidate_labels_count"] = str(count)
        preview = labels[:LABEL_PREVIEW] + (["..."] if count > LABEL_PREVIEW else [])
        summary["candidate_labels_preview"] = json.dumps(preview)
    return {
        "embedding_model": model,
        "vector_dimension": dimension,
        "metric": check_metric(metric),
        "source_docs_folder": source,
        "run_date": datetime.now(timezone.utc).isoformat(),
        "classification_enabled": classifier is not None,
        "classifier_model": classifier,
        "chunker": chunker,
        "chunk_params": {k: str(v) for k, v in (chunk_params or {}).items()},
        "config_summary": summary,
    }


MANIFEST_SCHEMA = (
    "embedding_model string, vector_dimension int, metric string, source_docs_folder string, run_date string, "
    "classification_enabled boolean, classifier_model string, chunker string, chunk_params map<string,string>, "
    "config_summary map<string,string>"
)


def manifest_frame(spark: SparkSession, manifest: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame([manifest], MANIFEST_SCHEMA)


def write_manifest(spark: SparkSession, manifest: dict[str, Any], path: str) -> None:
    manifest_frame(spark, manifest).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def store_counts(chunks: DataFrame) -> DataFrame:
    """The invariants of a store, in one pass over ids and vector sizes."""
    sized = chunks.select(
        "chunk_id",
        F.col("text").isNull().cast("int").alias("no_text"),
        F.when(F.col("vector").isNull(), 1).otherwise(0).alias("no_vector"),
        F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"),
    )
    # Ids are counted by themselves first, so a hot id is only a count.
    per_id = sized.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("no_text").alias("no_text"), F.sum("no_vector").alias("no_vector"),
        F.min("dim").alias("low"), F.max("dim").alias("high"),
    )
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.count("chunk_id").alias("ids"),
        F.coalesce(F.sum("no_text"), F.lit(0)).alias("missing_texts"),
        F.coalesce(F.sum("no_vector"), F.lit(0)).alias("missing_vectors"),
        F.min("low").alias("min_dim"),
        F.max("high").alias("max_dim"),
    )


def validate_store(chunks: DataFrame) -> DataFrame:
    """Counts and ``valid``: as many texts, ids and vectors as items, one width."""
    ok = (
        (F.col("items") > 0)
        & (F.col("items") == F.col("ids"))
        & (F.col("missing_texts") == 0)
        & (F.col("missing_vectors") == 0)
        & (F.col("min_dim") == F.col("max_dim"))
        & (F.col("min_dim") > 0)
    )
    return store_counts(chunks).withColumn("valid", F.coalesce(ok, F.lit(False)))


FILE_LOG = "source_file string, modificationTime timestamp, length bigint, deleted boolean"


class CommitConflict(RuntimeError):
    """Another run was committed first."""


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """All commits of a store in order: one small record per run."""
    folder, store = _hadoop(spark, f"{path}/commits")
    if not store.exists(folder):
        return []
    found = []
    for status in store.listStatus(folder):
        if status.getPath().getName().endswith(".json"):
            stream = store.open(status.getPath())
            try:
                found.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
    return sorted(found, key=lambda c: c["version"])


def new_run() -> str:
    return uuid.uuid4().hex


def publish(
    spark: SparkSession, path: str, run: str, manifest: dict[str, Any], *, version: int, replaces: bool, n_chunks: int
) -> int:
    """Make a checked run count as the given version; fails if that version is there already."""
    record = {"version": version, "run": run, "replaces": replaces, "n_chunks": n_chunks, "manifest": manifest}
    final, store = _hadoop(spark, f"{path}/commits/{version:020d}.json")
    hidden, _ = _hadoop(spark, f"{path}/commits/.{run}.tmp")
    stream = store.create(hidden, True)
    stream.write(bytearray(json.dumps(record).encode()))
    stream.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    place = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), store.getConf())
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        place.rename(place.makeQualified(hidden), place.makeQualified(final), options)
    except Py4JJavaError as e:
        store.delete(hidden, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise CommitConflict(f"version {version} of {path} was committed by another run") from e
        raise
    return version


def refuse_existing(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Fail before any work is done."""
    if not overwrite and commits(spark, path):
        raise FileExistsError(f"a store exists at {path}; pass overwrite=True to replace it")


def write_run(
    chunks: DataFrame, path: str, run: str, files: DataFrame | None = None, errors: DataFrame | None = None
) -> dict[str, Any]:
    """Write a run to its own folders and return its counts. Written again, it replaces itself."""
    spark = chunks.sparkSession
    place = f"{path}/chunks/run={run}"
    chunks.write.mode("overwrite").parquet(place)
    written = spark.read.schema(chunks.schema).parquet(place)
    if files is None and "source_file" in chunks.columns:
        files = written.select("source_file").distinct()
    if files is not None:
        log = {"modificationTime": "timestamp", "length": "bigint", "deleted": "boolean"}
        whole = files.select(
            "source_file", *[(F.col(c) if c in files.columns else F.lit(None)).cast(t).alias(c) for c, t in log.items()]
        )
        whole.fillna(False, ["deleted"]).write.mode("overwrite").parquet(f"{path}/files/run={run}")
    if errors is not None:
        errors.write.mode("overwrite").json(f"{path}/parse_errors/run={run}")
    return validate_store(written).first().asDict()


def write_store(
    chunks: DataFrame,
    manifest: dict[str, Any],
    path: str,
    *,
    overwrite: bool = False,
    cluster_by_id: bool = False,
    files: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Write chunks to a folder of their own, check them, then commit them as all that the store holds.

    A failed write leaves the store as it was. ``cluster_by_id`` sorts the table by id, so that point lookups read few
    row groups; it costs a shuffle of the store.
    """
    spark = chunks.sparkSession
    refuse_existing(spark, path, overwrite)
    before = commits(spark, path)
    out = chunks
    if cluster_by_id:
        out = chunks.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
    run = new_run()
    report = write_run(out, path, run, files, errors)
    if not report["valid"]:
        delete_run(spark, path, run)
        raise ValueError(f"invalid store: {report}")
    version = before[-1]["version"] + 1 if before else 0
    held = {**manifest, "vector_dimension": report["max_dim"]}
    publish(spark, path, run, held, version=version, replaces=True, n_chunks=report["items"])
    return spark.read.parquet(f"{path}/chunks/run={run}")


def delete_run(spark: SparkSession, path: str, run: str) -> None:
    delete_paths(spark, [f"{path}/{kind}/run={run}" for kind in ("chunks", "files", "parse_errors")])


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> list[dict[str, Any]]:
    """The commits that make up a version, the newest if none is given: from the last one that replaced all."""
    known = [c for c in commits(spark, path) if version is None or c["version"] <= version]
    if not known or (version is not None and known[-1]["version"] != version):
        raise FileNotFoundError(f"no store at {path}" if version is None else f"no version {version} at {path}")
    first = max((i for i, c in enumerate(known) if c["replaces"]), default=0)
    return known[first:]


def _numbered(spark: SparkSession, held: list[dict[str, Any]]) -> DataFrame:
    """Run and version of each commit; one small row per run."""
    return F.broadcast(spark.createDataFrame([(c["run"], c["version"]) for c in held], "run string, version bigint"))


def file_log(spark: SparkSession, path: str, held: list[dict[str, Any]]) -> DataFrame:
    """What the runs of some commits say of files: ``FILE_LOG``, ``run`` and ``version``."""
    places = [f"{path}/files/run={c['run']}" for c in held]
    there = [p for p in places if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], f"{FILE_LOG}, run string, version bigint")
    rows = spark.read.schema(f"{FILE_LOG}, run string").option("basePath", f"{path}/files").parquet(*there)
    return rows.join(_numbered(spark, held), "run")


def current_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files of a version as their newest run saw them, without those that are gone."""
    log = file_log(spark, path, snapshot(spark, path, version))
    seen = F.max_by(F.struct("modificationTime", "length", "deleted", "version"), "version").alias("seen")
    return log.groupBy("source_file").agg(seen).filter("NOT seen.deleted").select("source_file", "seen.*").drop("deleted")


def current_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of a version: those of each run, less files that a later run took again or found gone."""
    held = snapshot(spark, path, version)
    places = [f"{path}/chunks/run={c['run']}" for c in held if c["n_chunks"]]
    if not places:
        return spark.read.parquet(f"{path}/chunks/run={held[0]['run']}")
    if len(held) == 1:
        return spark.read.parquet(places[0])
    rows = spark.read.option("basePath", f"{path}/chunks").parquet(*places).join(_numbered(spark, held), "run")
    later = file_log(spark, path, held[1:]).groupBy("source_file").agg(F.max("version").alias("newest"))
    return (
        rows.join(later, "source_file", "left")
        .filter(F.col("newest").isNull() | (F.col("newest") <= F.col("version")))
        .drop("newest", "run", "version")
    )


def drop_old_runs(spark: SparkSession, path: str) -> int:
    """Delete runs that the newest version does not need, failed ones among them; returns how many commits went.

    No other run may be under way, and versions before become unreadable.
    """
    held = snapshot(spark, path)
    needed = {c["run"] for c in held}
    for kind in ("chunks", "files", "parse_errors"):
        folder, store = _hadoop(spark, f"{path}/{kind}")
        for status in store.listStatus(folder) if store.exists(folder) else ():
            name = status.getPath().getName()
            if name.startswith("run=") and name.removeprefix("run=") not in needed:
                store.delete(status.getPath(), True)
    old = [c for c in commits(spark, path) if c["version"] < held[0]["version"]]
    delete_paths(spark, [f"{path}/commits/{c['version']:020d}.json" for c in old])
    return len(old)


def export_supporting_data(chunks: DataFrame, path: str) -> None:
    """Texts, ids and metadata as JSON lines beside the store."""
    chunks.drop("vector").write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any]:
    return snapshot(spark, path, version)[-1]["manifest"]


def load_store(
    spark: SparkSession,
    path: str,
    *,
    model: str | None = None,
    dimension: int | None = None,
    version: int | None = None,
) -> tuple[DataFrame, dict[str, Any]]:
    """``(chunks, manifest)`` of the newest version, or of another one. Queries must use the model the store was made with."""
    manifest = load_manifest(spark, path, version)
    for name, wanted in (("embedding_model", model), ("vector_dimension", dimension)):
        if wanted is not None and manifest[name] != wanted:
            raise ValueError(f"store has {name} {manifest[name]!r}, the query uses {wanted!r}")
    return current_chunks(spark, path, version), manifest


def store_status(chunks: DataFrame | None, manifest: dict[str, Any] | None, spark: SparkSession) -> DataFrame:
    """One row: loaded or not, number of items, model and metric."""
    info = manifest or {}
    fixed = [
        F.lit(info.get("embedding_model")).cast("string").alias("embedding_model"),
        F.lit(info.get("metric")).cast("string").alias("metric"),
        F.lit(info.get("vector_dimension")).cast("int").alias("vector_dimension"),
    ]
    if chunks is None:
        return spark.range(1).select(F.lit(False).alias("store_loaded"), F.lit(0).cast("bigint").alias("items"), *fixed)
    return chunks.agg(F.count(F.lit(1)).alias("items")).select(F.lit(True).alias("store_loaded"), "items", *fixed)


def write_viz_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").json(path)


def read_viz_points(spark: SparkSession, path: str) -> DataFrame:
    """Saved plot points; a row that is not a point fails the read."""
    return spark.read.schema(POINT_SCHEMA).option("mode", "FAILFAST").json(path)
