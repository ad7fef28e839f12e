"""Keeping a store up to date with a folder, file by file.

The stream and :func:`refresh_store` add runs to one store, and every run is a
commit of its own, so both may be used on one store in any order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.plans.ingest import IngestOptions, chunks_of_parts, manifest_of
from passagemill.session import delete_paths, materialize, recorded
from passagemill.sources import store as st
from passagemill.sources.documents import parse_errors, parse_listed, parts_of
from passagemill.sources.files import FILE_SCHEMA, list_source_files, with_source_file

SEEN = ["source_file", "modificationTime", "length"]
TRIES = 20
# Spark lists the new files of a batch one by one, in up to 10,000 tasks by itself, and reads only their names and sizes.
LISTED_BY_A_CORE = 8
NAME_COST = 16 << 10


def ingest_run(
    files: DataFrame, out: str, options: IngestOptions, run: str, *, gone: DataFrame | None = None, at: int | None = None
) -> int:
    """Commit the parts of listed ``files``, and the files that are ``gone``, as one run; returns its version.

    A run of a name that was committed before adds nothing. With ``at`` the
    run is made for that version and fails if another run took it; without,
    it takes the next free one.
    """
    spark = files.sparkSession
    done = [c for c in st.commits(spark, out) if c["run"] == run]
    if done:
        return done[0]["version"]
    with recorded() as paths:
        parsed = materialize(parse_listed(files, pdf_extractor=options.pdf_extractor), "parsed")
        chunks = chunks_of_parts(parts_of(parsed), options)
        log = files.select(*SEEN, F.lit(False).alias("deleted"))
        if gone is not None:
            log = log.unionByName(gone.select("source_file").withColumn("deleted", F.lit(True)), allowMissingColumns=True)
        report = st.write_run(chunks, out, run, log, parse_errors(parsed))
        if report["items"] and not report["valid"]:
            st.delete_run(spark, out, run)
            raise ValueError(f"invalid run: {report}")
    delete_paths(spark, paths)
    for _ in range(TRIES):
        before = st.commits(spark, out)
        version = at if at is not None else before[-1]["version"] + 1 if before else 0
        width = report["max_dim"] or (before[-1]["manifest"]["vector_dimension"] if before else None)
        if before and report["max_dim"] and before[-1]["manifest"]["vector_dimension"] not in (None, report["max_dim"]):
            st.delete_run(spark, out, run)
            raise ValueError(f"the store has vectors of {before[-1]['manifest']['vector_dimension']}, the run of {report['max_dim']}")
        manifest = {**manifest_of(options, ""), "vector_dimension": width}
        try:
            return st.publish(spark, out, run, manifest, version=version, replaces=False, n_chunks=report["items"])
        except st.CommitConflict:
            if at is not None:
                st.delete_run(spark, out, run)
                raise
    raise st.CommitConflict(f"no free version at {out}")


def listing_session(spark: SparkSession) -> SparkSession:
    """A copy of the session for a stream, in which many files are listed in few tasks."""
    held = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    tasks = LISTED_BY_A_CORE * spark.sparkContext.defaultParallelism
    held.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks))
    held.conf.set("spark.sql.files.openCostInBytes", str(NAME_COST))
    return held


def incremental_ingest(
    spark: SparkSession, root: str, out: str, checkpoint: str, options: IngestOptions | None = None
) -> StreamingQuery:
    """Ingest the files that are new since the last run, then stop.

    A batch that is tried again has the name of the first try, so it is
    committed once. Only names and sizes come from the stream; files are read
    as in a batch, whatever their length. Spark's stream does not list names
    that begin with an underscore, nor changes: :func:`refresh_store` does.
    """
    options = options or IngestOptions()
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    source = (
        listing_session(spark).readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)
    )

    def take(batch_rows: DataFrame, batch: int) -> None:
        with recorded() as paths:
            listed = materialize(batch_rows, "batch")
            if not listed.isEmpty():
                ingest_run(listed, out, options, f"stream-{stream}-{batch}")
        delete_paths(spark, paths)

    return (
        with_source_file(source, root)
        .drop("content")
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(take)
        .start()
    )


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the newest version of each file."""
    return st.current_chunks(spark, out)


def refresh_store(spark: SparkSession, root: str, out: str, options: IngestOptions | None = None) -> int:
    """Bring a store in line with a folder: files that are new, changed by time or size, or gone, as one commit.

    Returns the version, or -1 if nothing changed. Fails, and changes
    nothing, if another run is committed meanwhile.
    """
    options = options or IngestOptions()
    before = st.commits(spark, out)
    at = before[-1]["version"] + 1 if before else 0
    with recorded() as paths:
        files, gone = materialize(list_source_files(spark, root), "listing"), None
        if before:
            known = materialize(st.current_files(spark, out, at - 1), "known").select(*SEEN)
            gone = known.join(files, "source_file", "left_anti")
            files = files.join(known, SEEN, "left_anti").select(*files.columns)
        version = -1
        if not files.isEmpty() or (gone is not None and not gone.isEmpty()):
            version = ingest_run(files, out, options, st.new_run(), gone=gone, at=at)
    delete_paths(spark, paths)
    return version
