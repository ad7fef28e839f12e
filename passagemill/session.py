"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that are safe to change on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Rows may be whole files; a batch then holds few of them.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("passagemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Settings and code that a given session needs."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_code(spark, "passagemill")
    return spark


_shipped: set[tuple[str, str]] = set()


def ship_code(spark: SparkSession, package: str) -> None:
    """Send a package beside this one to the Python workers, once per session.

    The archive is only built on the driver; Spark copies it to the executors.
    """
    context = spark.sparkContext
    if (context.applicationId, package) in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="passagemill-code-")) / f"{package}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((root / package).rglob("*.py")):
            z.write(source, source.relative_to(root).as_posix())
    context.addPyFile(str(archive))
    _shipped.add((context.applicationId, package))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can write to: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, since a machine-local folder would be lost
    with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    folder = tempfile.mkdtemp(prefix="passagemill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The list of all paths that :func:`new_path` gives out meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables whose readers are done."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of a few small files one task per core.

    A scan that already has at least one partition per core is left alone, so
    large inputs are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    return df.repartition(cores)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
