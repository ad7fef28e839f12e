"""From raw documents to packed sequences: five stages, each on what the one before kept.

Each stage is a function of (spark, docs, sf_dir) and gives back a DataFrame; all
but the last have the columns of ``documents``. :func:`run` writes the result of
a stage to the shared folder and reads it again as the next one's ``docs``.

1. quality rules: documents that fail a rule go.
2. exact dedup: one row of each group of equal texts stays.
3. MinHash near-dedup: one row of each component of similar texts stays (five
   words, similarity 0.8).
4. secret scans: reported spans are replaced in the text, no document goes.
5. packing: the pieces of all documents with their place in a sequence.

Null texts count as empty and fail the quality rules; an empty table passes
through all stages as an empty table. Rows that repeat an id are judged by their
texts; of equal texts the longest stays, then the smallest id (null last), then
the first row. Columns beside ``doc_id text lang source`` may have any name and
keep their values up to the last stage, but ``n_chars`` follows a masked text.
"""

from __future__ import annotations

import functools
import threading
from collections import defaultdict
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import exact_dedup, minhash, packing, quality, secret_scan
from passagemill.session import configure, delete_paths, load_table, materialize, recorded


_left: dict[tuple[str, str, int], list[str]] = defaultdict(list)


def left_by(spark: SparkSession, sf_dir: str) -> list[str]:
    """Intermediate tables of the last stage over this folder in this session and thread, so runs beside each other keep theirs."""
    return _left[spark.sparkContext.applicationId, sf_dir, threading.get_ident()]


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that first deletes the intermediate tables of the stage before it.

    The result of the stage before has been written and read again by then, so
    nothing reads them any more; the disk holds those of one stage at a time.
    In one thread and folder a stage's result must be written before the next is called.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        left = left_by(spark, sf_dir)
        delete_paths(spark, left)
        left.clear()
        with recorded() as paths:
            result = work(spark, docs, sf_dir)
        left.extend(paths)
        return result

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs)


@stage
def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


@stage
def keep_first_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = dict(docs.dtypes)["n_chars"]
    return masked.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.PackOptions(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", keep_first_copies),
    ("MinHash near-dedup", keep_first_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

# The merges of the tokenizer and the component search cannot be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = load_table(configure(spark), sf_dir, "documents")
    for name, work in STAGES:
        docs = materialize(work(spark, docs, sf_dir), name.replace(" ", "-"))
    delete_paths(spark, left_by(spark, sf_dir))
    _left.pop((spark.sparkContext.applicationId, sf_dir, threading.get_ident()), None)
    return docs
