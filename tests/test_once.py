"""Costly steps run once per row, and the faster forms of text functions give what the plain ones gave."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.functions import vectors as vec
from passagemill.operators import sentences as sen
from passagemill.operators.boundaries import group_starts
from passagemill.operators.classify import classify_zero_shot, label_table
from passagemill.operators.embedding import embed_hashed
from passagemill.operators.projection import project_2d
from tests.test_text import SAMPLES


def _evaluations(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_vectors_and_scores_are_worked_out_once(spark):
    chunks = spark.createDataFrame([("a", "red dog"), ("b", None), ("c", "")], "chunk_id string, text string")
    rows = embed_hashed(chunks).select("chunk_id", F.posexplode("vector").alias("i", "x"))
    assert _evaluations(rows) == 1
    assert {r["chunk_id"] for r in rows.collect()} == {"a", "b", "c"}
    scored = classify_zero_shot(chunks, label_table(spark, ["dog", "cat"]))
    told = scored.select("chunk_id", F.explode(F.arrays_zip("labels", "scores")).alias("x"))
    assert _evaluations(told) == 1 and told.count() == 6


def test_a_layout_goes_over_its_points_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        seen.add(1)
        return [float(i), float(i * i % 7), 1.0]

    points = spark.range(20).select(F.col("id").alias("chunk_id"), vector("id").alias("vector"))
    assert project_2d(points).filter("x IS NOT NULL").count() == 20
    assert seen.value == 20


def test_words_windows_and_counts_of_odd_texts(spark):
    texts = [*SAMPLES, "a", "a b c d e", "a b  c", "a b c", "a\nb", " a b", "a b ", "x y z", "\x00 a", "a﻿b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i")
    x = F.col("x")
    got = rows.select(tx.words(x), tx.count_tokens(x), sen.token_windows(x, 2, 0), sen.token_windows(x, 1, 0)).collect()
    for text, (words, count, pairs, ones) in zip(texts, got):
        found = None if text is None else re.findall(r"[^\s\x1c-\x1f]+", text)
        assert words == found and count == len(found or [])
        assert pairs == [" ".join(found[i : i + 2]) for i in range(0, len(found), 2)] if found else pairs == []
        assert ones == (found or [])


def test_terms_are_hashed_as_before(spark, monkeypatch):
    texts = [*SAMPLES, "Straße STRASSE ½ x2 İ Σς", "a a b", ", ."]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i")
    terms = [r[0] or [] for r in rows.select(tx.terms(F.col("x"))).collect()]
    want = np.zeros((len(texts), 8), np.float32)
    for row, some in zip(want, terms):
        for t in some:
            code = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16
            row[code % 8] += 1 if code < 8 else -1
    assert [r[0] for r in rows.select(vec.hashed_vector(F.col("x"), 8)).collect()] == want.tolist()
    joined = pa.array([" ".join(some) for some in terms] + [None])
    monkeypatch.setattr(vec, "SLICE_TERMS", 1)
    assert vec.term_matrix(joined, 8)[:-1].tolist() == want.tolist()


def test_groups_do_not_depend_on_the_slice(monkeypatch):
    units = [["a b", "a b c", "x y", None, "x y z", "a"], [], ["q", "q q"], None, ["m n", "a m", "a b", "b"]]
    parts = pa.array(units, pa.list_(pa.string()))
    for window in (1, 3):
        for mode, skip in (("window", 0), ("cumulative", 0), ("window", 2)):
            kernel = group_starts(64, "auto", window, mode, skip)
            whole = kernel(parts).to_pylist()
            with monkeypatch.context() as m:
                m.setattr("passagemill.operators.boundaries.SLICE_UNITS", 2)
                assert kernel(parts).to_pylist() == whole


def test_a_batch_holds_few_long_rows(spark):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    long = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("x"), 4 << 20).alias("text"))
    assert long.mapInArrow(rows, "rows bigint").agg(F.max("rows")).first()[0] <= 3
