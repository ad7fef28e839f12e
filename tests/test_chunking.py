from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from passagemill.functions.text import count_tokens
from passagemill.operators import sentences as sen
from passagemill.operators.chunking import chunk_documents
from passagemill.session import load_table
from passagemill.sources.documents import parts_from_table
from tests.conftest import TABLES


@pytest.fixture(scope="module")
def parts(spark):
    docs = load_table(spark, str(TABLES), "documents")
    return parts_from_table(docs, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text")).persist()


@pytest.mark.parametrize("strategy", ["token", "sentence", "recursive", "semantic", "sdpm"])
def test_chunks_keep_all_words(spark, parts, strategy):
    size = 40
    chunks = chunk_documents(parts, strategy, chunk_size=size)
    per = chunks.groupBy("part_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_order", "text"))).alias("c")
    ).collect()
    whole = {r["part_id"]: r["text"] for r in parts.select("part_id", "text").collect()}
    assert {r["part_id"] for r in per} == set(whole)
    for r in per:
        assert [c["chunk_order"] for c in r["c"]] == list(range(len(r["c"])))
        joined = ("" if strategy == "recursive" else " ").join(c["text"] for c in r["c"])
        assert joined.split() == whole[r["part_id"]].split()
        if strategy == "recursive":
            assert joined == whole[r["part_id"]]
    ids = chunks.agg(F.count(F.lit(1)), F.countDistinct("chunk_id")).first()
    assert ids[0] == ids[1]
    if strategy in ("token", "recursive"):
        assert chunks.agg(F.max(count_tokens(F.col("text")))).first()[0] <= size


@pytest.mark.parametrize("strategy", ["sentence", "sdpm"])
def test_partitioning_does_not_matter(parts, strategy):
    def rows(n):
        return sorted(map(tuple, chunk_documents(parts.repartition(n), strategy).select("chunk_id", "text").collect()))

    assert rows(1) == rows(7)


def _python_sentences(text, low):
    raw = re.split(r"(?<=[.!?]) ", text) if text else []
    out = []
    for i, s in enumerate(raw):
        if out and (len(s) < low or (i == 1 and len(raw[0]) < low)):
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def test_sentences_by_hand(spark):
    texts = ["", "One.", "Hi. This is longer text here. No. And another long sentence! Ok? Yes.", "A. B. C. D.", "no stop at all"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.orderBy("i").select(sen.sentences(F.col("t"), 12)).collect()
    assert [r[0] for r in got] == [_python_sentences(t, 12) for t in texts]


def test_sentence_overlap(spark):
    text = "Aa bb cc. Dd ee ff. Gg hh ii. Jj kk ll."
    row = spark.createDataFrame([(text,)], "t string").select(sen.sentence_chunks(F.col("t"), 6, 3, 1, 0)).first()[0]
    assert row == ["Aa bb cc. Dd ee ff.", "Dd ee ff. Gg hh ii. Jj kk ll."]


def test_recursive_prefers_coarse_cuts(spark):
    text = "one two three; four five six. " * 4
    rows = spark.createDataFrame([(text.strip(),)], "t string")
    got = rows.select(sen.recursive_chunks(F.col("t"), 6, 0, sen.RECIPES["default"])).first()[0]
    assert "".join(got) == text.strip() and all(g.strip().endswith("six.") for g in got)


def test_boundary_model_failures(spark, parts):
    def broken(windows):
        if any("the" in w for w in windows):
            raise RuntimeError("model failed")
        return [[0.0] * len(w) for w in windows]

    got = chunk_documents(parts, "boundary", scorer=broken)
    failed = got.filter(F.col("chunking_error").isNotNull())
    first = F.col("chunk_order") == 0
    assert failed.count() > 0 and failed.filter(first & ~F.col("chunk_id").endswith("_chunk_0")).count() == 0
    assert got.select("part_id").distinct().count() == parts.count()
    missing = chunk_documents(parts, "boundary")
    assert missing.filter(first & ~F.col("chunk_id").endswith("_chunk_0_init_fail")).count() == 0
    # Nothing of a part is left out.
    words = lambda df: {r[0]: r[1] for r in df.groupBy("part_id").agg(F.sum(F.size(F.split(F.trim("text"), " +")))).collect()}
    assert words(missing) == words(parts)


def test_cumulative_mode(parts):
    chunks = chunk_documents(parts, "semantic", mode="cumulative", threshold=0.5)
    assert chunks.select("part_id").distinct().count() == parts.count()
