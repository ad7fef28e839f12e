from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.functions.markup import markup_text, without_xml_tags
from passagemill.functions import text as tx
from passagemill.options import RAG_PROMPT, overlap_tokens, parse_threshold, strategy_options
from passagemill.sources.structured import leaves


def _python_clean(text):
    return re.sub(r"\s+", " ", text or "").replace("\x00", "").strip()


def _one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x"))).first()[0]


SAMPLES = [
    None, "", " ", "a  b", " a \x00 b ", "\x1ca\x1fb", "a​b", "　x　", "tab\tline\nend\r\n",
    "\x85next", "é́ ß", "\x00", "a\x0bb\x0cc",
]


def test_clean_text_and_counts(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, x string")
    got = rows.select("i", tx.clean_text(F.col("x")), tx.count_tokens(F.col("x")), tx.is_blank(F.col("x"))).orderBy("i")
    for (_, clean, tokens, blank), given_text in zip(got.collect(), SAMPLES):
        assert clean == _python_clean(given_text), repr(given_text)
        assert tokens == len((given_text or "").split())
        assert blank == (_python_clean(given_text) == "")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_clean_text_on_any_text(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(tx.clean_text(F.col("x"))).collect()]
    assert got == [_python_clean(t) for t in texts]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("a/b c.txt", "a_b_c.txt"), ("__x__", "x"), ("..", "unknown_file_component"), ("é", "unknown_file_component"),
        ("a--_.b-", "a--_.b"), ("", "unknown_file_component"), ("x/é/y", "x_y"),
    ],
)
def test_sanitize_id(spark, name, expected):
    assert _one(spark, name, tx.sanitize_id) == expected


def test_display_names(spark):
    row = spark.range(1).select(
        tx.display_source_name(F.lit("d/sample.csv"), row_index=F.lit(0), chunk_order=F.lit(0)).alias("a"),
        tx.display_source_name(F.lit("sample.txt")).alias("b"),
        tx.display_source_name(F.lit(None).cast("string"), page_number=F.lit(3)).alias("c"),
    ).first()
    assert tuple(row) == ("sample.csv (Row:1, Chk:1)", "sample.txt", "UnknownSource (P:3)")


def test_templates(spark):
    values = {"context": F.lit("{query} C"), "query": F.lit("Q")}
    got = spark.range(1).select(tx.fill_template("{{x}} {context}|{query}", values)).first()[0]
    assert got == "{x} {query} C|Q"
    fallback = spark.range(1).select(tx.build_messages(F.lit("Q"), F.lit("C"), "{unknown} {context}")).first()[0]
    assert fallback[0]["content"] == RAG_PROMPT.replace("{context}", "C")


def test_cited_tags(spark):
    answer = "[Source 3] [source 1][SOURCE 2] [Source 3] [Source x] [Source 99999999999999999999]"
    assert _one(spark, answer, tx.cited_tags) == [1, 2, 3]


def test_chat_response(spark):
    cases = {
        '{"choices":[{"message":{"content":" hi\\n"}}]}': "hi",
        '{"choices":[{"message":{"content":""},"delta":{"content":"d"}}]}': "d",
        '{"choices":[]}': None,
        "broken": None,
    }
    for body, expected in cases.items():
        assert _one(spark, body, tx.parse_chat_response) == expected


def test_leaves():
    value = {"root": {"x": 1}, "a": [None, True, {"b": 1.0}], "e": {}, "f": [], "s": "t"}
    assert list(leaves(value)) == [("x", "1"), ("a.[1]", "True"), ("a.[2].b", "1.0"), ("s", "t")]
    assert list(leaves(5)) == [("root", "5")]


def test_options():
    assert parse_threshold("Smart") == "auto" and parse_threshold("50") == 50.0
    assert strategy_options("sdpm", chunk_size=99, threshold="0.4").chunk_size == 99
    assert overlap_tokens(0.25, 256) == 64 and overlap_tokens(10, 256) == 10
    with pytest.raises(ValueError):
        strategy_options("nothing")
    with pytest.raises(ValueError):
        overlap_tokens(256, 256)


def test_cdata_is_text_not_markup(spark):
    long = "<r>" + "word " * 200_000 + "<![CDATA[a < b]]></r>"
    given = ["<r>one<![CDATA[if x <b> &amp; y]]>two</r>", "<r>a &lt; b</r>", "<r><![CDATA[open</r>", None, long]
    df = spark.createDataFrame(list(enumerate(given)), "n int, x string").withColumn("raw", without_xml_tags(F.col("x")))
    got = [r.t for r in df.select("n", markup_text(F.col("raw")).alias("t")).orderBy("n").collect()]
    assert got[:2] == ["oneif x <b> &amp; ytwo", "a < b"] and got[3] in (None, "")
    assert got[4].endswith("word a < b") and got[4].count("word") == 200_000
