"""Long JSON files read in ranges give the leaves, and the errors, of a whole read."""

from __future__ import annotations

import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.sources import json_ranges as js
from passagemill.sources.documents import parse_errors, parse_folder, parts_of
from passagemill.sources.splits import json_stream_leaves

GOOD = ['{"a": {"b": [1, 2.5, "x\\\\\\"]}", [], {}], "root": {"c": true}}, "a": null, "d": "e\\u00e9 é€"}', "[]", " 7 ", ' "s, {" ', "[[[1], {}]]",
        '{"root": {"inner": 1}, "root": {"k": [[], ["a", "b"], -12.5e3]}}', "1e5", '[NaN,\n-0.0 , "\\\\"]', '{"":{"":[0,{"x":""}]}}']
BROKEN = ["", "  ", "{", "[1,]", '{"a" 1}', '{"a": 1,}', "[1 2]", "[1]]", "{]", '"open', '["x\\', "tru", "[tru, 1]", "[1}", "{1: 2}", '{"a": 1} x', ",", "[,1]",
          "[12\x0b]", "[12\x0b34]", "[12\x85]", "[1é]", "[1, é]", '{"a": "\n"}', '{"a\\q": [1, 2, 3]}', '["a"b"c"]', "[﻿1]", "\\[1]", '["a" "b"]',
          '{"a": {"b": 1}}}', "[1], [2]", '{"a", "b"}', '["a": 1]', "[[1, 2]", '{"a": [1, 2}']


def by_ranges(path, split_bytes):
    """Leaves of all ranges, and the first reason for an error, put together as Spark puts them together."""
    size = path.stat().st_size
    name = f"file:{path}"
    cuts = [(i, b, min(size, b + split_bytes)) for i, b in enumerate(range(0, max(size, 1), split_bytes))]
    told = [js.outlines_of_range(name, b, e, size) for _, b, e in cuts]
    table = {"split": [c[0] for c in cuts][::-1], "outside": [t[0] for t in told][::-1], "inside": [t[1] for t in told][::-1]}
    starts = js.starts_of_file(pa.table(table)).to_pylist()
    found, reason = [], None
    for row, (_, _, end) in zip(starts, cuts):
        try:
            found += js.range_leaves({**row, "path": name, "end": end})
        except Exception as e:  # noqa: BLE001
            reason = f"{type(e).__name__}: {e}"
            break
    if reason is None and not starts[0]["closed"]:
        reason = "ValueError: the value is not closed"
    return found, reason


def whole(content):
    found = []
    try:
        for leaf in json_stream_leaves(io.BytesIO(content)):
            found.append(leaf)
    except ValueError as e:
        return found, f"{type(e).__name__}: {e}"
    return found, None


def value(draw, depth):
    kind = draw.randrange(7 if depth else 4)
    if kind < 2:
        return draw.choice(["", "a", 'q"', "\\", "\\\\", "x, y", "{[", "é€", "]}", "line\n", "long " * 9])
    if kind < 4:
        return draw.choice([None, True, 1, -2.5, 10**20])
    if kind < 6:
        return {draw.choice(["a", "root", "", 'k"', "\\", "é", "b:"]) + draw.choice(["", "1"]): value(draw, depth - 1) for _ in range(draw.randrange(4))}
    return [value(draw, depth - 1) for _ in range(draw.randrange(5))]


@pytest.mark.parametrize("text", GOOD + BROKEN)
def test_fixed_texts(tmp_path, text):
    path = tmp_path / "t.json"
    path.write_bytes(text.encode())
    for split_bytes in (1, 2, 3, 5, 11, 10_000):
        assert by_ranges(path, split_bytes) == whole(text.encode()), split_bytes


@pytest.mark.parametrize("seed", range(30))
def test_random_texts(tmp_path, seed):
    draw = random.Random(seed)
    text = json.dumps([value(draw, 5) for _ in range(4)], ensure_ascii=seed % 2 == 0, indent=draw.choice([None, 1]))
    path = tmp_path / "t.json"
    for broken in (False, True):
        content = text.encode()
        if broken:
            at = draw.randrange(len(content))
            content = content[:at] + draw.choice([b"", b",", b'"', b"}", b"]", b"\\", b"x", b"\xff", b" "]) + content[at + draw.randrange(2) :]
        path.write_bytes(content)
        for split_bytes in (1, 2, 3, 7, 40, 10_000):
            assert by_ranges(path, split_bytes) == whole(content), (split_bytes, content)


def test_a_long_json_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    items = [{"key": i, "more": [{"s": ["é" * (i % 7)], "p": {"root": f"x {i}"}}]} for i in range(3000)]
    (tmp_path / "in" / "all.json").write_text(json.dumps(items, ensure_ascii=False))
    (tmp_path / "in" / "bad.json").write_text(json.dumps(items)[:-1])
    columns = ["source_file", "part_order", "part_id", "json_path", "text", "content_type"]

    def rows(**options):
        parsed = parse_folder(spark, str(tmp_path / "in"), **options)
        held = parts_of(parsed).withColumn("task", F.spark_partition_id()).select(*columns, "task").collect()
        return sorted(r[:-1] for r in held), {r["task"] for r in held}, [r["source_file"] for r in parse_errors(parsed).collect()]

    once, split = rows(), rows(split_bytes=4096)
    assert once[0] and split[0] == once[0] and split[2] == once[2] == ["bad.json"]
    parsed = parse_folder(spark, str(tmp_path / "in"), split_bytes=4096).filter(F.col("error").isNull())
    # One task had all of a file before.
    assert parsed.select(F.spark_partition_id().alias("task")).distinct().count() > 4
