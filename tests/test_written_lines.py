"""Real files written by many tasks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from checks.frames import written_lines
from passagemill.session import recorded


def test_lines_of_many_tasks_make_one_file(spark):
    lines = spark.range(0, 5000, 1, 6).select((-F.col("id")).alias("place"), F.concat(F.lit("é"), F.col("id").cast("string"), F.lit("\n")).alias("line"))
    with recorded() as paths:
        root = written_lines(lines, "a b/all.txt", head="<", tail=">")
    assert any("/line-parts-" in p for p in paths)
    text = Path(root.removeprefix("file:"), "a b/all.txt").read_text(encoding="utf-8")
    assert text == "<" + "".join(f"é{i}\n" for i in reversed(range(5000))) + ">"
    root = written_lines(lines.limit(0), "none.txt", head="<", tail=">")
    assert Path(root.removeprefix("file:"), "none.txt").read_text() == "<>"
