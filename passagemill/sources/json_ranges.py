"""Long JSON files read by many tasks, a byte range each, with the leaves of a whole read.

A task outlines its range once for each state it may begin in, outside or
inside a string: how many tokens begin there, which open objects and lists it
closes, and which it leaves open. Going over the outlines of a file in order
gives every range the objects and lists that are open before it. So each task
reads its own tokens with the rules and the paths of a whole read. A name is
kept as its place in the file, so an outline is a few numbers per open level.

Ranges before the first one that breaks a rule have been given what a whole
read has there, so the first failing range fails for the reason a whole read has.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import materialize
from passagemill.sources.splits import json_leaf_steps, json_tokens, moved, parts_by, ranges_of
from passagemill.sources.walk import open_file, spread_by_bytes

# A string, a mark, a word; another byte is a token that no rule allows. What follows a byte of a word may belong to the word.
_WORD = rb'[^\s\x1c-\x1f\x80-\xff{}\[\],:"]'
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+("|\Z)|[{}\[\],:]|' + _WORD + rb"++|[^ \t\n\r]", re.DOTALL)
_WORD_GOES_ON = re.compile(_WORD + rb"*+")
_STRING_GOES_ON = re.compile(rb'(?:[^"\\]++|\\.)*+("|\Z)', re.DOTALL)
_CLOSING = {"}", "]"}


def between_escapes(before: bytes, after: bytes) -> bool:
    return before != b"\\"


def outline(data: bytes, begin: int, inside: bool) -> list[Any]:
    """What the range ``data[1:]`` holds; its first byte is the one before, and the range begins at ``begin`` in the file.

    Whether it ends inside a string, the number of tokens that begin in it and the place of the first one, its last two
    kinds of token, the place of a string that is its first token, how many levels it closes that were open before, the
    commas and the last name at the lowest level, and the levels it leaves open: kind, commas, place of the last name.
    """
    at, ends_inside = 1, False
    if inside:
        at = found.end() if (found := _STRING_GOES_ON.match(data, 1)) else len(data)
        if not (found and found[1]):
            return [True, 0, None, "", None, 0, 0, None, []]
    elif _WORD_GOES_ON.match(data, 0, 1).end():
        at = _WORD_GOES_ON.match(data, 1).end()
    # The lowest level is one that was open before.
    levels: list[list[Any]] = [["", 0, None]]
    top, closed, count, first, first_string, last, before = levels[0], 0, 0, None, None, "", ""
    for token in _TOKEN.finditer(data, at):
        kind = chr(data[token.start()])
        if kind == '"':
            ends_inside = not token[1]
            if last == "," or last == "{":
                top[2] = begin + token.start() - 1
            elif count == 0:
                first_string = begin + token.start() - 1
        elif kind == ",":
            top[1] += 1
        elif kind == "{" or kind == "[":
            top = [kind, 0, None]
            levels.append(top)
        elif kind in _CLOSING:
            if len(levels) > 1:
                levels.pop()
            else:
                closed += 1
                levels[0] = ["", 0, None]
            top = levels[-1]
        elif kind != ":":
            kind = "w"
        if count == 0:
            first = begin + token.start() - 1
        count += 1
        before, last = last, kind
    return [ends_inside, count, first, before + last, first_string, closed, *levels[0][1:], levels[1:]]


def outlines_of_range(path: str, begin: int, end: int, size: int) -> tuple[str, str]:
    with open_file(path) as stream:
        begin, end = (moved(stream, x, size, between_escapes) for x in (begin, end))
        stream.seek(max(0, begin - 1))
        data = stream.read(end - max(0, begin - 1)) if begin < end else b""
    data = data if begin else b" " + data
    return tuple(json.dumps(outline(data or b" ", begin, inside)) for inside in (False, True))


def state_of(levels: list[list[Any]], tail: str) -> str:
    """What is allowed behind the last two kinds of token at the open levels, as :func:`json_leaf_steps` calls it."""
    last, in_object = tail[-1:], bool(levels) and levels[-1][0] == "{"
    if last in ("", ":"):
        return "value"
    if last in ("{", "["):
        return "name or }" if last == "{" else "value or ]"
    if last == ",":
        return "name" if in_object else "value"
    if last == '"' and in_object and tail[-2:-1] in ("{", ","):
        return "colon"
    return "next" if levels else "end"


def starts_of_file(table: pa.Table) -> pa.Table:
    """For each range of a file its tokens and the levels before it; ``closed`` tells whether the file ends where it may."""
    table = table.sort_by("split")
    levels: list[list[Any]] = []
    tail, inside = "", False
    told: list[tuple] = []
    for both in zip(table["outside"].to_pylist(), table["inside"].to_pylist()):
        ends_inside, count, first, kinds, first_string, closed, commas, name, opened = json.loads(both[inside])
        told.append((first, count, state_of(levels, tail), json.dumps(levels)))
        if first_string is not None and closed == 0 and name is None and tail[-1:] in ("{", ","):
            name = first_string
        levels = levels[: max(0, len(levels) - closed)]
        if levels:
            kind, had, known = levels[-1]
            levels[-1] = [kind, had + commas, known if name is None else name]
        levels = levels + opened
        tail, inside = (tail + kinds)[-2:], ends_inside
    done = not inside and state_of(levels, tail) == "end"
    first, count, state, held = zip(*told)
    columns = [pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(state, pa.string()), pa.array(held, pa.string())]
    names = [*table.column_names[:-2], "first", "tokens", "state", "levels", "closed"]
    return pa.table([*table.columns[:-2], *columns, pa.array([done] * len(told), pa.bool_())], names)


def joined(base: str, step: str) -> str:
    return step if base == "root" else f"{base}.{step}"


def range_leaves(row: dict[str, Any]) -> Iterator[tuple[str, str]]:
    """(path, text) of the scalar leaves that begin in a range."""
    if not row["tokens"]:
        return
    with open_file(row["path"]) as stream:

        def name_at(place: int) -> str:
            stream.seek(place)
            return json.loads(next(json_tokens(stream, 1 << 10)))

        stack, path = [], "root"
        for kind, commas, name in json.loads(row["levels"]):
            stack.append([path, commas if kind == "[" else -1])
            path = joined(path, f"[{commas}]" if kind == "[" else "" if name is None else name_at(name))
        stream.seek(row["first"])
        tokens = itertools.islice(json_tokens(stream, max(1, row["end"] - row["first"])), row["tokens"])
        yield from json_leaf_steps(tokens, row["state"], path, stack)


def checked(starts: DataFrame) -> DataFrame:
    """Adds the number of leaves of each range, and the reason if it breaks a rule."""
    names = [*starts.columns, "leaves", "broken"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, reasons = [], []
            for row in batch.to_pylist():
                n, reason = 0, None
                try:
                    for _ in range_leaves(row):
                        n += 1
                except Exception as e:  # noqa: BLE001 - kept as the error of the file
                    reason = f"{type(e).__name__}: {e}"[:500]
                counts.append(n)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(reasons, pa.string())], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in starts.dtypes)
    return starts.mapInArrow(run, f"{kinds}, leaves bigint, broken string")


def json_ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """The ranges of long files taken as JSON, written: ``path``, what a task needs to read one, ``before``, the leaves before it,
    and ``problem``, the first reason why the file is not one JSON value."""
    ranges = ranges_of(files.select("path", "length"), split_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "end", "length")])
            outside, inside = zip(*[outlines_of_range(*x) for x in asked])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(outside, pa.string()), pa.array(inside, pa.string())], [*batch.schema.names, "outside", "inside"]
            )

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranges.dtypes)
    outlines = ranges.mapInArrow(run, f"{kinds}, outside string, inside string")
    # One short row per range comes together for a file.
    starts = outlines.groupBy("path").applyInArrow(
        starts_of_file, f"{kinds}, first bigint, tokens bigint, state string, levels string, closed boolean"
    )
    told = checked(spread_by_bytes(materialize(starts, "json-starts"), F.col("end") - F.col("begin")))
    file = Window.partitionBy("path")
    order = file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    reason = F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("split"))).over(file)
    unclosed = F.when(~F.col("closed"), F.lit("ValueError: the value is not closed"))
    counted = materialize(told, "json-checked").withColumns(
        {"before": F.coalesce(F.sum("leaves").over(order), F.lit(0)), "problem": F.coalesce(reason, unclosed)}
    )
    return materialize(counted.drop("length", "begin", "closed", "broken"), "json-ranges")


def json_range_parts(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Leaves of long JSON files by their :func:`json_ranges`; a file that is not JSON gives an error alone."""
    wanted = ranges.filter((F.col("problem").isNull() & (F.col("leaves") > 0)) | (F.col("problem").isNotNull() & (F.col("split") == 0)))
    asked = ["path", "first", "tokens", "state", "levels", "end", "before", "problem"]
    dealt = wanted.join(F.broadcast(files), "path").repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4, "path", "split")

    def read(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        if row["problem"] is not None:
            yield {"error": row["problem"]}
            return
        for i, (place, text) in enumerate(range_leaves(row)):
            yield {"raw_text": text, "json_path": place, "content_type": "json_text_value", "part_order": row["before"] + i}

    return parts_by(dealt, read, asked).drop("split", "leaves", *asked[1:])
