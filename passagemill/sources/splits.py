"""Long files read by many tasks, a byte range each, with the rows of a whole read.

Tables of lines (CSV, TSV, JSON lines): a task reads its range once for each
state it may begin in, outside or inside a quoted cell, and tells the state it
ends in, how many records begin there and where the first one does. Going over
the ranges of a file in order then gives every range its true state and the
number of records before it, so each task parses its own records with their
numbers in the file, and no line is shuffled.

Plain text: a range is a part; it begins and ends behind white space.

Markup: one task reads a file as a stream, with bounded memory, and hands it
on in pieces that are cut at white space outside of tags.

JSON is read in ranges by :mod:`passagemill.sources.json_ranges`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Generator, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import materialize
from passagemill.sources.structured import ARROW_PARTS, FIELDS, PART_SCHEMA, STREAMED, PdfExtractor, delimited_parts, jsonl_parts, pdf_parts
from passagemill.sources.walk import open_file, spread_by_bytes

BOM = b"\xef\xbb\xbf"
BLOCK = 1 << 20
PARTS_IN_BATCH = 4096
END_OF_LINE = re.compile(rb"\r\n|\r|\n")
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
SEPARATORS = {".csv": ",", ".tsv": "\t"}


def ranges_of(files: DataFrame, split_bytes: int) -> DataFrame:
    """One row per ``split_bytes`` of each file: adds ``split``, ``begin`` and ``end``."""
    last = F.greatest(F.lit(0), F.expr(f"(length - 1) div {split_bytes}")).cast("bigint")
    dealt = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("split"))
    begin = F.col("split") * split_bytes
    placed = dealt.withColumns({"begin": begin, "end": F.least(F.col("length"), begin + split_bytes)})
    return spread_by_bytes(placed, F.col("end") - F.col("begin"))


def moved(stream, at: int, size: int, may_cut: Callable[[bytes, bytes], bool]) -> int:
    """The first place from ``at`` on between two bytes where ``may_cut`` allows it, or the end of the file."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    room = 64
    while at < size:
        stream.seek(at - 1)
        block = stream.read(room)
        room = min(2 * room, BLOCK)
        for i in range(1, len(block)):
            if may_cut(block[i - 1 : i], block[i : i + 1]):
                return at + i - 1
        at += max(1, len(block) - 1)
    return size


def between_lines(before: bytes, after: bytes) -> bool:
    return not (before == b"\r" and after == b"\n")


def between_cells(before: bytes, after: bytes) -> bool:
    # A quote before the cut could be the first of two or close a cell.
    return before != b'"' and between_lines(before, after)


def behind_space(before: bytes, after: bytes) -> bool:
    return SPACE.match(before) is not None and between_lines(before, after)


class Scanner:
    """What a range of a file holds, for each state that it may begin in."""

    def __init__(self, separator: str | None):
        """``separator`` of cells; without one, lines know no quotes."""
        self.quoted = separator is not None
        if separator is not None:
            before = re.escape(separator.encode())
            inner = rb'[^"]*+(?:""[^"]*+)*+("|\Z)'
            self.cell = re.compile(rb'(?<=[' + before + rb'\r\n])"' + inner)
            self.rest = re.compile(inner)

    @staticmethod
    def lines_in(data: bytes, begin: int, end: int) -> int:
        returns = data.count(b"\r", begin, end)
        both = data.count(b"\r\n", begin, end) if returns else 0
        return data.count(b"\n", begin, end) + returns - both

    def scan(self, data: bytes, inside: bool) -> tuple[bool, int, int | None]:
        """Whether it ends inside a cell, how many records begin, and the first one's place.

        ``data`` is led by one byte that is not part of the range.
        """
        at, count, first, ends_inside = 1, 0, None, False

        def outside(end: int) -> None:
            nonlocal count, first
            found = self.lines_in(data, at, end)
            if found and first is None:
                first = END_OF_LINE.search(data, at, end).end()
            count += found

        if inside:
            cell = self.rest.match(data, 1)
            if not cell[1]:
                return True, 0, None
            at = cell.end()
        elif data[:1] in (b"\r", b"\n"):
            # The lead byte ended a record.
            count, first = 1, 1
        for cell in self.cell.finditer(data, at) if self.quoted else ():
            outside(cell.start())
            at = cell.end()
            ends_inside = not cell[1]
        if not ends_inside:
            outside(len(data))
            if count and data[-1:] in (b"\r", b"\n") and len(data) > at:
                # What follows the last line end begins in the next range, or not at all.
                count -= 1
                first = None if count == 0 else first
        return ends_inside, count, None if first is None else first - 1


SCAN = (
    "split bigint, out_inside boolean, out_records bigint, out_first bigint, "
    "in_inside boolean, in_records bigint, in_first bigint"
)


def scan_file_range(path: str, begin: int, end: int, size: int, separator: str | None) -> tuple:
    """The scans of a range for both states, with places in the file."""
    scanner = Scanner(separator)
    with open_file(path) as stream:
        base = len(BOM) if scanner.quoted and stream.read(len(BOM)) == BOM else 0
        may_cut = between_cells if scanner.quoted else between_lines
        begin, end = (max(base, moved(stream, x, size, may_cut)) for x in (begin, end))
        if begin >= end:
            return False, 0, None, True, 0, None
        stream.seek(begin)
        data = stream.read(end - begin)
        lead = b"\n"
        if begin > base:
            stream.seek(begin - 1)
            lead = stream.read(1)
    data = lead + data
    outside = scanner.scan(data, False)
    inside = scanner.scan(data, True) if scanner.quoted else (True, 0, None)
    place = lambda x: None if x is None else begin + x
    return outside[0], outside[1], place(outside[2]), inside[0], inside[1], place(inside[2])


def scanned(ranges: DataFrame) -> DataFrame:
    """Rows of :func:`ranges_of` with ``parsing_type_used``, each with its scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "end", "length", "parsing_type_used")])
            told = [scan_file_range(*x[:4], SEPARATORS.get(x[4])) for x in asked]
            columns = [
                pa.array(values, kind)
                for values, kind in zip(zip(*told), [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()])
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *SCAN.replace(",", "").split()[2::2]])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranges.dtypes)
    return ranges.mapInArrow(run, f"{kinds}, {SCAN.split(', ', 1)[1]}")


def resolved(scans: DataFrame, keys: list[str]) -> DataFrame:
    """The true state of each range, from those before it: adds ``first``, ``records`` and ``before``.

    A range either keeps the state, turns it round or ends in one state
    whatever it began in. So a range begins in the state that the last one of
    the third kind ended in, turned round as often as ranges since did. Only
    numbers are shuffled, one row per range.
    """
    order = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("out_inside") & ~F.col("in_inside")).cast("bigint")
    turned = scans.withColumn("turned", F.coalesce(F.sum(turns).over(order), F.lit(0)))
    fixed = F.when(F.col("out_inside") == F.col("in_inside"), F.struct(F.col("out_inside").alias("inside"), "turned"))
    known = turned.withColumn("known", F.last(fixed, ignorenulls=True).over(order))
    since = F.col("turned") - F.coalesce("known.turned", F.lit(0))
    inside = F.coalesce("known.inside", F.lit(False)) != (F.pmod(since, F.lit(2)) == 1)
    stated = known.select(
        *keys,
        "split",
        F.when(inside, F.col("in_first")).otherwise(F.col("out_first")).alias("first"),
        F.when(inside, F.col("in_records")).otherwise(F.col("out_records")).alias("records"),
    )
    return stated.withColumn("before", F.coalesce(F.sum("records").over(order), F.lit(0))).filter("records > 0")


def parts_in_batches(batch: pa.RecordBatch, row: int, parts: Iterable[dict[str, Any]]) -> Iterator[pa.RecordBatch]:
    """The parts of one input row beside copies of the row; a failure is a last part with an error."""
    names = [*batch.schema.names, *FIELDS]

    def told(rows: list[dict[str, Any]]) -> pa.RecordBatch:
        copies = batch.take(pa.array([row] * len(rows), pa.int64()))
        made = [pa.array([r.get(f) for r in rows], ARROW_PARTS[f]) for f in FIELDS]
        return pa.RecordBatch.from_arrays([*copies.columns, *made], names)

    held: list[dict[str, Any]] = []
    order = -1
    source = iter(parts)
    while True:
        try:
            part = next(source, None)
        except Exception as e:  # noqa: BLE001 - kept as an error row
            part = {"error": f"{type(e).__name__}: {e}"[:500]}
            source = iter(())
        if part is None:
            break
        order = part.setdefault("part_order", order + 1)
        held.append(part)
        if len(held) >= PARTS_IN_BATCH:
            yield told(held)
            held = []
    if held:
        yield told(held)


def parts_by(rows: DataFrame, read: Callable[[dict[str, Any]], Iterable[dict[str, Any]]], asked: list[str]) -> DataFrame:
    """The parts that ``read`` makes of the ``asked`` columns of each row, beside the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(asked).to_pylist()):
                yield from parts_in_batches(batch, i, read(row))

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, {PART_SCHEMA}")


def read_records(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """The records that begin in a range."""
    with open_file(row["path"]) as stream:
        if row["parsing_type_used"] in SEPARATORS:
            separator = SEPARATORS[row["parsing_type_used"]]
            yield from delimited_parts(stream, separator, row["first"], row["records"], row["before"])
        else:
            yield from jsonl_parts(stream, row["first"], row["records"], row["before"])


def record_parts(files: DataFrame, split_bytes: int) -> DataFrame:
    """Parts of long files of lines; ``files`` has path, length, parsing_type_used and columns that come along."""
    stated = materialize(resolved(scanned(ranges_of(files, split_bytes)), files.columns), "ranges")
    # A range stands for as many bytes as it was cut to.
    dealt = spread_by_bytes(stated, F.least(F.col("length"), F.lit(split_bytes)))
    asked = ["path", "parsing_type_used", "first", "records", "before"]
    return parts_by(dealt, read_records, asked).drop("split", "first", "records", "before")


def text_pieces(files: DataFrame, split_bytes: int) -> DataFrame:
    """Ranges of long texts as ``content`` with ``part_order``; joined, they are the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, begin, end, size) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "end", "length")])):
                with open_file(path) as stream:
                    begin, end = (moved(stream, x, size, behind_space) for x in (begin, end))
                    if begin >= end:
                        continue
                    stream.seek(begin)
                    piece = stream.read(end - begin)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([begin], pa.int64()), pa.array([piece], pa.binary())], names)

    placed = ranges_of(files, split_bytes)
    names = [*placed.columns, "part_order", "content"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes)
    return placed.mapInArrow(run, f"{kinds}, part_order bigint, content binary").drop("split", "begin", "end")


# A comment, a section, a script or style with all it holds, or a tag; each may still be open.
_OPENINGS = [(b"<!--", rb"-->"), (b"<![cdata[", rb"\]\]>"), (b"<script", rb"</script\s*>"), (b"<style", rb"</style\s*>")]
_TAG = re.compile(rb"""<[!?/a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?/a-zA-Z][^>]*>""")
_LONGEST_OPENING = max(len(o) for o, _ in _OPENINGS)


def markup_pieces(stream, piece_bytes: int) -> Iterator[bytes]:
    """A file of markup in pieces that end behind white space outside of tags, comments, sections and scripts."""
    held, at, cut, more = b"", 0, 0, True
    size = max(piece_bytes, 1)
    while True:
        if more and len(held) - at < BLOCK:
            block = stream.read(max(BLOCK, len(held)))
            held, more = held + block, bool(block)
        place = held.find(b"<", at)
        text_end = len(held) if place < 0 else place
        spaces = max(held.rfind(c, at, text_end) for c in (b" ", b"\n", b"\t"))
        cut = max(cut, spaces + 1)
        if cut >= size:
            yield held[:cut]
            held, text_end, cut, place = held[cut:], text_end - cut, 0, place - cut if place >= 0 else -1
        if place < 0:
            at = len(held)
            if not more:
                break
            continue
        opening = held[place : place + _LONGEST_OPENING].lower()
        ending = next((e for o, e in _OPENINGS if opening.startswith(o)), None)
        found = re.compile(ending, re.IGNORECASE).search(held, place) if ending else _TAG.match(held, place)
        if found:
            at = found.end()
        elif more:
            # Not closed yet: read on and look again.
            at = place
            block = stream.read(max(BLOCK, len(held)))
            held, more = held + block, bool(block)
        else:
            at = place + 1 if not ending else len(held)
    if held:
        yield held


def markup_piece_rows(files: DataFrame, piece_bytes: int) -> DataFrame:
    """Pieces of long files of markup as ``content`` with ``part_order``; one task reads a file as a stream."""
    names = [*files.columns, "part_order", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                row = batch.slice(i, 1)
                with open_file(path) as stream:
                    for order, piece in enumerate(markup_pieces(stream, piece_bytes)):
                        yield pa.RecordBatch.from_arrays([*row.columns, pa.array([order], pa.int64()), pa.array([piece], pa.binary())], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return spread_by_bytes(files).mapInArrow(run, f"{kinds}, part_order bigint, content binary")


_TOKEN = re.compile(r'[ \t\n\r]*+(?:([{}\[\],:])|("(?:[^"\\]++|\\.)*+")|([^\s{}\[\],:"]++))', re.DOTALL)


def json_tokens(stream, first_block: int | None = None) -> Iterator[str]:
    """Tokens of a JSON text, read block by block; the buffer holds one token at least."""
    import codecs

    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held, at, more = "", 0, True
    if first_block:
        block = stream.read(min(first_block, BLOCK))
        more = bool(block)
        held = decode(block, final=not more)
    while True:
        found = _TOKEN.match(held, at)
        # A word at the end of the buffer may go on.
        if found and (found.end() < len(held) or not more or found[1]):
            yield found[found.lastindex]
            at = found.end()
        elif more:
            block = stream.read(max(BLOCK, 2 * (len(held) - at)))
            more = bool(block)
            held, at = held[at:] + decode(block, final=not more), 0
        elif held[at:].strip(" \t\n\r"):
            raise ValueError("not a JSON text")
        else:
            return


def json_leaf_steps(tokens: Iterable[str], state: str, path: str, stack: list[list[Any]]) -> Generator[tuple[str, str], None, str]:
    """(path, text) of the scalar leaves among tokens, from what is known before the first one on; returns the last state.

    ``stack`` has the open objects and lists: their path, and the number of items of a list or -1.
    """
    joined = lambda base, step: step if base == "root" else f"{base}.{step}"
    for token in tokens:
        if state == "end":
            raise ValueError("text behind the value")
        if state in ("name", "name or }"):
            if token == "}" and state == "name or }":
                stack.pop()
                state = "next" if stack else "end"
            elif token[0] == '"':
                path = joined(stack[-1][0], json.loads(token))
                state = "colon"
            else:
                raise ValueError("a name is missing")
        elif state == "colon":
            if token != ":":
                raise ValueError("a colon is missing")
            state = "value"
        elif state == "next":
            top = stack[-1]
            if token == ",":
                state = "name"
                if top[1] >= 0:
                    top[1] += 1
                    path, state = joined(top[0], f"[{top[1]}]"), "value"
            elif token == ("}" if top[1] < 0 else "]"):
                stack.pop()
                state = "next" if stack else "end"
            else:
                raise ValueError("a comma is missing")
        elif token == "{":
            stack.append([path, -1])
            state = "name or }"
        elif token == "[":
            stack.append([path, 0])
            path, state = joined(path, "[0]"), "value or ]"
        elif token == "]" and state == "value or ]":
            stack.pop()
            state = "next" if stack else "end"
        else:
            value = json.loads(token)
            if value is not None:
                yield path, str(value)
            state = "next" if stack else "end"
    return state


def json_stream_leaves(stream) -> Iterator[tuple[str, str]]:
    """(path, text) of the scalar leaves of one JSON value, without holding it."""
    state = yield from json_leaf_steps(json_tokens(stream), "value", "root", [])
    if state != "end":
        raise ValueError("the value is not closed")


def heads_of(files: DataFrame, head_bytes: int) -> DataFrame:
    """Long files with ``content``, their first bytes, and ``opens_json``, if they begin like JSON."""
    names = [*files.columns, "content", "opens_json"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, good = [], []
            for path in batch.column("path").to_pylist():
                with open_file(path) as stream:
                    heads.append(stream.read(head_bytes))
                opens = heads[-1].removeprefix(BOM).lstrip()[:1] in (b"{", b"[")
                good.append(opens and not path.lower().endswith(".jsonl"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(good, pa.bool_())], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return spread_by_bytes(files).mapInArrow(run, f"{kinds}, content binary, opens_json boolean")


def whole_file_parts(files: DataFrame, pdf_extractor: PdfExtractor | None, max_whole: int) -> DataFrame:
    """Parts of long files that one task reads through a stream that can seek.

    The caller's PDF decoder takes bytes, so a PDF above ``max_whole`` bytes is an error.
    """

    def read(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        parser = row["parsing_type_used"]
        with open_file(row["path"]) as stream:
            if parser in STREAMED:
                yield from STREAMED[parser](stream)
            elif row["length"] > max_whole:
                raise ValueError(f"longer than {max_whole} bytes")
            else:
                yield from pdf_parts(stream.read(), pdf_extractor)

    return parts_by(spread_by_bytes(files), read, ["path", "parsing_type_used", "length"])
