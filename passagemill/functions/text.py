"""Text columns: cleaning, ids, display names, tokens, previews, prompts.

Every function takes and returns a ``Column`` and stays inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.options import RAG_PROMPT

# The white space of Unicode plus the four separators x1c-x1f.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD = r"(?U)[^\s\x1c-\x1f]+"
FILLED = r"(?U)[^\s\x00\x1c-\x1f]"
TERM = r"[\p{L}\p{N}]+"
# White space other than the blank.
ODD_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]]"
EMPTY_ID = "unknown_file_component"


def clean_text(text: Column) -> Column:
    """Null to empty, white-space runs to one blank, NULs out, trimmed."""
    squeezed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE + "+", " ")
    return F.trim(F.replace(squeezed, F.lit("\x00"), F.lit("")))


def is_blank(text: Column) -> Column:
    """True for null and for text of white space and NULs only."""
    return ~F.coalesce(text.rlike(FILLED), F.lit(False))


def oddly_spaced(text: Column) -> Column:
    """False where single blanks between words are the only white space, as in most cleaned texts."""
    outside = text.startswith(" ") | text.endswith(" ") | text.contains("  ")
    return outside | text.rlike(ODD_SPACE)


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return (
        F.when(oddly_spaced(text), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .when(text == "", F.array().cast("array<string>"))
        .otherwise(F.split(text, " "))
    )


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def joined_terms(text: Column) -> Column:
    """The :func:`terms` of a text with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def count_tokens(text: Column, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """Number of words, or what a caller's column function counts."""
    if tokenizer is not None:
        return tokenizer(text)
    given = F.coalesce(text.cast("string"), F.lit(""))
    blanks = F.octet_length(given) - F.octet_length(F.replace(given, F.lit(" "), F.lit("")))
    return (
        F.when(oddly_spaced(given), F.regexp_count(given, F.lit(WORD)))
        .when(given == "", F.lit(0))
        .otherwise(blanks + 1)
    )


def sanitize_id(name: Column) -> Column:
    """A name reduced to letters, digits, ``_``, ``.`` and ``-``."""
    kept = F.regexp_replace(name.cast("string"), "[^0-9a-zA-Z_.-]+", "_")
    bare = F.regexp_replace(F.regexp_replace(kept, "_{2,}", "_"), "^[_.-]+|[_.-]+$", "")
    return F.regexp_replace(bare, "^$", EMPTY_ID)


def part_id(source_file: Column, locations: Mapping[str, Column], part_order: Column, parts_in_file: Column) -> Column:
    """Id of a part: its file, then its location, else its number when not alone.

    A location mark is three letters of its name and its value, e.g. ``pag3``
    or ``sheQ1_row7``.
    """
    marks = [
        F.concat(F.lit(name.split("_")[0][:3]), F.substring(sanitize_id(value), 1, 15))
        for name, value in locations.items()
    ]
    nowhere = F.coalesce(*[v.cast("string") for v in locations.values()], F.lit(None)).isNull()
    number = F.when(nowhere & (parts_in_file > 1), F.concat(F.lit("docpart"), part_order.cast("string")))
    return sanitize_id(F.concat_ws("_", sanitize_id(source_file), *marks, number))


def chunk_id(part: Column, order: Column) -> Column:
    return F.concat(part, F.lit("_chunk_"), order.cast("string"))


def _short(value: Column, keep_end: bool) -> Column:
    """At most 20 characters: 17 and three dots at the cut end."""
    cut = (
        F.concat(F.lit("..."), F.right(value, F.lit(17)))
        if keep_end
        else F.concat(F.substring(value, 1, 17), F.lit("..."))
    )
    return F.when(F.length(value) > 20, cut).otherwise(value)


def display_source_name(
    source_file: Column,
    *,
    page_number: Column | None = None,
    sheet_name: Column | None = None,
    row_index: Column | None = None,
    line_number: Column | None = None,
    json_path: Column | None = None,
    epub_item_name: Column | None = None,
    chunk_order: Column | None = None,
) -> Column:
    """File name, then the known places in brackets: ``a.pdf (P:3, Chk:2)``."""

    def mark(tag: str, value: Column | None, shape=lambda c: c.cast("string")):
        return None if value is None else F.concat(F.lit(tag), shape(value))

    marks = [
        mark("P:", page_number),
        mark("Sht:", sheet_name, lambda c: F.substring(c, 1, 15)),
        mark("Row:", row_index, lambda c: (c + 1).cast("string")),
        mark("L:", line_number),
        mark("Path:", json_path, lambda c: _short(c, keep_end=True)),
        mark("Epub:", epub_item_name, lambda c: _short(c, keep_end=False)),
        mark("Chk:", chunk_order, lambda c: (c + 1).cast("string")),
    ]
    name = F.substring_index(F.coalesce(source_file, F.lit("UnknownSource")), "/", -1)
    inside = F.concat_ws(", ", *[m for m in marks if m is not None])
    return F.when(inside == "", name).otherwise(F.concat(name, F.lit(" ("), inside, F.lit(")")))


def row_to_text(columns: Mapping[str, Column]) -> Column:
    """``name: value`` of the filled cells, joined by `` | `` and cleaned."""
    cells = []
    for name, value in columns.items():
        shown = value.cast("string")
        cells.append(F.when(~is_blank(shown), F.concat(F.lit(f"{name}: "), shown)))
    return clean_text(F.concat_ws(" | ", *cells))


def python_style(value: Column, type_name: str) -> Column:
    """Text of a cell as Python prints it where Spark differs."""
    if type_name == "boolean":
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if type_name.startswith("timestamp"):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return value.cast("string")


def text_preview(text: Column, *, always_dots: bool = False) -> Column:
    """First 150 characters and dots."""
    return clip(text, 150, always_dots=always_dots)


def snippet(text: Column) -> Column:
    """First 200 characters, with dots if longer."""
    return clip(text, 200)


def clip(text: Column, size: int, *, always_dots: bool = False) -> Column:
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return cut if always_dots else F.when(F.length(text) > size, cut).otherwise(text)


def source_block(tag: Column, text: Column) -> Column:
    """A chunk as the model reads it: numbered tag, blank line, text, blank line."""
    return F.concat(F.lit("[Source "), tag.cast("string"), F.lit("]\n\n"), text, F.lit("\n\n"))


def cited_tags(answer: Column) -> Column:
    """Ascending distinct numbers of the ``[Source N]`` tags in an answer."""
    found = F.regexp_extract_all(answer, F.lit(r"(?i)\[Source(?U:[\s\x1c-\x1f]*)(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda n: n.try_cast("bigint")))))


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places in one pass; ``{{`` and ``}}`` are literal braces.

    The template is cut up here, so braces inside the values are never read.
    """
    pieces: list[Column] = []
    for token in re.findall(r"\{\{|\}\}|\{\w+\}|[^{}]+|[{}]", template):
        if token in ("{{", "}}"):
            pieces.append(F.lit(token[0]))
        elif token.startswith("{") and token.endswith("}") and token != "{}":
            if token[1:-1] not in values:
                raise KeyError(token[1:-1])
            pieces.append(F.coalesce(values[token[1:-1]], F.lit("")))
        else:
            pieces.append(F.lit(token))
    return F.concat(*pieces)


def build_messages(query: Column, context: Column, template: str, user: Column | None = None) -> Column:
    """System and user message as ``array<struct<role, content>>``.

    A template that names an unknown value is replaced by the default prompt.
    """
    values = {"context": context, "query": query}
    try:
        system = fill_template(template, values)
    except KeyError:
        system = fill_template(RAG_PROMPT, values)
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), (query if user is None else user).alias("content")),
    )


def chat_request_json(messages: Column, model: str, max_tokens: int, temperature: float) -> Column:
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            messages.alias("messages"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(temperature).alias("temperature"),
            F.lit(False).alias("stream"),
        )
    )


def parse_chat_response(body: Column) -> Column:
    """Text of the first choice: its message, else its delta, else null."""

    def content(kind: str) -> Column:
        found = F.get_json_object(body, f"$.choices[0].{kind}.content")
        return F.when(found != "", found)

    raw = F.coalesce(content("message"), content("delta"))
    return F.regexp_replace(raw, rf"^{SPACE}+|{SPACE}+$", "")
