"""Files and tables to document parts."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import schemas
from passagemill.functions import text as tx
from passagemill.functions.markup import markup_text, without_html_tags, without_xml_tags
from passagemill.functions.ranking import distributed_row_number
from passagemill.session import materialize
from passagemill.sources import files as fl
from passagemill.sources import json_ranges as js
from passagemill.sources import splits
from passagemill.sources.structured import PART_TYPES, PdfExtractor, structured_reader
from passagemill.sources.walk import with_content

# Parsers done by column functions alone.
PLAIN = fl.TEXT_EXTENSIONS + fl.MARKDOWN_EXTENSIONS + fl.CODE_EXTENSIONS + [".html", ".xml"]

# Files above this are read in ranges or as streams.
SPLIT_BYTES = 64 << 20
# Repaired ids that may be sent to every task.
BROADCAST_REPAIRS = 1_000_000
# What one binary value can hold.
MAX_WHOLE_BYTES = 2_000_000_000
MARKUP = [".html", ".xml"]
LINES = [".csv", ".tsv", ".jsonl"]


def supported_files(known: DataFrame) -> DataFrame:
    """Files that have a reader; adds ``__generic``, true for text of an unknown type."""
    parser = F.col("parsing_type_used")
    generic = (F.col("detected_group") == "text") & ~parser.isin(fl.KNOWN_EXTENSIONS)
    return known.withColumn("__generic", generic).filter(parser.isin(fl.KNOWN_EXTENSIONS) | F.col("__generic"))


def with_text(rows: DataFrame) -> DataFrame:
    """Parsed rows with their clean ``text``: from ``__plain``, a text as it is, or ``raw_text``, what a reader gave."""
    parser = F.col("parsing_type_used")
    raw = F.coalesce("__plain", "raw_text")
    stripped = (
        F.when(parser.isin(".html", ".epub"), without_html_tags(raw))
        .when(parser == ".xml", without_xml_tags(raw))
        .otherwise(raw)
    )
    markup = parser.isin(".html", ".epub", ".xml")
    held = F.col("__stripped")
    text = F.when(markup, markup_text(F.when(markup, held))).otherwise(tx.clean_text(held))
    kind = (
        F.when(parser.isin(fl.MARKDOWN_EXTENSIONS), F.lit("markdown"))
        .when(parser.isin(fl.CODE_EXTENSIONS), F.lit("code"))
        .when(parser == ".html", F.lit("html_text"))
        .when(parser == ".xml", F.lit("xml_text"))
        .otherwise(F.col("content_type"))
    )
    return (
        schemas.computed_once(rows.withColumns({"content_type": kind, "__stripped": stripped}), "text", text)
        .withColumn("extraction_method", F.when(F.col("__generic"), F.lit("generic_text_fallback")))
        .withColumn("sheet_name", tx.sanitize_id(F.col("sheet_name")))
        .drop("__plain", "raw_text", "__stripped", "__generic")
    )


def parse_files(files: DataFrame, pdf_extractor: PdfExtractor | None = None) -> DataFrame:
    """Every part and every parse error of ``files``, which come with their ``content``, in one scan.

    Text, markup and code are cleaned in the JVM; the other formats go through one
    table function, which only receives the bytes it has to parse.
    """
    supported = supported_files(fl.file_metadata(files))
    parser = F.col("parsing_type_used")
    plain = parser.isin(PLAIN) | F.col("__generic")
    split = supported.select(
        *[c for c in supported.columns if c != "content"],
        F.when(plain, fl.as_text(F.col("content"))).alias("__plain"),
        F.when(~plain, F.col("content")).alias("__bytes"),
    )
    reader = structured_reader(pdf_extractor)
    return with_text(split.lateralJoin(reader(parser.outer(), F.col("__bytes").outer())).drop("__bytes"))


def parse_long_files(
    files: DataFrame, split_bytes: int = SPLIT_BYTES, pdf_extractor: PdfExtractor | None = None
) -> DataFrame:
    """The rows of :func:`parse_files` for files of any length, which are never held whole.

    CSV, TSV, JSON, JSON lines and plain text are read by many tasks, a range
    each; markup, workbooks, packages and Parquet by one task per file. Text
    and markup above ``split_bytes`` become several parts, cut at white space.
    """
    heads = materialize(splits.heads_of(files, fl.SNIFFED_BYTES), "heads")
    maybe_json = heads.filter(F.col("opens_json") | (fl.extension_of(F.col("source_file")) == ".json"))
    json_ranges = None if maybe_json.isEmpty() else js.json_ranges(maybe_json, split_bytes)
    heads = heads.withColumnRenamed("opens_json", "whole_json")
    if json_ranges is not None:
        good = json_ranges.filter((F.col("split") == 0) & F.col("problem").isNull()).select("path", F.lit(True).alias("__good"))
        whole = F.col("whole_json") & F.coalesce("__good", F.lit(False))
        heads = heads.join(F.broadcast(good), "path", "left").withColumn("whole_json", whole).drop("__good")
    known = materialize(supported_files(fl.file_metadata(heads)).drop("content"), "long-files")
    parser = F.col("parsing_type_used")
    way = (
        F.when(F.col("__generic") | (parser.isin(PLAIN) & ~parser.isin(MARKUP)), "text")
        .when(parser.isin(MARKUP), "markup")
        .when(parser.isin(LINES), "lines")
        .when(parser == ".json", "json")
        .otherwise("whole")
    )
    readers = {
        "text": lambda some: splits.text_pieces(some, split_bytes),
        "markup": lambda some: splits.markup_piece_rows(some, split_bytes),
        "lines": lambda some: splits.record_parts(some, split_bytes),
        "json": lambda some: js.json_range_parts(some, json_ranges),
        "whole": lambda some: splits.whole_file_parts(some, pdf_extractor, MAX_WHOLE_BYTES),
    }
    made = []
    for name in sorted(r[0] for r in known.select(way.alias("way")).distinct().collect()):
        rows = readers[name](known.filter(way == name)).drop("path", "length")
        if "content" in rows.columns:
            pieces = rows.withColumn("__plain", fl.as_text(F.col("content"))).drop("content")
            rows = pieces.withColumns({f: F.lit(None).cast(t) for f, t in PART_TYPES.items() if f not in pieces.columns})
        else:
            rows = rows.withColumn("__plain", F.lit(None).cast("string"))
        made.append(rows)
    if not made:
        return parse_files(files.limit(0).withColumn("content", F.lit(None).cast("binary")))
    return with_text(functools.reduce(DataFrame.unionByName, made))


def parse_listed(
    files: DataFrame, *, pdf_extractor: PdfExtractor | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """All parts and errors of listed files: short files whole, long ones in ranges or as streams."""
    short = parse_files(with_content(files.filter(F.col("length") <= split_bytes)), pdf_extractor)
    long = files.filter(F.col("length") > split_bytes)
    if long.isEmpty():
        return short
    return short.unionByName(parse_long_files(long, split_bytes, pdf_extractor))


def parse_folder(
    spark: SparkSession,
    root: str,
    *,
    pdf_extractor: PdfExtractor | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """All parts and errors of a folder. The listing is written first, so all steps see the same files."""
    files = materialize(fl.list_source_files(spark, root), "listing")
    return parse_listed(files, pdf_extractor=pdf_extractor, split_bytes=split_bytes)


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("source_file", "parsing_type_used", "error")


def drop_blank_parts(parts: DataFrame) -> DataFrame:
    return parts.filter(~tx.is_blank(F.col("text")))


def location_columns(df: DataFrame) -> dict[str, Column]:
    return {k: schemas.optional(df, k, v) for k, v in schemas.LOCATION_FIELDS.items()}


def parts_of(parsed: DataFrame, *, unique: bool = True) -> DataFrame:
    """Parsed rows with text as ``doc_parts``."""
    filled = drop_blank_parts(parsed.filter(F.col("error").isNull()))
    # Only readers that mark each part's place give a file several parts.
    ids = tx.part_id(F.col("source_file"), location_columns(filled), F.col("part_order"), F.lit(1))
    parts = schemas.conform(filled.withColumn("part_id", ids), schemas.PART_FIELDS)
    return unique_part_ids(parts) if unique else parts


def unique_part_ids(parts: DataFrame) -> DataFrame:
    """Append ``_d1``, ``_d2``, ... to later parts that share an id.

    Locations are cut to 15 characters, so all items of a long JSON list may
    share one id; such a group is numbered across many tasks.
    """
    shared = parts.groupBy("part_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    places = parts.select("part_id", "source_file", "part_order").join(
        shared.select("part_id"), "part_id", "left_semi"
    )
    numbered = distributed_row_number(places, ["part_id"], [F.col("source_file"), F.col("part_order")], "__place")
    later = numbered.filter(F.col("__place") > 1)
    repaired = later.count()
    if repaired == 0:
        return parts
    if repaired <= BROADCAST_REPAIRS:
        # Few enough to send along; the texts then need not be shuffled.
        later = F.broadcast(later)
    joined = parts.join(later, ["part_id", "source_file", "part_order"], "left")
    repaired_id = F.concat(F.col("part_id"), F.lit("_d"), (F.col("__place") - 1).cast("string"))
    fixed = F.when(F.col("__place").isNotNull(), repaired_id).otherwise(F.col("part_id"))
    unique = joined.withColumn("part_id", fixed).select(*parts.columns)
    # A repaired id may be the own id of another part.
    made = later.select(repaired_id.alias("part_id"))
    if parts.select("part_id").join(made, "part_id", "left_semi").isEmpty():
        return unique
    return unique_part_ids(unique)


def read_documents(
    spark: SparkSession, root: str, *, pdf_extractor: PdfExtractor | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(doc_parts, parse_errors)`` of a folder."""
    parsed = parse_folder(spark, root, pdf_extractor=pdf_extractor)
    return parts_of(parsed), parse_errors(parsed)


def parts_from_table(
    df: DataFrame,
    source_file: Column,
    text: Column,
    *,
    locations: Mapping[str, Column] | None = None,
    part_order: Column | None = None,
    keep_newlines: bool = False,
    cleaned: bool = False,
    **metadata: Column,
) -> DataFrame:
    """Rows of any table as ``doc_parts``.

    Rows of one source without locations are told apart by ``part_order``.
    """
    shown = text if cleaned else F.trim(text) if keep_newlines else tx.clean_text(text)
    places = dict(locations or {})
    rows = df.filter(~tx.is_blank(text)).select(
        source_file.alias("source_file"),
        shown.alias("text"),
        (F.lit(0) if part_order is None else part_order).cast("bigint").alias("part_order"),
        *[c.cast(schemas.LOCATION_FIELDS[k]).alias(k) for k, c in places.items()],
        *[c.alias(k) for k, c in metadata.items()],
    )
    in_file = F.lit(1) if part_order is None else F.lit(2)
    if part_order is not None and not places:
        counts = df.groupBy(source_file.alias("source_file")).agg(F.count(F.lit(1)).alias("__parts"))
        rows = rows.join(counts, "source_file")
        in_file = F.col("__parts")
    ids = tx.part_id(F.col("source_file"), location_columns(rows), F.col("part_order"), in_file)
    return schemas.conform(rows.withColumn("part_id", ids), schemas.PART_FIELDS)


def table_row_parts(df: DataFrame, source_file: Column, row_index: Column, columns: list[str]) -> DataFrame:
    """Rows of a table as ``name: value`` parts."""
    types = dict(df.dtypes)
    shown = {c: tx.python_style(F.col(c), types[c]) for c in columns}
    named = df.withColumns({"__source": source_file, "__index": row_index})
    texts = schemas.computed_once(named, "__text", tx.row_to_text(shown))
    return parts_from_table(
        texts,
        F.col("__source"),
        F.col("__text"),
        locations={"row_index": F.col("__index")},
        part_order=F.col("__index"),
        cleaned=True,
    )


def read_parquet_rows(spark: SparkSession, path: str, source_file: Column | None = None) -> DataFrame:
    """One part per row of a Parquet table of any size, numbered within its file."""
    table = spark.read.parquet(path)
    columns = table.columns
    held = table.select("*", F.col("_metadata.row_index").alias("__row"), F.col("_metadata.file_name").alias("__file"))
    return table_row_parts(held, source_file if source_file is not None else F.col("__file"), F.col("__row"), columns)
