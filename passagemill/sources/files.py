"""Listing a folder, file metadata, and telling file types by content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.schemas import computed_once
from passagemill.sources.walk import walk

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"

# The extensions of each group of readers.
TEXT_EXTENSIONS = [".txt"]
MARKDOWN_EXTENSIONS = [".md"]
CODE_EXTENSIONS = [".py", ".js", ".java", ".c", ".cpp", ".cs", ".go", ".rb", ".php"]
STRUCTURED_EXTENSIONS = [".json", ".jsonl", ".csv", ".tsv", ".parquet", ".xlsx", ".pdf", ".docx", ".epub"]
KNOWN_EXTENSIONS = (
    TEXT_EXTENSIONS + MARKDOWN_EXTENSIONS + CODE_EXTENSIONS + [".html", ".xml"] + STRUCTURED_EXTENSIONS
)

# Content labels that may override the extension, and from which score.
OVERRIDE_LABELS = {
    "markdown": ".md", "python": ".py", "javascript": ".js", "json": ".json",
    "xml": ".xml", "html": ".html", "csv": ".csv", "pdf": ".pdf",
}
OVERRIDE_SCORE = 0.80
SNIFFED_BYTES = 4096


def without_scheme(path: Column) -> Column:
    return F.regexp_replace(path, SCHEME, "")


def relative_path(path: Column, root: str) -> Column:
    base = re.sub(SCHEME, "", root).rstrip("/") + "/"
    return F.substring(without_scheme(path), len(base) + 1, 1 << 20)


def wanted_files(source_file: Column) -> Column:
    """False below hidden or ``__MACOSX`` folders and for hidden or temporary files."""
    hidden_folder = source_file.rlike(r"(?i)(^|/)(\.[^/]*|__macosx)/")
    hidden_file = source_file.rlike(r"(^|/)\.[^/]*$")
    temporary = source_file.rlike(r"(?i)\.(tmp|temp|ds_store)$")
    return ~(hidden_folder | hidden_file | temporary)


def list_source_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: ``(source_file, path, modificationTime, length)``, empty ones too.

    The folder is walked in tasks, so names that begin with ``_`` are found as
    well. :func:`passagemill.sources.walk.with_content` adds the bytes.
    """
    return walk(spark, root).filter(wanted_files(F.col("source_file")))


def with_source_file(scan: DataFrame, root: str) -> DataFrame:
    return scan.select(
        relative_path(F.col("path"), root).alias("source_file"), *[f.name for f in FILE_SCHEMA.fields]
    ).filter(wanted_files(F.col("source_file")))


def extension_of(source_file: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(source_file, "/", -1), r"^.+(\.[^.]+)$", 1))


def as_text(content: Column) -> Column:
    """UTF-8 with replacement characters for broken bytes."""
    return F.make_valid_utf8(content.cast("string"))


def head_of(content: Column) -> Column:
    """The first characters. The cut may split one, which is no sign of broken text."""
    return F.regexp_replace(as_text(F.substring(content, 1, SNIFFED_BYTES)), "\ufffd{1,3}\\z", "")


def opening_of(head: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring(head, 1, 256), "^\ufeff?\\s*", ""))


def sniff(content: Column, extension: Column, head: Column, opening: Column, whole_json: Column | None = None) -> Column:
    """``struct<label, group, score>`` from a file's first bytes.

    Rules over magic numbers and openings; guesses at text formats are only
    made for names without a known extension and for plain text. Where
    ``content`` is not the whole file, ``whole_json`` tells whether that is JSON.
    """
    first_bytes = F.hex(F.substring(content, 1, 8))
    unsure = ~extension.isin([e for e in KNOWN_EXTENSIONS if e != ".txt"])

    def guess(label: str, group: str, score: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(group).alias("group"), F.lit(score).alias("score"))

    def features(*patterns: str) -> Column:
        found = [F.when(head.rlike(p), 1).otherwise(0) for p in patterns]
        total = found[0]
        for f in found[1:]:
            total = total + f
        return total

    # A comma table has a line of short names, then lines of as many cells.
    commas = F.transform(
        F.slice(F.filter(F.split(head, r"\r?\n"), lambda line: line != ""), 1, 5),
        lambda line: F.regexp_count(line, F.lit(",")),
    )
    even = (
        head.rlike(r'^"?[\p{L}_][\w -]{0,39}"?(,"?[\p{L}_][\w -]{0,39}"?)+\r?\n')
        & (F.size(commas) >= 3)
        & (F.array_min(commas) == F.array_max(commas))
    )
    is_json = opening.rlike(r"^[\[{]") & (
        F.try_parse_json(as_text(content)).isNotNull() if whole_json is None else whole_json
    )
    zipped = first_bytes.startswith("504B0304")
    return (
        F.when(first_bytes.startswith("255044462D"), guess("pdf", "document", 0.99))
        .when(first_bytes.startswith("50415231"), guess("parquet", "application", 0.99))
        .when(zipped & extension.isin(".docx", ".xlsx"), guess("office", "document", 0.95))
        .when(zipped & (extension == ".epub"), guess("epub", "document", 0.95))
        .when(zipped, guess("zip", "archive", 0.95))
        .when(opening.rlike(r"^(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)?<(!doctype html|html)\b"), guess("html", "code", 0.95))
        .when(opening.startswith("<?xml"), guess("xml", "code", 0.95))
        .when(extension == ".jsonl", guess("jsonl", "code", 0.9))
        .when(is_json, guess("json", "code", 0.95))
        .when(F.col("length") == 0, guess("empty", "inode", 1.0))
        .when(head.contains("\x00") | head.contains("�"), guess("unknown", "unknown", 0.0))
        .when(
            unsure & (features(r"(?m)^(def|class) \w+.*:\s*$", r"(?m)^(import|from) \w+", r"(?m)^    \w", r"\bself\.") >= 2),
            guess("python", "code", 0.85),
        )
        .when(
            unsure & (features(r"\bfunction\b.*\{", r"(?m)^\s*(const|let|var) \w+ =", r"=>\s*[\{(]", r"(?m);\s*$") >= 3),
            guess("javascript", "code", 0.85),
        )
        .when(
            unsure & (features(r"(?m)^#{1,6} \S", r"(?m)^[-*] \S", r"\[[^\]]+\]\([^)]+\)", r"(?m)^```") >= 2),
            guess("markdown", "text", 0.85),
        )
        .when(unsure & even, guess("csv", "code", 0.85))
        .otherwise(guess("txt", "text", 0.6))
    )


def parser_for(extension: Column, label: Column, score: Column) -> Column:
    """The extension, unless a sure enough label says otherwise."""
    override = F.create_map(*[F.lit(x) for pair in OVERRIDE_LABELS.items() for x in pair])
    return F.when(score >= OVERRIDE_SCORE, F.coalesce(F.try_element_at(override, label), extension)).otherwise(
        extension
    )


def file_metadata(files: DataFrame) -> DataFrame:
    """Files with their base metadata; empty files are left out.

    Long files come with their first bytes as ``content`` and with ``whole_json``.
    """
    extension = F.col("file_extension")
    opened = (
        files.filter(F.col("length") > 0)
        .withColumn("file_extension", extension_of(F.col("source_file")))
        .withColumn("__head", head_of(F.col("content")))
        .withColumn("__opening", opening_of(F.col("__head")))
    )
    whole_json = F.col("whole_json") if "whole_json" in files.columns else None
    found = sniff(F.col("content"), extension, F.col("__head"), F.col("__opening"), whole_json)
    sniffed = computed_once(opened, "__sniff", found)
    return sniffed.select(
        "source_file",
        "file_extension",
        F.col("__sniff.label").alias("detected_type"),
        F.col("__sniff.group").alias("detected_group"),
        F.round("__sniff.score", 4).alias("detection_score"),
        parser_for(extension, F.col("__sniff.label"), F.col("__sniff.score")).alias("parsing_type_used"),
        F.col("modificationTime").alias("file_last_modified"),
        F.col("length").alias("file_size_bytes"),
        "content",
        *(["path", "length"] if whole_json is not None else []),
    )
