"""Column layout of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# Where a part sits inside its file; order matters for ids.
LOCATION_FIELDS = {
    "page_number": I,
    "sheet_name": S,
    "row_index": L,
    "line_number": L,
    "json_path": S,
    "epub_item_id": S,
    "epub_item_name": S,
}

FILE_FIELDS = {
    "source_file": S,
    "file_extension": S,
    "detected_type": S,
    "detected_group": S,
    "detection_score": D,
    "parsing_type_used": S,
    "file_last_modified": T.TimestampType(),
    "file_size_bytes": L,
}

PART_FIELDS = {
    "part_id": S,
    **FILE_FIELDS,
    "content_type": S,
    "extraction_method": S,
    "conversion_source": S,
    **LOCATION_FIELDS,
    "epub_book_title": S,
    "part_order": L,
    "text": S,
    "extra": T.MapType(S, S),
}

CHUNK_FIELDS = {
    **{k: v for k, v in PART_FIELDS.items() if k != "text"},
    "chunk_id": S,
    "chunk_order": I,
    "text": S,
    "display_source_name": S,
    "chunking_error": S,
    "chunking_notes": S,
    "top_label": S,
    "top_label_score": D,
    "labels": T.ArrayType(S),
    "scores": T.ArrayType(D),
    "classification_status": S,
    "classification_error": S,
    "vector": T.ArrayType(T.FloatType()),
}


def struct_of(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


DOC_PARTS = struct_of(PART_FIELDS)
CHUNKS = struct_of(CHUNK_FIELDS)
PARSE_ERRORS = struct_of({"source_file": S, "parsing_type_used": S, "error": S})
QUERIES = struct_of({"query_id": L, "query": S})


def conform(df: DataFrame, fields: dict[str, T.DataType]) -> DataFrame:
    """Select ``fields`` in order, adding typed nulls for missing columns."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name).cast(dtype) if name in have else F.lit(None).cast(dtype)).alias(name)
            for name, dtype in fields.items()
        ]
    )


def optional(df: DataFrame, name: str, dtype: T.DataType = S) -> Column:
    """The column when the frame has it, else a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters may use.

    A filter on a plain projection is pushed below it, and so works the value
    out a second time; it is not pushed through a generator.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))
