"""Readers. Files are made from the tables: their bytes are columns."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from checks import check
from checks.frames import as_files, table, written_files, written_lines
from checks.twins import clean, hash_of, html, twin, words
from passagemill.sources import documents as doc
from passagemill.sources import files as fl
from passagemill.functions import text as tx

_PARSED = ["source_file", "text"]


def _document_files(spark, d, extension: str):
    docs = table(spark, d, "documents")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(extension))
    return as_files(docs, name, F.encode("text", "UTF-8"))


def _page_files(spark, d, extension):
    pages = table(spark, d, "pages")
    return as_files(pages, F.concat(F.lit("pages/"), F.col("page_id").cast("string"), extension), F.encode("html", "UTF-8"))


def _read(files, *columns: str, **options):
    return doc.parts_of(doc.parse_files(files, **options), unique=False).select("source_file", "text", *columns)


_FOLDER = "['a', '.cache', '__MACOSX', 'b/.git/x', 'c d', '_under'][1 + doc_id % 6]"
_SUFFIX = "['.txt', '.TMP', '.temp', '.DS_Store', '.md'][1 + doc_id % 5]"


@check(
    "list_source_files",
    f"""SELECT {_FOLDER} || '/' || p || doc_id || {_SUFFIX} AS source_file, strlen(text)::BIGINT AS size
        FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END AS p FROM documents)
        WHERE p = '' AND doc_id % 6 IN (0, 4, 5) AND doc_id % 5 IN (0, 4)""",
)
def list_source_files(spark, d):
    """Real files, also in folders and of names that begin with an underscore."""
    n = F.col("doc_id")
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    name = F.concat(
        pick(["a", ".cache", "__MACOSX", "b/.git/x", "c d", "_under"], n % 6),
        F.lit("/"),
        F.when(n % 11 == 0, F.lit(".")).otherwise(F.lit("")),
        n.cast("string"),
        pick([".txt", ".TMP", ".temp", ".DS_Store", ".md"], n % 5),
    )
    files = table(spark, d, "documents").select(name.alias("source_file"), F.encode("text", "UTF-8").alias("content"))
    return fl.list_source_files(spark, written_files(files)).select("source_file", F.col("length").alias("size"))


@check(
    "file_metadata",
    """SELECT source || '/' || doc_id || '.TXT' AS source_file, '.txt' AS file_extension, strlen(text)::BIGINT AS file_size_bytes
       FROM documents WHERE strlen(text) > 0""",
)
def file_metadata(spark, d):
    return fl.file_metadata(_document_files(spark, d, ".TXT")).select("source_file", "file_extension", "file_size_bytes")


@check(
    "detect_file_type",
    """SELECT 'pages/' || page_id || ['.html', '.txt', '', '.dat'][1 + page_id % 4] AS source_file, 'html' AS detected_type,
         'code' AS detected_group, 0.95::DOUBLE AS detection_score, '.html' AS parsing_type_used FROM pages
       UNION ALL
       SELECT 'events/' || event_id || ['.json', '.txt', '.jsonl'][1 + event_id % 3],
         CASE WHEN event_id % 3 = 2 THEN 'jsonl' ELSE 'json' END, 'code', CASE WHEN event_id % 3 = 2 THEN 0.9 ELSE 0.95 END,
         CASE WHEN event_id % 3 = 2 THEN '.jsonl' ELSE '.json' END FROM events""",
)
def detect_file_type(spark, d):
    n = F.col("page_id")
    ext = F.element_at(F.array(F.lit(".html"), F.lit(".txt"), F.lit(""), F.lit(".dat")), (n % 4 + 1).cast("int"))
    e = F.col("event_id")
    event_ext = F.element_at(F.array(F.lit(".json"), F.lit(".txt"), F.lit(".jsonl")), (e % 3 + 1).cast("int"))
    events = as_files(
        table(spark, d, "events"), F.concat(F.lit("events/"), e.cast("string"), event_ext), F.encode("props", "UTF-8")
    )
    files = _page_files(spark, d, ext).unionByName(events)
    return fl.file_metadata(files).select(
        "source_file", "detected_type", "detected_group", "detection_score", "parsing_type_used"
    )


def _text_twin(extension: str) -> str:
    return f"""SELECT source || '/' || doc_id || '{extension}' AS source_file, {clean('text')} AS text
               FROM documents WHERE {clean('text')} <> ''"""


@check("read_text_docs", _text_twin(".txt"))
def read_text_docs(spark, d):
    return _read(_document_files(spark, d, ".txt"))


@check("read_markdown_docs", f"SELECT *, 'markdown' AS content_type FROM ({_text_twin('.md')})")
def read_markdown_docs(spark, d):
    return _read(_document_files(spark, d, ".md"), "content_type")


@check("read_code_docs", f"SELECT *, 'code' AS content_type FROM ({_text_twin('.java')})")
def read_code_docs(spark, d):
    return _read(_document_files(spark, d, ".java"), "content_type")


@check("generic_text_fallback", f"SELECT *, 'generic_text_fallback' AS extraction_method FROM ({_text_twin('.log')})")
def generic_text_fallback(spark, d):
    return _read(_document_files(spark, d, ".log"), "extraction_method")


_PAGES = f"SELECT 'pages/' || page_id || '.html' AS source_file, {html('html')} AS text, 'html_text' AS content_type FROM pages"


@check("extract_html", _PAGES)
def extract_html(spark, d):
    return _read(_page_files(spark, d, F.lit(".html")), "content_type")


@check(
    "extract_documents",
    f"""SELECT source_file, text, content_type, NULL::VARCHAR AS json_path FROM ({_PAGES})
        UNION ALL SELECT source_file, text, NULL, NULL FROM ({_text_twin('.txt')})
        UNION ALL SELECT 'events/' || event_id || '.json', json_extract_string(props, '$.k'), 'json_text_value', 'k' FROM events""",
)
def extract_documents(spark, d):
    """Several formats in one scan, and types that nothing reads."""
    events = as_files(
        table(spark, d, "events"),
        F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")),
        F.encode("props", "UTF-8"),
    )
    binary = as_files(
        table(spark, d, "nation"), F.concat("n_name", F.lit(".bin")), F.unhex(F.lit("00FF00FE"))
    )
    files = _page_files(spark, d, F.lit(".html")).unionByName(_document_files(spark, d, ".txt"))
    return _read(files.unionByName(events).unionByName(binary), "content_type", "json_path")


@check(
    "extract_xml",
    """SELECT 'c' || c_custkey || '.xml' AS source_file, concat_ws(' ', c_name, 'a < b & c', c_mktsegment) AS text FROM customer""",
)
def extract_xml(spark, d):
    body = F.concat(
        F.lit('<?xml version="1.0"?>\n<!-- <x>no</x> -->\n<customer id="1">\n  <name lang=">">'),
        "c_name",
        F.lit("</name><note>a &lt; b &amp; c</note>\n<segment>"),
        "c_mktsegment",
        F.lit("</segment></customer>"),
    )
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".xml"))
    return _read(as_files(table(spark, d, "customer"), name, F.encode(body, "UTF-8")))


@check(
    "json_leaves",
    """SELECT 'o' || o_orderkey || '.json' AS source_file, path AS json_path, text FROM (
         SELECT o_orderkey, unnest(['key', 'customer.id', 'customer.tags.[0]', 'customer.tags.[1]', 'open', 'inner']) AS path,
           unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority,
                   CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END, 'x']) AS text FROM orders)""",
)
def json_leaves(spark, d):
    customer = F.struct(
        F.col("o_custkey").alias("id"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.array().cast("array<string>").alias("none"),
        F.lit("  ").alias("blank"),
    )
    body = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("key"),
            customer.alias("customer"),
            (F.col("o_orderkey") % 2 == 0).alias("open"),
            F.struct(F.lit("x").alias("inner")).alias("root"),
        )
    )
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return _read(as_files(table(spark, d, "orders"), name, F.encode(body, "UTF-8")), "json_path")


_LINES = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) + (turn // 3)"


@check(
    "read_jsonl_docs",
    f"""SELECT * FROM (
          SELECT 'c' || conv_id || '.jsonl' AS source_file, (turn + 1 + turn // 3)::BIGINT AS line_number, path AS json_path, text, kind AS content_type FROM (
            SELECT conv_id, turn, 'role' AS path, role AS text, 'jsonl_text_value' AS kind FROM conversations WHERE turn % 4 <> 3
            UNION ALL SELECT conv_id, turn, 'said.text', {clean('text')}, 'jsonl_text_value' FROM conversations WHERE turn % 4 <> 3
            UNION ALL SELECT conv_id, turn, NULL, '{{broken ' || role, 'jsonl_malformed_line_text' FROM conversations WHERE turn % 4 = 3))
        WHERE text <> ''""",
)
def read_jsonl_docs(spark, d):
    """A file per conversation: a line per turn, some broken, some blank."""
    whole = F.to_json(F.struct("role", F.struct("text").alias("said")))
    line = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("{broken "), "role")).otherwise(whole)
    spaced = F.concat(line, F.when(F.col("turn") % 3 == 2, F.lit("\n")).otherwise(F.lit("")))
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", spaced.alias("line")))).alias("lines")
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    files = as_files(lines, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")), F.encode(body, "UTF-8"))
    return _read(files, "line_number", "json_path", "content_type")


def _table_files(df, key: str, columns: list[str], separator: str, extension: str, rows: int = 100):
    """Text tables of ``rows`` consecutive keys each."""
    cells = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    line = F.concat_ws(separator, *cells)
    grouped = df.groupBy(F.floor(F.col(key) / rows).cast("bigint").alias("g")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))).alias("lines")
    )
    body = F.concat(
        F.lit(separator.join(columns) + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    )
    return as_files(grouped, F.concat(F.lit("t"), F.col("g").cast("string"), F.lit(extension)), F.encode(body, "UTF-8"))


def _row_twin(name: str, key: str, columns: list[str], extension: str) -> str:
    cells = ", ".join(f"'{c}: ' || {c}" for c in columns)
    return f"""SELECT 't' || ({key} // 100) || '{extension}' AS source_file, ({key} % 100)::BIGINT AS row_index,
               concat_ws(' | ', {cells}) AS text FROM {name}"""


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
_PART = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]


@check("read_csv_docs", _row_twin("customer", "c_custkey", _CUSTOMER, ".csv"))
def read_csv_docs(spark, d):
    return _read(_table_files(table(spark, d, "customer"), "c_custkey", _CUSTOMER, ",", ".csv"), "row_index")


@check("read_tsv_docs", _row_twin("supplier", "s_suppkey", _SUPPLIER, ".tsv"))
def read_tsv_docs(spark, d):
    return _read(_table_files(table(spark, d, "supplier"), "s_suppkey", _SUPPLIER, "\t", ".tsv"), "row_index")


@check(
    "read_parquet_docs",
    """SELECT o_orderkey AS row_index, concat_ws(' | ', 'o_orderkey: ' || o_orderkey, 'o_custkey: ' || o_custkey,
         'o_orderstatus: ' || o_orderstatus, 'o_totalprice: ' || o_totalprice, 'o_orderdate: ' || o_orderdate,
         'o_orderpriority: ' || o_orderpriority) AS text FROM orders""",
)
def read_parquet_docs(spark, d):
    return doc.read_parquet_rows(spark, f"{d}/orders.parquet").select("row_index", "text")


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _workbook(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("p_partkey")
    strings = list(dict.fromkeys(_PART + rows.p_name.tolist() + rows.p_brand.tolist()))
    place = {s: i for i, s in enumerate(strings)}

    def cell(value) -> str:
        return f'<c t="s"><v>{place[value]}</v></c>' if isinstance(value, str) else f"<c><v>{value}</v></c>"

    body = "".join(
        "<row>" + "".join(cell(v) for v in line) + "</row>" for line in [_PART, *rows[_PART].itertuples(index=False)]
    )
    content = _zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Parts &amp; more" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
            "xl/worksheets/s1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>',
        }
    )
    return pd.DataFrame({"g": [int(rows.p_partkey.iloc[0]) // 100], "content": [content]})


@check(
    "read_xlsx_docs",
    f"SELECT *, 'Parts_more' AS sheet_name FROM ({_row_twin('part', 'p_partkey', _PART, '.xlsx')})",
)
def read_xlsx_docs(spark, d):
    part = table(spark, d, "part")
    books = part.groupBy(F.floor(F.col("p_partkey") / 100)).applyInPandas(_workbook, "g bigint, content binary")
    files = as_files(books, F.concat(F.lit("t"), F.col("g").cast("string"), F.lit(".xlsx")), F.col("content"))
    return _read(files, "row_index", "sheet_name")


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(text: str) -> bytes:
    body = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n")
    )
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'})


@check(
    "read_docx_docs",
    f"SELECT *, 'docx_plain_text' AS content_type FROM ({_text_twin('.docx')})",
)
def read_docx_docs(spark, d):
    def build(batches):
        for rows in batches:
            yield pd.DataFrame({"source_file": rows.source_file, "content": [_docx(t) for t in rows.text]})

    docs = table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("source_file"), "text"
    )
    built = docs.mapInPandas(build, "source_file string, content binary")
    return _read(as_files(built, F.col("source_file"), F.col("content")), "content_type")


def _epub(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("page_id")
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>',
        "OEBPS/b.opf": '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest>'
        + "".join(
            f'<item id="i{i}" href="p{i}.xhtml" media-type="application/xhtml+xml"/>' for i in rows.page_id
        )
        + '<item id="css" href="s.css" media-type="text/css"/></manifest></package>',
        **{f"OEBPS/p{i}.xhtml": h for i, h in zip(rows.page_id, rows.html)},
    }
    return pd.DataFrame({"g": [int(rows.page_id.iloc[0]) // 10], "content": [_zipped(files)]})


@check(
    "read_epub_docs",
    f"""SELECT 'b' || (page_id // 10) || '.epub' AS source_file, {html('html')} AS text, 'i' || page_id AS epub_item_id,
          'p' || page_id || '.xhtml' AS epub_item_name, 'Book' AS epub_book_title FROM pages""",
)
def read_epub_docs(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    books = pages.groupBy(F.floor(F.col("page_id") / 10)).applyInPandas(_epub, "g bigint, content binary")
    files = as_files(books, F.concat(F.lit("b"), F.col("g").cast("string"), F.lit(".epub")), F.col("content"))
    return _read(files, "epub_item_id", "epub_item_name", "epub_book_title")


def _form_feed_pages(content: bytes) -> list[str]:
    """Stands in for a PDF decoder."""
    return content[5:].decode("utf-8").split("\f")


@check(
    "read_pdf_docs",
    f"""SELECT 'c' || conv_id || '.pdf' AS source_file, (turn + 1)::INTEGER AS page_number, {clean('text')} AS text,
          'pdf_page_text' AS content_type FROM conversations WHERE {clean('text')} <> ''""",
)
def read_pdf_docs(spark, d):
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")
    )
    body = F.concat(F.lit("%PDF-"), F.array_join(F.transform("turns", lambda x: x["text"]), "\f"))
    files = as_files(talks, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".pdf")), F.encode(body, "UTF-8"))
    return _read(files, "page_number", "content_type", pdf_extractor=_form_feed_pages)


@check(
    "parse_errors",
    """SELECT 'events/' || event_id || '.json' AS source_file, '.json' AS parsing_type_used FROM events WHERE event_id % 10 = 0
       UNION ALL SELECT n_name || '.xlsx', '.xlsx' FROM nation UNION ALL SELECT n_name || '.pdf', '.pdf' FROM nation""",
)
def parse_errors(spark, d):
    props = F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(3))).otherwise(F.col("props"))
    events = as_files(
        table(spark, d, "events"),
        F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")),
        F.encode(props, "UTF-8"),
    )
    nation = table(spark, d, "nation")
    broken = as_files(nation, F.concat("n_name", F.lit(".xlsx")), F.unhex(F.lit("504B030400")))
    pdf = as_files(nation, F.concat("n_name", F.lit(".pdf")), F.encode(F.lit("%PDF-1.4"), "UTF-8"))
    parsed = doc.parse_files(events.unionByName(broken).unionByName(pdf))
    return doc.parse_errors(parsed).select("source_file", "parsing_type_used")


# One file of all rows, read in ranges of this many bytes.
_RANGE = 256 << 10
_LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]
# Orders all rows but equal ones.
_PLACE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
_NOTE = "l_linestatus || chr(10) || ', \"' || l_partkey || '\"' || CASE WHEN l_orderkey % 3 = 0 THEN chr(13) || chr(10) ELSE '' END || l_suppkey"


@check(
    "read_csv_ranges",
    f"""SELECT row_number() OVER (ORDER BY {', '.join(_PLACE)}) - 1 AS row_index,
          {" || ' | ' || ".join(f"'{c}: ' || {c}" for c in _LINEITEM)} || ' | note: ' || {clean(_NOTE)} AS text FROM lineitem""",
)
def read_csv_ranges(spark, d):
    """All line items in one file, with line feeds and separators inside quotes."""
    note = F.expr(_NOTE.replace("chr(", "char("))
    cells = [F.col(c).cast("string") for c in _LINEITEM] + [F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))]
    lines = table(spark, d, "lineitem").select(
        F.struct(*_PLACE).alias("place"), F.concat(F.concat_ws(",", *cells), F.lit("\n")).alias("line")
    )
    root = written_lines(lines, "_all items.csv", head=",".join([*_LINEITEM, "note"]) + "\n")
    return doc.parts_of(doc.parse_folder(spark, root, split_bytes=_RANGE), unique=False).select("row_index", "text")


_END = "[chr(10), chr(13), chr(13) || chr(10), chr(10) || ' ' || chr(10)][1 + turn % 4]"


@check(
    "read_jsonl_ranges",
    f"""WITH lines AS (
          SELECT *, (row_number() OVER w + sum(CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END) OVER w - CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END)::BIGINT AS line_number
          FROM conversations WINDOW w AS (ORDER BY conv_id, turn))
        SELECT * FROM (
          SELECT line_number, 'role' AS json_path, role AS text FROM lines WHERE turn % 5 <> 4
          UNION ALL SELECT line_number, 'said.[0].text', {clean('text')} FROM lines WHERE turn % 5 <> 4
          UNION ALL SELECT line_number, NULL, '{{broken ' || role FROM lines WHERE turn % 5 = 4) WHERE text <> ''""",
)
def read_jsonl_ranges(spark, d):
    """All turns in one file, with line ends of every kind, blank and broken lines."""
    whole = F.to_json(F.struct("role", F.array(F.struct("text")).alias("said")))
    line = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{broken "), "role")).otherwise(whole)
    end = F.element_at(F.array(F.lit("\n"), F.lit("\r"), F.lit("\r\n"), F.lit("\n \n")), (F.col("turn") % 4 + 1).cast("int"))
    lines = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("place"), F.concat(line, end).alias("line"))
    parts = doc.parts_of(doc.parse_folder(spark, written_lines(lines, "talks.jsonl"), split_bytes=_RANGE), unique=False)
    return parts.select("line_number", "json_path", "text")


def _word_sums(text: str) -> str:
    return f"""SELECT count(*) AS n_words, sum({hash_of('w')})::BIGINT AS word_sum FROM (SELECT unnest({words(clean(text))}) AS w"""


@check(
    "extract_long_documents",
    f"""SELECT 'all.txt' AS source_file, * FROM ({_word_sums('text')} FROM documents))
        UNION ALL SELECT 'all.xml', * FROM ({_word_sums("c_name || ' a < b ' || c_mktsegment")} FROM customer))
        UNION ALL SELECT 'all.json', * FROM ({_word_sums("o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority")} FROM orders))""",
)
def extract_long_documents(spark, d):
    """A text, an XML and a JSON file of whole tables, never held whole: every word of them, once."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("line"))
    root = written_lines(docs, "all.txt")
    customer = F.concat(
        F.lit('<customer at="1 > 0"> <!-- <no> no --> <name>'), "c_name", F.lit("</name> <![CDATA[ a < b ]]> <segment>"), "c_mktsegment",
        F.lit("</segment> </customer>\n"),
    )
    xml = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), customer.alias("line"))
    written_lines(xml, "all.xml", head="<?xml version='1.0'?>\n<all>", tail="</all>", root=root)
    order = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.array(F.struct(F.array("o_orderstatus").alias("s"), F.struct("o_orderpriority").alias("p"))).alias("more")))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.concat(order, F.lit(",\n")).alias("line"))
    written_lines(orders, "all.json", head="[", tail="null]", root=root)
    parts = doc.parts_of(doc.parse_folder(spark, root, split_bytes=_RANGE), unique=False)
    told = parts.select("source_file", F.explode(F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0))).alias("w"))
    return told.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum(F.conv(F.left(F.md5("w"), F.lit(8)), 16, 10).cast("bigint")).alias("word_sum")
    )
