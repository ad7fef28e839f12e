from __future__ import annotations

import io
import os
import time

import pytest
from pyspark.sql import functions as F

from passagemill.plans.ingest import IngestOptions, run_ingest
from passagemill.plans.answer import chat_requests, parse_answers, rag_batch
from passagemill.sources import store as st
from passagemill.sources.documents import parse_folder, parts_of, read_documents
from passagemill.sources.files import list_source_files
from passagemill.streaming.incremental import current_chunks, incremental_ingest, refresh_store


def test_listing(spark, folder):
    names = {r[0] for r in list_source_files(spark, folder).select("source_file").collect()}
    assert "sub dir/page.html" in names and "sample.txt" in names
    assert not any(n.startswith((".", "__MACOSX", "old")) for n in names)


def test_parts(spark, folder):
    parts, errors = read_documents(spark, folder)
    rows = {r["part_id"]: r for r in parts.collect()}
    texts = {k: r["text"] for k, r in rows.items()}
    assert texts["sample.txt"] == "This is a sample text file for testing."
    assert texts["sample.md"].startswith("# Markdown Sample This is") and rows["sample.md"]["content_type"] == "markdown"
    json_ids = sorted(k for k in rows if k.startswith("sample.json"))
    assert json_ids == [
        "sample.json_jsodetails.descrip", "sample.json_jsodetails.items", "sample.json_jsodetails.items_d1",
        "sample.json_jsoname", "sample.json_jsoversion",
    ]
    assert texts["sample.csv_row0"] == "id: 1 | name: alpha | value: 100"
    assert texts["sub_dir_page.html"] == "One & two été"
    assert texts["sub_dir_data.xml"] == "x < y z"
    assert texts["tabs.tsv_row0"] == "x: 1 | y: hello"
    assert rows["code.py"]["content_type"] == "code"
    assert texts["web.txt"] == "hidden page" and rows["web.txt"]["parsing_type_used"] == ".html"
    assert rows["notes.log"]["extraction_method"] == "generic_text_fallback"
    assert texts["lines.jsonl_lin3"] == "not json" and rows["lines.jsonl_lin3"]["content_type"] == "jsonl_malformed_line_text"
    lines = {(r["line_number"], r["json_path"]): r["text"] for r in rows.values() if r["source_file"] == "lines.jsonl"}
    assert lines[(4, "b.[0]")] == "True" and lines[(4, "b.[2]")] == "1.0" and lines[(4, "b.[3]")] == "1e+16"
    ragged = {r["row_index"]: r["text"] for r in rows.values() if r["source_file"] == "ragged.csv"}
    assert ragged == {
        0: "code: 007 | amount: 1.50 | flag: True", 1: "code: 008 | amount: 2 | flag: False | column_3: extra",
        3: "code: 009 | amount: x y | flag: True", 4: 'code: a "b" | amount: 3 | flag: True',
    }
    assert not any(r["source_file"] in ("empty.txt", "blob.bin") for r in rows.values())
    assert [r["source_file"] for r in errors.collect()] == ["bad.json"]


def test_long_jsonl_in_splits(spark, folder):
    with open(os.path.join(folder, "many+ lines.jsonl"), "w") as f:
        f.writelines(f'{{"n": {i}, "t": "{"x" * (i % 50)}"}}\n' + ("\n" if i % 9 == 0 else "") for i in range(3000))
    columns = ["source_file", "part_id", "line_number", "json_path", "text", "content_type", "file_size_bytes"]

    def rows(**options):
        parts = parts_of(parse_folder(spark, folder, **options)).filter(F.lower("source_file").endswith(".jsonl"))
        return sorted(map(str, parts.select(*columns).collect()))

    whole = rows()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = rows(split_bytes=1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(whole) > 5800 and split == whole


def test_ingest_default(spark, folder, tmp_path):
    out = str(tmp_path / "store")
    assert run_ingest(spark, folder, out)
    chunks, manifest = st.load_store(spark, out)
    report = st.validate_store(chunks).first()
    assert report["valid"] and report["items"] == report["ids"] == chunks.count()
    assert manifest["chunker"] == "sdpm" and manifest["vector_dimension"] == 64 and manifest["metric"] == "cosine"
    assert chunks.filter("source_file = 'sample.txt'").first()["display_source_name"] == "sample.txt (Chk:1)"
    with pytest.raises(FileExistsError):
        run_ingest(spark, folder, out)
    with pytest.raises(ValueError):
        st.load_store(spark, out, model="other")
    assert run_ingest(spark, folder, out, IngestOptions(overwrite=True, strategy="token"))


def test_ingest_with_labels_and_points(spark, folder, tmp_path):
    out = str(tmp_path / "store")
    options = IngestOptions(
        strategy="recursive", enable_classification=True, candidate_labels=["sample text", "numbers"], prepare_viz_data=True
    )
    assert run_ingest(spark, folder, out, options)
    chunks, manifest = st.load_store(spark, out)
    assert {r[0] for r in chunks.select("classification_status").distinct().collect()} == {"success"}
    assert manifest["classification_enabled"] and manifest["config_summary"]["candidate_labels_count"] == "2"
    assert st.read_viz_points(spark, f"{out}/viz_points").count() == chunks.count()
    queries = spark.createDataFrame([(1, "sample text file")], "query_id int, query string")
    prompts, citations = rag_batch(queries, chunks, k=5, reranker="bm25", top_n=3)
    assert "[Source 1]" in prompts.first()["context"] and citations.count() <= 3
    assert '"stream":false' in chat_requests(prompts, "m").first()["request"]
    answers = parse_answers(spark.sql("""select 1 query_id, '{"choices":[{"message":{"content":"x [Source 1]"}}]}' response"""))
    assert answers.first()["answer"] == "x [Source 1]"


def test_empty_folder(spark, tmp_path):
    root = tmp_path / "nothing"
    root.mkdir()
    assert run_ingest(spark, str(root), str(tmp_path / "store")) is False


def test_classification_without_classifier(spark, folder, tmp_path):
    out = str(tmp_path / "store")
    assert run_ingest(spark, folder, out, IngestOptions(enable_classification=True, classifier=None))
    chunks, _ = st.load_store(spark, out)
    assert {r[0] for r in chunks.select("classification_status").distinct().collect()} == {"skipped_no_model_name"}


def test_stream_takes_new_files(spark, folder, tmp_path):
    out, state = str(tmp_path / "store"), str(tmp_path / "state")
    options = IngestOptions(strategy="token")
    incremental_ingest(spark, folder, out, state, options).awaitTermination()
    before = current_chunks(spark, out).count()
    with open(os.path.join(folder, "later.txt"), "w") as f:
        f.write("a later file")
    incremental_ingest(spark, folder, out, state, options).awaitTermination()
    assert current_chunks(spark, out).count() == before + 1


def test_refresh_replaces_changed_files(spark, folder, tmp_path):
    out = str(tmp_path / "store")
    options = IngestOptions(strategy="token")
    assert refresh_store(spark, folder, out, options) == 0
    assert refresh_store(spark, folder, out, options) == -1
    path = os.path.join(folder, "sample.txt")
    with open(path, "w") as f:
        f.write("changed")
    os.utime(path, (time.time() + 5, time.time() + 5))
    assert refresh_store(spark, folder, out, options) == 1
    got = current_chunks(spark, out).filter(F.col("source_file") == "sample.txt").select("text").collect()
    assert [r[0] for r in got] == ["changed"]


def test_docx_tables_and_date_formats():
    import io
    import zipfile

    from passagemill.sources.structured import docx_parts, shows_date

    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
    table = f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc><w:tc>{p('other')}</w:tc></w:tr></w:tbl>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        body = p("before") + table + p("after")
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    assert [x["raw_text"] for x in docx_parts(held)] == ["before\ncell\nother\nafter"]
    assert [shows_date(c) for c in ("yyyy-mm-dd", "mmm", "h:mm:ss", '0.0" days"', "[Red]0.00", "General")] == [
        True, True, False, False, False, False,
    ]


def test_later_cells_of_another_type_stay():
    from passagemill.sources.structured import delimited_parts

    content = "n,f\n" + "1,true\n" * 1000 + "12a,maybe\n7,false\n"
    got = [p["raw_text"] for p in delimited_parts(io.BytesIO(content.encode()), ",")]
    assert len(got) == 1002 and got[0] == "n: 1 | f: True"
    assert got[1000:] == ["n: 12a | f: maybe", "n: 7 | f: False"]
