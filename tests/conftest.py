from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from passagemill.session import local_session  # noqa: E402

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="6g")


@pytest.fixture
def folder(tmp_path):
    """Small files of several kinds, some of which must be left out."""
    root = tmp_path / "docs"
    files = {
        "sample.txt": "This is a sample text file for testing.",
        "sample.md": "# Markdown Sample\n\nThis is a sample markdown document.\n\n- Item 1\n- Item 2\n\nAnother paragraph.\n",
        "sample.json": '{"name": "Test", "version": "1.0", "details": {"description": "Testing JSON parsing.", "items": ["itemA", "itemB"]}}',
        "sample.csv": "id,name,value\n1,alpha,100\n2,beta,200\n3,gamma,300\n",
        "sub dir/page.html": "<html><head><style>p{}</style></head><body><p>One &amp; two</p><script>no()</script><p>&eacute;t&eacute;</p></body></html>",
        "sub dir/data.xml": "<?xml version='1.0'?><a><b>x &lt; y</b><!-- no --><c>z</c></a>",
        "lines.jsonl": '{"a": 1}\n\nnot json\n{"b": [true, null, 1.0, 1e16]}\n',
        "ragged.csv": 'code,amount,flag\n007,1.50,true\n008,2,false,extra\n,,\n009,x y,true\n"a ""b""",3,true\n',
        "tabs.tsv": "x\ty\n1\thello\n",
        "code.py": "def f():\n    return 1\n",
        "web.txt": "<!DOCTYPE html><html><body>hidden page</body></html>",
        "notes.log": "plain notes in a file of unknown type",
        "bad.json": '{"open": ',
        "blob.bin": "\x00\x01\x02",
        "empty.txt": "",
        ".hidden.txt": "no",
        ".git/config.txt": "no",
        "__MACOSX/x.txt": "no",
        "old.TMP": "no",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(root)
