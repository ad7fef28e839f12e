"""Periodic runs, repeated lines and token alignment on small odd tables, against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from passagemill.llm import line_dedup, periodic_runs, queries, token_alignment
from passagemill.session import materialize

SCHEMA = "doc_id bigint, text string, kept string, h string, n_a string, runs string, row string"
LINE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of stars"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
OPTIONS = token_alignment.AlignOptions(
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
)
TEXTS = [
    None,
    "",
    " \n\t ",
    "\n",
    "one",
    LINE,
    f"\t{LINE.upper()} \n{LINE}\n\nsame short\nsame short",
    (LINE + "\n") * 30 + "end",
    "a b " * 40 + "c " + "a b " * 12 + "x",
    "a " * 23 + "b " + "a " * 24,
    "x" * 5_000,
    "é ß 日本語 \x1c odd  spaces\r\n\n don't stop <|endoftext|> <s> </s> <unk> <0x41>",
    "has ▁ the mark",
    "  two before and two after  ",
    "ends in a line feed\n",
    "don't \x85 a　b   c d \x00 ',;'",
    "w1 w2 w3 w4 w5 " * 500,
]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "clash", "clash", "clash", None, "clash") for i, t in enumerate(TEXTS)]
    found += [(100 + i, f"{LINE}\n own line of number {i}\n{LINE.title()} ", "c", "c", "c", "c", "c") for i in range(40)]
    odd = [(None, f"{LINE}\nand more of it"), (None, "only a null id has this\nonly a null id has this"), (5, LINE), (5, LINE)]
    return [*found, *[(*r, None, None, None, None, None) for r in odd]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return materialize(spark.createDataFrame(rows, SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return materialize(spark.createDataFrame([], SCHEMA), "none")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_runs(words):
    """Every stretch of every period, from its longest extension; the smallest period only."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if length >= max(24, 3 * p):
                found.setdefault((i, length), p)  # smaller periods come first
            i = j
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return runs, best, left


def test_runs(docs, rows, empty):
    plain = Counter()
    for r in rows:
        words = WORDS.findall(r[1] or "")
        runs, best, left = plain_row(words)
        plain[(r[0], len(words), tuple(runs), len(runs), best, left)] += 1
    for options in (None, periodic_runs.RunOptions(slice_words=1)):
        got = periodic_runs.collapse_runs(docs, options).collect()
        shown = Counter(
            (r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.n_runs, r.best and tuple(r.best), r.collapsed) for r in got
        )
        assert shown == plain
    assert {(r.kept, r.h, r.row) for r in got} == {(r[2], r[3], r[6]) for r in rows}
    assert periodic_runs.collapse_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.RunOptions(min_periods=2)


def test_runs_of_random_words():
    draw = np.random.default_rng(7)
    for letters in (1, 2, 3):
        lists = []
        for _ in range(150):
            piece = draw.integers(0, letters, draw.integers(1, 30))
            words = np.tile(piece, draw.integers(1, 9))
            words = np.concatenate([draw.integers(0, letters, draw.integers(0, 20)), words, draw.integers(0, letters, draw.integers(0, 20))])
            if draw.random() < 0.3:
                words[draw.integers(0, len(words))] = 9
            lists.append(words)
        got = periodic_runs.find_runs(np.concatenate(lists), np.array([len(x) for x in lists]))
        assert got == [plain_runs(x.tolist()) for x in lists]


def test_planted_runs_query(spark, tmp_path):
    draw = np.random.default_rng(8)
    rows = [(i, " ".join(draw.choice(list("abcdefgh"), draw.integers(0, 200)))) for i in range(120)] + [(None, LINE * 3), (500, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for doc_id, text in rows:
        words = WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs, best, left = plain_row(words)
        s, length, p = best or (None, None, None)
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
        assert got[doc_id] == (len(runs), s, length, p, best and 1000 * length // p, sha(listed), sha(left))
    assert changed > 5


def test_lines(docs, rows, empty):
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (d is None, d or 0)
    for least in (2, 3):
        held = defaultdict(list)
        for r in rows:
            for k in {fold(x) for x in (r[1] or "").split("\n")}:
                held[k].append(r[0])
        plain = Counter()
        for r in rows:
            lines = (r[1] or "").split("\n")
            left = []
            for x in lines:
                k = fold(x)
                shared = len(k) >= 10 and len(held[k]) >= least
                if not shared or min(held[k], key=order) == r[0]:
                    left.append(x)
            plain[(r[0], len(lines), len(lines) - len(left), "\n".join(left))] += 1
        got = line_dedup.drop_repeated_lines(docs, line_dedup.LineOptions(min_docs=least)).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == plain
    assert {(r.h, r.row) for r in got} == {(r[3], r[6]) for r in rows}
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_hot_lines_are_met_by_broadcast(spark):
    """A line of most documents, and lines of two each; the same result at any bound of hot keys."""
    from passagemill.llm import common

    rows = [(i, f"one line that all documents hold\nline of pair {i // 2} and its twin\nline of {i} alone") for i in range(300)]
    df = materialize(spark.createDataFrame(rows, "id bigint, text string"), "hot")
    table = materialize(line_dedup.repeated_lines(df, line_dedup.LineOptions()), "lines")
    hot, cold = common.hot_and_cold(table, "n", least=100)
    assert (hot.count(), cold.count()) == (1, 150)
    got = line_dedup.drop_repeated_lines(df, id_col="id").groupBy("n_dropped").count().collect()
    assert {r.n_dropped: r["count"] for r in got} == {0: 1, 1: 149, 2: 150}  # the owner of a line keeps it


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(OPTIONS.byte_level)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=OPTIONS.pieces)
    bytes_of = {chr(x): x for x in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    bytes_of |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in bytes_of)}
    return a, b, bytes_of


def plain_alignment(text, a, b, bytes_of):
    """Ids by the libraries on the whole text, groups and links by byte ranges."""
    if not text:
        return None
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    told_a = [bytes(bytes_of[c] for c in a.id_to_token(i)) for i in ids_a]
    told_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if not b"".join(told_a) == b"".join(told_b) == b" " + text.encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in told_a]).tolist(), np.cumsum([len(x) for x in told_b]).tolist()
    groups, links, i, j = [], Counter(), 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        to_i, to_j = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
        for x in range(i, to_i):
            for y in range(j, to_j):
                if max(ends_a[x] - len(told_a[x]), ends_b[y] - len(told_b[y])) < min(ends_a[x], ends_b[y]):
                    links[(ids_a[x], ids_b[y])] += 1
        i, j = to_i, to_j
    return len(ids_a), len(ids_b), groups, links


def compare_alignment(got, rows, tokenizers):
    found = [plain_alignment(r[1], *tokenizers) for r in rows]
    docs = Counter(pair for f in found if f for pair in f[3])
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    plain = Counter()
    for r, f in zip(rows, found):
        if f is None:
            plain[(r[0], 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        n_a, n_b, groups, links = f
        best = sum(n for pair, n in links.items() if docs[pair] == most[pair[0]])
        total = sum(n * docs[pair] for pair, n in links.items())
        plain[(r[0], n_a, n_b, len(groups), sum(links.values()), best, total, sha(";".join(groups)))] += 1
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in got) == plain


def test_alignment(docs, rows, empty, tokenizers):
    small = token_alignment.AlignOptions(OPTIONS.byte_level, OPTIONS.pieces, slice_words=7, lane_words=3, chunk_chars=20)
    for options in (OPTIONS, small):
        got = token_alignment.align_tokens(docs, options).collect()
        compare_alignment(got, rows, tokenizers)
    assert {(r.kept, r.h, r.row) for r in got} == {(r[2], r[3], r[6]) for r in rows}
    assert token_alignment.align_tokens(empty, OPTIONS).count() == 0


def test_alignment_of_random_texts(spark, tokenizers):
    draw = np.random.default_rng(9)
    letters = list("aé bcß日 \n\t.,'1٣🙂 ​T") + [" ", " ", "the", "ing", " word", "<s>", "  "]
    rows = [(i, "".join(draw.choice(letters, draw.integers(1, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = token_alignment.align_tokens(df, OPTIONS).collect()
    compare_alignment(got, rows, tokenizers)


def test_a_vocabulary_over_blanks_gets_whole_texts(tokenizers):
    own = token_alignment.Aligner(OPTIONS)
    assert not own.whole
    own.whole = True
    assert own.words("a b  c") == ["a b  c"]
