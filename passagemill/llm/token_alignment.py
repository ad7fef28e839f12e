"""Tokens of two tokenizers over one text, aligned by their byte ranges.

The tokens of A and B of a document are two rising lists of byte ends. They are
merged in lockstep: one state vector holds, for every document of a slice, the
places of its present A and B token. A step tells the pair as a link, notes a
cut where both tokens end together, and moves on whichever token ends first
(both at a cut). Documents that are done leave the vector. Documents above a
length take several places in it, each from one meeting of words to another,
where both tokenizers cut anyway.

Texts are encoded by the libraries. Words repeat, and no token of either
vocabulary reaches over a blank between two other characters, so each
different word of a batch is encoded once, many in one call; a vocabulary
that has such a token gets whole texts.

Counts over the corpus are added up per task before they are shuffled. An id
pair that many documents hold is met again through a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import matched, placed_beside, text_of, with_row_id
from passagemill.llm.tokenizing import BYTE_LETTERS
from passagemill.session import new_path

MEETING = re.compile(r"(?<=\S)(?= \S)")
# White space other than blanks and line feeds.
RARE_SPACE = re.compile(r"[^\S \n]")
PAIR = 1 << 32  # A's id times this, plus B's id
MADE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@dataclass(frozen=True)
class AlignOptions:
    byte_level: str  # vocabulary file of A, for the tokenizers library
    pieces: str  # model file of B, for the sentencepiece library
    slice_words: int = 100_000  # words merged together
    lane_words: int = 512  # longer documents take several places of the state vector
    chunk_chars: int = 1 << 16  # of different words, encoded in one call


@dataclass(frozen=True)
class Ids:
    """Ids and their byte lengths, one row of ``first`` to ``first + count`` for each word."""

    ids: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of a list of words one after the other, and how many ids each has."""
        count = self.count[words]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[words] - (ends - count), count)
        return self.ids[at], self.sizes[at], count


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, options: AlignOptions):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.options = options
        self.a = Tokenizer.from_file(options.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=options.pieces)
        byte_of = {c: b for b, c in BYTE_LETTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_LETTERS}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            # Added tokens are not byte-level; encoding does not give them.
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(map(byte_of.__contains__, token)) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in each], np.int64) for each in (self.a_bytes, self.b_bytes))
        over = re.compile(r"\S ")
        self.whole = any(over.search(x.decode("utf-8", "replace")) for x in [*self.a_bytes, *self.b_bytes])
        self.digits = digit_table(max(len(self.a_bytes), len(self.b_bytes)))

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the blank that stands before it.

        The first has the blank put before the text. Joined by blanks they are the text.
        """
        if self.whole:
            return [text]
        odd = "  " in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")
        if odd or RARE_SPACE.search(text):
            return [part[1:] for part in MEETING.split(" " + text)]
        return text.split(" ")

    def both(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of blank + text by A, of text by B, and whether both give back the bytes."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        raw = b" " + text.encode()
        return a, b, self.joined(self.a_bytes, a) == raw == self.joined(self.b_bytes, b)

    @staticmethod
    def joined(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(table.__getitem__, ids))

    def encode_words(self, words: list[str]) -> tuple[Ids, Ids, np.ndarray]:
        """A's and B's ids of each different word, and which words both tell whole."""
        n = len(words)
        a_parts: list[list[int]] = []
        b_parts: list[list[int]] = []
        counts = np.zeros((2, n), np.int64)
        good = np.ones(n, bool)
        order: list[int] = []
        chunk: list[int] = []
        size = 0

        def one(i: int) -> None:
            a, b, good[i] = self.both(words[i])
            a_parts.append(a)
            b_parts.append(b)
            counts[0, i], counts[1, i] = len(a), len(b)
            order.append(i)

        def done() -> None:
            if not chunk:
                return
            a, b, fits = self.both(" ".join([words[i] for i in chunk]))
            bounds = np.cumsum([len(words[i].encode()) + 1 for i in chunk])
            ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            to_a, to_b = np.searchsorted(ends_a, bounds, "right"), np.searchsorted(ends_b, bounds, "right")
            if fits and np.array_equal(ends_a[to_a - 1], bounds) and np.array_equal(ends_b[to_b - 1], bounds):
                counts[0, chunk], counts[1, chunk] = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
                a_parts.append(a)
                b_parts.append(b)
                order.extend(chunk)
            else:  # some word has no faithful tokens
                for i in chunk:
                    one(i)

        for i, word in enumerate(words):
            if not word or word[0].isspace() or word[-1].isspace():
                one(i)
                continue
            chunk.append(i)
            size += len(word)
            if size >= self.options.chunk_chars:
                done()
                chunk, size = [], 0
        done()

        def ids(parts: list[list[int]], sizes: np.ndarray, count: np.ndarray) -> Ids:
            flat = np.fromiter((x for part in parts for x in part), np.int64, sum(map(len, parts)))
            first = np.empty(n, np.int64)
            first[order] = np.cumsum(count[order]) - count[order]
            return Ids(flat, sizes[flat], first, count)

        return ids(a_parts, self.a_sizes, counts[0]), ids(b_parts, self.b_sizes, counts[1]), good


def digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, with room for one more character, and their number."""
    width = len(str(n - 1))
    powers = 10 ** np.arange(width)
    numbers = np.arange(n)
    count = np.maximum(1, (numbers[:, None] >= powers).sum(1))
    table = np.zeros((n, width + 1), np.uint8)
    for k in range(width):
        places = count - 1 - k
        rows = places >= 0
        table[rows, places[rows]] = 48 + numbers[rows] // powers[k] % 10
    return table, count


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of many lanes, each advanced one step at a time.

    ``lanes`` has a row (first A token, first B token, end of A's, end of B's)
    per lane. Gives the A and B token of each link and whether both end there,
    in the order of the tokens.
    """
    a, b, a_stop = lanes[:, 0], lanes[:, 1], lanes[:, 2]
    some = a < a_stop
    a, b, a_stop = a[some], b[some], a_stop[some]
    told_a, told_b, told_cut = [], [], []
    while len(a):
        end_a, end_b = a_ends[a], b_ends[b]
        cut = end_a == end_b
        told_a.append(a)
        told_b.append(b)
        told_cut.append(cut)
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        # Both lists of a lane end at one byte, so A's end is also B's.
        on = (a < a_stop) | ~cut
        if not on.all():
            a, b, a_stop = a[on], b[on], a_stop[on]
    if not told_a:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    a, b, cut = np.concatenate(told_a), np.concatenate(told_b), np.concatenate(told_cut)
    # Every step moves on at least one token, so the sum tells the order.
    place = np.full(int((a + b).max()) + 1, -1, np.int64)
    place[a + b] = np.arange(len(a))
    order = place[place >= 0]
    return a[order], b[order], cut[order]


class Told:
    """What is known of a document so far."""

    __slots__ = ("counts", "digest", "pairs", "times")

    def __init__(self):
        self.counts = np.zeros(4, np.int64)  # tokens of A, of B, groups, links
        self.digest = hashlib.sha256()
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Different id pairs and how often each is linked."""
        if len(self.pairs) == 1:
            return self.pairs[0], self.times[0]
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate(self.times)).astype(np.int64)


def align_texts(own: Aligner, texts: list[str]) -> list[Told]:
    """Align every text of a batch, a bounded number of words at a time."""
    options = own.options
    number: dict[str, int] = {}
    split: list[np.ndarray] = []
    for text in texts:
        words = own.words(text) if text else []
        for word in words:
            if word not in number:
                number[word] = len(number)
        # Words are kept as numbers; the strings of all texts would take ten times as much.
        split.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    a_of, b_of, good = own.encode_words(list(number))
    told = [Told() for _ in texts]
    lanes: list[tuple[int, np.ndarray]] = []
    held = 0
    for doc, numbers in enumerate(split):
        if not len(numbers) or not good[numbers].all():
            continue
        for first in range(0, len(numbers), options.lane_words):
            lane = numbers[first : first + options.lane_words]
            lanes.append((doc, lane))
            held += len(lane)
            if held >= options.slice_words:
                merge_slice(own, a_of, b_of, lanes, told)
                lanes, held = [], 0
    if lanes:
        merge_slice(own, a_of, b_of, lanes, told)
    return told


def merge_slice(own: Aligner, a_of: Ids, b_of: Ids, lanes: list[tuple[int, np.ndarray]], told: list[Told]) -> None:
    """Merge lanes in lockstep and add what they tell to their documents."""
    words = np.concatenate([w for _, w in lanes])
    lane_words = np.array([len(w) for _, w in lanes])
    last = np.cumsum(lane_words) - 1
    a_ids, a_sizes, a_count = a_of.of(words)
    b_ids, b_sizes, b_count = b_of.of(words)
    a_stop, b_stop = np.cumsum(a_count)[last], np.cumsum(b_count)[last]
    a_start, b_start = np.concatenate(([0], a_stop[:-1])), np.concatenate(([0], b_stop[:-1]))
    a, b, cut = lockstep(np.cumsum(a_sizes), np.cumsum(b_sizes), np.stack([a_start, b_start, a_stop, b_stop], 1))

    # A lane's links follow each other, and its last one is a cut.
    lane_of_link = np.searchsorted(a_stop, a, "right")
    group_of_link = np.cumsum(cut) - cut
    a_group, b_group = np.empty(len(a_ids), np.int64), np.empty(len(b_ids), np.int64)
    a_group[a], b_group[b] = group_of_link, group_of_link
    cut_a, cut_b = a[cut], b[cut]  # last tokens of each group

    # The text of a group: A's ids, then B's. Each token is followed by one character.
    before_b = np.concatenate(([0], cut_b[:-1] + 1))
    a_at = np.arange(len(a_ids)) + before_b[a_group]
    b_at = np.arange(len(b_ids)) + cut_a[b_group] + 1
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[a_at[cut_a]], mark[b_at[cut_b]] = ord("|"), ord(";")
    table, count = own.digits
    shown, size = table[ids], count[ids]
    shown[np.arange(len(ids)), size] = mark
    written = shown[np.arange(table.shape[1]) <= size[:, None]].tobytes()
    ends = np.cumsum(size + 1)[a_stop + b_stop - 1].tolist()

    # The lanes of a document follow each other.
    doc_of_lane = np.array([doc for doc, _ in lanes])
    docs, doc_of_lane = np.unique(doc_of_lane, return_inverse=True)
    pair = a_ids[a] * PAIR + b_ids[b]
    doc_of_link = doc_of_lane[lane_of_link]
    # Sorted by document, then pair; documents are in order already.
    order = np.lexsort((pair, doc_of_link))
    pair, doc_of_pair = pair[order], doc_of_link[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc_of_pair[1:] != doc_of_pair[:-1]))))
    times = np.diff(first, append=len(pair))
    bounds = np.searchsorted(doc_of_pair[first], np.arange(len(docs) + 1)).tolist()
    n_links = np.bincount(doc_of_link, minlength=len(docs))
    n_groups = np.bincount(doc_of_link[cut], minlength=len(docs))
    n_a = np.bincount(doc_of_lane, a_stop - a_start, len(docs)).astype(np.int64)
    n_b = np.bincount(doc_of_lane, b_stop - b_start, len(docs)).astype(np.int64)
    different = pair[first]
    last_lane = np.searchsorted(doc_of_lane, np.arange(len(docs)), "right") - 1
    at = 0
    for i, doc in enumerate(docs.tolist()):
        own_told = told[doc]
        end = ends[last_lane[i]]
        # Between the slices of one document stands the mark that ends a group.
        own_told.digest.update((b";" if own_told.counts[0] else b"") + written[at : end - 1])
        at = end
        own_told.counts += [n_a[i], n_b[i], n_groups[i], n_links[i]]
        own_told.pairs.append(different[bounds[i] : bounds[i + 1]])
        own_told.times.append(times[bounds[i] : bounds[i + 1]])


_aligners: dict[AlignOptions, Aligner] = {}


def aligner(options: AlignOptions) -> Aligner:
    """One pair of tokenizers per worker."""
    if options not in _aligners:
        _aligners[options] = Aligner(options)
    return _aligners[options]


TALLY_PAIRS = 1_000_000  # different pairs a task counts before it tells them
LINKS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def link_rows(rows: DataFrame, options: AlignOptions) -> DataFrame:
    """Per row of (..., text) its counts, digest and links; then rows without ``__row`` that tell how many documents of a task hold each pair."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(options)
        names: list[str] = []
        types: list[pa.DataType] = []
        held: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def lists(arrays: list[np.ndarray]) -> pa.ListArray:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
            flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate(held), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate(times)).astype(np.int64)

        def tally(pairs: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            nothing = [pa.nulls(1, t) for t in types]
            numbers = [pa.nulls(1, pa.int64()) for _ in range(4)]
            return pa.RecordBatch.from_arrays([*nothing, *numbers, pa.nulls(1, pa.string()), lists([pairs]), lists([docs])], names)

        for batch in batches:
            names = [*batch.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            types = list(batch.schema.types[:-1])
            told = align_texts(own, batch.column(batch.num_columns - 1).to_pylist())
            counts = np.array([t.counts for t in told], np.int64).reshape(-1, 4)
            links = [t.links() for t in told]
            digests = [t.digest.hexdigest() if t.counts[0] else "" for t in told]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(counts[:, i]) for i in range(4)], pa.array(digests, pa.string()),
                 lists([p for p, _ in links]), lists([t for _, t in links])],
                names,
            )
            if any(len(p) for p, _ in links):
                every = np.concatenate([p for p, _ in links])
                held.append(every)
                times.append(np.ones(len(every), np.int64))
                pairs, docs = merged()
                held, times = [pairs], [docs]
                if len(pairs) >= TALLY_PAIRS:
                    yield tally(pairs, docs)
                    held, times = [], []
        if held:
            yield tally(held[0], times[0])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes)
    return rows.mapInArrow(run, f"{kinds}, {LINKS}")


def align_tokens(
    docs: DataFrame, options: AlignOptions, *, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """Each row with its tokens of A and B, aligned.

    A encodes a blank and the text, B the text, before which it puts a blank
    itself. Adds ``n_a`` and ``n_b`` (tokens), ``n_groups`` (stretches between
    byte offsets where tokens of both end), ``n_links`` (pairs of tokens whose
    bytes overlap), ``n_best`` (links whose id pair is held by as many
    documents as any pair of that A id), ``count_sum`` (over all links, the
    documents that hold the link's id pair) and ``groups_sha256``, the digest
    of the groups' ids.

    Null and empty texts have no tokens, nor have texts that the tokens do not
    give back byte by byte: zeros and an empty digest. Texts of any length are
    taken whole. Rows that repeat are documents of their own. ``columns`` of the
    input (all, if not given) come along; one that is named like a column made
    here is replaced. An empty table gives an empty table.
    """
    carried = placed_beside(docs, columns, MADE)
    held = docs.select(F.struct(*[F.col(c) for c in carried], F.lit(0).alias("__")).alias("row"), text_of(text).alias("text"))
    numbered = with_row_id(held).select("__row", "row", "text")
    spark = docs.sparkSession
    path = new_path(spark, "links")
    work = link_rows(numbered, options)
    # Sorted id pairs are small once compressed.
    work.write.option("compression", "zstd").parquet(path)
    linked = spark.read.schema(work.schema).parquet(path)

    told = linked.filter("__row IS NOT NULL")
    each = lambda rows, keep: rows.select(*keep, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        *keep, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    counts = each(linked.filter("__row IS NULL"), []).groupBy("pair").agg(F.sum("times").alias("docs"))
    # The pairs of an A id are at most as many as B has ids.
    of_a = Window.partitionBy(F.expr(f"pair div {PAIR}"))
    best = counts.withColumn("is_best", F.col("docs") == F.max("docs").over(of_a))
    table_path = new_path(spark, "pairs")
    best.write.parquet(table_path)
    table = spark.read.schema(best.schema).parquet(table_path)
    links = matched(each(told, ["__row"]), table, "pair", "docs")
    sums = links.groupBy("__row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("docs")).alias("count_sum"),
    )
    narrow = told.select("__row", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return narrow.join(sums, "__row", "left").select(
        *[F.col("row").getField(c).alias(c) for c in carried],
        *["n_a", "n_b", "n_groups", "n_links"],
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
