"""Removal of passages that a document with a smaller id has as well.

Every string of ``width`` bytes counts, so in principle all suffixes of all
texts are sorted to that depth. Three steps keep apart what need not be
sorted together; none loses a repeated string:

* Each string is owned by its minimizer, the least hash of the short grams in
  it. Neighbouring strings mostly share theirs, and equal strings have equal
  minimizers, so a run of strings travels as one stretch of text.
* Stretches of several runs that are equal as a whole are merged: all but
  those of the smallest document are settled, since their strings are all in
  it. So copies and common passages enter the sort once.
* Of the rest, a run is sorted only if its minimizer is in two documents.

What is left is sorted by deep-shallow sorting: a multikey sort to a shallow
depth, then blind tries for groups that still agree.

The texts lie in written blocks. A step is a question of each block to the
buckets that own its entries, packed into one row per bucket, and an answer
of one bit per entry in the same order. A block asks once per different entry,
so a passage that a third of all documents share is asked for once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import text_of
from passagemill.session import materialize

LAST = np.int64(2**63 - 1)  # stands for a null id
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class SuffixOptions:
    width: int = 50
    gram: int = 20
    shallow: int = 16  # bytes sorted before the tries
    group: int = 8  # strings of a run that are sent together
    stretch: int = 16  # runs in a stretch, on average
    block_bytes: int = 1 << 20
    slice_bytes: int = 1 << 16
    bucket_bytes: int = 8 << 20
    seed: int = 5


# ---------------------------------------------------------------- sorting


def shallow_sort(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort of byte rows by eight bytes at a time: order, and where groups equal to ``depth`` begin."""
    order = np.arange(len(rows))
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for at in range(0, depth, 8):
        # Only rows that are equal so far are sorted by the next key.
        size = np.diff(np.append(np.flatnonzero(new), len(rows)))
        group = np.repeat(np.arange(len(size)), size)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        key = np.ascontiguousarray(rows[order[tied], at : at + 8]).view(">u8").reshape(-1)
        inner = np.lexsort((key, group[tied]))
        order[tied] = order[tied][inner]
        key, group = key[inner], group[tied]
        split = np.ones(len(tied), bool)
        split[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[tied] |= split
    return order, new


def trie_sort(rows: np.ndarray, order: np.ndarray, new: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Blind tries over all groups at once, level by level.

    A node of a trie knows only the place of the first byte in which its rows
    differ; its children are the rows by that byte. A node without such a
    place is a leaf of equal rows.
    """
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(order)))
    active = np.flatnonzero(np.repeat(size > 1, size))
    while len(active):
        first = new[active]
        first[0] = True
        heads = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        part = rows[order[active], depth:]
        differ = np.minimum.reduceat(part, heads, axis=0) != np.maximum.reduceat(part, heads, axis=0)
        inner_node = differ.any(axis=1)
        place = differ.argmax(axis=1)
        keep = inner_node[number]
        active, part, number = active[keep], part[keep], number[keep]
        if not len(active):
            break
        byte = part[np.arange(len(part)), place[number]]
        inner = np.lexsort((byte, number))
        order[active] = order[active][inner]
        byte, number = byte[inner], number[inner]
        split = np.ones(len(active), bool)
        split[1:] = (byte[1:] != byte[:-1]) | (number[1:] != number[:-1])
        new[active] |= split
        size = np.diff(np.append(np.flatnonzero(split), len(active)))
        active = active[np.repeat(size > 1, size)]
    return order, new


def deep_shallow(rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows, and the number of the group of equal rows for each place in it."""
    depth = min(shallow, rows.shape[1] // 8 * 8)
    order, new = shallow_sort(rows, depth)
    if rows.shape[1] > depth:
        order, new = trie_sort(rows, order, new, depth)
    return order, np.cumsum(new) - 1


# ---------------------------------------------------------------- blocks


@dataclass
class Runs:
    """Runs of strings: first and last start, place and hash of the minimizer, document and stretch."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    stretch: np.ndarray


def gram_hashes(buf: np.ndarray, gram: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place."""
    whole, done, part, size, left = None, 0, byte_values(seed)[buf], 1, gram
    while left:
        if left & 1:
            if whole is None:
                whole, done = part, size
            else:
                n = len(buf) - done - size + 1
                whole = whole[:n] * np.uint64(pow(int(SPREAD), size, 2**64)) + part[done : done + n]
                done += size
        left >>= 1
        if left:
            n = len(buf) - 2 * size + 1
            part = part[:n] * np.uint64(pow(int(SPREAD), size, 2**64)) + part[size : size + n]
            size *= 2
    return mixed(whole)


def mixed(whole: np.ndarray) -> np.ndarray:
    whole = (whole ^ (whole >> np.uint64(29))) * MIX
    return whole ^ (whole >> np.uint64(32))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64)


def hashes_at(buf: np.ndarray, places: np.ndarray, options: SuffixOptions) -> np.ndarray:
    """:func:`gram_hashes` at some places only."""
    values, whole = byte_values(options.seed), np.zeros(len(places), np.uint64)
    for t in range(options.gram):
        whole = whole * SPREAD + values[buf[places + t]]
    return mixed(whole)


def runs_of(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, options: SuffixOptions) -> Runs:
    """Runs of all strings that lie inside one document, worked out in slices."""
    width, gram = options.width, options.gram
    window = width - gram + 1
    out: list[tuple] = []
    total = len(buf) - width + 1
    for at in range(0, max(total, 0), options.slice_bytes):
        part = buf[at : min(at + options.slice_bytes, total) + width - 1]
        n = len(part) - width + 1
        h = gram_hashes(part, gram, options.seed)
        # The hash above, the place below: the least is the leftmost of equal hashes.
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            rest = window - size
            least = np.minimum(least[:-rest], least[rest:])
        place = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        q = np.arange(at, at + n)
        doc = np.searchsorted(starts, q, side="right") - 1
        good = np.flatnonzero(q + width <= starts[doc] + lengths[doc])
        if not len(good):
            continue
        place, doc, q = place[good], doc[good], q[good]
        new = np.ones(len(good), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(good)) - 1
        out.append((q[first], q[last], place[first] + at, h[place[first]], doc[first]))
    if not out:
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none, none)
    return with_stretches(*(np.concatenate(x) for x in zip(*out)), options)


def with_stretches(
    first: np.ndarray, last: np.ndarray, place: np.ndarray, h: np.ndarray, doc: np.ndarray, options: SuffixOptions
) -> Runs:
    cut = (h % np.uint64(options.stretch)) == 0
    cut[:1] = True
    cut[1:] |= (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
    return Runs(first, last, place, h, doc, np.cumsum(cut) - 1)


def packed_runs(runs: Runs) -> bytes:
    """The number of strings of each run, then how far behind its start the minimizer lies."""
    return np.concatenate([runs.last - runs.first + 1, runs.place - runs.first]).astype("<u4").tobytes()


def unpacked_runs(packed: bytes, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, options: SuffixOptions) -> Runs:
    """The runs again: those of a document follow each other from its first byte to its last string."""
    count, behind = np.frombuffer(packed, "<u4").astype(np.int64).reshape(2, -1)
    strings = np.maximum(lengths - options.width + 1, 0)
    before = np.cumsum(strings) - strings
    at = np.cumsum(count) - count
    doc = np.searchsorted(before + strings, at, side="right")
    first = starts[doc] + at - before[doc]
    return with_stretches(first, first + count - 1, first + behind, hashes_at(buf, first + behind, options), doc, options)


def record_of(options: SuffixOptions) -> np.dtype:
    """A group of strings: the smallest id that has it, how many strings, and their text."""
    return np.dtype([("doc", "<i8"), ("n", "<u4"), ("text", f"V{options.width + options.group - 1}")])


class Block:
    """The texts of a block, and what it asks for in each step."""

    def __init__(self, row: dict, options: SuffixOptions, buckets: int):
        self.options, self.buckets = options, buckets
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        size = int(self.lengths.sum())
        self.raw = pa.decompress(row["data"], size, codec="zstd", asbytes=True) if size else b""
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known_runs = pa.decompress(row["runs"], row["runs_size"], codec="zstd", asbytes=True) if row["runs_size"] else b""
        self.answers = {(a["step"], a["bucket"]): a["bits"] for a in row.get("answers") or []}

    def answer(self, step: int, bucket: np.ndarray) -> np.ndarray:
        """Bits for entries in the order asked; ``bucket`` is that of each entry."""
        bits = np.zeros((len(bucket), self.options.group if step == 3 else 1), bool)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for (asked, b), given in self.answers.items():
            if asked == step:
                mine = order[cuts[b] : cuts[b + 1]]
                raw = np.unpackbits(np.frombuffer(given, np.uint8))
                bits[mine] = raw[: len(mine) * bits.shape[1]].reshape(len(mine), -1)
        return bits if step == 3 else bits[:, 0]

    def packed(self, entries: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
        return full, [entries[order[cuts[b] : cuts[b + 1]]].tobytes() for b in full]

    def runs(self) -> Runs:
        if not hasattr(self, "_runs"):
            self._runs = unpacked_runs(self.known_runs, self.buf, self.starts, self.lengths, self.options)
        return self._runs

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different stretches (digest, least id), their buckets, and for each stretch which it is and its id."""
        r = self.runs()
        heads = np.flatnonzero(np.diff(r.stretch, prepend=-1))
        ends = np.append(heads[1:], len(r.first)) - 1
        width = self.options.width
        digests = b"".join(
            xxhash.xxh3_128_digest(self.raw[a:b])
            for a, b in zip(r.first[heads].tolist(), (r.last[ends] + width).tolist())
        )
        keys = np.frombuffer(digests, np.dtype([("x", "<u8"), ("y", "<u8")]))
        doc = self.ids[r.doc[heads]]
        order = np.lexsort((doc, keys["y"], keys["x"]))
        new = np.ones(len(order), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        entries = np.empty(int(new.sum()), np.dtype([("x", "<u8"), ("y", "<u8"), ("doc", "<i8")]))
        entries["x"], entries["y"], entries["doc"] = keys["x"][order[new]], keys["y"][order[new]], doc[order[new]]
        bucket = (entries["x"] % np.uint64(self.buckets)).astype(np.int64)
        return entries, bucket, which, doc

    def open_runs(self) -> np.ndarray:
        """Runs of stretches that no smaller document has."""
        r = self.runs()
        if not len(r.first):
            return np.empty(0, np.int64)
        entries, bucket, which, doc = self.stretches()
        self.settled = self.answer(1, bucket)[which] | (doc > entries["doc"][which])
        return np.flatnonzero(~self.settled[r.stretch])

    def minimizers(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different minimizers of runs, their buckets, for each run which it has, and which are in two documents here."""
        r = self.runs()
        keys, which = np.unique(r.hash[runs], return_inverse=True)
        bucket = ((keys >> np.uint64(48)) * np.uint64(self.buckets) >> np.uint64(16)).astype(np.int64)
        least, most = np.full(len(keys), LAST), np.full(len(keys), -1, np.int64)
        np.minimum.at(least, which, r.doc[runs])
        np.maximum.at(most, which, r.doc[runs])
        return keys, bucket, which, least != most

    def groups(self, runs: np.ndarray):
        """Strings of the runs in groups: different ones as records with their buckets, and (which, start, count, id) of each."""
        r, width, size = self.runs(), self.options.width, self.options.group
        known: dict[bytes, int] = {}
        docs: list[int] = []
        middles, found = [], []
        raw, ids = self.raw, self.ids
        for first, last, place, doc in zip(r.first[runs].tolist(), r.last[runs].tolist(), r.place[runs].tolist(), r.doc[runs].tolist()):
            owner = int(ids[doc])
            while first <= last:
                # Groups are counted from the minimizer, so equal strings are in groups with the same middle.
                j = (place - first) // size
                end = min(last, place - j * size)
                text = raw[first : end + width]
                at = known.setdefault(text + (place - first).to_bytes(4, "little"), len(known))
                if at == len(docs):
                    docs.append(owner)
                    a = place - j * size
                    middles.append(xxhash.xxh3_64_intdigest(raw[a : a + width - size + 1]))
                elif owner < docs[at]:
                    docs[at] = owner
                found.append((at, first, end - first + 1, owner))
                first = end + 1
        record = record_of(self.options)
        records = np.zeros(len(docs), record)
        records["doc"] = docs
        texts = [key[:-4] for key in known]
        records["n"] = [len(t) - width + 1 for t in texts]
        padded = b"".join(t.ljust(width + size - 1, b"\0") for t in texts)
        records["text"] = np.frombuffer(padded, record["text"])
        bucket = (np.array(middles, np.uint64) % np.uint64(self.buckets)).astype(np.int64)
        return records, bucket, np.array(found, np.int64).reshape(-1, 4)

    def shared_runs(self) -> np.ndarray:
        runs = self.open_runs()
        if not len(runs):
            return runs
        _, bucket, which, here = self.minimizers(runs)
        return runs[(self.answer(2, bucket) | here)[which]]

    def question(self, step: int) -> tuple[list[int], list[bytes]]:
        if not len(self.runs().first):
            return [], []
        if step == 1:
            return self.packed(*self.stretches()[:2])
        if step == 2:
            keys, bucket, _, _ = self.minimizers(self.open_runs())
            return self.packed(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], bucket)
        records, bucket, _ = self.groups(self.shared_runs())
        return self.packed(records, bucket)

    def removed(self) -> np.ndarray:
        """Which bytes go."""
        edge = np.zeros(len(self.buf) + 1, np.int32)
        r, width = self.runs(), self.options.width
        if len(r.first):
            runs = self.shared_runs()
            gone = self.settled[r.stretch]
            np.add.at(edge, r.first[gone], 1)
            np.add.at(edge, r.last[gone] + width, -1)
            records, bucket, found = self.groups(runs)
            bits = self.answer(3, bucket)
            at, start, count, owner = found.T
            for t in range(self.options.group):
                hit = (t < count) & (bits[at, t] | (owner > records["doc"][at]))
                np.add.at(edge, start[hit] + t, 1)
                np.add.at(edge, start[hit] + t + width, -1)
        return np.cumsum(edge[:-1]) > 0

    def results(self) -> dict[str, list]:
        gone = self.removed()
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for start, length in zip(self.starts.tolist(), self.lengths.tolist()):
            mask = gone[start : start + length]
            out["n_bytes"].append(length)
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(int((mask[1:] & ~mask[:-1]).sum()) + int(bool(length and mask[0])))
            out["kept"].append(self.buf[start : start + length][~mask].tobytes())
        return out


# ---------------------------------------------------------------- buckets


def answers(step: int, questions: list[bytes], options: SuffixOptions) -> list[np.ndarray]:
    """Bits for the entries of each question that a bucket got."""
    record = record_of(options)
    sizes = [24, 6, record.itemsize]
    counts = [len(q) // sizes[step - 1] for q in questions]
    every = b"".join(questions)
    if step == 1:
        e = np.frombuffer(every, np.dtype([("x", "<u8"), ("y", "<u8"), ("doc", "<i8")]))
        order = np.lexsort((e["doc"], e["y"], e["x"]))
        e = e[order]
        new = np.ones(len(e), bool)
        new[1:] = (e["x"][1:] != e["x"][:-1]) | (e["y"][1:] != e["y"][:-1])
        bits = np.empty(len(e), bool)
        bits[order] = e["doc"] > e["doc"][np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))]
    elif step == 2:
        wide = np.zeros((sum(counts), 8), np.uint8)
        wide[:, :6] = np.frombuffer(every, np.uint8).reshape(-1, 6)
        _, which, times = np.unique(wide.reshape(-1).view("<u8"), return_inverse=True, return_counts=True)
        bits = times[which] > 1
    else:
        e = np.frombuffer(every, record)
        text = np.ascontiguousarray(e["text"]).view(np.uint8).reshape(len(e), -1)
        windows = np.lib.stride_tricks.sliding_window_view(text, options.width, axis=1)
        there = np.arange(options.group) < e["n"][:, None]
        rows = windows[there]
        doc = np.repeat(e["doc"], e["n"])
        order, group = deep_shallow(rows, options.shallow)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(np.diff(group, prepend=-1)))
        smaller = np.empty(len(rows), bool)
        smaller[order] = doc[order] > least[group]
        bits = np.zeros(there.shape, bool)
        bits[there] = smaller
    return np.split(bits, np.cumsum(counts)[:-1])


# ---------------------------------------------------------------- Spark


def blocks_of(docs: DataFrame, options: SuffixOptions, id_col: str, text: str) -> DataFrame:
    """Rows (block, ids, nulls, lengths, data, runs, runs_size) of whole documents, written.

    A long document is a block of its own. The runs are worked out here and kept
    beside the texts, since each later step needs them.
    """
    limit = options.block_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple[int | None, bytes]] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            data = b"".join(t for _, t in waiting)
            lengths = np.array([len(t) for _, t in waiting], "<i8")
            runs = packed_runs(runs_of(np.frombuffer(data, np.uint8), np.cumsum(lengths) - lengths, lengths, options))
            row = {
                "block": [number],
                "ids": [np.array([LAST if d is None else d for d, _ in waiting], "<i8").tobytes()],
                "nulls": [bytes(d is None for d, _ in waiting)],
                "lengths": [lengths.tobytes()],
                "data": [pa.compress(data, codec="zstd", asbytes=True) if data else b""],
                "runs": [pa.compress(runs, codec="zstd", asbytes=True) if runs else b""],
                "runs_size": [len(runs)],
            }
            number += 1
            waiting.clear()
            return pa.RecordBatch.from_pydict(row)

        size = 0
        for batch in batches:
            for doc_id, each in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = each.encode()
                if waiting and size + len(raw) > limit:
                    yield block()
                    size = 0
                waiting.append((doc_id, raw))
                size += len(raw)
        if waiting:
            yield block()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    schema = "block bigint, ids binary, nulls binary, lengths binary, data binary, runs binary, runs_size bigint"
    return materialize(rows.mapInArrow(run, schema), "text-blocks")


def with_answers(blocks: DataFrame, given: DataFrame | None) -> DataFrame:
    if given is None:
        return blocks
    gathered = given.groupBy("block").agg(F.collect_list(F.struct("step", "bucket", "bits")).alias("answers"))
    return blocks.join(gathered.hint("shuffle_hash"), "block", "left")


def asked(blocks: DataFrame, given: DataFrame | None, step: int, buckets: int, options: SuffixOptions) -> DataFrame:
    """The answers (block, step, bucket, bits) of one step."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, entries = Block(row, options, buckets).question(step)
                if bucket:
                    columns = [pa.array([row["block"]] * len(bucket), pa.int64()), pa.array(bucket, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(entries, pa.binary())], ["block", "bucket", "entries"])

    def reply(table: pa.Table) -> pa.Table:
        bits = answers(step, table["entries"].to_pylist(), options)
        some = [i for i, b in enumerate(bits) if b.any()]
        kept = table.select(["block", "bucket"]).take(pa.array(some, pa.int64()))
        packed = [np.packbits(bits[i].reshape(-1)).tobytes() for i in some]
        steps = pa.array([step] * len(some), pa.int32())
        return pa.table({"block": kept["block"], "step": steps, "bucket": kept["bucket"], "bits": pa.array(packed, pa.binary())})

    questions = with_answers(blocks, given).mapInArrow(ask, "block bigint, bucket int, entries binary")
    told = questions.groupBy("bucket").applyInArrow(reply, "block bigint, step int, bucket int, bits binary")
    return materialize(told, f"answers-{step}")


def remove_repeats(
    docs: DataFrame, options: SuffixOptions | None = None, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    A byte goes if a string of ``width`` bytes over it also starts in a row
    with a smaller id; strings are judged on the input. A null id is larger
    than all others. Rows that repeat an id do not remove each other's text. A
    null or empty text, or one shorter than ``width``, stays as it is. An
    empty table gives an empty table.
    """
    options = options or SuffixOptions()
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_of(text)).cast("bigint"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // options.bucket_bytes))
    blocks = blocks_of(docs, options, id_col, text)
    given = None
    for step in (1, 2, 3):
        told = asked(blocks, given, step, buckets, options)
        given = told if given is None else given.union(told)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = Block(row, options, buckets).results()
                ids = [None if null else d for d, null in zip(np.frombuffer(row["ids"], "<i8").tolist(), row["nulls"])]
                numbers = [pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
                columns = [pa.array(ids, pa.int64()), *numbers, pa.array(out["kept"], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return with_answers(blocks, given).mapInArrow(finish, schema)
