"""Near duplicates by MinHash with tensored tables.

A document is the set of its word shingles. Two collections of a few short
sub-keys (minhashes of some hash functions each) are worked out, and every
table key is a pair of one sub-key from each: m + m sub-keys give m * m tables,
so the number of hash functions is about the square root of what as many
separate tables would take. Documents that share a table key are candidates;
each link is confirmed on the full sets.

Equal sets are merged first, so copies enter the tables once. Inside a table
the members of a key are put in an order that a hash of table and document
decides, and each is paired with the first, in keys of up to ``WHOLE`` members
also with the one before it: a key with n members gives n candidates at most,
and other tables pair them in other orders. Of the candidates the most promising are confirmed first, and
pairs that these links have already joined are left out.

These are all pairs of a key of up to ``WHOLE`` members. Of a larger key they are
only a start: its members, if the links have not joined them all, then go through an exact similarity join:
shingles are put in one order, rare ones first, so two similar sets share one of
their first few shingles, and the places of that shingle and the sizes bound
what they can have in common. All pairs left are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import BROADCAST_ROWS, beside, broadcast_if_small, lookup, shielded, sized, text_of, with_row_id
from passagemill.session import materialize

SLICE = 1024  # documents worked on at a time
WHOLE = 3  # members of a key that the first and the one before pair completely
MORE = 1 << 31  # added to the size of a member that stands for a key's more than WHOLE members of a slice
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class MinHashOptions:
    words: int = 5
    percent: int = 80  # 100 * intersection >= percent * union
    sub_keys: int = 8  # in each of the two collections; their square is the number of tables
    hashes: int = 2  # in a sub-key
    seed: int = 7
    bucket_keys: int = 2_000_000
    broadcast_nodes: int = 128_000  # about 20 MB of the driver each, three times while it is sent, and several at a time
    salts: int = 16
    partners: int = 64  # compared with one sent copy of a text
    order_docs: int = 20_000  # whose shingles are counted to put the rare ones first; any order is right
    order_shingles: int = 500_000
    token_rows: int = 4096  # of one shingle that meet in one task
    text_rows: int = 4096  # texts that a task compares, on average
    forest_nodes: int = 1_000_000  # joined in one task before the joins are sent on


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 300_000:
            self.clear()
        self[word] = found
        return found


_words = WordHashes()


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    parts = text.encode().lower().split()  # ASCII letters and ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * SPREAD + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def hash_functions(options: MinHashOptions) -> np.ndarray:
    """A pair of 64-bit numbers for each function: 2 collections of sub_keys x hashes."""
    draw = np.random.default_rng(options.seed)
    count = 2 * options.sub_keys * options.hashes
    return draw.integers(0, 2**63, (count, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sub_keys(sets: list[np.ndarray], functions: np.ndarray, options: MinHashOptions) -> np.ndarray:
    """Sub-keys (documents x both collections) of sets that are not empty."""
    m, k = options.sub_keys, options.hashes
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), 2 * m * k), np.uint64)
    for i, (a, b) in enumerate(functions):
        x = (flat ^ a) * b
        least[:, i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    sub = np.zeros((len(sets), 2 * m), np.uint64)
    for i in range(k):
        sub = mixed(sub * SPREAD + least[:, i::k])
    return sub


def table_keys(sub: np.ndarray, m: int) -> np.ndarray:
    """Table keys (documents x tables): each pair of a sub-key of one collection and one of the other."""
    left, right = sub[:, :m], mixed(sub[:, m:])
    table = np.arange(m * m, dtype=np.uint64).reshape(1, m, m)
    return mixed(left[:, :, None] * SPREAD + right[:, None, :] + table).reshape(len(sub), m * m)


def sketches(docs: DataFrame, options: MinHashOptions, id_col: str, text: str) -> DataFrame:
    """Rows (__row, doc_id, n_shingles, digest, sub_keys), written; neither texts nor sets are kept."""
    words, functions = options.words, hash_functions(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, SLICE):
            found = [shingles(t, words) for t in batch.column(2).to_pylist()]
            full = [s for s in found if len(s)]
            keys = iter(sub_keys(full, functions, options).astype("<u8") if full else ())
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                pa.array([next(keys).tobytes() if len(s) else None for s in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["__row", "doc_id", "n_shingles", "digest", "sub_keys"])

    rows = docs.select("__row", F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"__row bigint, doc_id {kind}, n_shingles bigint, digest binary, sub_keys binary"
    return materialize(rows.mapInArrow(run, schema), "sketches")


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of ``rows`` at most, to bound the memory of what is made of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def candidates(classes: DataFrame, options: MinHashOptions) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, tables) of class numbers that share table keys, and (key, node) of keys that need more pairs.

    ``classes`` has (node, n_shingles, sub_keys). Keys leave a task in one
    packed row per bucket, shuffled once. If more than ``WHOLE`` members of one
    key are in the same batch, they meet there and only their first goes on, so
    a key that a third of all documents share reaches its bucket once per batch;
    the pairs found in the batch travel along with some bucket. Less than two
    pairs per member, table and step: all pairs of keys with ``WHOLE`` members
    at most, one per member of the others, whose members are told.
    """
    m = options.sub_keys
    keys_in_all = classes.count() * m * m
    buckets = max(1, -(-keys_in_all // options.bucket_keys))
    buckets = max(buckets, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pairs(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (a, b, tables) of each key's first member and each other, and which members are first.

        Members of keys that ``few`` says have ``WHOLE`` at most are paired with the one before them, too.
        """
        order = np.lexsort((mixed(nodes.astype(np.uint64) * SPREAD ^ keys), keys))
        k, n, s = keys[order], nodes[order], sizes[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        others = np.flatnonzero(~new)
        after = others[few[order][others]]
        near = np.concatenate([head[others], after - 1])
        others = np.concatenate([others, after])
        # A pair of sets whose sizes alone rule the similarity out is no candidate.
        small, large = np.minimum(s[others], s[near]), np.maximum(s[others], s[near])
        good = (100 * small >= options.percent * large) & (n[others] != n[near])
        a, b = n[others[good]], n[near[good]]
        both = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
        both, times = np.unique(both, axis=0, return_counts=True) if len(both) else (both, both[:, 0])
        return np.column_stack([both, times]).astype("<i8"), order[new]

    def told(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Members of keys as rows beside those of pairs, in no table."""
        return np.column_stack([keys.view("<i8"), nodes, np.zeros(len(keys))]).astype("<i8") if len(keys) else np.empty((0, 3), "<i8")

    def sums(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each row the sum of the weights of its key."""
        _, place = np.unique(keys, return_inverse=True)
        return np.bincount(place, weights)[place] if len(keys) else weights

    schema = "bucket int, members binary, links binary"
    member = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<u4")])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, SLICE):
            sub = np.frombuffer(b"".join(batch.column("sub_keys").to_pylist()), "<u8").reshape(-1, 2 * m)
            if not len(sub):
                continue
            keys = table_keys(sub, m).reshape(-1)
            nodes = np.repeat(batch.column("node").to_numpy(), m * m)
            sizes = np.repeat(batch.column("n_shingles").to_numpy(), m * m)
            many = sums(keys, np.ones(len(keys))) > WHOLE
            links, firsts = pairs(keys[many], nodes[many], sizes[many], np.zeros(int(many.sum()), bool))
            links = np.concatenate([links, told(keys[many], nodes[many])])
            goes = np.concatenate([np.flatnonzero(~many), np.flatnonzero(many)[firsts]])
            packed = np.empty(len(goes), member)
            packed["key"], packed["node"], packed["size"] = keys[goes], nodes[goes], sizes[goes] + MORE * many[goes]
            where = (packed["key"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            packed, where = packed[order], where[order]
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            raw = [packed[cuts[i] : cuts[i + 1]].tobytes() for i in full]
            along = [b""] * len(full)
            along[int(nodes[0]) % len(full)] = links.tobytes()
            columns = [pa.array(full, pa.int32()), pa.array(raw, pa.binary()), pa.array(along, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "members", "links"])

    def meet(table: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(table["members"].to_pylist()), member)
        keys, nodes, sizes = every["key"].copy(), every["node"].copy(), every["size"].astype(np.int64)
        more = sizes >= MORE
        large = sums(keys, np.where(more, WHOLE + 1, 1)) > WHOLE
        links, _ = pairs(keys, nodes, sizes - MORE * more, ~large)
        sent = np.frombuffer(b"".join(table["links"].to_pylist()), "<i8").reshape(-1, 3)
        # Those that stand for others were told with them.
        every = np.concatenate([sent, links, told(keys[large & ~more], nodes[large & ~more])])
        return pa.table([pa.array(every[:, i], pa.int64()) for i in range(3)], ["a", "b", "tables"])

    sent = classes.select("node", "n_shingles", "sub_keys").mapInArrow(spread, schema)
    met = sent.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, tables bigint")
    met = materialize(sized(met, keys_in_all, options.bucket_keys), "met")
    members = met.filter("tables = 0").select(F.col("a").alias("key"), F.col("b").alias("node"))
    pairs = met.filter("tables > 0").groupBy("a", "b").agg(F.sum("tables").alias("tables"))
    return sized(pairs, met.count()), members


def common_shingles(texts: DataFrame, options: MinHashOptions) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that some of the texts have often, sorted, and how often."""
    words, step = options.words, max(1, texts.count() // options.order_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, SLICE):
            found = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select("text")
    counts = some.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter("n > 1").orderBy(F.desc("n"), "shingle").limit(options.order_shingles).toPandas()
    order = np.argsort(found["shingle"].to_numpy().astype(np.int64).view(np.uint64))
    return found["shingle"].to_numpy().astype(np.int64).view(np.uint64)[order], found["n"].to_numpy().astype(np.int64)[order]


def all_pairs(texts: DataFrame, options: MinHashOptions) -> DataFrame:
    """Every pair (a, b) that may be similar and has two labels, from a table (node, label, text).

    Sets of n shingles at most as large as the other's share one of the first
    ``n - need + 1`` in the common order, where ``need`` is what two sets of n
    must share; the larger ones are looked up by those they need against the
    smallest set that their size allows. Sizes in bands, so a set meets two.
    """
    words, percent = options.words, options.percent
    common, often = common_shingles(texts, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, SLICE):
            heads, lengths = [np.empty(0, np.uint64)], []
            counts = []
            for t in batch.column("text").to_pylist():
                found = shingles(t, words)
                n = len(found)
                place = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
                times = np.where(common[place] == found, often[place], 0) if len(common) else np.zeros(n, np.int64)
                heads.append(found[np.argsort(times, kind="stable")][: n - -(-percent * n // 100) + 1])
                lengths.append(len(heads[-1]))
                counts.append(n)
            places = [np.arange(x) for x in lengths]
            columns = [
                pa.array(np.concatenate(heads).view(np.int64)),
                pa.array(np.repeat(batch.column("node").to_numpy(), lengths)),
                pa.array(np.repeat(batch.column("label").to_numpy(), lengths)),
                pa.array(np.repeat(np.array(counts, np.int64), lengths)),
                pa.array(np.concatenate(places) if places else np.empty(0, np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "node", "label", "n", "place"])

    schema = "shingle bigint, node bigint, label bigint, n bigint, place bigint"
    heads = materialize(texts.select("node", "label", "text").mapInArrow(run, schema), "heads")
    # Only shingles in the heads of two labels; the rows of a frequent one are dealt to several tasks.
    shared = heads.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("l"), F.max("label").alias("h"))
    shared = sized(shared, heads.count()).filter("l < h").select("shingle", F.ceil(F.col("rows") / options.token_rows).cast("int").alias("salts"))
    width = float(np.log(100 / min(percent, 99)))
    rows = lookup(heads, shared, ["shingle"], "inner", options.broadcast_nodes, options.salts)
    rows = materialize(rows.withColumn("band", F.floor(F.log("n") / F.lit(width) + F.lit(1e-9)).cast("int")), "shared-heads")
    named = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("node", "label", "n", "place")]
    small = rows.filter(F.expr(f"place <= n - ceil({2 * percent} * n / {100 + percent})")).select(
        "shingle",
        F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"),
        F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"),
        *named("s"),
    )
    large = rows.select("shingle", "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *named("l"))
    fits = F.expr(
        f"""label_s <> label_l AND (n_s < n_l OR n_s = n_l AND node_s < node_l) AND 100 * n_s >= {percent} * n_l
        AND {100 + percent} * least(n_s - place_s, n_l - place_l) >= {percent} * (n_s + n_l)"""
    )
    met = small.join(large.hint("merge"), ["shingle", "band", "salt"]).filter(fits)
    return met.select(F.least("node_s", "node_l").alias("a"), F.greatest("node_s", "node_l").alias("b")).distinct()


def missed(members: DataFrame, labels: DataFrame, docs: DataFrame, options: MinHashOptions, text: str) -> DataFrame | None:
    """Links (a, b) between members of keys that ``labels`` does not join, written; None if there are no such keys."""
    told = beside(members, labels, ["node"], "left", options.broadcast_nodes, options.salts).select("key", "node", F.coalesce("label", "node").alias("label"))
    told = materialize(told, "labelled-members")
    n = told.count()
    keys = told.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("key")
    nodes = lookup(told, sized(keys, n), ["key"], "left_semi", options.broadcast_nodes, options.salts).select("node", "label")
    wanted = materialize(sized(nodes.distinct(), n), "open-nodes")
    if wanted.isEmpty():
        return None
    numbered, _ = broadcast_if_small(wanted.select(F.col("node").alias("__row"), "label"), options.broadcast_nodes, "open-rows")
    texts = docs.select("__row", text_of(text).alias("text")).join(numbered, "__row").withColumnRenamed("__row", "node")
    texts = texts.select("node", "label", "text")
    return confirmed(all_pairs(texts, options), docs, options, text)


def confirmed(pairs: DataFrame, docs: DataFrame, options: MinHashOptions, text: str) -> DataFrame:
    """The different pairs (a, b) whose full sets are similar enough, written.

    Texts travel, as they take fewer bytes than their sets: that of ``a`` once
    for each ``partners`` of its pairs, followed by those of the partners, so a
    task holds one set at a time besides its batch.
    """
    words, percent = options.words, options.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, t in zip(batch.column("b").to_pylist(), batch.column("text").to_pylist()):
                found = shingles(t, words)
                if b is None:
                    first = found
                    keep.append(False)
                    continue
                every = np.concatenate([first, found])
                every.sort()
                same = int((every[1:] == every[:-1]).sum())
                keep.append(100 * same >= percent * (len(every) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs.select("a", "b"), "pairs")
    n_pairs = pairs.count()
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > options.partners)
    told = lookup(pairs, sized(many, n_pairs), ["a"], "left", options.broadcast_nodes, options.salts)
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / options.partners)), F.lit(0).cast("bigint"))
    dealt = materialize(told.select("a", part.alias("part"), "b"), "dealt-pairs")
    leads = sized(dealt.select("a", "part").distinct(), n_pairs).select("a", "part", F.lit(None).cast("bigint").alias("b"), F.col("a").alias("__row"))
    wanted = leads.union(dealt.select("a", "part", "b", F.col("b").alias("__row")))
    wanted, _ = broadcast_if_small(wanted, options.broadcast_nodes, "wanted-texts")
    texts = docs.select("__row", text_of(text).alias("text")).join(wanted, "__row")
    sorted_rows = texts.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    sorted_rows = sized(sorted_rows, 2 * n_pairs, options.text_rows)  # whole parts one after the other
    return materialize(sorted_rows.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint"), "links")


def forest(links: DataFrame, options: MinHashOptions) -> DataFrame:
    """Links (a, b) that join the same nodes as ``links``: in each task every node with the smallest it is joined to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(node: int) -> int:
            at = above.setdefault(node, node)
            while at != above[at]:
                above[at] = at = above[above[at]]
            above[node] = at
            return at

        def stars() -> pa.RecordBatch:
            told = [(root(node), node) for node in above]
            both = np.array([x for x in told if x[0] != x[1]], np.int64).reshape(-1, 2)
            above.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                low, high = sorted((root(a), root(b)))
                above[high] = low
            if len(above) >= options.forest_nodes:
                yield stars()
        yield stars()

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, options: MinHashOptions) -> DataFrame:
    """(node, label): the smallest node of its component, for every node with a link.

    Links of one task are joined there first. Each round then takes the
    smallest label of the neighbours and the label of that label, so the rounds
    grow with the logarithm of a component's width. Every round is written;
    minima are taken map-side first.
    """
    limit, salts = options.broadcast_nodes, options.salts
    joins = materialize(forest(links, options), "forest")
    both = joins.union(joins.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = 2 * joins.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n"))
    labels = materialize(sized(labels, n).select("node", F.least("node", "n").alias("label")), "labels")
    while True:
        told = beside(both.select("a", F.col("b").alias("node")), labels, ["node"], "inner", limit, salts)
        least = sized(told.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")), n)
        moved = beside(least, labels, ["node"], "inner", limit, 1).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        moved = materialize(moved, "moved")
        roots = moved.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = beside(moved, roots, ["label"], "inner", limit, salts)
        after = materialize(jumped.select("node", "old", F.col("root").alias("label")), "labels")
        still = after.filter("old <> label").isEmpty()
        labels = after.select("node", "label")
        if still:
            return labels


def joined(labels: DataFrame, links: DataFrame, options: MinHashOptions) -> DataFrame:
    """Labels after some more links."""
    # Components of the labels are the nodes now.
    label = lambda c: F.coalesce(F.col(f"l{c}"), F.col(c))
    named = links
    for c in ("a", "b"):
        table = labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        named = beside(named, table, [c], "left", options.broadcast_nodes, options.salts)
    merged = components(named.select(label("a").alias("a"), label("b").alias("b")), options)
    known = labels.select("node", "label").union(
        beside(merged.select("node", F.col("node").alias("label")), labels.select("node"), ["node"], "left_anti", options.broadcast_nodes, 1)
    )
    roots = merged.select(F.col("node").alias("label"), F.col("label").alias("root"))
    renamed = beside(known, roots, ["label"], "left", options.broadcast_nodes, options.salts)
    return renamed.select("node", F.coalesce("root", "label").alias("label"))


def linked(docs: DataFrame, classes: DataFrame, options: MinHashOptions, text: str) -> DataFrame:
    """(node, label) of all classes in a component of two or more."""
    pairs, members = candidates(classes, options)
    pairs = materialize(pairs, "candidates")
    # First each node with the partner that it meets in most tables, among smaller nodes.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("tables", -F.col("a"))).alias("a")).select("a", "b")
    best = materialize(sized(best, classes.count()), "best-pairs")
    first = confirmed(best, docs, options, text)
    labels = components(first, options)
    rest = pairs.select("a", "b")
    for c in ("a", "b"):
        table = labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        rest = beside(rest, table, [c], "left", options.broadcast_nodes, options.salts)
    same = F.coalesce(F.col("la"), F.col("a")) == F.coalesce(F.col("lb"), F.col("b"))
    rest = beside(rest.filter(~same).select("a", "b"), best, ["a", "b"], "left_anti", options.broadcast_nodes, 1)
    second = confirmed(rest, docs, options, text)
    if not second.isEmpty():
        labels = materialize(joined(labels, second, options), "joined")
    third = missed(members, labels, docs, options, text)
    return labels if third is None or third.isEmpty() else joined(labels, third, options)


def groups(docs: DataFrame, options: MinHashOptions | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: __row, doc_id, n_shingles, component_id, kept.

    ``docs`` has a written column ``__row``. A component's id is the smallest
    id in it, null ids last; of rows that repeat that id the first stays. A
    text with fewer words than a shingle is one shingle; one without words, or
    null, is linked with nothing and stays. An empty table gives an empty
    table. Texts of any length enter whole.
    """
    options = options or MinHashOptions()
    rows = sketches(docs, options, id_col, text)
    full = rows.filter("digest IS NOT NULL")
    # The row of its smallest document stands for a class.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    classes = full.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(sized(classes, rows.count()), "classes").withColumn("node", F.col("first.__row"))
    firsts = full.select(F.col("__row").alias("node"), "n_shingles", "sub_keys")
    firsts = beside(firsts, classes.select("node"), ["node"], "left_semi", options.broadcast_nodes, 1)
    labels = materialize(linked(docs, materialize(firsts, "class-sketches"), options, text), "components")
    # The smallest document over all classes of a component.
    limit, salts = options.broadcast_nodes, options.salts
    named = beside(classes, labels, ["node"], "left", limit, 1)
    least = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("least"))
    least = materialize(sized(least, labels.count()), "least")
    by_class = beside(named.filter("label IS NOT NULL OR copies > 1"), least, ["label"], "left", limit, salts)
    by_class = by_class.select("digest", F.coalesce("least", "first").alias("least"))
    told = lookup(rows.drop("sub_keys"), by_class, ["digest"], "left", limit, salts)
    alone = F.col("least").isNull()
    return told.select(
        "__row",
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (alone | (F.col("least.__row") == F.col("__row"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, options: MinHashOptions | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, see :func:`groups`; columns of any name stay as they are."""
    own = shielded(docs, id_col, text)
    numbered = materialize(with_row_id(own), "numbered")
    dropped = groups(numbered, options, id_col, text).filter("NOT kept").select("__row")
    return lookup(numbered, dropped, ["__row"], "left_anti", BROADCAST_ROWS, 1).select(*own.columns).toDF(*docs.columns)
