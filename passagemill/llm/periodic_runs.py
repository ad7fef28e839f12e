"""Runs of repeated word sequences, found by a dictionary of basic factors.

The dictionary gives every stretch of 1, 2, 4, 8, ... words of a document a
class, so that equal stretches have equal classes: the class of a stretch comes
from those of its two halves. At each length L, places of one class that follow
each other within 2 L words form arithmetic progressions, and the step of a
progression is proposed as a period. A proposal is extended to both sides as
long as words one period apart agree; equal results of several lengths are one.

Why nothing is lost: a run with period p has, for the least L >= p, all its
stretches repeated exactly p words later and not before, so p is proposed.
Why nothing else is told: a step d is the least distance of its stretch, so if
the extended run is at least 3 d words long, d is its smallest period.

A stretch that occurs once in its document cannot be part of a longer repeated
one, so its place is left out of all greater lengths, and a text without
repeats ends after a few. Documents are worked on many at a time, as one array.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import placed_beside, text_of

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
MADE = ["n_words", "runs", "n_runs", "best", "collapsed"]


@dataclass(frozen=True)
class RunOptions:
    min_words: int = 24
    min_periods: int = 3  # at least 3
    slice_words: int = 200_000  # words of documents worked on together

    def __post_init__(self):
        if self.min_periods < 3 or self.min_words < 3:
            raise ValueError("a run has at least 3 periods and 3 words")


Run = tuple[int, int, int]  # first word, words, period


def reach(words: np.ndarray, at: int, end: int, period: int) -> int:
    """How far words from ``at`` on equal those one period later, below ``end``."""
    step = 32
    while at + period < end:
        stop = min(at + step, end - period)
        differ = words[at:stop] != words[at + period : stop + period]
        first = int(differ.argmax()) if len(differ) else 0
        if len(differ) and differ[first]:
            return at + first
        at, step = stop, step * 2
    return at


def reach_back(words: np.ndarray, at: int, begin: int, period: int) -> int:
    """How far back words before ``at`` equal those one period later, not below ``begin``."""
    step = 32
    while at > begin:
        stop = max(at - step, begin)
        differ = words[stop:at] != words[stop + period : at + period]
        last = np.flatnonzero(differ)
        if len(last):
            return stop + int(last[-1]) + 1
        at, step = stop, step * 2
    return at


def proposals(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, options: RunOptions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First places and steps of the progressions of each length.

    ``doc`` is the number of each word's document and ``ends`` where that document ends.
    """
    n = len(words)
    place = np.arange(n, dtype=np.int64)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    length = 1
    classes = np.empty(n, np.int64)
    while len(place):
        order = np.argsort(key, kind="stable")  # places of a class stay in order
        sorted_key, sorted_place = key[order], place[order]
        same = sorted_key[1:] == sorted_key[:-1]
        # Below this length a run that is long enough is also proposed by a greater one.
        if length * 4 > options.min_words:
            step = np.zeros(n, np.int64)
            gap = sorted_place[1:] - sorted_place[:-1]
            near = same & (gap <= 2 * length)
            step[sorted_place[:-1][near]] = gap[near]
            # Neighbouring places with one step belong to one stretch of equal words.
            first = np.flatnonzero((step > 0) & (step != np.concatenate(([0], step[:-1]))))
            yield first, step[first]
        again = np.zeros(len(place), bool)
        again[1:] = same
        again[:-1] |= same
        number = np.cumsum(np.concatenate(([0], ~same))) if len(place) else place
        # Places that stay, in order of place.
        stay_place, stay_class = sorted_place[again], number[again]
        by_place = np.argsort(stay_place, kind="stable")
        stay_place, stay_class = stay_place[by_place], stay_class[by_place]
        classes.fill(-1)
        classes[stay_place] = stay_class
        whole = stay_place + 2 * length <= ends[doc[stay_place]]
        place, left = stay_place[whole], stay_class[whole]
        right = classes[place + length]
        both = right >= 0
        place, left, right = place[both], left[both], right[both]
        key = left * (int(right.max(initial=0)) + 1) + right
        length *= 2


def find_runs(words: np.ndarray, lengths: np.ndarray, options: RunOptions | None = None) -> list[list[Run]]:
    """The runs of documents whose word numbers follow each other in ``words``, sorted by start, then period."""
    options = options or RunOptions()
    ends = np.cumsum(lengths)
    starts = ends - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    found: list[set[Run]] = [set() for _ in lengths]
    known: dict[int, list[tuple[int, int]]] = {}  # for each period, stretches already extended, in order
    for places, steps in proposals(words, doc, ends, options):
        for at, period in zip(places.tolist(), steps.tolist()):
            stretches = known.setdefault(period, [])
            i = bisect_right(stretches, (at, 1 << 62)) - 1
            if i >= 0 and at + period < stretches[i][1]:
                continue
            d = int(doc[at])
            first = reach_back(words, at, int(starts[d]), period)
            end = reach(words, at, int(ends[d]), period) + period
            stretches.insert(i + 1, (first, end))
            if end - first >= max(options.min_words, options.min_periods * period):
                found[d].add((first - int(starts[d]), end - first, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def work_on(texts: list[bytes], options: RunOptions) -> Iterator[tuple[int, list[Run], bytes]]:
    """Number of words, runs and collapsed text of each text, in slices of documents."""
    waiting: list[list[bytes]] = []
    held = 0

    def slice_done() -> Iterator[tuple[int, list[Run], bytes]]:
        numbers: dict[bytes, int] = {}
        lengths = np.array([len(w) for w in waiting], np.int64)
        words = np.fromiter((numbers.setdefault(x, len(numbers)) for w in waiting for x in w), np.int64, int(lengths.sum()))
        for each, runs in zip(waiting, find_runs(words, lengths, options)):
            left = each
            if runs:
                left = [each[i] for i in np.flatnonzero(kept_words(len(each), runs)).tolist()]
            yield len(each), runs, b" ".join(left)

    for text in texts:
        words = text.split()  # of bytes: at blank, tab, line feed, vertical tab, form feed, carriage return
        waiting.append(words)
        held += len(words)
        if held >= options.slice_words:
            yield from slice_done()
            waiting, held = [], 0
    yield from slice_done()


def collapse_runs(
    docs: DataFrame, options: RunOptions | None = None, *, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """Each row with its periodic runs and the text in which only the first period of each run is left.

    Adds ``n_words``, ``runs`` (start, length and period in words, by start,
    then period), ``n_runs``, ``best`` (the run with the greatest exact length
    / period; ties: smallest start, then period; null without a run) and
    ``collapsed``, the words left, joined by one blank.

    Null and empty texts have no words. Texts of any length are taken whole,
    one of them at least per slice. Rows may repeat. ``columns`` of the input (all, if not
    given) come along; one that is named like a column made here is replaced.
    An empty table gives an empty table. No row is shuffled.
    """
    options = options or RunOptions()
    carried = placed_beside(docs, columns, MADE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
            counts, runs, left = [], [], []
            for n, found, collapsed in work_on(texts, options):
                counts.append(n)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                left.append(collapsed)
            columns = [pa.array(counts, pa.int64()), pa.array(runs, ARROW_RUNS), pa.array(left, pa.large_binary()).cast(pa.large_string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "n_words", "runs", "collapsed"]
            )

    rows = docs.select(*[F.col(c) for c in carried], text_of(text).alias("__text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    schema = f"{kinds}{', ' if kinds else ''}n_words bigint, runs {RUNS}, collapsed string"
    done = rows.mapInArrow(run, schema)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", nothing, lambda held, r: F.when(better(held, r), r).otherwise(held))
    return done.select(*carried, "n_words", "runs", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), "collapsed")
