"""Splitting and packing inside one row: words, sentences, greedy chunks.

All of these are array expressions over a part's own text, so cutting a
corpus needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import SPACE, count_tokens, is_blank, oddly_spaced, words

SENTENCE_END = "(?<=[.!?]) "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(n: Column) -> Column:
    """``0..n-1``; empty for ``n = 0``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def joined_runs(items: Column, starts: Column, sep: str = " ") -> Column:
    """Items joined from each start up to the next one."""
    return F.transform(runs(items, starts), lambda run: F.array_join(run, sep))


def runs(items: Column, starts: Column) -> Column:
    """Items from each start up to the next one, as arrays."""
    return F.transform(
        starts,
        lambda s, j: F.slice(items, s + 1, F.coalesce(F.get(starts, j + 1), F.size(items)) - s),
    )


def merge_short(items: Column, min_chars: int) -> Column:
    """Join items shorter than ``min_chars`` to the one before.

    A short first item takes in the second. Decided in one pass on the lengths
    before merging.
    """

    def body(xs: Column) -> Column:
        def opens(i: Column) -> Column:
            long = F.length(F.get(xs, i)) >= min_chars
            follows_short_first = (i == 1) & (F.length(F.get(xs, F.lit(0))) < min_chars)
            return (i == 0) | (long & ~follows_short_first)

        return let(F.filter(positions(F.size(xs)), opens), lambda starts: joined_runs(xs, starts))

    return let(items, body)


def sentences(text: Column, min_chars: int = 12) -> Column:
    """Sentences of a cleaned text; blank text has none."""
    raw = F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(text, SENTENCE_END))
    return merge_short(raw, min_chars) if min_chars > 0 else raw


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each new one adding words."""
    if overlap == 0 and size > 0:
        # Each window is one match, so no word becomes a value of its own.
        spaced = F.when(oddly_spaced(text), F.regexp_replace(text, SPACE + "+", " ")).otherwise(text)
        found = F.regexp_extract_all(spaced, F.lit(f"[^ ]++(?: [^ ]++){{0,{size - 1}}}+"), F.lit(0))
        return F.coalesce(found, F.array().cast("array<string>"))
    step = size - overlap

    def body(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>")),
            lambda s: (s == 0) | (s + overlap < n),
        )
        return F.transform(starts, lambda s: F.array_join(F.slice(ws, s + 1, size), " "))

    return let(words(text), body)


def greedy_starts(tokens: Column, size: int, min_items: int) -> Column:
    """Where chunks begin when items are packed in order up to ``size`` tokens."""
    none = F.array().cast("array<int>")
    zero = F.struct(none.alias("starts"), F.lit(0).alias("tokens"), F.lit(0).alias("items"))

    def step(acc: Column, i: Column) -> Column:
        t = F.coalesce(F.get(tokens, i), F.lit(0))
        full = (acc["items"] >= min_items) & (acc["tokens"] + t > size)
        opens = (i == 0) | full
        return F.struct(
            F.when(opens, F.array_append(acc["starts"], i)).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, t).otherwise(acc["tokens"] + t).alias("tokens"),
            F.when(opens, F.lit(1)).otherwise(acc["items"] + 1).alias("items"),
        )

    return F.aggregate(positions(F.size(tokens)), zero, step)["starts"]


def packed_runs(items: Column, size: int, min_items: int = 1) -> Column:
    """Items packed greedily into arrays of at most ``size`` tokens."""
    return let(
        items,
        lambda xs: let(
            F.transform(xs, lambda x: count_tokens(x)),
            lambda tokens: let(greedy_starts(tokens, size, max(1, min_items)), lambda st: runs(xs, st)),
        ),
    )


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Put before each chunk the longest run of whole trailing sentences of the
    one before it that has at most ``overlap`` tokens."""

    def tail(run: Column) -> Column:
        # Sentences still fitting, from the end backwards.
        zero = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("items"), F.lit(False).alias("done"))

        def step(acc: Column, s: Column) -> Column:
            t = count_tokens(s)
            stop = acc["done"] | (acc["tokens"] + t > overlap)
            return F.struct(
                F.when(stop, acc["tokens"]).otherwise(acc["tokens"] + t).alias("tokens"),
                F.when(stop, acc["items"]).otherwise(acc["items"] + 1).alias("items"),
                stop.alias("done"),
            )

        kept = F.aggregate(F.reverse(run), zero, step)["items"]
        return F.slice(run, F.size(run) - kept + 1, kept)

    return let(
        chunks,
        lambda cs: F.transform(
            cs, lambda c, i: F.when(i == 0, c).otherwise(F.concat(tail(F.get(cs, i - 1)), c))
        ),
    )


def sentence_chunks(text: Column, size: int, overlap: int, min_sentences: int, min_chars: int) -> Column:
    packed = packed_runs(sentences(text, min_chars), size, min_sentences)
    if overlap > 0:
        packed = with_overlap(packed, overlap)
    return F.transform(packed, lambda run: F.array_join(run, " "))


# -- separator hierarchy ---------------------------------------------------

# Where each level may cut; every cut keeps its separator on the left.
RECIPES = {
    "default": ["(?<=\n\n)", "(?<=\n)", "(?<=[.!?] )", "(?<=[;:] )", "(?<=, )", "(?<= )"],
    "markdown": [
        "(?<=\n)(?=#{1,6} )", "(?<=\n\n)", "(?<=\n)", "(?<=[.!?] )", "(?<=[;:] )",
        "(?<=, )", "(?<= )",
    ],
}


def recursive_chunks(text: Column, size: int, min_chars: int, separators: list[str]) -> Column:
    """Cut at the coarsest separator that helps, finer only where still too long.

    The pieces put together give the text again.
    """

    def level(pieces: Column, separator: str) -> Column:
        def finer(p: Column) -> Column:
            cut = F.filter(F.split(p, separator), lambda x: x != "")
            return F.when(count_tokens(p) <= size, F.array(p)).otherwise(
                F.transform(packed_runs(cut, size), lambda run: F.array_join(run, ""))
            )

        return F.flatten(F.transform(pieces, finer))

    pieces = F.array(text)
    for separator in separators:
        pieces = level(pieces, separator)
    return _absorb_small(pieces, size, min_chars)


def _absorb_small(pieces: Column, size: int, min_chars: int) -> Column:
    """Give pieces under ``min_chars`` to the next one when both fit."""

    def body(ps: Column) -> Column:
        tokens = F.transform(ps, lambda p: count_tokens(p))

        def opens(i: Column, counts: Column) -> Column:
            before = F.get(ps, i - 1)
            fits = F.get(counts, i - 1) + F.get(counts, i) <= size
            # A piece that took in a small one is not itself handed on.
            handed_on = (F.length(before) < min_chars) & fits
            chained = (i > 1) & (F.length(F.get(ps, i - 2)) < min_chars)
            return (i == 0) | ~(handed_on & ~chained)

        return let(
            tokens,
            lambda counts: let(
                F.filter(positions(F.size(ps)), lambda i: opens(i, counts)),
                lambda starts: joined_runs(ps, starts, ""),
            ),
        )

    return let(pieces, body)
