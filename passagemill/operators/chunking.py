"""Parts to chunks: six strategies, fallbacks, ids and display names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill import options as opt
from passagemill import schemas
from passagemill.functions import text as tx
from passagemill.functions.vectors import SCORE_DECIMALS
from passagemill.operators import sentences as sen
from passagemill.operators.boundaries import group_starts

# A scorer gets windows of words and returns one score per word: how likely a
# new chunk starts there.
BoundaryScorer = Callable[[list[list[str]]], list[list[float]]]

PIECES = "__pieces"
FAILURE = "__failure"


def threshold_of(threshold: float | str, sim: Column) -> Column:
    """Aggregate that resolves a similarity threshold per group of similarities."""
    value = opt.parse_threshold(threshold)
    if value == "auto":
        return F.round(F.avg(sim) - F.stddev_pop(sim), SCORE_DECIMALS)
    if value > 1:
        return F.round(F.percentile(sim, F.lit(value / 100)), SCORE_DECIMALS)
    return F.first(F.lit(value))


def pieces_by_similarity(parts: DataFrame, o: opt.SemanticOptions) -> DataFrame:
    """Sentences grouped by topic; adds the ``PIECES`` array."""
    skip = getattr(o, "skip_window", 0)
    kernel = F.arrow_udf(
        group_starts(o.dim, opt.parse_threshold(o.threshold), o.similarity_window, o.mode, skip), "array<int>"
    )

    def unit_terms(xs: Column) -> Column:
        units = sen.positions(F.ceil(F.size(xs) / o.min_sentences).cast("int"))
        block = lambda u: F.array_join(F.slice(xs, u * o.min_sentences + 1, o.min_sentences), " ")
        return F.transform(units, lambda u: tx.joined_terms(block(u)))

    def cut(xs: Column, starts: Column) -> Column:
        groups = sen.runs(xs, F.transform(starts, lambda s: s * o.min_sentences))
        return sen.let(groups, lambda gs: sen.let(F.transform(gs, group_tokens), lambda ts: sized(gs, ts)))

    def group_tokens(group: Column) -> Column:
        return F.aggregate(group, F.lit(0), lambda acc, s: acc + tx.count_tokens(s))

    def sized(groups: Column, tokens: Column) -> Column:
        # Small groups join the one before, then long ones are packed anew.
        starts = F.filter(
            sen.positions(F.size(groups)), lambda i: (i == 0) | (F.get(tokens, i) >= o.min_chunk_size)
        )
        merged = sen.let(starts, lambda st: F.transform(sen.runs(groups, st), F.flatten))

        def repack(group: Column) -> Column:
            return F.when(group_tokens(group) <= o.chunk_size, F.array(group)).otherwise(
                sen.packed_runs(group, o.chunk_size)
            )

        return F.transform(
            F.flatten(F.transform(merged, repack)), lambda group: F.array_join(group, " ")
        )

    return (
        parts.withColumn("__sentences", sen.sentences(F.col("text"), o.min_characters_per_sentence))
        .withColumn("__terms", unit_terms(F.col("__sentences")))
        .withColumn("__starts", kernel(F.col("__terms")))
        .withColumn(PIECES, cut(F.col("__sentences"), F.col("__starts")))
        .drop("__sentences", "__terms", "__starts")
    )


def pieces_by_boundary_model(parts: DataFrame, o: opt.BoundaryOptions, scorer: BoundaryScorer) -> DataFrame:
    """Cut before the words a caller's model marks; adds the ``PIECES`` array."""
    if not 0 < o.stride <= o.window:
        raise ValueError("stride must be within 1..window")

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def score(windows: pd.Series) -> pd.Series:
        out = []
        for part in windows:
            try:
                given = [list(w) for w in part]
                scored = [[float(x) for x in row] for row in scorer(given)]
                if [len(row) for row in scored] != [len(w) for w in given]:
                    raise ValueError("one score per word is needed")
                out.append(scored)
            except Exception:  # noqa: BLE001 - a failing model gives a fallback chunk
                out.append(None)
        return pd.Series(out, dtype=object)

    def windows(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(o.stride))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda s: F.slice(ws, s + 1, o.window))

    def best(scores: Column, i: Column) -> Column:
        last = F.floor(i / o.stride).cast("int")
        first = F.greatest(F.lit(0), F.floor((i - o.window) / o.stride).cast("int") + 1)
        seen = F.transform(
            F.sequence(first, last), lambda w: F.get(F.get(scores, w), i - w * o.stride)
        )
        return F.array_max(seen)

    ws, scores = F.col("__words"), F.col("__scores")
    starts = F.filter(
        sen.positions(F.size(ws)), lambda i: (i == 0) | (best(scores, i) >= o.threshold)
    )
    cut = sen.merge_short(sen.let(starts, lambda st: sen.joined_runs(ws, st)), o.min_characters_per_chunk)
    return (
        parts.withColumn("__words", tx.words(F.col("text")))
        .withColumn("__scores", score(windows(F.col("__words"))))
        .withColumn(PIECES, F.when(scores.isNotNull(), cut))
        .withColumn(FAILURE, F.when(scores.isNull(), F.lit("raised")))
        .drop("__words", "__scores")
    )


def add_pieces(
    parts: DataFrame, strategy: str, options, scorer: BoundaryScorer | None = None
) -> DataFrame:
    """Run a strategy; adds ``PIECES`` and ``FAILURE``."""
    text = F.col("text")
    if strategy == "boundary":
        if scorer is None:
            return parts.withColumn(PIECES, F.lit(None).cast("array<string>")).withColumn(
                FAILURE, F.lit("no_chunker")
            )
        return pieces_by_boundary_model(parts, options, scorer)
    if strategy in ("semantic", "sdpm"):
        return pieces_by_similarity(parts, options).withColumn(FAILURE, F.lit(None).cast("string"))
    if strategy == "token":
        overlap = opt.overlap_tokens(options.chunk_overlap, options.chunk_size)
        pieces = sen.token_windows(text, options.chunk_size, overlap)
    elif strategy == "sentence":
        pieces = sen.sentence_chunks(
            text,
            options.chunk_size,
            opt.overlap_tokens(options.chunk_overlap, options.chunk_size),
            options.min_sentences_per_chunk,
            options.min_characters_per_sentence,
        )
    elif strategy == "recursive":
        separators = sen.RECIPES[options.recipe or "default"]
        pieces = sen.recursive_chunks(text, options.chunk_size, options.min_characters_per_chunk, separators)
    else:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    return parts.withColumn(PIECES, pieces).withColumn(FAILURE, F.lit(None).cast("string"))


def with_fallback(cut: DataFrame, strategy: str, *, start_only: bool = False) -> DataFrame:
    """Drop blank pieces; a part left without any is cut into windows of words.

    The windows have the strategy's default size and hold the whole part. With
    ``start_only`` one chunk of the part's first ``chunk_size * 5`` characters is kept
    instead and the rest left out.
    """
    default_size = getattr(opt.STRATEGIES[strategy](), "chunk_size", 256)
    text = F.col("text")
    if start_only:
        head = F.substring(text, 1, default_size * opt.FALLBACK_CHARS_PER_TOKEN)
        instead = F.when(~tx.is_blank(head), F.array(head)).otherwise(F.array().cast("array<string>"))
    else:
        instead = sen.token_windows(text, default_size, 0)
    kept = F.filter(F.coalesce(F.col(PIECES), F.array().cast("array<string>")), lambda p: ~tx.is_blank(p))
    return (
        cut.withColumn(PIECES, kept)
        .withColumn(
            FAILURE,
            F.when(F.size(PIECES) == 0, F.coalesce(F.col(FAILURE), F.lit("no_output"))),
        )
        .withColumn(PIECES, F.when(F.col(FAILURE).isNull(), F.col(PIECES)).otherwise(instead))
    )


def enrich(cut: DataFrame, strategy: str) -> DataFrame:
    """One row per piece with order, id, display name and fallback notes."""
    failure = F.col(FAILURE)
    # The outer form, because for the inner one the optimiser adds a
    # "size > 0" filter and pushes it down, which would cut every text twice.
    rows = cut.select(
        *[F.col(c) for c in cut.columns if c not in (PIECES, "text")],
        F.posexplode_outer(PIECES).alias("chunk_order", "text"),
    ).filter(F.col("chunk_order").isNotNull())
    # The first chunk of such a part tells what happened.
    first = F.col("chunk_order") == 0
    suffix = (
        F.when(first & (failure == "no_chunker"), F.lit("_init_fail"))
        .when(first & (failure == "no_output"), F.lit("_full_content_fallback"))
        .otherwise(F.lit(""))
    )
    error = (
        F.when(failure == "no_chunker", F.lit(f"no chunker for strategy '{strategy}'; cut into windows of words"))
        .when(failure == "raised", F.lit(f"strategy '{strategy}' failed; cut into windows of words"))
        .when(failure == "no_output", F.lit("strategy gave no chunks; cut into windows of words"))
    )
    marks = {
        name: schemas.optional(cut, name, dtype)
        for name, dtype in schemas.LOCATION_FIELDS.items()
        if name != "epub_item_id"
    }
    return (
        rows.withColumn("chunk_id", F.concat(tx.chunk_id(F.col("part_id"), F.col("chunk_order")), suffix))
        .withColumn(
            "display_source_name",
            tx.display_source_name(F.col("source_file"), **marks, chunk_order=F.col("chunk_order")),
        )
        .withColumn("chunking_error", error)
        .withColumn("chunking_notes", F.when(first & (failure == "no_output"), F.lit("windows of the whole content")))
        .drop(FAILURE)
    )


def chunk_documents(
    parts: DataFrame,
    strategy: str = opt.DEFAULT_STRATEGY,
    *,
    scorer: BoundaryScorer | None = None,
    **given,
) -> DataFrame:
    """Cut parts into chunks with the named strategy and its options."""
    options = opt.strategy_options(strategy, **given)
    cut = add_pieces(parts, strategy, options, scorer)
    return enrich(with_fallback(cut, strategy), strategy)
