"""Quality rules with thresholds learnt from the data of each language and source.

Each document is measured in one pass. The measures of every (language,
source) go into quantile sketches: counts per value, values kept to three
significant digits. Two sketches merge by adding their counts, so they are
built map-side, do not depend on the order of the rows, and the sketch of a
language or of everything is the sum of those of its sources. A document
fails where a measure lies far outside the middle half of its group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import SPACES, WORDS, bound, lookup, shielded, text_of
from passagemill.session import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Measure:
    """A measure in whole thousandths, and the least distance that counts as far."""

    name: str
    top: str
    base: str
    slack: int
    low: bool = False


@dataclass(frozen=True)
class QualityOptions:
    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 3  # times the distance of the quartiles
    min_rows: int = 200  # a smaller group takes the sketch of its language, then of everything
    broadcast_rows: int = 50_000
    measures: tuple[Measure, ...] = (
        Measure("symbols", "n_symbols", "word_chars", 50),
        Measure("dup_lines", "n_dup_lines", "n_lines", 500),
        Measure("repeats", "n_repeat_words", "n_words", 250),
        Measure("capitals", "n_capitals", "word_chars", 300),
        Measure("word_length", "word_chars", "n_words", 3000, low=True),
    )


def count_of(text: Column, others: str) -> Column:
    """Characters left after deleting ``others``."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("bigint")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash within one text. Only texts with a
    repeated window are sorted.
    """

    def of_repeated(windows: Column) -> Column:
        places = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

        def kept(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(x["w"] == F.get(s, k)["w"], F.lit(False))
            marked = F.transform(s, lambda x, i: F.when(twin(x, i - 1) | twin(x, i + 1), x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return bound(bound(F.array_sort(places), kept), covered)

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        some = bound(
            windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), of_repeated(t)).otherwise(F.lit(0))
        )
        return F.when(F.size(w) >= 3, some).otherwise(F.lit(0))

    return bound(words, of_words).cast("bigint")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of words, characters, symbols, repeated lines and words.

    A null text counts as one without words. Existing columns of these names
    are replaced.
    """
    t = text_of(text)
    words = F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORDS))
    both = bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return docs.withColumns(
        {
            "__words": bound(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))),
            "__lines": both,
            "word_chars": count_of(t, SPACES),
            "n_symbols": count_of(t, r"[^#*$%&|<>]+"),
            "n_capitals": count_of(t, "[^A-Z]+"),
        }
    ).withColumns(
        {
            "n_words": F.col("__words.n").cast("bigint"),
            "n_repeat_words": F.col("__words.r"),
            "n_lines": F.col("__lines.n").cast("bigint"),
            "n_dup_lines": (F.col("__lines.n") - F.col("__lines.d")).cast("bigint"),
        }
    ).drop("__words", "__lines")


def sketch_value(m: Measure) -> Column:
    """The measure in thousandths, kept to three significant digits."""
    exact = F.expr(f"{m.top} * 1000L div {m.base}")
    unit = F.expr("1L") * F.pow(F.lit(10), F.greatest(F.length(exact.cast("string")) - 3, F.lit(0))).cast("bigint")
    return F.when(F.col(m.base) > 0, exact - exact % unit)


def sketches(features: DataFrame, options: QualityOptions) -> DataFrame:
    """Counts (lang, source, measure, value, n) of documents with words."""
    values = F.array(*[F.struct(F.lit(m.name).alias("measure"), F.col(f"__{m.name}").alias("value")) for m in options.measures])
    return (
        features.filter("n_words > 0")
        .select("__lang", "__source", F.explode(values).alias("v"))
        .select("__lang", "__source", "v.measure", "v.value")
        .filter("value IS NOT NULL")
        .groupBy("__lang", "__source", "measure", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(counts: DataFrame, keys: list[str], level: str) -> DataFrame:
    """First and third quartile of merged sketches."""
    by = [*keys, "measure"]
    merged = counts.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy(*by).orderBy("value")
    places = merged.select(*by, "value", "n", F.sum("n").over(up_to).alias("below")).withColumn(
        "all", F.sum("n").over(Window.partitionBy(*by))
    )
    first = lambda part: F.min(F.when(F.col("below") * 4 >= F.col("all") * part, F.col("value")))
    return places.groupBy(*by).agg(
        F.struct(F.sum("n").alias("rows"), first(1).alias("q1"), first(3).alias("q3")).alias(level)
    )


def thresholds(counts: DataFrame, options: QualityOptions) -> DataFrame:
    """Bounds of every measure, one row per (lang, source)."""
    own = quartiles(counts, ["__lang", "__source"], "own")
    lang = quartiles(counts, ["__lang"], "language")
    every = quartiles(counts, [], "every")
    enough = lambda level: F.col(f"{level}.rows") >= options.min_rows
    chosen = F.when(enough("own"), F.col("own")).when(enough("language"), F.col("language")).otherwise(F.col("every"))
    picked = own.join(lang, ["__lang", "measure"]).join(every, ["measure"]).withColumn("q", chosen)
    columns = []
    for m in options.measures:
        far = F.greatest((F.col("q.q3") - F.col("q.q1")) * options.spread, F.lit(m.slack))
        mine = F.col("measure") == m.name
        columns.append(F.max(F.when(mine, F.col("q.q3") + far)).alias(f"__{m.name}_high"))
        if m.low:
            columns.append(F.max(F.when(mine, F.col("q.q1") - far)).alias(f"__{m.name}_low"))
    return picked.groupBy("__lang", "__source").agg(*columns)


def judge_quality(
    docs: DataFrame,
    options: QualityOptions | None = None,
    columns: list[str] | None = None,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``.

    A null language or source counts as the empty string. A document without
    words fails the base rules. An empty table gives an empty table. Texts of
    any length are measured whole; repeated rows are judged one by one and
    each counts in the sketches. ``columns`` are those of ``docs`` to return
    (all by default). Texts are measured once, into a written table; only
    counts are shuffled.
    """
    options = options or QualityOptions()
    kept = docs.columns if columns is None else columns
    features = measured(docs, text).withColumns(
        {
            "__lang": F.coalesce(F.col(lang).cast("string"), F.lit("")),
            "__source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        }
    )
    features = materialize(features.select(*kept, *[c for c in COUNTS if c not in kept], "__lang", "__source"), "measured")
    features = features.withColumns({f"__{m.name}": sketch_value(m) for m in options.measures})
    counts = materialize(sketches(features, options), "sketches")
    return verdicts(features, thresholds(counts, options), options)


def drop_rejected(
    docs: DataFrame, options: QualityOptions | None = None, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``docs`` without the documents that fail a rule, see :func:`judge_quality`; columns of any name stay as they are."""
    own = shielded(docs, text, lang, source)
    judged = judge_quality(own, options, own.columns, text, lang, source)
    return judged.filter("kept").select(*own.columns).toDF(*docs.columns)


def verdicts(features: DataFrame, limits: DataFrame, options: QualityOptions) -> DataFrame:
    """Join every document with the bounds of its group and apply both kinds of rules."""
    joined = lookup(features, limits, ["__lang", "__source"], "left", options.broadcast_rows)
    base = (F.col("n_words") < options.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * options.max_repeat_percent
    )
    far = [F.col(f"__{m.name}") > F.col(f"__{m.name}_high") for m in options.measures]
    far += [F.col(f"__{m.name}") < F.col(f"__{m.name}_low") for m in options.measures if m.low]
    outside = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in far])
    own = [c for c in joined.columns if not c.startswith("__")]
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~outside).select(*own, "base_failed", "kept")
