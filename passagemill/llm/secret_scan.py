"""Secrets in texts, and the weaker parts of credentials that stand beside each other.

Three kinds count by themselves: assignments to secret-like names, access
identifiers of a known form and long hexadecimal runs. Three more are too weak
alone: names of users or clients, opaque tokens and endpoints. They are
reported only where a part that completes them lies in the same scope, which
is a stretch of a text. The scopes are found by an interval join of each
document's parts with themselves, done as a sweep over their starts, so no
pair is ever written out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import bound, shielded, text_of, with_row_id
from passagemill.session import materialize


def either_case(words: str) -> str:
    """A pattern for ASCII letters in either case; other characters stay as they are."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_IS = r"""["']?\x20*[:=]\x20*["']?"""
_SECRET_NAME = either_case("(password|passwd|secret|token|api_?key)")
_USER_NAME = either_case("(client_?id|account_?id|access_?key_?id|user_?name|login)")
_SCHEME = either_case("(https?|jdbc:postgresql|jdbc:mysql|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)")


@dataclass(frozen=True)
class Kind:
    """A pattern, the least length of its match and of the value (group 2), and what completes it (empty: nothing need)."""

    name: str
    pattern: str
    least: int
    least_value: int = 0
    mixed: bool = False  # lower case, upper case and digits are asked for
    completed_by: tuple[str, ...] = ()


KINDS = (
    Kind("assign", _SECRET_NAME + _IS + "([A-Za-z0-9+/_.=-]+)", 0, 6),
    Kind("access", "AKIA[A-Z0-9]+", 20),
    Kind("hex", "[0-9a-f]+", 24),
    Kind("user", _USER_NAME + _IS + "([A-Za-z0-9@_.-]+)", 0, 3, completed_by=("assign", "hex", "opaque")),
    Kind("opaque", "[A-Za-z0-9+/]+", 32, mixed=True, completed_by=("access", "user", "endpoint")),
    Kind("endpoint", _SCHEME + r"://[^\x20\x09-\x0D\"'<>]+", 0, completed_by=("assign", "access", "hex", "opaque")),
)
BASE = 3  # kinds that count by themselves


@dataclass(frozen=True)
class SecretOptions:
    scope: int = 400  # code points between a part and what completes it
    kinds: tuple[Kind, ...] = field(default=KINDS)


def rough_pattern(kind: Kind) -> str:
    """The pattern with short runs left out where that finds the same long ones.

    A run of one class is always matched whole, so asking for its length in
    the pattern changes nothing but the number of matches.
    """
    if kind.least and not kind.least_value:
        head, one = ("AKIA", kind.pattern[4:-1]) if kind.pattern.startswith("AKIA") else ("", kind.pattern[:-1])
        return f"{head}{one}{{{kind.least - len(head)},}}"
    return kind.pattern


def matches(text: Column, no: int, kind: Kind) -> Column:
    """Matches of a kind as (kind, gap before, length, counts), or null without any."""
    pattern = rough_pattern(kind)

    def with_gaps(found: Column) -> Column:
        def good(m: Column) -> Column:
            ok = F.char_length(m) >= kind.least
            if kind.least_value:
                ok = ok & (F.char_length(F.regexp_extract(m, pattern, 2)) >= kind.least_value)
            if kind.mixed:
                ok = ok & m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
            return ok

        one = lambda m, gap: F.struct(
            F.lit(no).alias("kind"),
            F.char_length(gap).cast("bigint").alias("gap"),
            F.char_length(m).cast("bigint").alias("length"),
            good(m).alias("good"),
        )
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.when(F.size(found) > 0, F.zip_with(found, gaps, one))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_gaps)


def matched(docs: DataFrame, options: SecretOptions, text: str, *columns: Column) -> DataFrame:
    """``columns`` and the matches of all kinds (``__matches``) per row, written."""
    every = F.array(*[matches(text_of(text), no, kind) for no, kind in enumerate(options.kinds)])
    return materialize(docs.select("__row", *columns, every.alias("__matches")), "matches")


def spans(found: DataFrame, options: SecretOptions) -> DataFrame:
    """Rows (__row, kind, start, end, since): all reported spans; ``since`` is where the spans before them end.

    Only matches are shuffled, once, by ``__row``.
    """
    parts = found.select("__row", F.explode("__matches").alias("m")).filter("m IS NOT NULL")
    parts = parts.select("__row", F.posexplode("m").alias("at", "m")).select("__row", "at", "m.*")
    in_kind = Window.partitionBy("__row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(in_kind)
    placed = (
        parts.repartition("__row")
        .withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("length"))
        .filter("good")
        .select("__row", "kind", "start", "end")
    )
    swept = placed
    before = Window.partitionBy("__row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("__row").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    numbers = {kind.name: no for no, kind in enumerate(options.kinds)}
    complete = F.lit(True)
    for no, kind in enumerate(options.kinds):
        if kind.completed_by:
            other = F.col("kind").isin([numbers[name] for name in kind.completed_by])
            swept = swept.withColumns(
                {
                    f"end_{no}": F.max(F.when(other, F.col("end"))).over(before),
                    f"start_{no}": F.min(F.when(other, F.col("start"))).over(after),
                }
            )
            near = (F.col(f"end_{no}") >= F.col("start") - options.scope) | (
                F.col(f"start_{no}") <= F.col("end") + options.scope
            )
            complete = F.when(F.col("kind") == no, F.coalesce(near, F.lit(False))).otherwise(complete)
    reported = swept.filter(complete).select("__row", "kind", "start", "end")
    return reported.withColumn("since", F.coalesce(F.max("end").over(before), F.lit(0).cast("bigint")))


def scan(found: DataFrame, options: SecretOptions) -> DataFrame:
    """Per ``__row`` with a span: ``__found``, its spans (start, kind, end, since) in order."""
    rows = spans(found, options)
    return rows.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "since"))).alias("__found"))


def report(docs: DataFrame, options: SecretOptions | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: counts of base spans, their digest and all spans.

    A null text counts as empty; a text without spans gets zeros, the digest
    of the empty string and an empty list. Null or repeated ids are kept row by
    row. An empty table gives an empty table. Nothing limits the number of
    spans or the length of a text.
    """
    options = options or SecretOptions()
    rows = matched(with_row_id(docs), options, text, F.col(id_col).alias("doc_id"))
    found = scan(rows, options)
    names = F.array(*[F.lit(kind.name) for kind in options.kinds])
    told = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,since:bigint>>")
    every = F.coalesce(F.col("__found"), none)
    base = F.filter(every, lambda s: s["kind"] < BASE)
    count = lambda no: F.size(F.filter(every, lambda s: s["kind"] == no)).cast("bigint")
    return rows.select("__row", "doc_id").join(found, "__row", "left").select(
        "doc_id",
        *[count(no).alias(f"n_{kind.name}") for no, kind in enumerate(options.kinds[:BASE])],
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, told), ",").alias("spans"),
    )


def redact(docs: DataFrame, options: SecretOptions | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``, overlapping ones by one.

    Rows without a span stay as they are, null texts too; repeated rows are
    masked one by one, other columns of any name stay as they are, and an empty
    table gives an empty table.
    """
    options = options or SecretOptions()
    own = shielded(docs, text)
    rows = matched(with_row_id(own), options, text, *[F.col(c) for c in own.columns])
    # Texts without any match are written on as they are; only the others meet their spans.
    hit = F.exists("__matches", lambda of_kind: F.coalesce(F.exists(of_kind, lambda m: m["good"]), F.lit(False)))
    found = scan(rows, options)
    fresh = F.filter(F.col("__found"), lambda s: s["start"] >= s["since"])
    part = lambda s: F.concat(F.substring(F.col(text), s["since"] + 1, s["start"] - s["since"]), F.lit(mark))
    last = F.array_max(F.transform(F.col("__found"), lambda s: s["end"]))
    rest = F.substring(F.col(text), last + 1, F.char_length(text))
    masked = F.concat(F.array_join(F.transform(fresh, part), ""), rest)
    joined = rows.filter(hit).drop("__matches").join(found, "__row", "left")
    changed = joined.withColumn(text, F.when(F.col("__found").isNull(), F.col(text)).otherwise(masked))
    return rows.filter(~hit).select(*own.columns).union(changed.select(*own.columns)).toDF(*docs.columns)
