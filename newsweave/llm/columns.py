"""Small column expressions that several operators share."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word, as the contracts of the operators define it: a run of anything but these blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
# Positions are summed in runs of this many matches, so that no array is copied per match.
RUN = 256
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every leftmost non-overlapping match: code point start, end and the group's text.

    The pattern must match at least one character. Null text gives null.
    """
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    return F.when(
        text.rlike(pattern), let(parts, lambda p: _placed(p["gaps"], p["found"], p["values"]))
    ).when(text.isNotNull(), F.array().cast(SPAN))


def _placed(gaps: Column, found: Column, values: Column) -> Column:
    def step(gap: Column, match: Column) -> Column:
        return F.struct(
            F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size")
        )

    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, step)
    steps = F.zip_with(steps, values, lambda s, v: F.struct(s["gap"], s["size"], v.alias("value")))
    return let(steps, _summed)


def _summed(steps: Column) -> Column:
    last = F.floor((F.size(steps) - 1) / RUN).cast("int")
    runs = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice(steps, i * RUN + 1, F.lit(RUN))
    )
    return let(runs, lambda r: F.flatten(F.zip_with(r, _starts(r), _within)))


def _starts(runs: Column) -> Column:
    width = F.transform(
        runs, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["size"])
    )
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(
        width,
        none,
        lambda acc, w: F.struct(
            (acc["at"] + w).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")
        ),
        lambda acc: acc["all"],
    )


def _within(run: Column, start: Column) -> Column:
    none = F.struct(start.alias("at"), F.array().cast(SPAN).alias("all"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(
            begin.alias("start"), (begin + x["size"]).alias("end"), x["value"].alias("value")
        )
        return F.struct(
            (begin + x["size"]).alias("at"), F.concat(acc["all"], F.array(span)).alias("all")
        )

    return F.aggregate(run, none, add, lambda acc: acc["all"])


def joined_spans(found: Column) -> Column:
    """``kind:start:end`` of an array of such structs, in its order, comma-joined."""
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
