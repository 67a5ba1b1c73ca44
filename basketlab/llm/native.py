"""Column expressions over texts: places of matches and words, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words: letters, digits and everything past ASCII, in either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_AFTER_WORD = r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
NOT_BEFORE_WORD = r"(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"

_SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def places(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """(start, end, text) of the leftmost matches whose ``group`` has ``least`` characters.

    Offsets are code points. Matches and the pieces between them alternate, so sums of their
    lengths are the offsets; a text without a match is only searched once.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    both = F.zip_with(
        matches, measured, lambda m, g: F.struct(m.alias("text"), (F.length(g) >= least).alias("passes"))
    )
    steps = F.zip_with(
        F.split(text, pattern, -1),
        both,
        lambda before, m: F.struct(
            F.length(before).cast("long").alias("before"),
            F.coalesce(F.length(m["text"]), F.lit(0)).cast("long").alias("length"),
            F.coalesce(m["passes"], F.lit(False)).alias("passes"),
            m["text"].alias("text"),
        ),
    )
    empty = F.array().cast(_SPANS)

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["before"]
        end = start + step["length"]
        span = F.array(F.struct(start.alias("start"), end.alias("end"), step["text"].alias("text"))).cast(_SPANS)
        spans = F.when(step["passes"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    inside = let(steps, lambda bound: F.transform(parted(bound), lambda part: F.aggregate(part, zero, add)))
    found = F.flatten(let(inside, _shifted))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda every mention would compute it anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parted(items: Column) -> Column:
    """An array as parts of about as many members as there are parts: to append to a part copies little.

    ``items`` is mentioned often: bind it by :func:`let` first.
    """
    width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), width)
    return F.transform(starts, lambda at: F.slice(items, at, width))


def _shifted(parts: Column) -> Column:
    """Spans of each part moved by what the parts before it are long."""

    def add(starts: Column, part: Column) -> Column:
        return F.concat(starts, F.array(F.element_at(starts, -1) + part["at"]))

    starts = F.aggregate(parts, F.array(F.lit(0).cast("long")), add)
    return F.zip_with(
        parts,
        F.slice(starts, F.lit(1), F.size(parts)),
        lambda part, by: F.transform(
            part["spans"],
            lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["text"].alias("text")),
        ),
    )


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (a polynomial, good to 1e-7)."""
    x = F.least(F.abs(z), F.lit(8.0))
    t = 1 / (1 + 0.2316419 * x)
    series = F.lit(0.0)
    # Coefficients of the approximation, highest power first.
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = (series + c) * t
    tail = series * F.exp(-x * x / 2) / 2.5066282746310002
    return F.when(z >= 0, tail).otherwise(1 - tail)
