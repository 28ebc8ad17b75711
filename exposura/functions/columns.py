"""Column expressions: hashing, time parts, numeric coercion, vectors, tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UNKNOWN = "unknown"
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000


def uniform_hash(*parts: Column | str) -> Column:
    """A repeatable draw in [0, 1) from the given key parts.

    The first 48 bits of an md5 over ``a:b:c``; the same value comes back when a task is rerun on
    another executor, and other SQL engines can reproduce it.
    """
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(281474976710656.0)


def hour_of(timestamp_ms: Column) -> Column:
    """UTC hour of an epoch-millisecond column, whatever the session time zone is."""
    return F.floor(F.pmod(timestamp_ms, F.lit(MS_PER_DAY)) / MS_PER_HOUR).cast("int")


def day_of_week_of(timestamp_ms: Column) -> Column:
    """UTC weekday of an epoch-millisecond column, Monday = 0 (the epoch was a Thursday)."""
    return F.pmod(F.floor(timestamp_ms / MS_PER_DAY) + 3, F.lit(7)).cast("int")


def finite_or_zero(column: Column) -> Column:
    """Coerce to double; text, null, NaN and infinities become 0."""
    number = column.try_cast("double")
    infinity = float("inf")
    usable = ~F.isnan(number) & (number != infinity) & (number != -infinity)
    return F.when(usable, number).otherwise(F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of an ANSI error when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def smoothed_rate(positives: Column, exposures: Column, prior: Column, alpha: float) -> Column:
    return (positives + F.lit(float(alpha)) * prior) / (exposures + F.lit(float(alpha)))


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, term: total + term,
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(vector: Column, floor: float = 1e-12) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
        return bind(norm, lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return bind(vector, scaled)


def discount(rank: Column) -> Column:
    """Logarithmic rank discount 1 / log2(rank + 1)."""
    return F.lit(1.0) / F.log2(rank.cast("double") + 1)


def ideal_gain(positives: Column, k: Column) -> Column:
    """Best reachable discounted gain when ``positives`` binary hits are ranked first."""
    return F.aggregate(
        F.sequence(F.lit(1), F.least(positives, k).cast("int")),
        F.lit(0.0),
        lambda total, rank: total + discount(rank),
    )


_STRIPPED = " []'\""


def primary_category(tag: Column) -> Column:
    """First category of a serialized tag list.

    A bracketed literal list gives its first element; otherwise the text before the first separator,
    without brackets, quotes and blanks. Null and empty tags are ``unknown``.
    """
    text = F.trim(tag)
    # the first element of a quoted or numeric literal list, tuple or set
    # (a parenthesis without a comma is no tuple)
    quoted = F.regexp_extract(text, r"""^(?:[\[{]|\((?=.*,))\s*(['"])(.*?)\1\s*(?:,.*)?[\])}]$""", 2)
    number = F.regexp_extract(text, r"""^(?:[\[{]|\((?=.*,))\s*(-?\d+(?:\.\d+)?)\s*(?:,.*)?[\])}]$""", 1)
    first = (
        F.when(F.contains(text, F.lit(",")), F.split_part(text, F.lit(","), F.lit(1)))
        .when(F.contains(text, F.lit("|")), F.split_part(text, F.lit("|"), F.lit(1)))
        .when(F.contains(text, F.lit(";")), F.split_part(text, F.lit(";"), F.lit(1)))
        .otherwise(text)
    )
    cleaned = F.trim(first, F.lit(_STRIPPED))
    return (
        F.when(tag.isNull(), F.lit(UNKNOWN))
        .when(F.length(quoted) > 0, quoted)
        .when(F.length(number) > 0, number)
        .when(F.length(cleaned) == 0, F.lit(UNKNOWN))
        .otherwise(cleaned)
    )
