"""Column functions on numbers and their texts. Roundings are those of exact binary values, half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _format(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def round1(x: Column) -> Column:
    """x to one decimal; infinities and NaN as they are. Spark's own round and bround differ on ties."""
    d = x.cast("double")
    plain = ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.when(plain, F.when(plain, _format(d, "0.0")).cast("double")).otherwise(d)


def nearest(x: Column) -> Column:
    """To a whole number, half up."""
    return F.floor(x + 0.5)


def short(n: Column) -> Column:
    """999, 1.0K, 2.5M, 1.2B; a dash for null. Below a thousand, at most three decimals."""
    small = F.regexp_replace(_format(n, "0.000"), r"\.?0+$", "")
    small = F.when(n == F.floor(n), _format(n, "0")).otherwise(small)
    sizes = [(1e9, "B"), (1e6, "M"), (1e3, "K")]
    found = F.when(n.isNull(), DASH)
    for size, mark in sizes:
        found = found.when(n >= size, F.concat(_format(n / size, "0.0"), F.lit(mark)))
    return found.otherwise(small)


def dollars_per_million(x: Column, missing: str | None = DASH) -> Column:
    """Of a price for one: '$' and two decimals for a million. missing None: null counts as 0."""
    text = F.concat(F.lit("$"), _format(F.coalesce(x, F.lit(0.0)) * 1e6, "0.00"))
    return text if missing is None else F.when(x.isNull(), missing).otherwise(text)


def ago(seconds: Column) -> Column:
    """59s, 2m, 3h; a dash for null."""
    whole = lambda x: nearest(x).cast("string")
    return F.when(seconds.isNull(), DASH).when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m"))).otherwise(F.concat(whole(seconds / 3600), F.lit("h")))


def padded(n: Column, width: int = 2) -> Column:
    """With zeros in front up to the width; longer ones whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def percent_of(x: Column, top: Column) -> Column:
    return F.when((x != 0) & x.isNotNull(), x / top * 100).otherwise(0.0)


def or_dash(x: Column, *, zero_too: bool = False) -> Column:
    shown = x.isNotNull() & (x != 0) if zero_too else x.isNotNull()
    return F.when(shown, x.cast("string")).otherwise(DASH)
