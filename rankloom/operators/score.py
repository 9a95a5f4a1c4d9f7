"""Signals on one scale, blended by weights that make up for what is missing, and ranked."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numbers import round1
from rankloom.sources.shared import joined, stored


@dataclass(frozen=True)
class Signal:
    name: str
    column: str
    higher_is_better: bool = True
    logarithmic: bool = False
    quality: bool = False


# The signals of the model index and their usual weights.
MODEL_SIGNALS = (
    Signal("intelligence", "intelligence_index", quality=True), Signal("coding", "coding_index", quality=True), Signal("agentic", "agentic_index", quality=True), Signal("arena", "arena_elo", quality=True),
    Signal("usage", "usage_rank", higher_is_better=False), Signal("downloads", "downloads", logarithmic=True), Signal("likes", "likes"), Signal("price", "price_completion", higher_is_better=False),
)
MODEL_WEIGHTS = {"intelligence": 30.0, "coding": 15.0, "agentic": 10.0, "arena": 10.0, "usage": 20.0, "downloads": 5.0, "likes": 5.0, "price": 5.0}
WITHOUT_QUALITY = 0.80


def _raw(s: Signal) -> Column:
    x = F.col(s.column).cast("double")
    return F.log10(x + 1) if s.logarithmic else x


def normalised(df: DataFrame, signals: tuple[Signal, ...]) -> DataFrame:
    """df with norm_<signal>: 0 to 100 over all rows, null where the signal is.

    Each signal's least and greatest value come from one aggregation and go to every row as a
    single row, so nothing is moved; a filter put on the result does not change the scale. A
    constant signal is 0 (100 where lower is better).
    """
    ends = df.agg(*[f(_raw(s)).alias(f"_{k}_{s.name}") for s in signals for k, f in (("low", F.min), ("high", F.max))])
    wide = df.join(F.broadcast(ends))  # one row
    out = {}
    for s in signals:
        low, high = F.col(f"_low_{s.name}"), F.col(f"_high_{s.name}")
        x = (_raw(s) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low) * 100.0
        out[f"norm_{s.name}"] = x if s.higher_is_better else 100.0 - x
    return wide.withColumns(out).drop(*ends.columns)


def parse_weights(raw: str | None) -> dict[str, float] | None:
    """'a:1,b:2' to a dict; parts that are no number, or not finite, are left out; None if nothing is left."""
    found = {}
    for part in (raw or "").split(","):
        name, colon, value = part.partition(":")
        try:
            if colon and math.isfinite(x := float(value)):
                found[name.strip()] = x
        except ValueError:
            pass
    return found or None


def blended(df: DataFrame, signals: tuple[Signal, ...], weights: dict[str, float] | None = None, defaults: dict[str, float] | None = None, *, dampened: float = WITHOUT_QUALITY) -> DataFrame:
    """df (with its norm_ columns) with score and score_breakdown.

    The score is the mean of the signals that are there, by weight, and null if none is; rows
    without any quality signal that has a weight are dampened. Signals without a weight over 0, and
    weights of unknown signals, have no part. The breakdown has only the signals that count.
    """
    w = {**(MODEL_WEIGHTS if defaults is None else defaults), **(weights or {})}
    used = [(n, w[n], s) for n in w for s in signals if s.name == n and w[n] > 0]
    if not used:
        return df.withColumns({"score": F.lit(None).cast("double"), "score_breakdown": F.create_map().cast("map<string,double>")})
    total, weight, quality = F.lit(0.0), F.lit(0.0), F.lit(False)
    for n, x, s in used:  # each step refers to the one before it once, so the expressions grow with the signals, no faster
        v = F.col(f"norm_{n}")
        total = total + F.coalesce(v * x, F.lit(0.0))
        weight = weight + F.when(v.isNull(), 0.0).otherwise(x)
        quality = quality | (v.isNotNull() & F.lit(s.quality))
    wide = df.withColumns({"_total": total, "_weight": weight, "_quality": quality})
    score = F.when(F.col("_weight") != 0, F.col("_total") / F.col("_weight"))
    score = F.when(F.col("_quality"), score).otherwise(score * dampened)
    parts = F.create_map(*[c for n, _, _ in used for c in (F.lit(n), round1(F.col(f"norm_{n}")))])
    return wide.withColumns({"score": round1(score), "score_breakdown": F.map_filter(parts, lambda _, v: v.isNotNull())}).drop("_total", "_weight", "_quality")


def numbered(df: DataFrame, order: list[Column], out: str = "rank", kind: str = "int", within: tuple[str, ...] = ()) -> DataFrame:
    """df with its rows' numbers 1, 2, ... in the order, which should be total; within: numbers begin anew for each value of these.

    Rows are spread by range over `within` and the order, sorted and written with their places in
    their part, in one shuffle; a number is a place plus the sizes of the parts before. No task sees
    more than its part, however large a group is, unlike with a window. As Spark samples the input
    to find the ranges, df should be cheap to read. kind is the numbers' type; more than 2^31 rows
    need bigint.
    """
    by = [F.col(c) for c in within]
    parts = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    parts = stored(parts.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(2**33 - 1)}).drop("_at"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*within, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))  # no more rows than groups and parts
    sizes = sizes.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    found = joined(parts, stored(sizes), same) if within else parts.join(F.broadcast(sizes), same)  # a row for each part
    number = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return found.withColumn(out, number.cast(kind)).drop("_part", "_place", "_p", "_first", "_before", *[f"_w{i}" for i in range(len(within))])


def ranked(df: DataFrame, seq: str = "seq") -> DataFrame:
    """By the rounded score, rows without one last, ties in order of seq: no rank twice."""
    return numbered(df, [F.col("score").desc_nulls_last(), F.col(seq).asc()])


def leaderboard(df: DataFrame, signals: tuple[Signal, ...] = MODEL_SIGNALS, weights: dict[str, float] | None = None, defaults: dict[str, float] | None = None, seq: str = "seq") -> DataFrame:
    return ranked(blended(normalised(df, signals), signals, weights, defaults), seq)
