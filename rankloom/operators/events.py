"""Events between two states of a ranked table, or all along its history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numbers import dollars_per_million, round1
from rankloom.operators.score import numbered
from rankloom.sources.shared import joined, stored

SLIM = ("key", "name", "rank", "score", "intelligence_index", "coding_index", "usage_rank", "arena_elo", "price_completion", "noise", "sources")
SOCIAL = ("new_leader", "new_model")
EVENT = "type string, key string, name string, rank int, score double, ts double, headline string, rank_delta int, score_delta double, old_price double, new_price double"


@dataclass(frozen=True)
class Limits:
    """When an event is worth telling."""

    newcomer_rank: int = 150
    climbed_ranks: int = 15
    climbed_score: float = 2.5
    price_fall: float = 0.25


def slim(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in SLIM if c in df.columns])


def _said(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def _event(kind: str, headline: Column, p: str = "c", **extra: Column) -> Column:
    none = {"rank_delta": "int", "score_delta": "double", "old_price": "double", "new_price": "double"}
    fields = [F.lit(kind).alias("type"), *[F.col(f"{p}.{x}").alias(x) for x in ("key", "name", "rank", "score")], F.col("ts").cast("double").alias("ts"), headline.alias("headline")]
    return F.struct(*fields, *[extra.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()])


def _there(x: Column) -> Column:
    return x.isNotNull() & (x != 0)


def _row_events(limits: Limits) -> Column:
    """What a row c tells against its former state o (null: none), in order; ts is the time of c."""
    c, o = (lambda n: F.col(f"c.{n}")), (lambda n: F.col(f"o.{n}"))
    scored = F.concat(F.lit(" (score "), _said(c("score")), F.lit(")."))
    new = F.col("o").isNull()
    known = c("intelligence_index").isNotNull() | _there(c("usage_rank"))
    arrives = new & known & _there(c("rank")) & (c("rank") <= limits.newcomer_rank)
    newcomer = _event("new_model", F.concat(F.lit("🔭 New intelligence detected — "), _said(c("name")), F.lit(" enters the index at #"), _said(c("rank")), scored))
    up, gain = o("rank") - c("rank"), F.coalesce(c("score"), F.lit(0.0)) - F.coalesce(o("score"), F.lit(0.0))
    climbs = ~new & _there(o("rank")) & _there(c("rank")) & ((up >= limits.climbed_ranks) | (gain >= limits.climbed_score))
    climber = _event("big_climber", F.concat(F.lit("📈 "), _said(c("name")), F.lit(" is climbing — up "), _said(up), F.lit(" to #"), _said(c("rank")), scored), rank_delta=up, score_delta=round1(gain))
    was, now = o("price_completion"), c("price_completion")
    falls = ~new & _there(was) & _there(now) & (now < was * (1 - limits.price_fall))
    cheaper = _event("price_drop", F.concat(F.lit("💸 "), _said(c("name")), F.lit(" got cheaper — "), dollars_per_million(was, None), F.lit(" → "), dollars_per_million(now, None), F.lit(" /Mtok.")), old_price=was, new_price=now)
    calm = F.coalesce(c("noise"), F.lit(False))
    return F.when(calm, F.array().cast("array<" + newcomer_type() + ">")).otherwise(F.array_compact(F.array(F.when(arrives, newcomer), F.when(climbs, climber), F.when(falls, cheaper))))


def newcomer_type() -> str:
    return "struct<" + ",".join(f.strip().replace(" ", ":") for f in EVENT.split(",")) + ">"


def _leader() -> Column:
    return _event("new_leader", F.concat(F.lit("🔭 New #1 — "), _said(F.col("c.name")), F.lit(" takes the top spot (score "), _said(F.col("c.score")), F.lit(").")))


def _in_order(df: DataFrame, *lead: str) -> DataFrame:
    """One row an event, with ord: the leader first, then by rank, and of a row's events by their place."""
    each = stored(df.select(*lead, "place", F.posexplode("events").alias("pos", "e")))
    order = [F.col("place"), F.col("e.key"), F.col("pos")]
    return numbered(each, order, "ord", within=lead).select(*lead, "ord", "e.*")


def diff(prev: DataFrame, cur: DataFrame, ts: float, limits: Limits = Limits()) -> DataFrame:
    """Events from prev to cur (slim rows, one a key), with ord. An empty prev is no state: no events.

    One left join by key, then the leaders of both; the events are few against the rows.
    """
    names = [n for n in SLIM if n != "sources"]
    pack = lambda df, a: df.select(F.col("key").alias(f"_{a}"), F.struct(*names).alias(a))
    c, o = pack(cur, "c"), pack(prev, "o")
    some = prev.limit(1).select(F.lit(1).alias("_some"))
    rows = c.join(o, F.col("_c") == F.col("_o"), "left").withColumn("ts", F.lit(float(ts)))
    rows = rows.select(F.coalesce("c.rank", F.lit(2**31 - 1)).alias("place"), _row_events(limits).alias("events"))
    was = prev.where("rank = 1").agg(F.min("key").alias("_was"))  # one row
    top = c.where("c.rank = 1").join(F.broadcast(was)).where(~F.col("_was").eqNullSafe(F.col("c.key"))).withColumn("ts", F.lit(float(ts)))
    top = top.select(F.lit(0).alias("place"), F.array(_leader()).alias("events"))
    every = top.unionByName(rows).where(F.size("events") > 0).join(F.broadcast(some))  # one row or none
    return _in_order(every)


def diff_history(df: DataFrame, series: str, snapshot: str, order: str, limits: Limits = Limits()) -> DataFrame:
    """series, snapshot, ord and the events of each snapshot against the one before it in its series.

    df has one slim row a snapshot and key. A key absent from the snapshot before is new again, even
    if older ones had it; so rows are joined with the very snapshot before, not with the key's last row.
    """
    names = [n for n in SLIM if n != "sources"]
    w = Window.partitionBy("_series").orderBy("_order", "s")
    line = stored(df.groupBy(F.col(snapshot).alias("s")).agg(F.min(series).alias("_series"), F.min(order).alias("_order")).select("s", "_series", F.col("_order").cast("double").alias("ts"), F.lag("s").over(w).alias("before"), F.lead("s").over(w).alias("after")))
    rows = df.select(F.col(snapshot).alias("s"), F.col("key").alias("k"), F.struct(*names).alias("r"))
    c = joined(rows.withColumnRenamed("r", "c"), line, "s").where("before is not null").drop("after")
    o = joined(rows.withColumnRenamed("r", "o"), line.select("s", "after"), "s").where("after is not null").select(F.col("after").alias("s"), "k", "o")
    told = c.join(o, ["s", "k"], "left").select(F.col("_series").alias(series), F.col("s").alias(snapshot), F.coalesce("c.rank", F.lit(2**31 - 1)).alias("place"), _row_events(limits).alias("events"))
    was = o.where("o.rank = 1").groupBy("s").agg(F.min("k").alias("_was"))  # a row a snapshot
    top = c.where("c.rank = 1").join(was, "s", "left").where(~F.col("_was").eqNullSafe(F.col("k"))).select(F.col("_series").alias(series), F.col("s").alias(snapshot), F.lit(0).alias("place"), F.array(_leader()).alias("events"))
    return _in_order(top.unionByName(told).where(F.size("events") > 0), series, snapshot)


def unchanged(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """One row, `unchanged`: both have the same keys with the same rank and score. An empty prev: false."""
    side = lambda df, a: df.select(F.col("key").alias("key"), F.struct("rank", "score").alias(a))
    both = side(prev, "a").join(side(cur, "b"), "key", "full_outer")
    n = both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("moved"), F.count("a").alias("before"))
    return n.select(((F.col("moved") == 0) & (F.col("before") > 0)).alias("unchanged"))


def social(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").isin(*SOCIAL))
