"""Filtered, sorted and cut views of a ranked table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.numbers import ago, nearest, percent_of
from rankloom.functions.text import contains_text, filled


def chosen(df: DataFrame, *, hide_noise: bool = True, search: str = "", scored_only: bool = False) -> DataFrame:
    """The rows to show. To be put on scored rows: scores and ranks are over all rows."""
    if hide_noise:
        df = df.where(~F.coalesce("noise", F.lit(False)))
    if search:
        df = df.where(contains_text(search, F.col("name"), F.col("hf_id")))
    return df.where("score is not null") if scored_only else df


def order_by(df: DataFrame, column: str, ascending: bool, tie: str = "rank") -> list[Column]:
    """Nulls count as less than all: first upwards, last downwards. Texts stand in Unicode's order, ties in that of `tie`."""
    c = F.collate(F.col(column), "UNICODE") if dict(df.dtypes)[column] == "string" else F.col(column)
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last(), F.col(tie).asc()]


def toggled(column: str, ascending: bool, clicked: str, rising: tuple[str, ...] = ("name", "rank")) -> tuple[str, bool]:
    """The order after a click on a column: the same column turns round, another starts downwards unless it is a name or rank."""
    return (column, not ascending) if clicked == column else (clicked, clicked in rising)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """df[:n] as Python cuts: a negative n leaves out the last -n rows."""
    return df.limit(n if n >= 0 else max(0, df.count() + n))


def podium(df: DataFrame, order: list[Column], places: int = 3) -> DataFrame:
    """The first scored rows in the order shown, with place and the share of the best score among them (of 1 at least)."""
    from pyspark.sql import Window

    top = df.where("score is not null").orderBy(*order).limit(places)
    place = F.row_number().over(Window.orderBy(*order))  # of `places` rows
    best = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1.0))
    stats = F.concat_ws(
        " · ",
        F.when(F.col("usage_rank") != 0, F.concat(F.lit("USAGE #"), F.col("usage_rank"))),
        F.when(F.col("intelligence_index") != 0, F.concat(F.lit("INTL "), F.col("intelligence_index"))),
        F.when(F.col("arena_elo") != 0, F.concat(F.lit("ARENA "), nearest(F.col("arena_elo")))),
    )
    return top.select(place.alias("place"), "key", "name", "score", percent_of(F.col("score"), best).alias("pct"), F.coalesce(filled(stats), F.lit("—")).alias("stats"))


def with_bars(shown: DataFrame) -> DataFrame:
    """The rows shown, with pct: each score's share of the best among them (of 1 at least)."""
    best = shown.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("_best"))  # one row
    return shown.join(F.broadcast(best)).withColumn("pct", percent_of(F.col("score"), F.col("_best"))).drop("_best")


def link(hub: str, other: str) -> Column:
    """Where a row leads: to its hub page, or else to the other list's."""
    return F.when(filled(F.col("hf_id")).isNotNull(), F.concat(F.lit(hub), F.col("hf_id"))).otherwise(F.concat(F.lit(other), F.col("or_id")))


def badges(labels: dict[str, str]) -> Column:
    """Marks of the sources a row comes from, and AA where it has an intelligence index that is not 0."""
    marks = [F.when(F.array_contains("sources", s), m) for s, m in labels.items()]
    return F.array_compact(F.array(*marks, F.when(F.col("intelligence_index") != 0, "AA")))


# How weights and kinds of events are called, the blend's line, and the ends of a weight's slider.
WEIGHT_LABELS = {
    "intelligence": "INTELLIGENCE", "coding": "CODING", "agentic": "AGENTIC", "arena": "ARENA ELO", "usage": "REAL USAGE", "downloads": "DOWNLOADS", "likes": "LIKES", "price": "CHEAP PRICE",
}
BLEND = "SCORE = WEIGHTED BLEND OF INTELLIGENCE · CODING · AGENTIC · ARENA · USAGE · DOWNLOADS · LIKES · PRICE"
SLIDER = (0.0, 50.0)
EVENT_LABELS = {"new_leader": "NEW #1", "new_model": "NEW MODEL", "big_climber": "CLIMBER", "price_drop": "PRICE DROP"}


def feed_view(events: DataFrame, now: float, hub: str) -> DataFrame:
    """Of each event: label, link (of keys with a slash), the headline before, at and after the name's first place, and its age."""
    labels = F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv])
    name = F.coalesce("name", F.lit(""))
    at = F.when(F.col("key").contains("/") & (name != ""), F.instr("headline", name)).otherwise(0)
    cut = lambda a, n: F.substr("headline", a, n)
    return events.select(
        "ord", F.coalesce(F.try_element_at(labels, F.col("type")), "type").alias("label"), F.when(F.col("key").contains("/"), F.concat(F.lit(hub), "key")).alias("link"),
        F.when(at > 0, cut(F.lit(1), at - 1)).otherwise(F.col("headline")).alias("before"), F.when(at > 0, name).otherwise("").alias("linked"),
        F.when(at > 0, cut(at + F.length(name), F.length("headline"))).otherwise("").alias("after"), ago(nearest(F.lit(float(now)) - F.col("ts"))).alias("age"),
    )


def shown_of(shown: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: how many rows are shown, and of how many."""
    return shown.agg(F.count("*").alias("shown")).join(F.broadcast(whole.agg(F.count("*").alias("all"))))  # one row each


def labelled(name: Column, labels: dict[str, str]) -> Column:
    """The label of a name, or else the name itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), name), name)


def slider(weight: Column) -> Column:
    """A weight as a slider shows it; none is 0."""
    return F.greatest(F.lit(SLIDER[0]), F.least(F.lit(SLIDER[1]), F.coalesce(weight.cast("double"), F.lit(0.0))))


def weight_controls(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """signal, label and shown weight of every signal that has a label."""
    rows = spark.createDataFrame([(n, weights.get(n)) for n in WEIGHT_LABELS], "signal string, weight double")  # fixed rows
    return rows.select("signal", labelled(F.col("signal"), WEIGHT_LABELS).alias("label"), slider(F.col("weight")).alias("shown"))


def freshness(ages: dict[str, float | None], labels: dict[str, str]) -> list[Column]:
    """'LABEL 12s · LABEL 3m', a dash where a source was never read; as one Column, given in a list for select."""
    parts = [F.concat(F.lit(f"{label} "), ago(F.lit(None if ages.get(k) is None else round(ages[k])).cast("bigint"))) for k, label in labels.items()]
    return [F.concat_ws(" · ", *parts).alias("text")]


def indexed_line(whole: DataFrame) -> DataFrame:
    """One row, text: how many models there are."""
    return whole.agg(F.count("*").alias("n")).select(F.concat(F.col("n"), F.lit(f" MODELS INDEXED · {BLEND}")).alias("text"))


def shown_line(shown: DataFrame, whole: DataFrame) -> DataFrame:
    """One row, text: how many models are shown, of how many."""
    return shown_of(shown, whole).select(F.concat(F.col("shown"), F.lit(" / "), F.col("all"), F.lit(f" MODELS SHOWN · {BLEND}")).alias("text"))


def empty_feed(snapshots: int, name: str = "rankloom") -> str:
    """What an empty feed says, after a first reading and before it."""
    return "No changes detected since the last sweep — the index is steady." if snapshots > 0 else f"Calibrating — {name} takes its first reading on the next sweep."
