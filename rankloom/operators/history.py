"""Full snapshots that come again and again: what changed, and the history of every key.

Both operators take one table of snapshot rows and a SnapshotSpec. What they have in common:

* A key is compared without surrounding white space and in lower case. Rows whose key, so written,
  is null or empty, or whose snapshot id is null, name nothing and are left out.
* Snapshots of one series (a null series is a series of its own) are ordered by `order`, null
  first, then by id.
* Of several rows of one key in a snapshot, the one with the greatest `version` holds (null is
  least); of equal versions, the one with the greatest values in the order of `fields`, so repeated
  rows and ties change nothing from run to run.
* NaN and null both mean missing. A missing value against a present one is a change; numbers are a
  change if they differ by the field's tolerance or more.
* An empty table gives an empty result. Columns not named in the spec are ignored, whatever their
  names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.shared import joined, stored


@dataclass(frozen=True)
class SnapshotSpec:
    """Column roles. fields: each compared column with its tolerance (0: any difference counts)."""

    series: str
    snapshot: str
    order: str
    key: str
    version: str
    fields: dict[str, float] = field(default_factory=dict)


def tidy_key(key: Column) -> Column:
    """The form in which keys are equal: trimmed, lower case, null if nothing is left."""
    return F.nullif(F.lower(F.btrim(key, F.lit(" \t\r\n"))), F.lit(""))


def _missing_as_null(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.nanvl(c, F.lit(None)) if dict(df.dtypes)[name] in ("double", "float") else c


def _rows(df: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """s (snapshot), k (key) and v: version, the compared values, and the digest h of those."""
    values = [_missing_as_null(df, c) for c in spec.fields]
    v = F.struct(F.col(f"`{spec.version}`").alias("at"), *[x.alias(f"f{i}") for i, x in enumerate(values)], _digest(values).alias("h"))
    return df.select(F.col(f"`{spec.snapshot}`").alias("s"), tidy_key(F.col(f"`{spec.key}`")).alias("k"), v.alias("v")).where("s is not null and k is not null")


def series_of(df: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """One row per snapshot: s, its series, place in the series (1...), and the ids before and after.

    The rows are folded to one per snapshot on the map side; what is left, and goes through the
    window, is as many rows as there are snapshots.
    """
    w = Window.partitionBy("series").orderBy("o", "s")
    one = (
        df.where(F.col(f"`{spec.snapshot}`").isNotNull() & tidy_key(F.col(f"`{spec.key}`")).isNotNull())
        .groupBy(F.col(f"`{spec.snapshot}`").alias("s"))
        .agg(F.min(f"`{spec.series}`").alias("series"), F.min(f"`{spec.order}`").alias("o"))
    )
    return one.select("s", "series", F.row_number().over(w).alias("place"), F.lag("s").over(w).alias("before"), F.lead("s").over(w).alias("after"))


def _digest(values: list[Column]) -> Column:
    """Of each value and whether it is there: Spark's hash by itself passes over nulls, so that (1, null) and (null, 1) would be one."""
    return F.xxhash64(*[x for v in values for x in (v.isNull(), v)])


def _differs(a: str, b: str, spec: SnapshotSpec) -> Column:
    """Rows of equal digests whose values are the same are settled; all others are compared value by value, with the tolerances.

    So equal digests of unlike values hide nothing.
    """
    found = F.lit(False)
    for i, tolerance in enumerate(spec.fields.values()):
        x, y = F.col(f"{a}.f{i}"), F.col(f"{b}.f{i}")
        far = F.abs(x - y) >= tolerance if tolerance else x != y
        found = found | (x.isNull() != y.isNull()) | F.coalesce(far, F.lit(False))
    values = lambda v: F.struct(*[F.col(f"{v}.f{i}") for i in range(len(spec.fields))])
    settled = (F.col(f"{a}.h") == F.col(f"{b}.h")) & values(a).eqNullSafe(values(b)) if spec.fields else F.lit(True)
    return ~settled & found


def snapshot_changes(df: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """What came, went or changed from each snapshot to the next of its series.

    Gives snapshot (the later one's id), key, change_kind (added, removed, changed) and of every
    field old_... and new_... . The first snapshot of a series has no rows.

    Every row goes to two groups, tagged by side: as the current state of its own snapshot and as
    the former state of the next. One aggregation by (snapshot, key) keeps the row that holds on
    either side, already on the map side, and classifies: a single shuffle however many snapshots
    there are, and a key or snapshot with very many rows is folded before it.
    """
    series = stored(series_of(df, spec).select("s", "before", "after"))
    tagged = joined(_rows(df, spec), series, "s").select(
        "k",
        F.explode(
            F.array(
                F.struct(F.when(F.col("before").isNotNull(), F.col("s")).alias("s"), F.col("v").alias("cur"), F.lit(None).cast(_type(df, spec)).alias("old")),
                F.struct(F.col("after").alias("s"), F.lit(None).cast(_type(df, spec)).alias("cur"), F.col("v").alias("old")),
            )
        ).alias("x"),
    )
    sides = tagged.select("x.s", "k", "x.cur", "x.old").where("s is not null").groupBy("s", "k").agg(F.max("cur").alias("cur"), F.max("old").alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("cur").isNull(), "removed").when(_differs("old", "cur", spec), "changed")
    return (
        sides.withColumn("change_kind", kind)
        .where("change_kind is not null")
        .select(
            F.col("s").alias(spec.snapshot), F.col("k").alias("key"), "change_kind",
            *[F.col(f"{side}.f{i}").alias(f"{name}_{c}") for side, name in (("old", "old"), ("cur", "new")) for i, c in enumerate(spec.fields)],
        )
    )


def _type(df: DataFrame, spec: SnapshotSpec) -> str:
    return _rows(df, spec).schema["v"].dataType.simpleString()


def attribute_history(df: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Every version of every key, with the snapshots from which and until which it held.

    Gives series, key, from_id, to_id (-1: it still holds in the series' last snapshot), the fields
    and version_no (1... for each key of a series). A key that was gone starts anew.

    The state of each snapshot (one row per key) is joined in full with the state of the one before
    it, on snapshot and key. Rows on the one side only are inserted or deleted keys, rows on both
    that differ are changed ones. Only these events go on; lead() over a key's events gives the end
    of each version.
    """
    series = stored(series_of(df, spec).select("s", "series", "place", "after"))
    state = _rows(df, spec).groupBy("s", "k").agg(F.max("v").alias("v"))
    before = joined(state, series.select("s", "after"), "s").where("after is not null").select(F.col("after").alias("s"), "k", F.col("v").alias("old"))
    both = state.withColumnRenamed("v", "cur").join(before, ["s", "k"], "full_outer")
    events = both.where(F.col("old").isNull() | F.col("cur").isNull() | _differs("old", "cur", spec)).select("s", "k", "cur")
    w = Window.partitionBy("series", "k").orderBy("place")
    ended = joined(events, series.select("s", "series", "place"), "s").select(
        "series", "k", "s", "cur", F.lead("s").over(w).alias("end"), F.count("cur").over(w).alias("version_no")
    )
    return ended.where("cur is not null").select(
        F.col("series").alias(spec.series), F.col("k").alias("key"), F.col("s").alias("from_id"),
        F.coalesce("end", F.lit(-1).cast("bigint")).alias("to_id"), *[F.col(f"cur.f{i}").alias(c) for i, c in enumerate(spec.fields)], "version_no",
    )
