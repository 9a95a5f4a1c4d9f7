"""Records of several sources into one row per key, by stated rules about duplicates and order.

Order is a column (`ordinal`), as a DataFrame has none. Rows with a null or empty key are left out.
Each operator folds on the map side, so a key with very many rows is no burden.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import billions, both, filled, last_part, sidelined, squashed


def last_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: its last, with `position`, the ordinal of its first."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    kept = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), F.col(ordinal)).alias("_r"), F.min(ordinal).alias("position"))
    return kept.select("_r.*", "position")


def first_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: its first, with `position`, its ordinal."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    kept = rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*df.columns), F.col(ordinal)).alias("_r"), F.min(ordinal).alias("position"))
    return kept.select("_r.*", "position")


def lookup_by_text(lines: DataFrame, name: str, value: str, ordinal: str) -> DataFrame:
    """norm, value: of every squashed name its last value, where name and value are there and the value is not 0."""
    ok = F.col(name).isNotNull() & (F.col(name) != "") & (F.col(value) != 0)
    return lines.where(ok).groupBy(squashed(F.col(name)).alias("norm")).agg(F.max_by(value, ordinal).alias(value))


def with_fallback(df: DataFrame, text: Column, column: str, lookup: DataFrame, value: str) -> DataFrame:
    """df where `column`, if null or 0, is the value that lookup has for the squashed text."""
    found = df.withColumn("_n", squashed(text)).join(lookup.select(F.col("norm").alias("_n"), F.col(value).alias("_v")), "_n", "left")
    return found.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit(0.0)), "_v")).drop("_n", "_v")


@dataclass(frozen=True)
class Sides:
    """Roles: link is the primary's reference to the secondary's id; own the primary's own id."""

    link: str
    own: str
    id: str
    name: str
    from_primary: tuple[str, ...]
    from_secondary: tuple[str, ...]
    rating: str
    primary_label: str = "usage"
    secondary_label: str = "hub"


def merged(primary: DataFrame, secondary: DataFrame, ratings: DataFrame, sides: Sides, *, primary_ordinal: str, secondary_ordinal: str) -> DataFrame:
    """All primary rows by key (link, or else own id), filled from the secondary; then what only the secondary has.

    Of equal keys the primary's last row holds, in its first one's place; where it looks a link up,
    the secondary's last row counts; of rows that only the secondary has, the first. Missing ratings
    are looked up by name. The sides are joined apart and put one below the other, as their rules
    differ. `seq` orders the rows: side (0: primary, 1: only secondary), then place, the ordinal there.
    """
    seq = lambda side: F.struct(F.lit(side).alias("side"), F.col("position").cast("bigint").alias("place")).alias("seq")
    s = sides
    p = last_by_key(primary.withColumn("key", F.coalesce(filled(F.col(s.link)), F.col(s.own))), "key", primary_ordinal)
    last = last_by_key(secondary, s.id, secondary_ordinal).select(F.col(s.id).alias("_id"), *[F.col(c).alias(f"_{c}") for c in s.from_secondary])
    types = dict(primary.dtypes)
    joined = p.join(last, filled(F.col(s.link)) == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    above = joined.select(
        "key", F.coalesce(filled(F.col(s.name)), F.col(s.own)).alias("name"), F.col(s.name).alias("_said"), F.col(s.link).alias(s.link), F.col(s.own).alias(s.own),
        *[F.col(f"_{c}").alias(c) for c in s.from_secondary], *s.from_primary,
        F.when(hit, F.array(F.lit(s.primary_label), F.lit(s.secondary_label))).otherwise(F.array(F.lit(s.primary_label))).alias("sources"), seq(0),
    )
    below = first_by_key(secondary, s.id, secondary_ordinal).join(p.select(F.col("key").alias("_key")), F.col(s.id) == F.col("_key"), "left_anti")
    below = below.select(
        F.col(s.id).alias("key"), F.col(s.id).alias("name"), F.col(s.id).alias("_said"), F.col(s.id).alias(s.link), F.lit(None).cast(types[s.own]).alias(s.own),
        *s.from_secondary, *[F.lit(None).cast(types[c]).alias(c) for c in s.from_primary], F.array(F.lit(s.secondary_label)).alias("sources"), seq(1),
    )
    text = F.when(F.col("seq.side") == 1, last_part(F.col("key"))).otherwise(F.col("_said"))
    every = with_fallback(above.unionByName(below), text, s.rating, ratings, s.rating)
    words = both(F.col("_said"), F.col(s.link))
    return every.withColumns({"noise": sidelined(words), "params_b": billions(words), "local": filled(F.col(s.link)).isNotNull()}).drop("_said")
