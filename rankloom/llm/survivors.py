"""One record out of each group of duplicates, field by field, and how far its values can be believed.

`beliefs` is a latent truth model with two-sided source quality: a source has, for each field, a
sensitivity (how much of what is true it says) and a specificity (how rarely it says what is not).
Expectation-maximisation infers both together with the truth of every value, and as values are
judged one by one, several of a field may be true. A source that gives some usable value for a
group denies the group's other values of that field.

`survivors` picks among the claimed values the one that survives, and its row: by a fixed order of
precedence (trust, recency, completeness, smallest id), which no estimate of quality may overrule,
then by belief. So the model decides only where the order leaves several values, as rows of one id
do; and it says how far each survivor is to be believed.

Defined cases: a null source is one source of its own; a null group is a group; repeated rows of one
source claim a value once; rows tie down to the smallest id; groups without a usable value of a
field have no row for it; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.score import numbered
from rankloom.sources.shared import joined, stored


@dataclass(frozen=True)
class Claimed:
    """A field: which of its values are usable, the text by which two of them are equal, and the value itself as text."""

    name: str
    usable: Column
    text: Column
    value: Column


@dataclass(frozen=True)
class Roles:
    group: str
    row: str
    source: str
    recency: str
    complete: tuple[str, ...]
    fields: tuple[Claimed, ...]


def _claims(df: DataFrame, roles: Roles, *more: str) -> DataFrame:
    """g, f, v, s, value: what each row claims of each field; and more columns of the row."""
    each = F.array(*[F.struct(F.lit(c.name).alias("f"), F.when(c.usable, c.text).alias("v"), c.value.alias("value")) for c in roles.fields])
    return df.select(F.col(roles.group).alias("g"), F.coalesce(F.col(roles.source).cast("string"), F.lit("")).alias("s"), *more, F.explode(each).alias("e")).where("e.v is not null").select("g", "e.f", "e.v", "s", "e.value", *more)


def _patterns(claims: DataFrame, carried: tuple[Column, ...]) -> tuple[DataFrame, list[str]]:
    """(g, f, v, says, denies, carried; sources): the sources for and against each value, by their numbers; no more of either than there are sources."""
    sources = stored(numbered(stored(claims.select("s").distinct()), [F.col("s").asc()], "no"))
    claims = joined(claims, sources, "s").withColumn("no", F.col("no") - 1)
    facts = claims.groupBy("g", "f", "v").agg(F.array_sort(F.collect_set("no")).alias("says"), *carried)
    cover = claims.groupBy(F.col("g").alias("g2"), F.col("f").alias("f2")).agg(F.array_sort(F.collect_set("no")).alias("cover"))
    both = facts.join(cover, F.col("g").eqNullSafe(F.col("g2")) & (F.col("f") == F.col("f2")))
    return both.withColumn("denies", F.array_except("cover", "says")).drop("g2", "f2", "cover"), [r.s for r in sources.orderBy("no").collect()]


@dataclass(frozen=True)
class Model:
    """What EM found: (sensitivity, specificity) by (field, source), and whether they stand still."""

    quality: dict[tuple[str, str], tuple[float, float]]
    converged: bool
    rounds: int


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All members of the lists, and the list each is of."""
    n = np.fromiter((0 if x is None else len(x) for x in lists), dtype=np.int64, count=len(lists))
    members = np.concatenate([np.asarray(x, dtype=np.int64) for x, k in zip(lists, n) if k]) if n.sum() else np.zeros(0, dtype=np.int64)
    return members, np.repeat(np.arange(len(lists)), n)


def _chances(field: np.ndarray, says: pd.Series, denies: pd.Series, quality: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """That each value is true, given who says and who denies it. quality: (fields, sources, 2)."""
    sens, spec = quality[..., 0], quality[..., 1]
    odds = np.log(prior / (1 - prior))[field]
    for lists, weight in ((says, np.log(sens / (1 - spec))), (denies, np.log((1 - sens) / spec))):
        who, of = _flat(lists)
        odds = odds + np.bincount(of, weight[field[of], who], len(field))
    return 1 / (1 + np.exp(-odds))


def beliefs(df: DataFrame, roles: Roles, *, rounds: int = 500, close: float = 1e-4) -> tuple[DataFrame, Model]:
    """g, f, v and belief of every claimed value; and the model of the sources."""
    return _beliefs(_claims(df, roles), roles, rounds=rounds, close=close)


def _beliefs(claims: DataFrame, roles: Roles, *carried: Column, rounds: int = 500, close: float = 1e-4) -> tuple[DataFrame, Model]:
    """The same from claims, with aggregates of the claims of each value.

    Values with the same sources for and against are alike to the model, so they are counted by that
    pattern once, and a round is one pass over the counts that gives four sums for each field and
    source: so many come to the driver and to each worker, as it is sources, not rows, that are
    judged. Rounds end when no sensitivity or specificity moves by `close`. The pseudo-counts hold
    sources to "says half of what is true, and seldom what is not" until their own record is longer.
    """
    fields = [c.name for c in roles.fields]
    facts, sources = _patterns(claims, carried)
    place = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    facts = stored(facts.withColumn("i", place[F.col("f")]))
    counts = stored(facts.groupBy("i", "says", "denies").agg(F.count("*").alias("n")))
    counts = counts.coalesce(max(1, counts.count() // 50_000))  # a round over few patterns is one short task
    k, m, sc = len(fields), len(sources), claims.sparkSession.sparkContext
    quality, prior, moved, done = np.tile([0.6, 0.9], (k, m, 1)), np.full(k, 0.5), 1.0, 0
    seen = np.zeros((k, m), dtype=bool)
    while moved > close and done < rounds and m:
        held = sc.broadcast((quality, prior))

        def sums(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            quality, prior = held.value
            by_source, by_field = np.zeros((4, k * m)), np.zeros((2, k))
            for pdf in batches:
                i, n = pdf["i"].to_numpy(np.int64), pdf["n"].to_numpy(float)
                p = _chances(i, pdf["says"], pdf["denies"], quality, prior)
                for said, lists in ((True, pdf["says"]), (False, pdf["denies"])):
                    who, of = _flat(lists)
                    at, t, u = i[of] * m + who, (n * p)[of], (n * (1 - p))[of]
                    for row, w in ((1, t), (3, u), (0, t) if said else (2, u)):
                        by_source[row] += np.bincount(at, w, k * m)
                by_field += [np.bincount(i, n * p, k), np.bincount(i, n, k)]
            at = np.flatnonzero(by_source.any(axis=0))
            yield pd.DataFrame({"at": at, **{f"x{j}": by_source[j, at] for j in range(4)}})
            yield pd.DataFrame({"at": -1 - np.arange(k), "x0": by_field[0], "x1": by_field[1], "x2": 0.0, "x3": 0.0})

        got = counts.mapInPandas(sums, "at bigint, x0 double, x1 double, x2 double, x3 double").groupBy("at").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(4)]).toPandas()  # fields x sources
        held.destroy()
        one, field = got[got["at"] >= 0], got[got["at"] < 0]
        new = np.tile([0.5, 0.9], (k, m, 1))
        f, s = one["at"].to_numpy() // m, one["at"].to_numpy() % m
        new[f, s, 0], new[f, s, 1] = (one["x0"] + 5) / (one["x1"] + 10), (one["x2"] + 9) / (one["x3"] + 10)
        seen[f, s] = True
        moved, quality, done = float(np.abs(new - quality)[seen].max(initial=0.0)), new, done + 1
        prior[-1 - field["at"].to_numpy()] = np.clip(field["x0"] / np.maximum(field["x1"], 1e-300), 0.01, 0.99)
    held = sc.broadcast((quality, prior))

    @F.pandas_udf("double")
    def chance(i: pd.Series, says: pd.Series, denies: pd.Series) -> pd.Series:
        return pd.Series(_chances(i.to_numpy(np.int64), says, denies, *held.value))

    known = {(fields[a], sources[b]): (float(quality[a, b, 0]), float(quality[a, b, 1])) for a, b in zip(*np.nonzero(seen))}
    return facts.withColumn("belief", chance("i", "says", "denies")).drop("i", "says", "denies"), Model(known, moved <= close or not m, done)


def true_values(df: DataFrame, roles: Roles, *, least: float = 0.5) -> DataFrame:
    """group, field_name, value, belief: every value judged true, which may be several of one field."""
    found, _ = beliefs(df, roles)
    return found.where(F.col("belief") >= least).select(F.col("g").alias(roles.group), F.col("f").alias("field_name"), F.col("v").alias("value"), "belief")


def survivors(df: DataFrame, trust: DataFrame, roles: Roles, *, least_rows: int = 2) -> DataFrame:
    """group, field_name, row, value, and belief: for each group of least_rows rows or more and each field with a usable value.

    Every claimed value comes with the best of its rows by the order of precedence and with what the
    model believes of it, and the survivor is the greatest by the one, then by the other (belief to
    six digits, as it is found to a tolerance). best: the value that the model believes most (of
    equal ones the least).

    trust: source and trust (0 for any other source and for none). The greatest are kept on the map
    side, first by value, then by group and field, so a group of any size is no burden.
    """
    t = stored(trust.where(F.col(roles.source).isNotNull()).groupBy(F.col(roles.source).alias("_s")).agg(F.max("trust").alias("_trust")))
    filled = sum((F.col(c).isNotNull().cast("int") for c in roles.complete), F.lit(0))
    order = F.struct(F.coalesce("_trust", F.lit(0)).alias("a"), F.col(roles.recency).alias("b"), filled.alias("c"), (-F.col(roles.row)).alias("d"))
    rows = joined(df, t, F.col(roles.source) == F.col("_s"), "left").withColumn("_order", order)
    found, model = _beliefs(_claims(rows, roles, "_order"), roles, F.max(F.struct("_order", "value")).alias("top"))
    if not model.converged:
        warnings.warn(f"the model of the sources still moves after {model.rounds} rounds", stacklevel=2)
    kept, most = F.struct("top._order", F.round("belief", 6).alias("sure"), "v", "top.value", "belief"), F.struct(-F.col("belief"), "v")
    best = found.groupBy("g", "f").agg(F.max(kept).alias("e"), F.min_by("v", most).alias("best"))
    large = df.groupBy(F.col(roles.group).alias("g2")).count().where(F.col("count") >= least_rows)
    best = best.where("e._order.d is not null").join(large, F.col("g").eqNullSafe(F.col("g2")), "left_semi")
    return best.select(F.col("g").alias(roles.group), F.col("f").alias("field_name"), (-F.col("e._order.d")).alias(roles.row), "e.value", "e.belief", F.col("e.v").alias("text"), "best")


def agreement(found: DataFrame) -> DataFrame:
    """By field of what `survivors` gives: survivors, how many of them are the value the model believes most, how many are judged true, and their mean belief."""
    n = F.count("*")
    return found.groupBy("field_name").agg(n.alias("survivors"), F.count_if(F.col("text") == F.col("best")).alias("believed_most"), F.count_if(F.col("belief") >= 0.5).alias("judged_true"), F.avg("belief").alias("mean_belief"))


def records(found: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """What `survivors` gives, as one record a group: a column of text for each field."""
    return found.groupBy(group).agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields])
