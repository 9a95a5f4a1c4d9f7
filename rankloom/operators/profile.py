"""Column profiles of loads, and the loads in which a column is not what it usually is.

A ColumnRule turns a column into a number and says which texts are malformed and which numbers are
impossible. From the counts of each value in each load come, exactly, the base figures
(`column_profile`), and the codes on which a classifier two-sample test with ablation runs
(`load_shifts`).

Defined cases: a null load is a load of its own; null and NaN are missing; an empty text is
malformed; repeated rows count as often as they occur; an empty table gives an empty result;
columns that no rule names are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.score import numbered
from rankloom.sources.shared import joined, stored

MISSING, MALFORMED, IMPOSSIBLE, USABLE = range(4)
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Where the bands of usable values begin, as shares of all usable values.
CUTS = [0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999]
#: Steps of "how many of the other loads know this value".
KNOWN = [0.01, 0.1, 0.5]
MOST_DIGITS = 8
#: Codes of a value: its kind, or from USABLE on (band, digits, known) in this layout.
DIGITS_AT, KNOWN_AT = MOST_DIGITS + 1, len(KNOWN) + 2
CODES = USABLE + (len(CUTS) + 1) * DIGITS_AT * KNOWN_AT
#: Where the levels of a column's score begin, of which the joint model is made; columns that are judged together.
LEVELS = np.array([-2.5, -1.3, -0.6, -0.15, 0.15, 0.6, 1.3, 2.5])
TOGETHER = 3
#: Loads whose models go over the rows of all at once.
BLOCK = 256
#: Quantiles of the shape.
SHAPE = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


@dataclass(frozen=True)
class ColumnRule:
    """low and high bound the possible numbers, both included; None: no bound."""

    column: str
    low: float | None = None
    high: float | None = None


def _usable(rule: ColumnRule, x: Column) -> Column:
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (x >= rule.low)
    if rule.high is not None:
        ok = ok & (x <= rule.high)
    return ok


def _read(df: DataFrame, rule: ColumnRule) -> Column:
    """struct(kind, x, raw): x is the number of a usable or impossible value, raw the text of any other."""
    c = F.col(f"`{rule.column}`")
    kind = dict(df.dtypes)[rule.column]
    if kind == "string":
        x = F.when(c.rlike(NUMBER), c.try_cast("double"))
        there = c.isNotNull()
    else:
        x = c.cast("double")
        there = c.isNotNull() & ~F.isnan(x) if kind in ("double", "float") else c.isNotNull()
    what = F.when(~there, MISSING).when(x.isNull() | F.isnan(x), MALFORMED).when(_usable(rule, x), USABLE).otherwise(IMPOSSIBLE)
    return F.struct(what.alias("kind"), F.when(what >= IMPOSSIBLE, x).alias("x"), F.when(what == MALFORMED, c.cast("string")).alias("raw"))


def _half(df: DataFrame) -> Column:
    """0 or 1 by a hash of the row's columns (of those that can be hashed)."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not any(x in t for x in ("map<", "variant", "void"))]), F.lit(2)).cast("int")


def value_counts(df: DataFrame, load: str, rules: list[ColumnRule]) -> DataFrame:
    """load, column_name, kind, x, raw, fold, n: how often each value occurs in each load.

    fold halves the rows by a hash of all their columns, for cross-fitting. The counting folds on
    the map side, so that a load or a value with very many rows takes no more room than others.
    """
    one = F.explode(F.array(*[F.struct(F.lit(r.column).alias("column_name"), _read(df, r).alias("v")) for r in rules])).alias("e")
    return df.select(F.col(f"`{load}`").alias("load"), _half(df).alias("fold"), one).groupBy("load", "e.column_name", "e.v.kind", "e.v.x", "e.v.raw", "fold").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, load: str, rules: list[ColumnRule]) -> DataFrame:
    """Of every load and column: rows, missing, malformed, impossible, distinct_values, lowest, highest, mean, deviation.

    All exact and over all rows. The last four are of the usable values; distinct_values counts the
    different values present, malformed texts included. Of no value they are null, the counts 0.
    """
    c = value_counts(df, load, rules).groupBy("load", "column_name", "kind", "x", "raw").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    x, n = F.when(F.col("kind") == USABLE, F.col("x")), F.col("n")
    return (
        c.groupBy("load", "column_name")
        .agg(
            F.sum("n").alias("rows"), of(MISSING).alias("missing"), of(MALFORMED).alias("malformed"), of(IMPOSSIBLE).alias("impossible"), of(USABLE).alias("usable"),
            F.count(F.when(F.col("kind") != MISSING, 1)).alias("distinct_values"), F.min(x).alias("lowest"), F.max(x).alias("highest"), F.sum(x * n).alias("total"), F.sum(x * x * n).alias("squares"),
        )
        .select(
            F.col("load").alias(load), "column_name", "rows", "missing", "malformed", "impossible", "distinct_values", "lowest", "highest",
            F.try_divide("total", "usable").alias("mean"),
            F.sqrt(F.greatest(F.lit(0.0), F.try_divide("squares", "usable") - F.pow(F.try_divide("total", "usable"), 2))).alias("deviation"),
        )
    )


def column_shape(df: DataFrame, load: str, rules: list[ColumnRule]) -> DataFrame:
    """Of every load and column: mean, deviation and the quantiles of SHAPE of the usable rows; of none they are null.

    A quantile is a value that occurs, within a ten-thousandth of the load's rows. All of it folds on
    the map side in fixed room.
    """
    one = F.explode(F.array(*[F.struct(F.lit(r.column).alias("column_name"), _read(df, r).alias("v")) for r in rules])).alias("e")
    x = F.when(F.col("e.v.kind") == USABLE, F.col("e.v.x"))
    found = df.select(F.col(f"`{load}`").alias("load"), one).groupBy("load", "e.column_name").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.percentile_approx(x, list(SHAPE.values()), 10_000).alias("q"))
    return found.select(F.col("load").alias(load), "column_name", "mean", "deviation", *[F.col("q")[i].alias(name) for i, name in enumerate(SHAPE)])


def _digits(x: Column) -> Column:
    """Significant decimal digits, without the zeros at either end, at most MOST_DIGITS."""
    mantissa = F.regexp_extract(F.format_string("%.9e", F.abs(x)), r"^(\d\.\d*?)0*e", 1)
    return F.least(F.lit(MOST_DIGITS), F.length(F.regexp_replace(mantissa, r"\.", "")))


def band_cuts(df: DataFrame, rules: list[ColumnRule]) -> dict[str, list[float]]:
    """Where each column's bands begin: CUTS of its usable rows, so that a value weighs by how often it occurs.

    Within a two-thousandth of the rows, by a sketch of fixed size over all rows: an exact quantile of the
    counts would hold every distinct value in one task.
    """
    read = [_read(df, r) for r in rules]
    row = df.agg(*[F.percentile_approx(F.when(v["kind"] == USABLE, v["x"]), CUTS, 2000) for v in read]).first()
    return {r.column: c or [] for r, c in zip(rules, row)}


def coded(df: DataFrame, load: str, rules: list[ColumnRule]) -> tuple[DataFrame, DataFrame]:
    """(cells, loads). cells: no, fold, c0, c1, ... and n: how often each combination of codes occurs in a load; loads: load and its number.

    A code is what a classifier may see of a value: its kind, and of a usable one the band (where it
    lies among all usable rows), its digits and in how many of the other loads it occurs. Each
    different value is coded once; rows that are equal in all columns are one from the start.
    """
    names = [f"v{i}" for i in range(len(rules))]
    read = df.select(F.col(f"`{load}`").alias("load"), _half(df).alias("fold"), *[_read(df, r).alias(n) for n, r in zip(names, rules)])
    rows = stored(read.groupBy("load", "fold", *names).agg(F.count("*").alias("n")))
    loads = stored(numbered(rows.select("load").distinct(), [F.col("load").asc()], "no"))
    every = max(1, loads.count() - 1)
    cuts = band_cuts(df, rules)
    begins = F.array(*[F.array(*[F.lit(float(c)) for c in cuts[r.column]]).cast("array<double>") for r in rules])
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(n)["kind"].alias("kind"), F.col(n)["x"].alias("x")) for i, n in enumerate(names)])).alias("e")
    seen = rows.select("load", one).where(F.col("e.kind") == USABLE).select("load", "e.place", "e.x").distinct().groupBy("place", "x").agg(F.count("*").alias("loads"))
    share = (F.col("loads") - 1) / every
    known = sum((F.when(share >= k, 1).otherwise(0) for k in KNOWN), F.when(share > 0, 1).otherwise(0))
    band = F.size(F.filter(begins[F.col("place")], lambda c: c <= F.col("x")))
    code = (band * DIGITS_AT + _digits(F.col("x"))) * KNOWN_AT + known + USABLE
    codes = stored(seen.select("place", "x", code.cast("int").alias("code")))
    for i, n in enumerate(names):
        own = codes.where(F.col("place") == i).select(F.col("x").alias(f"x{i}"), F.col("code").alias(f"k{i}"))
        rows = joined(rows, own, F.when(F.col(n)["kind"] == USABLE, F.col(n)["x"]) == F.col(f"x{i}"), "left")
    rows = rows.select("load", "fold", *[F.coalesce(f"k{i}", F.col(n)["kind"]).alias(f"c{i}") for i, n in enumerate(names)], "n")
    rows = joined(rows, loads.withColumnRenamed("load", "_load"), F.col("load").eqNullSafe(F.col("_load")))
    return stored(rows.groupBy("no", "fold", *[f"c{i}" for i in range(len(rules))]).agg(F.sum("n").alias("n"))), loads


def _design() -> np.ndarray:
    """A row for each code: a constant, and a column for each kind, band, number of digits and step of known."""
    code = np.arange(CODES)
    rest = np.where(code >= USABLE, code - USABLE, 0)
    parts = [np.minimum(code, USABLE), rest // KNOWN_AT // DIGITS_AT, rest // KNOWN_AT % DIGITS_AT, rest % KNOWN_AT]
    hot = [(p[:, None] == np.arange(p.max() + 1)) & ((code >= USABLE)[:, None] | (i == 0)) for i, p in enumerate(parts)]
    return np.hstack([np.ones((CODES, 1)), *hot]).astype(float)


def _one_hot(codes: np.ndarray) -> np.ndarray:
    """A column for each value of each code, and a constant."""
    return np.hstack([np.ones((len(codes), 1)), *[(codes[:, [j]] == np.unique(codes[:, j])).astype(float) for j in range(codes.shape[1])]])


def _logistic(z: np.ndarray, a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps for weighted logistic regression; a and b: what the load and the others have in each cell."""
    na, nb = a.sum(), b.sum()
    beta = np.zeros(z.shape[1])
    if not na or not nb:
        return beta
    wa, wb, keep = a / na, b / nb, ridge / min(na, nb) * np.eye(z.shape[1])

    def cost(beta: np.ndarray) -> float:
        x = z @ beta
        return float(wa @ np.logaddexp(0, -x) + wb @ np.logaddexp(0, x) + beta @ keep @ beta / 2)

    now = cost(beta)
    for _ in range(200):  # convex, and no step goes up: ends long before
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * ((wa + wb) * p * (1 - p))[:, None]) + keep, z.T @ (wa * (1 - p) - wb * p) - keep @ beta)
        if np.abs(step).max() < 1e-6:
            break
        while (then := cost(beta + step)) > now + 1e-12 and np.abs(step).max() >= 1e-9:
            step = step / 2
        beta, now = beta + step, then
    return beta


def _auc(score: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """The chance that a value of the load scores above one of the others; ties count half."""
    if not a.sum() or not b.sum():
        return 0.5
    own, at = np.unique(score.round(9), return_inverse=True)
    x, y = np.bincount(at, a, len(own)) / a.sum(), np.bincount(at, b, len(own)) / b.sum()
    return float(x @ (np.cumsum(y) - y / 2))


def taken_out(auc: Callable[[tuple[int, ...]], float], columns: int, limit: float, alone: list[float], near: float = 0.01) -> tuple[list[bool], list[float]]:
    """(shifted, lost) of each column by ablation: columns are taken out of the model until it tells the load from the others no better than `limit`.

    auc: discrimination of the best model of some columns or of some of these (a column of noise makes a
    small load's model worse). At each step goes the column without which the
    model is worst; of those within `near` of that, the one that tells most alone, as of two columns
    that each tell all neither is missed. A column is shifted if it had to go. lost: what the model
    lost as it went, or would lose if it went from those that stay.
    """
    left, shifted, lost = list(range(columns)), [False] * columns, [0.0] * columns
    while True:
        whole = auc(tuple(left)) if left else 0.5
        without = {j: auc(tuple(i for i in left if i != j)) if len(left) > 1 else 0.5 for j in left}
        if whole <= limit:
            for j, x in without.items():
                lost[j] = whole - x
            return shifted, lost
        worst = min(without.values())
        j = max((j for j in left if without[j] <= worst + near), key=lambda j: (alone[j], -without[j], -j))
        shifted[j], lost[j] = True, whole - without[j]
        left.remove(j)


def _array(pdf: pd.DataFrame, columns: int) -> np.ndarray:
    """place, fold, code, n to (columns, 2, CODES)."""
    out = np.zeros((columns, 2, CODES))
    np.add.at(out, (pdf["place"].to_numpy(int), pdf["fold"].to_numpy(int), pdf["code"].to_numpy(int)), pdf["n"].to_numpy(float))
    return out


def _alone(marked: DataFrame, pool: np.ndarray, ridge: float) -> DataFrame:
    """no, place, rows, alone and levels of each load's columns. levels: of each fold's model, the level of each code's score."""
    columns, design = len(pool), _design()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own, out = _array(pdf, columns), []
        for j in sorted(pdf["place"].unique()):
            pooled = pdf.loc[pdf["place"] == j, "pooled"].iloc[0]
            a, b = own[j], np.maximum(0, pool[j] - own[j]) if pooled else pool[j]
            there = np.flatnonzero(a.sum(axis=0) + b.sum(axis=0))
            z = design[there]
            scores = [design @ _logistic(z, a[f, there], b[f, there], ridge) for f in (0, 1)]
            alone = np.mean([_auc(scores[f][there], a[1 - f, there], b[1 - f, there]) for f in (0, 1)])
            out.append((pdf["no"].iloc[0], j, int(a.sum()), float(alone), np.digitize(scores, LEVELS).astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["no", "place", "rows", "alone", "levels"])

    spread = marked.repartition(2 * marked.sparkSession.sparkContext.defaultParallelism, "no")  # few bytes, but much work
    return spread.groupBy("no").applyInPandas(one, "no int, place int, rows bigint, alone double, levels binary")


def _limit(rows: Column, threshold: float, noise: float) -> Column:
    return F.greatest(F.lit(threshold), 0.5 + noise * F.sqrt(1 / (12 * F.greatest(rows, F.lit(1)))))


def load_shifts(df: DataFrame, load: str, rules: list[ColumnRule], *, threshold: float = 0.57, noise: float = 3.0, ridge: float = 1.0) -> DataFrame:
    """The loads in which a column can be told from what it is in the ordinary loads.

    Gives load, column_name, rows, alone (cross-fitted discrimination of a logistic regression that
    sees this column alone; 0.5: none, 1: complete), joint (of one that sees all columns), lost
    (what that model loses when this column is taken out, see taken_out) and shifted.

    A first round compares each load with all others by single columns, to find the ordinary ones. In
    the second, each load is compared with the ordinary ones by a joint model on the levels of the
    single columns' scores, and columns are taken out of it until it tells no more than a limit:
    `threshold` (some 2 * (threshold - 0.5) of the values are unlike) or `noise` standard errors of a
    load of its size, whichever is more. Those that had to go are shifted. More than TOGETHER rules
    are judged in groups of so many, in the order given.

    Rows count by their combination of codes. A load's models are a few hundred numbers; BLOCK loads'
    models at a time go over the ordinary rows' combinations where those lie, and what comes out are
    counts of levels, however many rows there are.
    """
    cells, loads = coded(df, load, rules)
    k = len(rules)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"c{i}").alias("code")) for i in range(k)])).alias("e")
    single = stored(cells.select("no", "fold", one, "n").groupBy("no", "e.place", "fold", "e.code").agg(F.sum("n").alias("n")))
    pooled = lambda rows: _array(rows.groupBy("place", "fold", "code").agg(F.sum("n").alias("n")).toPandas(), k)  # noqa: E731 - bounded by the codes
    limit = _limit(F.col("rows"), threshold, noise)
    first = stored(_alone(single.withColumn("pooled", F.lit(True)), pooled(single), ridge).select("no", "place", (F.col("alone") <= limit).alias("pooled")))
    marked = stored(joined(single, first, ["no", "place"]))
    second = stored(_alone(marked, pooled(marked.where("pooled")), ridge))
    ordinary = stored(first.groupBy("no").agg(F.bool_and("pooled").alias("pooled")))
    found = None
    for g in range(0, k, TOGETHER):
        part = _ablated(cells, second, ordinary, list(range(g, min(k, g + TOGETHER))), loads.count(), threshold, noise, ridge)
        found = part if found is None else found.unionByName(part)
    told = joined(joined(second.select("no", "place", "rows", "alone"), stored(found), ["no", "place"]), loads, "no")
    names = F.array(*[F.lit(r.column) for r in rules])
    return told.select(F.col("load").alias(load), names[F.col("place")].alias("column_name"), "rows", "alone", "joint", "lost", "shifted")


def _ablated(cells: DataFrame, models: DataFrame, ordinary: DataFrame, places: list[int], loads: int, threshold: float, noise: float, ridge: float) -> DataFrame:
    """no, place, joint, lost and shifted of these columns, by joint models on the levels of their scores."""
    k, codes, size = len(places), [f"c{j}" for j in places], (len(LEVELS) + 1) ** len(places)
    marked = joined(cells.select("no", "fold", *codes, "n"), ordinary, "no")
    rows = stored(marked.groupBy("no", "fold", *codes).agg(F.sum("n").alias("n")))
    combos = stored(marked.where("pooled").groupBy("fold", *codes).agg(F.sum("n").alias("n")))
    weights = (len(LEVELS) + 1) ** np.arange(k)
    schema = "no int, own boolean, model int, fold int, cell int, n double"
    sc, parts = cells.sparkSession.sparkContext, None
    for begin in range(1, loads + 1, BLOCK):
        block = models.where(F.col("no").between(begin, begin + BLOCK - 1) & F.col("place").isin(places)).select("no", "place", "levels").toPandas()  # at most BLOCK loads' models
        levels = np.zeros((BLOCK, k, 2, CODES), dtype=np.uint8)
        for r in block.itertuples():
            levels[r.no - begin, places.index(r.place)] = np.frombuffer(r.levels, dtype=np.uint8).reshape(2, CODES)
        held = sc.broadcast((levels, sorted(block["no"].unique())))

        def summed(total: np.ndarray, own: bool, first: int = begin) -> pd.DataFrame:
            at = np.nonzero(total)
            return pd.DataFrame({"no": (at[0] + first).astype(np.int32), "own": own, "model": at[1].astype(np.int32), "fold": at[2].astype(np.int32), "cell": at[3].astype(np.int32), "n": total[at]})

        def packed(table: np.ndarray, c: np.ndarray) -> np.ndarray:
            return sum(table[j][c[:, j]].astype(np.int64) * int(w) for j, w in enumerate(weights))

        def others(batches: Iterator[pd.DataFrame], first: int = begin, held=held) -> Iterator[pd.DataFrame]:
            levels, present = held.value
            total = np.zeros((BLOCK, 2, 2, size))
            for pdf in batches:
                c, fold, n = pdf[codes].to_numpy(int), pdf["fold"].to_numpy(int), pdf["n"].to_numpy(float)
                for no in present:
                    for f in (0, 1):
                        total[no - first, f] += np.bincount(packed(levels[no - first, :, f], c) + fold * size, n, 2 * size).reshape(2, size)
            yield summed(total, False)

        def own(batches: Iterator[pd.DataFrame], first: int = begin, held=held) -> Iterator[pd.DataFrame]:
            levels, _ = held.value
            total = np.zeros((BLOCK, 2, 2, size))
            for pdf in batches:
                for no, p in pdf.groupby("no"):
                    c, fold, n = p[codes].to_numpy(int), p["fold"].to_numpy(int), p["n"].to_numpy(float)
                    for f in (0, 1):
                        total[no - first, f] += np.bincount(packed(levels[no - first, :, f], c) + fold * size, n, 2 * size).reshape(2, size)
            yield summed(total, True)

        both = combos.mapInPandas(others, schema).unionByName(rows.where(F.col("no").between(begin, begin + BLOCK - 1)).mapInPandas(own, schema))
        both = stored(both.groupBy("no", "own", "model", "fold", "cell").agg(F.sum("n").alias("n")))
        parts = both if parts is None else parts.unionByName(both)

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, at = np.unique(pdf["cell"], return_inverse=True)
        counts = np.zeros((2, 2, 2, len(cell)))  # own, model, fold
        np.add.at(counts, (pdf["own"].to_numpy(int), pdf["model"].to_numpy(int), pdf["fold"].to_numpy(int), at), pdf["n"].to_numpy(float))
        a, b = counts[1], np.maximum(0, counts[0] - counts[1]) if pdf["pooled"].iloc[0] else counts[0]
        code = cell[:, None] // weights % (len(LEVELS) + 1)
        known: dict[tuple[int, ...], float] = {}

        def auc(which: tuple[int, ...]) -> float:
            if which not in known:
                own, first = np.unique(code[:, which], axis=0, return_inverse=True)
                first = first.reshape(-1)
                fold = lambda x: np.bincount(first, x, len(own))
                z = _one_hot(own)
                known[which] = float(np.mean([_auc(z @ _logistic(z, fold(a[f, f]), fold(b[f, f]), ridge), fold(a[f, 1 - f]), fold(b[f, 1 - f])) for f in (0, 1)]))
            return known[which]

        def best(which: tuple[int, ...]) -> float:
            return max(auc(t) for n in range(1, len(which) + 1) for t in combinations(which, n))

        limit = max(threshold, 0.5 + noise * (1 / (12 * max(1.0, a[0].sum()))) ** 0.5)
        shifted, lost = taken_out(best, k, limit, [auc((j,)) for j in range(k)])
        return pd.DataFrame({"no": pdf["no"].iloc[0], "place": places, "joint": auc(tuple(range(k))), "lost": lost, "shifted": shifted})

    if parts is None:
        parts = cells.sparkSession.createDataFrame([], schema)
    spread = joined(parts, ordinary, "no").repartition(2 * sc.defaultParallelism, "no")
    return spread.groupBy("no").applyInPandas(judged, "no int, place int, joint double, lost double, shifted boolean")
