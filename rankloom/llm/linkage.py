"""Matching by soft logic: a hinge-loss problem over candidate links, solved by alternating directions.

Each candidate link is a variable in [0, 1]. Rules pull it up to, or hold it below, a truth value
that the caller computes from similarities, at a cost of weight * distance. Exclusivity: the links of
one left entity sum to at most 1. Transitivity: left entities of one group (known to be the same)
should agree on each right entity, at a cost of weight / 2 * squared distance from their mean. The
problem is convex; its solution is the confidence of each link.

Every rule, and each of the two constraints, keeps a copy of the variables it touches. A round sets
each copy by a closed form, averages the copies, and moves the multipliers. As no rule reaches
across groups, the problem falls apart into groups; these are spread by hash over as many blocks as
keep a block small, and all groups of a block are solved together, as arrays. Each group goes on until
its own variables and copies stand still, so what shares its block has no effect on it.

In a group of many links, left entities whose links are all alike are one with a number, and so
are right entities: exchanged for each other they leave the problem as it is, and as its solution is
unique their values are equal. A group that is too large for a task even so is solved by the same
rounds over tables, spread by link.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.sources.shared import drop, joined, stored

BLOCK_LINKS = 40_000
#: In groups of more links, alike entities are one.
MANY_LINKS = 500
#: Most links, after that, of a group that is solved in a task.
TASK_LINKS = 400_000
#: A group stands still when nothing in it moves by more than CLOSE in a round; ROUNDS ends what does not, and says so.
CLOSE, ROUNDS = 1e-6, 50_000
#: How much a copy that is apart from its variable costs: it changes how fast values stand still, not which.
STEP = 3.0
#: Of solutions that cost the same, the one nearest to one half: what a unit of half the squared distance from it costs.
HOLD = 0.05
#: Rounds between two looks.
LOOK = 10


@dataclass(frozen=True)
class Rule:
    """truth: Column in [0, 1]. pulls: at least truth is wanted; otherwise at most 1 - truth."""

    truth: Column
    weight: float
    pulls: bool = True


def solve(truth: np.ndarray, weight: np.ndarray, pulls: np.ndarray, left: np.ndarray, same: np.ndarray, agree: float, group: np.ndarray | None = None, rounds: int = ROUNDS, step: float = STEP, close: float = CLOSE, hold: float = HOLD, lefts: np.ndarray | None = None, rights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether it converged) of each link. lefts, rights: how many left and right entities that are alike it stands for.

    truth: (links, rules). left, same, group: codes 0... of each link's left entity, of its (group,
    right entity), and of its group (None: all are one).
    """
    n, r = truth.shape
    value, settled = np.full(n, 0.5), np.zeros(n, dtype=bool)
    if not n:
        return value, settled
    at = np.argsort(np.zeros(n) if group is None else group, kind="stable")  # links still open, by group
    code = np.zeros(n, dtype=int) if group is None else group[at]
    bound, left, same = np.where(pulls, truth, 1 - truth)[at], left[at], same[at]
    m, o = (np.ones(n) if c is None else c[at].astype(float) for c in (lefts, rights))
    move = weight / step
    x, dual = np.full(n, 0.5), np.zeros((n, r + 2))
    for k in range(1, rounds + 1):
        if k == 1 or k % LOOK == 1:  # what is open has changed, or may have
            left, same = (np.unique(c, return_inverse=True)[1] for c in (left, same))
            size_l, size_s = np.bincount(left, o)[left], np.bincount(same, m)[same]
        v = x[:, None] - dual
        h = v[:, :r]
        up = np.where(h >= bound, h, np.minimum(h + move, bound))
        down = np.where(h <= bound, h, np.maximum(h - move, bound))
        own, mean = v[:, r], np.bincount(same, m * v[:, r + 1])[same] / size_s
        z = np.empty_like(dual)
        z[:, :r] = np.where(pulls, up, down)
        z[:, r] = own - np.maximum(0, (np.bincount(left, o * own)[left] - 1) / size_l)
        z[:, r + 1] = (step * v[:, r + 1] + agree * mean) / (step + agree)
        new = np.clip((step * (z + dual).sum(axis=1) + hold / 2) / (step * (r + 2) + hold), 0, 1)
        dual += z - new[:, None]
        if k % LOOK and k < rounds:
            x = new
            continue
        moved = np.maximum(np.abs(new - x), np.abs(z - new[:, None]).max(axis=1))
        x = new
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        still = np.repeat(np.maximum.reduceat(moved, starts) < close, np.diff(np.r_[starts, len(code)]))
        value[at[still]], settled[at[still]] = x[still], True
        if still.any():
            x, dual, bound, left, same, code, at, m, o = (y[~still] for y in (x, dual, bound, left, same, code, at, m, o))
        if not len(at):
            break
    value[at] = x
    return value, settled


def solve_wide(rows: DataFrame, names: list[str], rules: list[Rule], agree: float, rounds: int = ROUNDS, step: float = STEP, close: float = CLOSE, hold: float = HOLD) -> DataFrame:
    """l, r, confidence and converged of the links of groups that no task can hold: solve's rounds, each two aggregations over the links.

    rows: l, r, g, the truths, m and o (solve's lefts and rights).

    All links go on until all stand still. Every round is stored, so an executor that is lost costs that round.
    """
    state = stored(rows.withColumns({"x": F.lit(0.5), "dual": F.array_repeat(F.lit(0.0), len(rules) + 2), "moved": F.lit(1.0)}))
    with_sums = lambda df, keys, c, weight, out: df.join(df.groupBy(*keys).agg(F.sum(F.col(c) * F.col(weight)).alias(out), F.sum(weight).alias(f"n_{out}")), keys)
    done = False
    for k in range(1, rounds + 1):
        v = [F.col("x") - F.col("dual")[i] for i in range(len(rules) + 2)]
        wide = with_sums(state.withColumns({"v_own": v[-2], "v_same": v[-1]}), ["g", "l"], "v_own", "o", "sum")
        wide = with_sums(wide, ["g", "r"], "v_same", "m", "mean")
        z = []
        for rule, h, name in zip(rules, v, names):
            bound, m = (F.col(name) if rule.pulls else 1 - F.col(name)), rule.weight / step
            z.append(F.when(h >= bound, h).otherwise(F.least(h + m, bound)) if rule.pulls else F.when(h <= bound, h).otherwise(F.greatest(h - m, bound)))
        z.append(v[-2] - F.greatest(F.lit(0.0), (F.col("sum") - 1) / F.col("n_sum")))
        z.append((step * v[-1] + agree * F.col("mean") / F.col("n_mean")) / (step + agree))
        mean = (step * sum((a + F.col("dual")[i] for i, a in enumerate(z)), F.lit(0.0)) + hold / 2) / (step * len(z) + hold)
        wide = wide.withColumns({"z": F.array(*z), "new": F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))})
        apart = F.transform("z", lambda a: a - F.col("new"))
        moved = F.greatest(F.abs(F.col("new") - F.col("x")), F.array_max(F.transform(apart, F.abs)))
        before, state = state, stored(wide.select("l", "r", "g", *names, "m", "o", F.col("new").alias("x"), F.zip_with("dual", apart, lambda d, a: d + a).alias("dual"), moved.alias("moved")))
        drop(before)
        if k % LOOK == 0 and (state.agg(F.max("moved")).first()[0] or 0.0) < close:
            done = True
            break
    return state.select("l", "r", F.col("x").alias("confidence"), F.lit(done).alias("converged"))


def alike(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (l, r, g, truths) with a, b, m and o: the class of each link's left and right entity, and how many are in it.

    Two left entities of a group are alike if they have the same links with the same truths. That is
    told by the number of links and two digests of all of them, which fold on the map side.
    """
    said = F.struct(*names)
    for own, other, out, n in (("l", "r", "a", "m"), ("r", "l", "b", "o")):
        links = [F.bit_xor(F.xxhash64(*([F.lit(seed), F.col(other)] if seed else [F.col(other)]), said)) for seed in ("", "again")]
        one = rows.groupBy("g", own).agg(F.xxhash64("g", F.count("*"), *links).alias(out))
        size = one.groupBy("g", out).agg(F.count("*").alias(n))
        rows = rows.join(one.join(size, ["g", out]), ["g", own])
    return rows


def match(links: DataFrame, left: str, right: str, group: str, rules: list[Rule], *, agree: float = 1.0, many_links: int = MANY_LINKS, task_links: int = TASK_LINKS) -> DataFrame:
    """left, right, confidence and converged of every candidate link.

    converged: the value stands still up to CLOSE. links has one row per candidate: repeated rows are
    taken as one. Null truths count as 0, links with a null id are left out, a null group is the left
    entity's own. An empty table gives an empty result; other columns are ignored.
    """
    own = F.coalesce(F.col(group).cast("string"), F.col(left).cast("string"))
    truths = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r.truth.cast("double"), F.lit(0.0)))).cast("float").alias(f"t{i}") for i, r in enumerate(rules)]
    names = [f"t{i}" for i in range(len(rules))]
    rows = links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("l"), F.col(right).alias("r"), F.xxhash64(own).alias("g"), *truths)
    rows = stored(rows.groupBy("l", "r", "g").agg(*[F.max(t).alias(t) for t in names]))
    weight, pulls = np.array([r.weight for r in rules]), np.array([r.pulls for r in rules])

    def solved(links: DataFrame, many: bool) -> DataFrame:
        """l, r, confidence and converged of the links, whole groups a block. many: with m and o."""

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            l, g = (pd.factorize(pdf[c])[0] for c in "lg")
            s = pdf.groupby(["g", "r"], sort=False).ngroup().to_numpy()
            value, settled = solve(pdf[names].to_numpy(float), weight, pulls, l, s, agree, g, **({"lefts": pdf["m"].to_numpy(), "rights": pdf["o"].to_numpy()} if many else {}))
            return pd.DataFrame({"l": pdf["l"], "r": pdf["r"], "confidence": value, "converged": settled})

        kinds, blocks = dict(links.dtypes), max(1, math.ceil(links.count() / BLOCK_LINKS))
        return links.withColumn("block", F.pmod("g", F.lit(blocks))).groupBy("block").applyInPandas(one, f"l {kinds['l']}, r {kinds['r']}, confidence double, converged boolean")

    def groups(links: DataFrame, most: int) -> DataFrame:
        return stored(links.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("g"))

    large = groups(rows, many_links)
    if large.isEmpty():
        found = solved(rows, False)
    else:
        every = stored(alike(joined(rows, large, "g", "left_semi"), names))
        each = stored(every.groupBy("g", "a", "b").agg(*[F.max(c).alias(c) for c in (*names, "m", "o")]).withColumnsRenamed({"a": "l", "b": "r"}))
        wide = groups(each, task_links)
        values = solved(joined(each, wide, "g", "left_anti"), True)
        if not wide.isEmpty():
            values = values.union(solve_wide(joined(each, wide, "g", "left_semi"), names, rules, agree))
        values = stored(values.withColumnsRenamed({"l": "a", "r": "b"}))
        found = solved(joined(rows, large, "g", "left_anti"), False).union(joined(every, values, ["a", "b"]).select("l", "r", "confidence", "converged"))
    return found.withColumnsRenamed({"l": left, "r": right})
