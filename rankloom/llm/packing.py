"""Filling containers of fixed capacity with items of varying size, by windows of several lengths.

Every item is routed to the smallest window it fits, of the lengths in `tiers` and the capacity. From
the longest tier down, a tier's items, larger ones first, fill the gaps of longer windows (best fit,
the longest first), then those of open windows of their own length, then new ones. So a long window's
gap takes from the shorter tiers, and what is left of a tier has windows of its own length. Windows
are then folded into containers, again larger ones first and best fit; where each length divides the
next nothing is lost by that. At last containers are dealt to groups (steps) so that the groups'
costs, the sums of squared sizes of items, come out even.

All of this is done on the counts of each size, of which there are at most as many as the capacity,
so a plan takes no longer for more items; windows filled alike are one pattern with a number. Items
then find their window by their number among the items of their size, windows their container.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tokens import FOLDER, VOCABULARY, ordinals, token_count
from rankloom.sources.shared import stored

_NUMBERS = 2**40


@dataclass
class Pattern:
    """`times` windows of length `window`, each with as many items of each size."""

    sizes: dict[int, int]
    window: int
    times: int

    @property
    def cost(self) -> int:
        return sum(n * s * s for s, n in self.sizes.items())


class _Gaps:
    """Open windows of one length, by the room that is left."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.at: dict[int, list[Pattern]] = {}

    def put(self, p: Pattern, room: int) -> None:
        if room not in self.at:
            self.at[room] = []
            bisect.insort(self.rooms, room)
        self.at[room].append(p)

    def take(self, size: int) -> tuple[Pattern, int] | None:
        """Of the windows with the least room that is enough, one pattern."""
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        p = self.at[room].pop()
        if not self.at[room]:
            del self.at[room], self.rooms[i]
        return p, room


def plan(counts: dict[int, int], capacity: int, tiers: list[int]) -> list[Pattern]:
    """Patterns of windows that hold all items of `counts` (size: number). tiers: lengths of windows, ascending, the last the capacity."""
    gaps = {w: _Gaps() for w in tiers}
    for size in sorted((s for s, n in counts.items() if n and s > 0), reverse=True):
        left, own = counts[size], tiers[bisect.bisect_left(tiers, size)]
        for w in [w for w in reversed(tiers) if w >= own]:
            while left and (found := gaps[w].take(size)):
                p, room = found
                each = min(room // size, left)
                n = min(p.times, left // each)
                if n < p.times:
                    gaps[w].put(Pattern(dict(p.sizes), w, p.times - n), room)
                gaps[w].put(Pattern(p.sizes | {size: p.sizes.get(size, 0) + each}, w, n), room - each * size)
                left -= n * each
        each = own // size
        if n := left // each:
            gaps[own].put(Pattern({size: each}, own, n), own - each * size)
        if rest := left % each:
            gaps[own].put(Pattern({size: rest}, own, 1), own - rest * size)
    return [p for g in gaps.values() for ps in g.at.values() for p in ps]


def _lookups(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(items, windows, containers): where items of a size lie, where windows of a length lie, and how many containers there are.

    items: for each run of numbers among the items of a size, its key (size and first number), first
    number, items a window, length, first window. windows: for each run of numbers among the windows
    of a length, its key, first number, first container. Windows of a length are numbered by falling
    cost. The windows of a length that share a container are far apart in that order, so costly ones
    meet cheap ones.
    """
    patterns = sorted(patterns, key=lambda p: (p.window, -p.cost, sorted(p.sizes.items())))
    used: dict[int, int] = {}
    items, runs, count = [], {}, {}
    for p in patterns:
        first = count.get(p.window, 0)
        for size, each in p.sizes.items():
            begin = used.get(size, 0)
            items.append((size * _NUMBERS + begin, begin, each, p.window, first))
            used[size] = begin + each * p.times
        runs.setdefault(p.window, []).append((first, p.cost))
        count[p.window] = first + p.times
    folds = plan(count, capacity, [capacity])
    kinds, at = [], dict.fromkeys(count, 0)
    for f in folds:  # f.times containers alike in their windows' lengths; slot k of a length takes f.times windows that follow each other
        slots = [(w, at[w] + k * f.times) for w, n in f.sizes.items() for k in range(n)]
        for w, n in f.sizes.items():
            at[w] += n * f.times
        cuts = sorted({0, f.times} | {b - begin for w, begin in slots for b, _ in runs[w] if 0 < b - begin < f.times})
        for a, b in zip(cuts, cuts[1:]):
            cost = sum(runs[w][bisect.bisect_right(runs[w], (begin + a, float("inf"))) - 1][1] for w, begin in slots)
            kinds.append((-cost, b - a, [(w, begin + a) for w, begin in slots]))
    kinds.sort()
    windows, first = [], 0
    for _, times, slots in kinds:
        windows += [(w * _NUMBERS + begin, begin, first) for w, begin in slots]
        first += times
    return np.array(sorted(items), dtype="int64").reshape(-1, 5), np.array(sorted(windows), dtype="int64").reshape(-1, 3), first


def packed(df: DataFrame, key: str, text: str, *, capacity: int = 4096, tiers: tuple[int, ...] = (512, 1024, 2048), group: int = 8, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, part, first_token, tokens, tier, window, window_id, container_id and step of every item.

    An item is a whole text, unless it alone has more than `capacity` tokens: then it is cut into
    parts of the capacity and a rest, which is an item like others. key must identify a row. tier is
    the length of window that the item was routed to, window that of the window it lies in (longer,
    where it fills a gap); windows of a length and containers are numbered from 0 by falling cost. A
    null or empty text has one row without tokens, window, container, tier and step. An empty table
    gives an empty result; other columns are ignored.
    """
    lengths = sorted({t for t in tiers if 0 < t < capacity} | {capacity})
    sized = stored(df.select(F.col(key).alias("k"), token_count(F.col(text), folder, vocabulary).alias("n")))
    parts = F.when(F.col("n") > 0, F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    items = sized.select("k", "n", F.explode(parts).alias("part")).select("k", "part", (F.col("part").cast("bigint") * capacity).alias("first"), F.least(F.lit(capacity), F.col("n") - F.col("part").cast("bigint") * capacity).cast("int").alias("size"))
    counts = {r.size: r.n for r in items.groupBy("size").agg(F.count("*").alias("n")).collect() if r.size}  # at most `capacity` sizes
    *tables, total = _lookups(plan(counts, capacity, lengths), capacity)
    steps = max(1, -(-total // group))
    sc = df.sparkSession.sparkContext.broadcast(tables)  # patterns x sizes or lengths in them: bounded by the capacity

    @F.pandas_udf("struct<window int, window_id bigint, container bigint>")
    def place(size: pd.Series, number: pd.Series) -> pd.DataFrame:
        items, windows = sc.value
        if not len(items):
            return pd.DataFrame({"window": np.zeros(len(size), dtype="int32"), "window_id": np.zeros(len(size), dtype="int64"), "container": np.zeros(len(size), dtype="int64")})
        find = lambda table, a, b: table[np.clip(np.searchsorted(table[:, 0], a * _NUMBERS + b, side="right") - 1, 0, None)]
        number = number.to_numpy(dtype="int64")
        i = find(items, size.to_numpy(dtype="int64"), number)
        w, j = i[:, 3], i[:, 4] + (number - i[:, 1]) // i[:, 2]
        c = find(windows, w, j)
        return pd.DataFrame({"window": w.astype("int32"), "window_id": j, "container": c[:, 2] + j - c[:, 1]})

    numbered = ordinals(items, ["size"], ["k", "part"], "o", rows=sum(counts.values())).withColumn("p", place("size", "o"))
    there = F.col("size") > 0
    c = F.col("p.container")
    turn, at = F.floor(c / steps), F.pmod(c, F.lit(steps))
    limits = F.array(*[F.lit(t) for t in lengths])
    tier = F.element_at(F.filter(limits, lambda t: t >= F.col("size")), 1)
    return numbered.select(
        F.col("k").alias(key), "part", F.col("first").alias("first_token"), F.col("size").alias("tokens"), *[F.when(there, x).alias(n) for x, n in ((tier, "tier"), (F.col("p.window"), "window"), (F.col("p.window_id"), "window_id"), (c, "container_id"))],
        F.when(there, F.when(turn % 2 == 0, at).otherwise(steps - 1 - at)).cast("bigint").alias("step"),
    )


def cut_items(items: DataFrame, key: str) -> DataFrame:
    """key of the items of what `packed` gives that lie in several containers."""
    return items.groupBy(key).agg(F.min("container_id").alias("first"), F.max("container_id").alias("last")).where("first < last").select(key)


def fill(items: DataFrame) -> DataFrame:
    """window, windows, items, from_shorter_tiers (items in gaps), tokens and filled (share of the room) by length of window of what `packed` gives."""
    each = items.where("container_id is not null").groupBy("window", "window_id").agg(F.count("*").alias("items"), F.count_if(F.col("tier") < F.col("window")).alias("from_shorter_tiers"), F.sum("tokens").alias("tokens"))
    return each.groupBy("window").agg(F.count("*").alias("windows"), *[F.sum(c).alias(c) for c in ("items", "from_shorter_tiers", "tokens")], (F.sum("tokens") / (F.count("*") * F.col("window"))).alias("filled"))


def totals(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: items, tokens, containers, least_containers (what the tokens need at least), fullest (most tokens in one), steps, least_cost and most_cost of a step (sum of squared sizes)."""
    there = items.where("container_id is not null")
    each = there.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.first("step").alias("step"), F.sum(F.col("tokens").cast("bigint") * F.col("tokens")).alias("cost"))
    steps = each.groupBy("step").agg(F.count("*").alias("containers"), *[F.sum(c).alias(c) for c in ("items", "tokens", "cost")], F.max("tokens").alias("fullest"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return steps.agg(n("items").alias("items"), n("tokens").alias("tokens"), n("containers").alias("containers"), F.ceil(n("tokens") / capacity).alias("least_containers"), F.max("fullest").alias("fullest"), F.count("*").alias("steps"), F.min("cost").alias("least_cost"), F.max("cost").alias("most_cost"))
