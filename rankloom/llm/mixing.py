"""Mixing sources to target shares of the tokens, by entropy balancing.

Every document gets a rate, the expected number of its copies. Of all rates that give each source
its target tokens and none more than its most repeats, those nearest (in relative entropy) to one
copy each are exponentially tilted: rate = min(repeats, exp(lambda * tokens)), with one lambda a
source. The lambdas solve a convex dual, by Newton steps: each is one aggregation over the counts of
(source, size), and gives three numbers a source. Rates become copies by an even rounding: along the
documents of a source in order of size, the copies add up to the rates' sum within one at every place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.tokens import FOLDER, VOCABULARY, ordinals, token_count
from rankloom.sources.shared import joined, stored


def _rate(tilt: dict[str, float], most: dict[str, float], scale: float) -> Column:
    flat = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    top = flat(most)[F.col("source")]
    return F.when(F.col("tokens") > 0, F.least(top, F.exp(F.least(F.lit(700.0), flat(tilt)[F.col("source")] * F.col("tokens") / scale)))).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Balance:
    """tilt: the lambda of each source, times scale. short: sources all of whose documents are at their most repeats, and that still miss their target. converged: all others meet it."""

    tilt: dict[str, float]
    scale: float
    short: frozenset[str]
    converged: bool


def balanced(counts: DataFrame, targets: dict[str, float], most: dict[str, float], *, rounds: int = 500, close: float = 1e-7) -> Balance:
    """Solves the dual. counts: source, tokens, n.

    It starts where even a document of one token is at its most repeats: the sum there is all that a
    source can give, and one that misses its target even so stays there. For the others the sums have
    a root below, between bounds that each step narrows; a Newton step that leaves the bounds is
    replaced by their middle. A target of 0 has its root at the least tilt.
    """
    total = counts.agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).first()
    scale = max(1.0, (total.t or 0) / max(1, total.n or 0))
    high = {s: scale * (math.log(max(most[s], 1.0)) + 1) for s in targets}
    low = {s: -700.0 * scale for s in targets}
    tilt = {s: high[s] if t > 0 else low[s] for s, t in targets.items()}
    open_, short, first = {s for s, t in targets.items() if t > 0}, set(), True
    for _ in range(rounds):
        if not open_:
            break
        top = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("source")]
        got, free = F.col("n") * F.col("tokens") * F.col("r"), (F.col("tokens") > 0) & (F.col("r") < top)
        rows = counts.where(F.col("source").isin(sorted(open_))).withColumn("r", _rate(tilt, most, scale)).groupBy("source")
        sums = {r.source: r for r in rows.agg(F.sum(got).alias("f"), F.sum(F.when(free, got * F.col("tokens") / scale).otherwise(0.0)).alias("d"), F.count_if(free).alias("free")).collect()}  # a row a source
        for s in sorted(open_):
            f, d, free_ = (sums[s].f, sums[s].d, sums[s].free) if s in sums else (0.0, 0.0, 0)
            miss = f - targets[s]
            if first and not free_ and miss < 0:
                short.add(s)
                open_.discard(s)
                continue
            if abs(miss) <= close * targets[s]:
                open_.discard(s)
                continue
            (high if miss > 0 else low)[s] = tilt[s]
            if first:  # from the untilted rates on
                tilt[s] = 0.0 if low[s] < 0.0 < high[s] else (low[s] + high[s]) / 2
                continue
            step = tilt[s] - miss / d if d > 0 else math.nan
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-13 * scale:  # as near as numbers allow
                open_.discard(s)
        first = False
    return Balance(tilt, scale, frozenset(short), not open_)


def mixed(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, *, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, report): copies has key, source, tokens, rate and copies of every document of a listed source.

    report has, of every listed source: target_share, max_repeats, own_tokens, target_tokens,
    mixed_tokens, reached_share, documents, copies, falls_short (with all its documents at their most
    repeats the solution still misses the target) and converged (the solution meets all other targets). The mix is to hold as many tokens as the documents of all listed sources
    together. targets lists few sources, as it comes to the driver; rows with a null source or share
    are left out, of a source listed twice the first in order of share holds, a null max_repeats is
    no limit. Documents of other sources or of none have no part in the mix; null and empty texts
    have 0 copies. Where the shares do not add up to 1, reached_share is still of the whole mix.
    """
    spark = df.sparkSession
    listed: dict[str, tuple[float, float]] = {}
    for r in targets.where("source is not null and target_share is not null").orderBy("source", "target_share", "max_repeats").collect():
        listed.setdefault(r.source, (float(r.target_share), float(2**31 if r.max_repeats is None else r.max_repeats)))
    docs = df.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t")).where(F.col("source").isin(sorted(listed)))
    sized = stored(docs.select("k", "source", token_count(F.col("t"), folder, vocabulary).alias("tokens")))
    counts = stored(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    own = {s: 0 for s in listed} | {r.source: int(r.own) for r in counts.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("own")).collect()}
    total = sum(own.values())
    goal, most = {s: share * total for s, (share, _) in listed.items()}, {s: m for s, (_, m) in listed.items()}
    found = balanced(counts, goal, most)
    rate = _rate(found.tilt, most, found.scale) if listed else F.lit(0.0)
    rows = counts.agg(F.sum("n")).first()[0] or 0
    # A source's documents stand in a line by size; copies are the whole numbers that the rates' sum passes at each.
    before = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)  # a row for each size
    starts = stored(counts.withColumn("rate", rate).select("source", "tokens", "rate", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)).alias("start")))
    even = joined(ordinals(sized, ["source", "tokens"], ["k"], "o", rows=rows), starts, ["source", "tokens"])
    passed = lambda o: F.floor(F.col("start") + o * F.col("rate"))
    copies = even.select(F.col("k").alias(key), "source", "tokens", "rate", (passed(F.col("o") + 1) - passed(F.col("o"))).cast("bigint").alias("copies"))
    got = copies.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"))
    lines = [(s, share, None if m == 2**31 else int(m), own[s], goal[s], s in found.short, found.converged) for s, (share, m) in listed.items()]
    report = spark.createDataFrame(lines, "source string, target_share double, max_repeats int, own_tokens bigint, target_tokens double, falls_short boolean, converged boolean").join(got, "source", "left")
    mix = F.coalesce("mixed_tokens", F.lit(0))
    whole = F.sum(mix).over(Window.partitionBy(F.lit(0)))  # of the listed sources, a row each
    report = report.select(
        "source", "target_share", "max_repeats", "own_tokens", "target_tokens", mix.alias("mixed_tokens"), F.try_divide(mix, whole).alias("reached_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), "falls_short", "converged",
    )
    return copies, report
