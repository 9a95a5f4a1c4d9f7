"""The model index as a service: what a web front end or a scheduled job calls."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.operators.entity import Sides, lookup_by_text, merged
from rankloom.operators.score import MODEL_SIGNALS, MODEL_WEIGHTS, leaderboard, parse_weights
from rankloom.sources.readers import Kept
from rankloom.sources.shared import scope
from rankloom.sources.sinks import EventLog, Snapshots, dispatch, error_answer, models_answer, news_answer
from rankloom.streaming.sweep import record, whole_number


class ModelIndex:
    """readers: how to read 'hub', 'usage' and 'arena' anew; what they give is kept for ttl seconds under folder.

    period: seconds between sweeps; None: RANKLOOM_POLL_SECONDS, or six hours.
    """

    def __init__(self, spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], folder: str, sides: Sides, *, ttl: float = 3600, period: int | None = None, clock: Callable[[], float] = time.time):
        folder, period = folder.rstrip("/"), whole_number("RANKLOOM_POLL_SECONDS", 6 * 3600) if period is None else period
        self.spark, self.readers, self.sides, self.ttl, self.period, self.clock = spark, readers, sides, ttl, period, clock
        self.kept, self.snapshots, self.log = Kept(spark, f"{folder}/kept", clock), Snapshots(spark, f"{folder}/states"), EventLog(spark, f"{folder}/events")
        self.channels: list[Callable[[dict], object]] = []

    def unified(self, force: bool = False) -> DataFrame:
        hub, usage, arena = (self.kept.fetched(k, self.readers[k], self.ttl, force) for k in ("hub", "usage", "arena"))
        ratings = lookup_by_text(arena, "name", "elo", "at").withColumnRenamed("elo", self.sides.rating)
        return merged(usage, hub, ratings, self.sides, primary_ordinal="usage_rank", secondary_ordinal="ordinal")

    def sweep(self, say: Callable[[str], object] = print) -> int:
        """Reads all sources anew, keeps the state by the usual weights, tells what moved; gives the number of events."""
        ts = self.clock()
        with scope(self.spark):
            found = record(leaderboard(self.unified(force=True)), ts, self.snapshots, self.log, int(ts * 1000))
            return 0 if found is None else dispatch(found, say, self.channels)

    def models(self, weights: str | None = None, refresh: bool = False) -> tuple[int, str]:
        """(status, JSON) of all models by these weights. A failed sweep does not hinder the answer, a failed source does."""
        chosen = parse_weights(weights)
        try:
            if refresh:
                try:
                    self.sweep()
                except Exception as e:  # noqa: BLE001
                    print(f"sweep failed: {e}")
            with scope(self.spark):
                rows = self.unified()
                return 200, models_answer(leaderboard(rows, MODEL_SIGNALS, chosen), {**MODEL_WEIGHTS, **(chosen or {})}, {k: self.kept.age(k) for k in self.readers})
        except Exception as e:  # noqa: BLE001
            return 502, error_answer(e)

    def news(self, since: float | None = None, limit: int = 50) -> str:
        with scope(self.spark):
            return news_answer(self.log.read(since, limit), self.snapshots.count(), self.period)
