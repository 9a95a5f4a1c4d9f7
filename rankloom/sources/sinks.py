"""Where states and events go: snapshots, an event log, channels, a JSON answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.events import EVENT, SOCIAL, slim
from rankloom.sources.shared import file_system, replace, stored

KEEP_SNAPSHOTS, KEEP_EVENTS = 300, 500


class Snapshots:
    """Slim states of a ranked table, one folder each, named by the time in milliseconds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def times(self) -> list[int]:
        fs, path = file_system(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("snapshot_ts="))

    def count(self) -> int:
        return len(self.times())

    def latest(self) -> DataFrame | None:
        """The newest state, or None if there is none or it cannot be read to its end.

        It is read once, into a stored table: a page that is broken shows here and not later on.
        """
        times = self.times()
        try:
            return stored(self.spark.read.parquet(f"{self.folder}/snapshot_ts={times[-1]}")) if times else None
        except Exception:  # noqa: BLE001 - as if there were none
            return None

    def save(self, ranked: DataFrame, ts: float, keep: int = KEEP_SNAPSHOTS) -> None:
        """Writes the state whole or not at all (again under the same time: in place of it), and drops all but the newest."""
        replace(slim(ranked), f"{self.folder}/snapshot_ts={int(ts * 1000)}")
        for old in self.times()[:-keep]:
            fs, path = file_system(self.spark, f"{self.folder}/snapshot_ts={old}")
            fs.delete(path, True)


def retained(df: DataFrame, snapshot: str, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """The rows of the newest `keep` snapshots of a table that has many: those are found among the distinct ids."""
    newest = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().orderBy(F.col(snapshot).desc()).limit(keep)
    return df.join(F.broadcast(newest), snapshot, "left_semi")  # keep rows


class EventLog:
    """Appended batches of events, newest first on reading. What is beyond the newest `keep` events is deleted."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = KEEP_EVENTS):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _batches(self) -> list[int]:
        fs, path = file_system(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n.split("=")[1]) for n in names if n.startswith("batch=")), reverse=True)

    def append(self, events: DataFrame, batch: int) -> None:
        """A batch under its number: written again, it takes its own place. Of a batch longer than `keep` the first by ord stay."""
        replace(events, f"{self.folder}/batch={batch}")
        self._truncate()

    def _truncate(self) -> None:
        """Batches are looked at from the newest on; as none is empty, no more than `keep` of them stay."""
        room = self.keep
        for b in self._batches():
            path = f"{self.folder}/batch={b}"
            if room > 0:
                n = (rows := self.spark.read.parquet(path)).count()
                if n > room:
                    replace(stored(rows.orderBy("ord").limit(room)), path)
                room -= n
            else:
                fs, p = file_system(self.spark, path)
                fs.delete(p, True)

    def read(self, since: float | None = None, limit: int | None = 50, keep: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.parquet(self.folder)
        except Exception:  # noqa: BLE001 - nothing was ever written
            return self.spark.createDataFrame([], f"batch int, ord int, {EVENT}")
        return feed(rows, since, limit, self.keep if keep is None else keep)


def feed(log: DataFrame, since: float | None, limit: int | None, keep: int = KEEP_EVENTS) -> DataFrame:
    """The newest `keep` events, of those the ones after `since` (a missing time is 0), of those the first `limit` as Python cuts."""
    from rankloom.operators.views import first_rows

    order = [F.col("batch").desc(), F.col("ord").asc()]
    rows = log.orderBy(*order).limit(keep)
    if since is not None:
        rows = rows.where(F.coalesce("ts", F.lit(0.0)) > since)
    rows = rows.orderBy(*order)
    return rows if limit is None else first_rows(rows, limit)


def dispatch(events: DataFrame, log: Callable[[str], object], channels: list[Callable[[dict], object]]) -> int:
    """Every headline to log, in order, and those of social types to all channels. A tick's events, streamed one by one."""
    n = 0
    for row in events.orderBy("ord").toLocalIterator():
        log(row["headline"])
        n += 1
        if row["type"] in SOCIAL:
            for send in channels:
                send(row.asDict())
    return n


def _json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def models_pieces(ranked: DataFrame, weights: dict[str, float], ages: dict[str, float | None]) -> Iterator[str]:
    """The JSON answer for a ranked table, piece by piece: rows in order of rank; ages in whole seconds.

    One partition after the other comes to the driver, so what is sent on as it comes needs no more room than that.
    """
    n = 0
    yield '{"models": ['
    for r in _json(ranked.orderBy("rank")).toLocalIterator():
        yield (", " if n else "") + r[0]
        n += 1
    yield f'], "count": {n}, "weights": {json.dumps(weights)}, "ages": {json.dumps({k: None if a is None else round(a) for k, a in ages.items()})}}}'


def models_answer(ranked: DataFrame, weights: dict[str, float], ages: dict[str, float | None]) -> str:
    """models_pieces as one text, for an index of a size that one answer can have."""
    return "".join(models_pieces(ranked, weights, ages))


def write_models(ranked: DataFrame, weights: dict[str, float], ages: dict[str, float | None], folder: str) -> None:
    """The same answer for an index of any size: folder/models has its rows as JSON lines, folder/head the rest."""
    _json(ranked).write.text(f"{folder}/models")
    head = ranked.agg(F.count("*").alias("count")).withColumns({"weights": F.from_json(F.lit(json.dumps(weights)), "map<string,double>"), "ages": F.from_json(F.lit(json.dumps(ages)), "map<string,double>")})
    _json(head.withColumn("ages", F.transform_values("ages", lambda _, a: F.rint(a).cast("bigint")))).write.text(f"{folder}/head")


def error_answer(error: Exception) -> str:
    return json.dumps({"error": str(error), "models": []})


def news_answer(events: DataFrame, snapshots: int, period: int) -> str:
    """The JSON answer for what EventLog.read gives: no more events than the log keeps."""
    rows = [json.loads(r[0]) for r in _json(events).collect()]
    return json.dumps({"events": rows, "snapshots": snapshots, "poll_interval": period})
