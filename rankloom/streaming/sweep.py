"""The periodic sweep as a stream: every tick's state is compared with the last one, told and kept."""

from __future__ import annotations

import os
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.events import Limits, diff, slim, unchanged
from rankloom.sources.shared import file_system, replace, scope, stored
from rankloom.sources.sinks import EventLog, Snapshots


def whole_number(name: str, default: int) -> int:
    """A whole number out of the environment; the default where it is unset. Anything else raises."""
    return int(os.environ.get(name, default))


def record(ranked: DataFrame, ts: float, snapshots: Snapshots, log: EventLog, batch: int, limits: Limits = Limits()) -> DataFrame | None:
    """The events of a new state, which is kept and logged; None if nothing moved in rank or score."""
    cur = stored(slim(ranked))
    prev = snapshots.latest()
    if prev is not None and unchanged(prev, cur).first()[0]:
        return None
    found = None
    if prev is not None:
        found = stored(diff(prev, cur, ts, limits))
        if not found.isEmpty():
            log.append(found, batch)
    snapshots.save(cur, ts)
    return found


class Waiting:
    """Ticks that could not be recorded, whole, each under its number, to be taken up again in order."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def numbers(self) -> list[int]:
        fs, path = file_system(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("tick="))

    def put(self, batch: DataFrame, number: int) -> None:
        replace(batch, f"{self.folder}/tick={number}")

    def get(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tick={number}")

    def done(self, number: int) -> None:
        fs, path = file_system(self.spark, f"{self.folder}/tick={number}")
        fs.delete(path, True)


def sweep(states: DataFrame, snapshots: Snapshots, log: EventLog, checkpoint: str, *, order: str = "ts", tell: Callable[[DataFrame], object] | None = None, every: str | None = None, limits: Limits = Limits(), tries: int = 2) -> StreamingQuery:
    """states: a stream of ranked rows, each tick one file (read with maxFilesPerTrigger=1).

    A tick is recorded under its own time, so a batch that is run again replaces what it wrote; an
    empty batch does nothing. Where recording fails `tries` times, the error is printed and the tick
    is written to the folder `waiting` below the checkpoint's; the stream goes on. Waiting ticks are
    taken up again, in order, before each later one, which waits behind them if they fail again, as
    each state is compared with the one before. If even that write fails, the batch fails, and the
    stream's checkpoint takes it up again after a restart. An error in telling is printed: the tick
    is recorded, as is what there was to tell. every None: what is available now, then stop.
    """
    waiting = Waiting(states.sparkSession, f"{checkpoint.rstrip('/')}-waiting")

    def recorded(batch: DataFrame, number: int) -> bool:
        for left in range(tries - 1, -1, -1):
            try:
                ts = batch.agg(F.max(order)).first()[0]
                found = None if ts is None else record(batch.drop(order), float(ts), snapshots, log, number, limits)
                break
            except Exception:  # noqa: BLE001
                traceback.print_exc()
                if not left:
                    return False
        try:
            if tell and found is not None:
                tell(found)
        except Exception:  # noqa: BLE001
            traceback.print_exc()
        return True

    def one(batch: DataFrame, number: int) -> None:
        with scope(batch.sparkSession):
            for n in waiting.numbers():
                if n < number:
                    if not recorded(waiting.get(n), n):
                        break
                    waiting.done(n)
            if any(n < number for n in waiting.numbers()) or not recorded(batch, number):
                waiting.put(batch, number)
            else:
                waiting.done(number)

    writer = states.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
