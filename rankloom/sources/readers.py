"""Readers of the three sources, with declared schemas, and a store that keeps what was read for a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import filled, to_number, to_price
from rankloom.sources.shared import file_system, replace

HUB = "id string, modelId string, downloads bigint, likes bigint, createdAt string, tags array<string>"
USAGE = (
    "data array<struct<id: string, name: string, hugging_face_id: string, context_length: bigint, pricing: struct<prompt: string, completion: string>,"
    " benchmarks: struct<artificial_analysis: struct<intelligence_index: double, coding_index: double, agentic_index: double>, design_arena: array<struct<elo: double, win_rate: double>>>>>"
)


def hub_rows(spark: SparkSession, path: str, limit: int | None = 300, *, array: bool = True) -> DataFrame:
    """Hub records as the source answers, a JSON array: the `limit` most downloaded (None: all). Missing counts are 0, missing tags none.

    An array is read by one task a file, which suits an answer of 300 records. For whole dumps give
    array=False: a record a line, which is read in parts.
    """
    raw = spark.read.schema(HUB).json(path, multiLine=array)
    rows = raw.select(
        F.coalesce(filled(F.col("id")), F.col("modelId")).alias("hf_id"), F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("likes", F.lit(0)).alias("likes"),
        F.col("createdAt").alias("created_at"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    order = [F.col("downloads").desc(), F.col("hf_id").asc_nulls_first(), F.col("likes").desc(), F.col("created_at").asc_nulls_first()]
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def best_elo(arena: Column) -> Column:
    """The greatest rating of an array of structs with elo, of those that are there and not 0."""
    return F.array_max(F.filter(F.transform(arena, lambda a: a["elo"]), lambda e: e.isNotNull() & (e != 0)))


def usage_rows(spark: SparkSession, path: str, *, pages: bool = False, carried: str = "") -> DataFrame:
    """A JSON object whose `data` lists models by usage: usage_rank is the place in it, from 1.

    pages: such an object a line, each a part of a long list, with `offset`, the number of models
    before it; these are read in parts. carried: further fields of the objects, as "name type, ...",
    which all their models get.
    """
    more = [f.strip().split(" ")[0] for f in carried.split(",") if f.strip()]
    raw = spark.read.schema(", ".join(x for x in (USAGE, "offset bigint", carried) if x)).json(path, multiLine=not pages)
    m = raw.select(*more, F.coalesce("offset", F.lit(0)).alias("offset"), F.posexplode("data").alias("pos", "m"))
    index = lambda n: F.col(f"m.benchmarks.artificial_analysis.{n}").alias(n)
    return m.select(
        *more, F.col("m.id").alias("or_id"), F.col("m.name").alias("name"), filled(F.col("m.hugging_face_id")).alias("hf_id"), (F.col("offset") + F.col("pos") + 1).cast("int").alias("usage_rank"), F.col("m.context_length").alias("context_length"),
        to_price(F.col("m.pricing.prompt")).alias("price_prompt"), to_price(F.col("m.pricing.completion")).alias("price_completion"),
        index("intelligence_index"), index("coding_index"), index("agentic_index"), best_elo(F.col("m.benchmarks.design_arena")).alias("arena_elo"),
    )


def arena_rows(spark: SparkSession, path: str) -> DataFrame:
    """at (place in the text, which orders the lines), name, elo of comma-separated lines without quoting, the first a heading.

    Best effort: a file that is missing, or a line of one part, a blank name or no rating other than
    0, gives nothing. A text of any size is read in parts.
    """
    try:
        raw = spark.read.text(path)
    except Exception:  # noqa: BLE001 - the source is optional
        return spark.createDataFrame([], "at struct<file: string, block: bigint, id: bigint>, name string, elo double")
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = raw.select(at.alias("at"), "value")
    head = lines.agg(F.min("at").alias("head"))  # one row
    parts = lines.join(F.broadcast(head)).where(F.col("at") > F.col("head")).select("at", F.transform(F.split("value", ","), lambda p: F.trim(p)).alias("p")).where(F.size("p") >= 2)
    return parts.select("at", F.get("p", 0).alias("name"), to_number(F.get("p", 1)).alias("elo")).where((F.col("name") != "") & (F.col("elo") != 0))


class Kept:
    """Tables kept by key for a time, each as numbered versions, the newest of which counts.

    A version is written aside and then renamed, so a reader finds the table before or the new one,
    never a part of it. The version before is left for those who still read it. A broken table
    counts as absent.
    """

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def _versions(self, key: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.folder}/{key}")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [f"{self.folder}/{key}/{n}" for n in sorted(n for n in names if n.startswith("v"))]

    def age(self, key: str) -> float | None:
        """Seconds since the table was written, or None."""
        found = self._versions(key)
        return None if not found else self.clock() - int(found[-1].rsplit("-", 1)[1]) / 1e6

    def get(self, key: str, ttl: float) -> DataFrame | None:
        """The table if it is no older than ttl seconds and can be read through, else None."""
        age = self.age(key)
        if age is None or age > ttl:
            return None
        try:
            found = self.spark.read.parquet(self._versions(key)[-1])
            found.write.format("noop").mode("overwrite").save()
            return found
        except Exception:  # noqa: BLE001 - as if there were none
            return None

    def put(self, key: str, df: DataFrame) -> DataFrame:
        before = self._versions(key)
        number = int(before[-1].rsplit("/v", 1)[1].split("-")[0]) + 1 if before else 0
        path = f"{self.folder}/{key}/v{number:012d}-{round(self.clock() * 1e6)}"
        replace(df, path)
        for old in before[:-1]:
            fs, p = file_system(self.spark, old)
            fs.delete(p, True)
        return self.spark.read.parquet(path)

    def fetched(self, key: str, read: Callable[[], DataFrame], ttl: float = 3600, force: bool = False) -> DataFrame:
        """What is kept, if it is fresh and not forced; else what `read` gives, kept anew."""
        found = None if force else self.get(key, ttl)
        return self.put(key, read()) if found is None else found
