"""Queries on the domain tables: profiles, snapshot changes, attribute histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.history import SnapshotSpec, attribute_history, snapshot_changes
from rankloom.operators.profile import ColumnRule, column_profile, column_shape, load_shifts
from rankloom.plans import data_sql
from rankloom.sources.tables import table

BOARDS = SnapshotSpec("board", "snapshot_id", "ts", "key", "ingested_at", {"rank": 0, "score": 0.01, "price_completion": 1e-10})
#: Prices are dollars a token, contexts tokens, the index a share of 100.
USAGE_RULES = [ColumnRule("price_prompt", 0.0, 1.0), ColumnRule("context_length", 1, 1e8), ColumnRule("coding_index", 0.0, 100.0)]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_shifts(table(spark, sf_dir, "usage_loads"), "load_id", USAGE_RULES).where("shifted").select("load_id", "column_name")


def p1_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_shifts(table(spark, sf_dir, "usage_loads"), "load_id", USAGE_RULES)


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = column_profile(table(spark, sf_dir, "usage_loads"), "load_id", USAGE_RULES)
    return found.select("load_id", "column_name", "rows", "missing", "malformed", "impossible", "distinct_values", "lowest", "highest")


def p1_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape that belongs to each row of p1_profile."""
    return column_shape(table(spark, sf_dir, "usage_loads"), "load_id", USAGE_RULES)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshots"), BOARDS).select("snapshot_id", "key", "change_kind")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_history(table(spark, sf_dir, "snapshots"), BOARDS).select("board", "key", "from_id", "to_id")


def p3_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every board: how many keys and versions it has had and how many still hold."""
    return (
        attribute_history(table(spark, sf_dir, "snapshots"), BOARDS)
        .groupBy("board")
        .agg(F.count_distinct("key").alias("keys"), F.count("*").alias("versions"), F.count_if(F.col("to_id") == -1).alias("holding"), F.max("version_no").alias("most_versions"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_shifts, p1_profile, p1_shape, p2_found, p3_found, p3_versions)}
SQL = {"p1_profile": data_sql.P1_PROFILE, "p2_found": data_sql.P2_FOUND, "p3_found": data_sql.P3_FOUND, "p3_versions": data_sql.P3_VERSIONS}
