"""Queries of this package, and their SQL counterparts where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.mixing import mixed
from rankloom.llm.model_names import linked_models
from rankloom.llm.packing import cut_items, fill, packed, totals
from rankloom.llm.subjects import subject_posteriors, subjects_of
from rankloom.llm.survivors import Claimed, Roles, agreement, records, survivors, true_values
from rankloom.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("rec_a", "rec_b")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_models(*(table(spark, sf_dir, t) for t in ("hub_models", "usage_models", "orgs")))


def _catalog() -> Roles:
    elo, down = F.col("arena_elo"), F.col("downloads")
    return Roles(
        "group_id", "row_id", "collector", "fetched_at", ("name", "or_id", "likes", "context_length"),
        (
            Claimed("arena_elo", (elo >= 500) & (elo <= 2500), F.round(elo, 1).cast("string"), elo.cast("string")),
            Claimed("hf_id", F.col("hf_id").rlike(r"^[^/\s]+/[^/\s]+$"), F.lower("hf_id"), F.col("hf_id")),
            Claimed("downloads", (down >= 1) & (down <= 10**10), down.cast("string"), down.cast("string")),
        ),
    )


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "catalog_rows"), table(spark, sf_dir, "collectors"), _catalog())


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).drop("text", "best")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field, how often the model believes the required survivor most."""
    return agreement(_survivors(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select("group_id", "field_name", "row_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record built for each group, with its fields in their types."""
    found = records(_survivors(spark, sf_dir), "group_id", ["arena_elo", "hf_id", "downloads"])
    return found.select("group_id", F.col("arena_elo").cast("double"), "hf_id", F.col("downloads").cast("bigint"))


def p5_true_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return true_values(table(spark, sf_dir, "catalog_rows"), _catalog())


P5_FOUND = r"""
WITH trusted AS (
  SELECT r.*, coalesce(t.trust, 0) AS trust,
         (name IS NOT NULL)::INT + (or_id IS NOT NULL)::INT + (likes IS NOT NULL)::INT + (context_length IS NOT NULL)::INT AS filled,
         count(*) OVER (PARTITION BY group_id) AS rows
  FROM catalog_rows r LEFT JOIN (SELECT collector, max(trust) AS trust FROM collectors GROUP BY collector) t USING (collector)
), claims AS (
  SELECT *, 'arena_elo' AS field_name FROM trusted WHERE arena_elo BETWEEN 500 AND 2500
  UNION ALL SELECT *, 'downloads' FROM trusted WHERE downloads BETWEEN 1 AND 10000000000
  UNION ALL SELECT *, 'hf_id' FROM trusted WHERE regexp_full_match(hf_id, '[^/\s]+/[^/\s]+')
)
SELECT group_id, field_name, row_id FROM claims WHERE rows >= 2
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust DESC, fetched_at DESC NULLS LAST, filled DESC, row_id) = 1
"""

def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the packing laid into several containers: those that had to be cut."""
    return cut_items(p6_containers(spark, sf_dir), "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p6_containers(spark, sf_dir))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(p6_containers(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("falls_short").select("source")


def p8_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of(p8_posteriors(spark, sf_dir), "doc_id")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents deal with each subject, and the mean share of their sentences."""
    p = p8_posteriors(spark, sf_dir)
    return p.groupBy("subject").agg(F.count_if(F.col("posterior") >= 0.5).alias("documents"), F.avg("share").alias("mean_share"))


QUERIES = {f.__name__: f for f in (p4_found, p4_matches, p5_found, p5_survivors, p5_agreement, p5_records, p5_true_values, p6_found, p6_containers, p6_fill, p6_totals, p7_found, p7_copies, p7_shares, p8_found, p8_posteriors, p8_composition)}
P5_RECORDS = f"""
SELECT group_id, max(CASE WHEN field_name = 'arena_elo' THEN c.arena_elo END) AS arena_elo, max(CASE WHEN field_name = 'hf_id' THEN c.hf_id END) AS hf_id, max(CASE WHEN field_name = 'downloads' THEN c.downloads END) AS downloads
FROM ({P5_FOUND}) f JOIN catalog_rows c USING (group_id, row_id) GROUP BY group_id
"""

SQL = {"p5_found": P5_FOUND, "p5_records": P5_RECORDS}
