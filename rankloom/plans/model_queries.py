"""Queries on the model index: sources into one table, scores, views, fits, events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import numbers as N
from rankloom.functions import text as T
from rankloom.operators import entity, events, fit, score, views
from rankloom.operators.history import tidy_key
from rankloom.plans import model_sql as sql
from rankloom.sources import readers, sinks
from rankloom.sources.shared import file_system, stored, work_folder
from rankloom.sources.tables import table
from rankloom.streaming import sweep as streaming

SIDES = entity.Sides(
    "hf_id", "or_id", "hf_id", "name",
    ("usage_rank", "context_length", "price_prompt", "price_completion", "intelligence_index", "coding_index", "agentic_index", "arena_elo"), ("downloads", "likes"), "arena_elo",
)
CUSTOM = "coding:40, price:0,usage:-3,unknown:5,arena:x,:7,intelligence"


def _without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c, t in df.dtypes if t == "double"})


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_nan(table(spark, sf_dir, "usage_models"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "arena_lines").withColumn("elo", T.to_number(F.col("elo")))
    return entity.lookup_by_text(lines, "name", "elo", "line_id").select("norm", F.col("elo").alias("arena_elo"))


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.merged(_usage(spark, sf_dir), table(spark, sf_dir, "hub_models"), _ratings(spark, sf_dir), SIDES, primary_ordinal="rec_id", secondary_ordinal="rec_id")


def unify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir).withColumns({"sources": F.concat_ws(",", "sources"), "side": F.col("seq.side"), "seq": F.col("seq.place")})


def _board(spark: SparkSession, sf_dir: str, weights: str | None = None) -> DataFrame:
    """The merged table is stored: its ends, the sample of its order and its rows are read from there."""
    return score.leaderboard(stored(unified(spark, sf_dir)), weights=score.parse_weights(weights))


def weighted_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select("rank", "key", "score")


def leaderboard_custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, CUSTOM).select("rank", "key", "score")


def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.blended(score.normalised(stored(unified(spark, sf_dir)), score.MODEL_SIGNALS), score.MODEL_SIGNALS)
    return rows.select("key", F.explode("score_breakdown").alias("signal", "value"))


def _scaled(df: DataFrame, key: str, signal: score.Signal) -> DataFrame:
    return score.normalised(df, (signal,)).select(key, N.round1(F.col(f"norm_{signal.name}")).alias("norm"))


def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(table(spark, sf_dir, "supplier"), "s_suppkey", score.Signal("x", "s_acctbal"))


def log_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(table(spark, sf_dir, "part"), "p_partkey", score.Signal("x", "p_retailprice", logarithmic=True))


def inverted_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(table(spark, sf_dir, "customer"), "c_custkey", score.Signal("x", "c_acctbal", higher_is_better=False))


def constant_column_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(table(spark, sf_dir, "supplier").withColumn("one", F.lit(7.0)), "s_suppkey", score.Signal("x", "one"))


def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.col("user_id").cast("string"))
    return entity.last_by_key(rows, "k", "event_id").select("k", "event_id", "event_type", "position")


def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.col("user_id").cast("string"))
    return entity.first_by_key(rows, "k", "event_id").select("k", "event_id", "event_type", "position")


def left_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hub = entity.last_by_key(table(spark, sf_dir, "hub_models"), "hf_id", "rec_id").select("hf_id", "downloads", "likes")
    return _usage(spark, sf_dir).select("rec_id", "hf_id").join(hub, "hf_id", "left").select("rec_id", "hf_id", "downloads", "likes")


def anti_join_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _usage(spark, sf_dir).select(F.coalesce(T.filled(F.col("hf_id")), F.col("or_id")).alias("key"))
    return entity.first_by_key(table(spark, sf_dir, "hub_models"), "hf_id", "rec_id").join(keys, F.col("hf_id") == F.col("key"), "left_anti").select("hf_id", "rec_id", "downloads")


def normalised_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.with_fallback(_usage(spark, sf_dir), F.col("name"), "arena_elo", _ratings(spark, sf_dir), "arena_elo").select("rec_id", "arena_elo")


def noise_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hub_models").select("rec_id", T.sidelined(T.both(F.lit(None), F.col("hf_id"))).alias("noise"))


def param_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hub_models").select("rec_id", T.billions(T.both(F.lit(None), F.col("hf_id"))).alias("params_b"))
    return rows.unionByName(table(spark, sf_dir, "usage_models").select("rec_id", T.billions(T.both(F.col("name"), F.col("hf_id"))).alias("params_b")))


def clean_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "usage_loads").select("load_id", "line_no", T.to_price(F.col("price_prompt")).alias("price_prompt"), T.to_price(F.col("price_completion")).alias("price_completion"))


def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "arena_lines").select("line_id", T.to_number(F.col("elo")).alias("elo"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def array_filter_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", readers.best_elo(F.transform("embedding", lambda x: F.struct(x.cast("double").alias("elo")))).alias("best"))


def ordinal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return score.numbered(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "ordinal")


def text_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(T.contains_text("LA", F.col("p_name"), F.col("p_brand"))).select("p_partkey", "p_name")


def sorted_view_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chosen(_board(spark, sf_dir))
    up = score.numbered(rows.select("key", "coding_index", "rank"), views.order_by(rows, "coding_index", True), "pos_up")
    return score.numbered(up, views.order_by(rows, "coding_index", False), "pos_down").select("key", "coding_index", "pos_up", "pos_down")


def podium_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chosen(_board(spark, sf_dir))
    return views.podium(rows, views.order_by(rows, "rank", True)).withColumn("pct", N.round1(F.col("pct")))


def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _board(spark, sf_dir)
    return b.select(
        "key", N.padded(F.col("rank")).alias("rank_text"), N.or_dash(F.col("score")).alias("score_text"), N.short(F.col("downloads")).alias("downloads_text"), N.dollars_per_million(F.col("price_completion")).alias("price_text"),
        N.or_dash(N.nearest(F.col("arena_elo")), zero_too=True).alias("arena_text"), views.link("https://hub.example/", "https://usage.example/").alias("link"), F.concat_ws(",", views.badges({"hub": "HF", "usage": "OR"})).alias("badges"),
    )


def _fit_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select("key", "params_b", N.round1(F.col("need")).alias("need"), "fit", "note", *more)


def hardware_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_columns(fit.fitted(_board(spark, sf_dir), fit.Machine()))


def fit_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_columns(fit.fit_view(_board(spark, sf_dir), fit.preset("RTX 5080 / 4080 · 16GB"), "coding_index"), "section", "pos")


def fit_best_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_columns(fit.best_pick(_board(spark, sf_dir), fit.preset("Apple M-series (unified)"), "agentic_index"))


def humanise_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return rows.select("o_orderkey", N.short(price * 1000).alias("short"), N.short(key).alias("short_key"), N.dollars_per_million(price / 1e9).alias("dollars"), N.ago(key).alias("ago"), N.padded(key % 200).alias("padded"), N.nearest(price).alias("nearest"), N.round1(price / 7).alias("tenth"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that holds of each key in each snapshot."""
    rows = _without_nan(table(spark, sf_dir, "snapshots")).withColumn("key", tidy_key(F.col("key")))
    kept = rows.groupBy("snapshot_id", "key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("snapshot_id", "key")]), F.struct("ingested_at", "row_id")).alias("r"))
    return kept.select("snapshot_id", "key", "r.*")


def snapshot_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.slim(_states(spark, sf_dir)).withColumn("sources", F.to_json("sources"))


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every board, the state in its last snapshot."""
    rows = _states(spark, sf_dir)
    last = rows.groupBy("board").agg(F.max("ts").alias("ts"))
    return rows.join(last, ["board", "ts"], "left_semi").select("board", "snapshot_id", "key", "rank", "score")


def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.retained(table(spark, sf_dir, "snapshots"), "snapshot_id").groupBy("snapshot_id").agg(F.count("*").alias("rows"))


def snapshot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "snapshots").agg(F.count_distinct("snapshot_id").alias("snapshots"))


def _told(df: DataFrame) -> DataFrame:
    return df.select("board", "snapshot_id", "ord", "type", "key", "name", "rank", "score", "headline", "rank_delta", "score_delta", "old_price", "new_price")


def diff_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(events.diff_history(_states(spark, sf_dir), "board", "snapshot_id", "ts"))


def social_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.social(diff_history(spark, sf_dir))


def yearly_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ranked by what they ordered, for every year: ts, and a ranked row for each customer with orders."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("double").alias("ts"), "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    sums = o.groupBy("ts", "o_custkey").agg(F.sum("p").cast("double").alias("total"), F.count("*").alias("n"))
    ends = sums.groupBy("ts").agg(F.min("total").alias("low"), F.max("total").alias("high"))
    rows = sums.join(F.broadcast(ends), "ts")  # a row a year
    x = (F.col("total") - F.col("low")) / F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.col("high") - F.col("low")) * 100.0
    key = F.col("o_custkey")
    rows = score.numbered(stored(rows.withColumn("x", x)), [F.col("total").desc(), key.asc()], within=("ts",))
    none, x = F.lit(None).cast("double"), F.col("x")
    return rows.select(
        "ts", F.concat(F.lit("c/"), key).alias("key"), F.concat(F.lit("Customer "), key).alias("name"), "rank", N.round1(x).alias("score"), none.alias("intelligence_index"), none.alias("coding_index"),
        F.col("n").cast("int").alias("usage_rank"), none.alias("arena_elo"), (F.col("total") / F.col("n") / 1e9).alias("price_completion"), (key % 10 == 0).alias("noise"),
    )


def diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly_states(spark, sf_dir)
    return events.diff(rows.where("ts = 1996"), rows.where("ts = 1997"), 1997.0)


def _of_type(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff_all(spark, sf_dir).where(F.col("type") == kind)

    query.__name__ = f"diff_{kind}"
    return query


def yearly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly_states(spark, sf_dir).withColumns({"snapshot_id": F.col("ts").cast("bigint"), "board": F.lit("orders")})
    return _told(events.diff_history(rows, "board", "snapshot_id", "ts"))


def unchanged_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly_states(spark, sf_dir)
    a, b = rows.where("ts = 1996"), rows.where("ts = 1997")
    return events.unchanged(a, a).select(F.lit("same").alias("pair"), "unchanged").unionByName(events.unchanged(a, b).select(F.lit("next year").alias("pair"), "unchanged"))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("batch"), F.col("event_id").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("event_type").alias("type"))


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days before the end, as the feed shows it."""
    log = _event_log(spark, sf_dir)
    since = log.agg(F.max("ts")).first()[0] - 2 * 86_400e6
    return sinks.feed(log, since, 50).select("ord", "type")


def event_log_append_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of events a week, appended one by one; what the log then holds on disk."""
    folder = work_folder(spark)
    log = sinks.EventLog(spark, folder)
    rows = table(spark, sf_dir, "events").select(F.floor(F.dayofyear("ts") / 7).cast("int").alias("week"), F.col("event_id").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
    for r in rows.select("week").distinct().orderBy("week").collect():  # some 53 a year
        log.append(rows.where(F.col("week") == r.week).drop("week"), r.week)
    return spark.read.parquet(folder).select("batch", "ord")


def swept(spark: SparkSession, sf_dir: str, states: Callable[[str], sinks.Snapshots]) -> DataFrame:
    """yearly_history, but by the stream: a file for each year, read one by one."""
    work = work_folder(spark)
    rows = yearly_states(spark, sf_dir)
    for r in rows.select("ts").distinct().orderBy("ts").collect():  # a row a year; files are read in the order they were written
        rows.where(F.col("ts") == r.ts).coalesce(1).write.mode("append").parquet(f"{work}/ticks")  # a tick is a file
    ticks = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/ticks")
    log = sinks.EventLog(spark, f"{work}/events", keep=2**31 - 1)
    query = streaming.sweep(ticks, states(f"{work}/states"), log, f"{work}/checkpoint")
    query.awaitTermination()
    return _told(log.read(limit=None).withColumns({"board": F.lit("orders"), "snapshot_id": F.col("ts").cast("bigint")}))


def streaming_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir, lambda folder: sinks.Snapshots(spark, folder))


def csv_lookup_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arena list written as text and read as the arena source is."""
    path = f"{work_folder(spark)}/arena"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = table(spark, sf_dir, "arena_lines").select(F.concat(text("name"), F.lit(","), text("elo"), F.lit(","), text("line_id")).alias("value"), "line_id")
    head = spark.createDataFrame([("name,elo,line", -1)], "value string, line_id bigint")
    head.unionByName(lines).repartitionByRange("line_id").sortWithinPartitions("line_id").select("value").write.text(path)
    rows = readers.arena_rows(spark, path)
    return entity.lookup_by_text(rows, "name", "elo", "at")


def ttl_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table kept for an hour holds, by a clock that is set: at first, within and after the hour, forced, and broken."""
    now, folder = [0.0], work_folder(spark)
    kept = readers.Kept(spark, folder, clock=lambda: now[0])
    hub, usage = (lambda: table(spark, sf_dir, "hub_models").select("rec_id")), (lambda: table(spark, sf_dir, "usage_models").select("rec_id"))
    found = []

    def step(name: str, at: float, read, force: bool = False) -> None:
        now[0] = at
        rows = kept.fetched("k", read, 3600, force)
        sums = rows.agg(F.count("*").alias("rows"), F.count_distinct("rec_id").alias("ids"))
        found.append(stored(sums.select(F.lit(name).alias("step"), "rows", "ids", F.lit(kept.age("k")).alias("age"))))  # now, as later steps replace the table

    step("first", 100.0, hub)
    step("within", 3700.0, usage)
    step("after", 3701.0, usage)
    step("forced", 3702.0, hub, force=True)
    step("forced again", 3703.0, usage, force=True)
    newest = kept._versions("k")[-1]
    fs, path = file_system(spark, f"{newest}/broken.parquet")
    out = fs.create(path, True)
    out.write(bytearray(b"no table"))
    out.close()
    step("broken", 3704.0, hub)
    return reduce(DataFrame.unionByName, found)


def json_sources_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub records written as a JSON array and read as the hub source is."""
    path = f"{work_folder(spark)}/hub.json"
    hub = table(spark, sf_dir, "hub_models").select(F.col("hf_id").alias("id"), "downloads", "likes", F.col("created_at").alias("createdAt"), "tags")
    hub.write.json(path)
    return readers.hub_rows(spark, path, limit=None, array=False).groupBy(F.col("downloads") > 0).agg(F.count("*").alias("n"), F.sum("likes").alias("likes")).toDF("downloaded", "n", "likes")


QUERIES = {
    f.__name__: f
    for f in (
        weighted_leaderboard, leaderboard_custom_weights, score_breakdown, minmax_normalise, log_minmax, inverted_minmax, constant_column_norm, unify_sources, dedupe_last_wins, dedupe_first_wins,
        left_lookup_join, anti_join_unmatched, normalised_name_lookup, noise_classifier, param_parse, clean_price, safe_cast, json_extract, array_filter_max, ordinal_rank, text_search_filter, sorted_view_nulls,
        podium_top3, row_texts, hardware_fit, fit_best_pick, fit_near_miss, humanise_numbers, snapshot_slim, snapshot_latest, snapshot_retention, snapshot_count, diff_history, social_events, diff_all,
        *[_of_type(k) for k in ("new_leader", "new_model", "big_climber", "price_drop")], yearly_history, unchanged_check, event_feed, event_log_append_cap, streaming_sweep, csv_lookup_scan, ttl_cache_roundtrip, json_sources_scan,
    )
}
SQL = sql.all_sql(score.parse_weights(CUSTOM))
