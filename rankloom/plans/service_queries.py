"""Queries on what the index takes in and gives out: source answers, JSON answers, delivery, failing ticks, texts."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from functools import reduce
from http.server import BaseHTTPRequestHandler, HTTPServer

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import numbers as N
from rankloom.operators import events, fit, score, views
from rankloom.plans import model_queries as M
from rankloom.plans import service_sql
from rankloom.sources import readers, sinks, web
from rankloom.sources.shared import stored, work_folder
from rankloom.sources.tables import table
from rankloom.streaming import sweep as streaming

HUB_COLUMNS = ("hf_id", "downloads", "likes", "created_at")
PAGE = 500
AGES = {"hub": 12.4, "usage": 150.0, "arena": None}
PERIOD = 21_600


def _hub_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hub_models").select(F.col("hf_id").alias("id"), "downloads", "likes", F.col("created_at").alias("createdAt"), "tags")


def _top(rows: DataFrame) -> DataFrame:
    return rows.select(*HUB_COLUMNS, F.to_json("tags").alias("tags"))


def hub_top300(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hub records, written as JSON arrays (one a file) and read as the hub source is."""
    path = f"{work_folder(spark)}/hub"

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        some = False
        for pdf in batches:
            yield pd.DataFrame({"value": [("," if some or i else "") + v for i, v in enumerate(pdf["value"])]})
            some = some or len(pdf) > 0
        yield pd.DataFrame({"value": ["]"]})

    _hub_answer(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).mapInPandas(arrays, "value string").write.text(path)
    return _top(readers.hub_rows(spark, path))


def web_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 records that the hub source itself answers with, over HTTP."""
    order = [F.col("downloads").desc(), F.col("id").asc_nulls_first(), F.col("likes").desc(), F.col("createdAt").asc_nulls_first()]
    rows = _hub_answer(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("downloads", "likes")})
    answers = {}

    class Source(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            limit = int(dict(x.split("=") for x in self.path.split("?")[1].split("&"))["limit"])
            if limit not in answers:
                answers[limit] = json.dumps([json.loads(r[0]) for r in rows.orderBy(*order).limit(limit).select(F.to_json(F.struct("*"))).collect()]).encode()  # `limit` rows
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answers[limit])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Source)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        path = web.download(web.hub_query(f"http://127.0.0.1:{server.server_port}/models"), f"{work_folder(spark)}/hub.json", timeout=600, spark=spark)
    finally:
        server.shutdown()
        server.server_close()
    return _top(readers.hub_rows(spark, path))


def usage_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every load written as the nested lists of the usage source, in pages, and read as that source is."""
    path = f"{work_folder(spark)}/usage"
    rows = score.numbered(M._without_nan(table(spark, sf_dir, "usage_loads")), [F.col("line_no").asc()], "at", within=("load_id",))
    index = F.struct(*[F.col(c) for c in ("intelligence_index", "coding_index", "agentic_index")])
    arena = F.array(*[F.struct(e.alias("elo"), F.lit(0.5).alias("win_rate")) for e in (F.lit(0.0), F.col("arena_elo"), F.lit(None).cast("double"), F.col("arena_elo") - 1)])
    model = F.struct(
        "at", F.col("or_id").alias("id"), "name", F.coalesce("hf_id", F.lit("")).alias("hugging_face_id"), "context_length", F.struct(F.col("price_prompt").alias("prompt"), F.col("price_completion").alias("completion")).alias("pricing"),
        F.struct(index.alias("artificial_analysis"), arena.alias("design_arena")).alias("benchmarks"),
    )
    page = F.floor((F.col("at") - 1) / PAGE)
    pages = rows.groupBy("load_id", page.alias("page")).agg(F.sort_array(F.collect_list(model)).alias("data"))  # PAGE models each
    pages.select("load_id", (F.col("page") * PAGE).alias("offset"), "data").write.json(path)
    return readers.usage_rows(spark, path, pages=True, carried="load_id bigint")


def models_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON answer with all models, written and read again: a row for each, with the answer's head."""
    folder = work_folder(spark)
    sinks.write_models(M._board(spark, sf_dir, M.CUSTOM), {**score.MODEL_WEIGHTS, **(score.parse_weights(M.CUSTOM) or {})}, AGES, folder)
    schema = "rank int, key string, name string, score double, or_id string, downloads bigint, price_completion double, noise boolean, params_b double, local boolean, score_breakdown map<string,double>"
    rows = spark.read.schema(schema).json(f"{folder}/models").withColumn("coding", F.try_element_at("score_breakdown", F.lit("coding"))).drop("score_breakdown")
    head = spark.read.schema("count bigint, weights map<string,double>, ages map<string,bigint>").json(f"{folder}/head")
    head = head.select("count", F.col("weights")["coding"].alias("w_coding"), F.col("weights")["likes"].alias("w_likes"), F.col("ages")["hub"].alias("hub_age"), F.col("ages")["arena"].alias("arena_age"))
    return rows.join(F.broadcast(head))  # one row


def _yearly_log(spark: SparkSession, sf_dir: str, times: int = 1) -> sinks.EventLog:
    """The events of each year, appended as its batch, as many times."""
    log = sinks.EventLog(spark, work_folder(spark))
    rows = stored(M.yearly_history(spark, sf_dir))
    for r in rows.select("snapshot_id").distinct().orderBy("snapshot_id").collect():  # a row a year
        for _ in range(times):
            log.append(rows.where(F.col("snapshot_id") == r.snapshot_id).withColumn("ts", F.col("snapshot_id").cast("double")).drop("board", "snapshot_id"), r.snapshot_id)
    return log


def news_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON answer with the news since 1996, read again: a row for each event, with the answer's head."""
    text = sinks.news_answer(_yearly_log(spark, sf_dir).read(1996.0, 50), 7, streaming.whole_number("RANKLOOM_POLL_SECONDS", PERIOD))
    schema = "events array<struct<ord: int, type: string, key: string, rank: int, score: double, ts: double, headline: string>>, snapshots int, poll_interval int"
    answer = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema).alias("a"))
    return answer.select(F.posexplode("a.events").alias("pos", "e"), "a.snapshots", "a.poll_interval").select("pos", "e.*", "snapshots", "poll_interval")


def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log holds after each batch came twice."""
    return _yearly_log(spark, sf_dir, 2).read(limit=None).groupBy("batch").agg(F.count("*").alias("events"), F.max("ord").alias("last"))


def stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's state saved, of which five are kept; the latest as it is read, with the number kept. Saved twice, a state takes its own place."""
    rows, store = M.yearly_states(spark, sf_dir), sinks.Snapshots(spark, work_folder(spark))
    for r in rows.select("ts").distinct().orderBy("ts").collect():  # a row a year
        for _ in range(2):
            store.save(rows.where(F.col("ts") == r.ts), r.ts, keep=5)
    return store.latest().select("key", "rank", "score", "usage_rank", "price_completion", "noise", F.lit(store.count()).alias("snapshots"))


class _Failing(sinks.Snapshots):
    """Cannot be written the first times that a tick comes."""

    def __init__(self, spark: SparkSession, folder: str, ts: float, times: int):
        super().__init__(spark, folder)
        self.ts, self.left = ts, times

    def save(self, ranked: DataFrame, ts: float, keep: int = sinks.KEEP_SNAPSHOTS) -> None:
        if ts == self.ts and self.left:
            self.left -= 1
            raise OSError("planned: this tick cannot be written yet")
        super().save(ranked, ts, keep)


def streaming_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """streaming_sweep where the tick of 1995 fails until two later ones have come: nothing is lost or out of order."""
    return M.swept(spark, sf_dir, lambda folder: _Failing(spark, folder, 1995.0, 5))


def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log and a channel get of a tick's events, in order."""
    got: list[tuple[str, str, str]] = []
    sinks.dispatch(M.diff_all(spark, sf_dir), lambda text: got.append(("log", text, "")), [lambda e: got.append(("channel", e["headline"], e["type"]))])
    place: dict[str, int] = {}
    rows = [(to, place.setdefault(to, 0), text, kind) for to, text, kind in got if not place.update({to: place.get(to, 0) + 1})]
    return spark.createDataFrame(rows, "sent_to string, pos int, headline string, type string")  # a tick's events, as delivered


def scored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored rows after a click on downloads, with bars."""
    rows = views.with_bars(views.chosen(M._board(spark, sf_dir), scored_only=True))
    column, ascending = views.toggled("rank", True, "downloads")
    return score.numbered(rows.select("key", "downloads", "rank", N.round1(F.col("pct")).alias("pct")), views.order_by(rows, column, ascending), "pos")


def weight_sliders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.weight_controls(spark, {**score.MODEL_WEIGHTS, **(score.parse_weights("coding:77,price:-3") or {})})


def machine_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preset with its budget and the largest model that fits, by storage form."""
    forms = [(m[0], q, fit.preset(m[0], fit.Machine(quant=q))) for m in fit.MACHINES for q in fit.BYTES]
    rows = spark.createDataFrame([(label, q.upper(), m.budget, fit.largest_fitting(m)) for label, q, m in forms], "label string, quant string, budget double, largest double")  # fixed rows
    return rows.join(fit.machines(spark), "label").withColumn("largest", N.nearest(F.col("largest")))


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of 1997 as the feed shows them an hour later."""
    return views.feed_view(M.diff_all(spark, sf_dir), 1997.0 + 3600, "https://hub.example/")


def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines around the tables: freshness, counts, fits, an empty feed, an error."""
    board = M._board(spark, sf_dir)
    one = lambda name, text: spark.createDataFrame([(name, text)], "name string, text string")
    line = lambda name, df: df.select(F.lit(name).alias("name"), "text")
    fresh = one("freshness", "").select("name", *views.freshness(AGES, {"hub": "HUB", "usage": "USAGE", "arena": "ARENA"}))
    parts = [
        fresh, line("indexed", views.indexed_line(board)), line("shown", views.shown_line(views.chosen(board, search="chat"), board)), line("fits", fit.fit_line(board, fit.Machine())),
        one("best", fit.fit_summary(board, fit.Machine(), "coding_index")), one("nothing", fit.fit_summary(board, fit.Machine(vram=0.0))),
        one("steady", views.empty_feed(3)), one("first", views.empty_feed(0)), one("error", sinks.error_answer(ValueError("the source is down"))),
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    f.__name__: f
    for f in (hub_top300, web_source_scan, usage_list_scan, models_answer, news_answer, replayed_log, stored_states, streaming_retry, delivered_events, scored_view, weight_sliders, machine_presets, feed_lines, status_texts)
}
SQL = service_sql.all_sql(score.parse_weights(M.CUSTOM))
