import json

import pytest
from pyspark.sql import functions as F

from rankloom.operators.entity import lookup_by_text
from rankloom.sources import readers, sinks
from rankloom.streaming.sweep import sweep
from tests.test_index import SLIM, m


def test_hub_reader(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"id": "a/x", "downloads": 5, "likes": None}, {"modelId": "b/y", "downloads": 9, "tags": ["t"]}, {"id": "", "modelId": "c"}]))
    got = readers.hub_rows(spark, str(tmp_path / "h.json"), limit=2).collect()
    assert [(r.hf_id, r.downloads, r.likes, r.tags) for r in got] == [("b/y", 9, 0, ["t"]), ("a/x", 5, 0, [])]


def test_usage_reader(spark, tmp_path):
    data = [{"id": "a", "hugging_face_id": "", "pricing": {"prompt": "0.1", "completion": "-1000000"}, "benchmarks": {"artificial_analysis": {"coding_index": 3.5}, "design_arena": [{"elo": 0}, {"elo": 900.0}, {"elo": None}]}}, {"id": "b"}]
    (tmp_path / "u.json").write_text(json.dumps({"data": data}))
    got = readers.usage_rows(spark, str(tmp_path / "u.json")).orderBy("usage_rank").collect()
    assert [(r.or_id, r.hf_id, r.usage_rank, r.price_prompt, r.price_completion, r.coding_index, r.arena_elo) for r in got] == [("a", None, 1, 0.1, None, 3.5, 900.0), ("b", None, 2, None, None, None, None)]


def test_arena_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,elo\n A , 1200\nB\n,5\nC,0\nD,x\na,1300,z\n"q,r",7\n')
    got = lookup_by_text(readers.arena_rows(spark, str(tmp_path / "a.csv")), "name", "elo", "at").collect()
    assert {(r.norm, r.elo) for r in got} == {("a", 1300.0)}
    assert readers.arena_rows(spark, str(tmp_path / "none.csv")).collect() == []


def test_kept(spark, tmp_path):
    now = [0.0]
    kept = readers.Kept(spark, str(tmp_path), clock=lambda: now[0])
    assert kept.age("k") is None and kept.get("k", 10) is None
    kept.put("k", spark.range(3))
    now[0] = 5
    assert round(kept.age("k")) == 5 and kept.get("k", 4) is None and kept.get("k", 6).count() == 3
    assert kept.fetched("k", lambda: spark.range(1), ttl=6).count() == 3 and kept.fetched("k", lambda: spark.range(1), force=True).count() == 1
    assert kept.age("k") == 0 and kept.fetched("k", lambda: 1 / 0).count() == 1


def broken(folder):
    for f in folder.rglob("*.parquet"):
        data = f.read_bytes()
        f.write_bytes(data[:4] + b"\xff" * (len(data) - 300) + data[-296:])  # the pages, not the footer
    for f in folder.rglob(".*.crc"):
        f.unlink()


def test_what_is_kept_and_broken_counts_as_absent(spark, tmp_path):
    kept = readers.Kept(spark, str(tmp_path))
    kept.put("k", spark.range(10000).selectExpr("id * 7919 % 10007 as x"))
    broken(tmp_path / "k")
    assert kept.get("k", 1e9) is None and kept.fetched("k", lambda: spark.range(2)).count() == 2


def test_kept_is_replaced_whole(spark, tmp_path):
    kept = readers.Kept(spark, str(tmp_path))
    old = kept.put("k", spark.range(3))
    with pytest.raises(Exception):
        kept.put("k", spark.range(9).select(F.raise_error(F.lit("broken off"))))
    assert kept.get("k", 1e9).count() == 3
    kept.put("k", kept.get("k", 1e9).union(old))  # out of itself
    assert kept.get("k", 1e9).count() == 6 and old.count() == 3
    kept.put("k", spark.range(1))
    assert len(list((tmp_path / "k").iterdir())) == 2


def test_a_state_that_is_broken_counts_as_none(spark, rows, tmp_path):
    store = sinks.Snapshots(spark, str(tmp_path / "s"))
    store.save(rows([m(f"a{i}", i) for i in range(500)], SLIM), 1.0)
    assert store.latest().count() == 500
    broken(tmp_path / "s")
    assert store.latest() is None and store.count() == 1


def test_the_log_is_cut(spark, rows, tmp_path):
    log = sinks.EventLog(spark, str(tmp_path / "e"), keep=5)
    for b in range(1, 5):
        log.append(rows([(i, float(b)) for i in range(1, 4)], "ord int, ts double"), b)
    kept = lambda: sorted((r.batch, r.ord) for r in spark.read.parquet(str(tmp_path / "e")).collect())
    assert kept() == [(3, 1), (3, 2), (4, 1), (4, 2), (4, 3)]
    log.append(rows([(i, 9.0) for i in range(1, 9)], "ord int, ts double"), 7)
    assert kept() == [(7, i) for i in range(1, 6)]


def test_no_folder_of_this_machine_on_a_cluster(spark, monkeypatch):
    from rankloom.sources import shared

    monkeypatch.setattr(shared, "is_local", lambda spark: False)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, *a: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError):
        shared.shared_dir(spark)


def test_scopes_delete_what_was_written_within(spark):
    import os

    from rankloom.sources import shared
    from rankloom.sources.shared import scope, stored

    path = lambda df: df.inputFiles()[0].removeprefix("file://")
    outer = path(stored(spark.range(2)))
    with scope(spark):
        inner = path(stored(spark.range(2)))
        assert os.path.exists(inner)
    assert os.path.exists(outer) and not os.path.exists(inner)
    shared.drop(table := shared.stored(spark.range(2)))
    assert not os.path.exists(table._stored_at)


def test_only_what_is_small_in_bytes_is_broadcast(spark):
    from rankloom.sources.shared import bytes_of, joined

    small = spark.range(50).select("id", F.lit("x" * 1000).alias("t"), F.array(F.lit("y" * 500)).alias("a"))
    assert 75_000 < bytes_of(small) < 90_000 and bytes_of(small.limit(0)) == 0
    plan = lambda most: joined(spark.range(100), small, "id", most=most)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(100_000).lower() and "broadcast" not in plan(50_000).lower()


def test_snapshots_and_log(spark, rows, tmp_path):
    store = sinks.Snapshots(spark, str(tmp_path / "s"))
    assert store.latest() is None and store.count() == 0
    for t in (1.0, 2.0, 3.0):
        store.save(rows([m("a", int(t))], SLIM), t, keep=2)
    assert store.count() == 2 and store.latest().first()["rank"] == 3
    log = sinks.EventLog(spark, str(tmp_path / "e"))
    assert log.read().collect() == []
    batch = rows([(i, float(i)) for i in range(4)], "ord int, ts double")
    for b in (1, 2, 2):
        log.append(batch, b)
    got = lambda **k: [(r.batch, r.ord) for r in log.read(**k).orderBy("batch", "ord").collect()]
    assert len(got(limit=None)) == 8 and got(since=2.0, limit=None) == [(1, 3), (2, 3)] and got(limit=0) == [] and len(got(limit=-1)) == 7 and got(limit=None, keep=5) == [(1, 0), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_dispatch_and_answers(rows):
    ev = rows([(2, "price_drop", "cheap"), (1, "new_model", "new")], "ord int, type string, headline string")
    said, sent = [], []
    assert sinks.dispatch(ev, said.append, [lambda e: sent.append(e["type"])]) == 2 and said == ["new", "cheap"] and sent == ["new_model"]
    answer = json.loads(sinks.models_answer(rows([("b", 2, None), ("a", 1, 3.0)], "key string, rank int, score double"), {"x": 1.0}, {"hub": 1.6, "arena": None}))
    assert answer == {"models": [{"key": "a", "rank": 1, "score": 3.0}, {"key": "b", "rank": 2, "score": None}], "count": 2, "weights": {"x": 1.0}, "ages": {"hub": 2, "arena": None}}
    assert json.loads(sinks.error_answer(ValueError("no"))) == {"error": "no", "models": []} and json.loads(sinks.news_answer(ev, 3, 60))["snapshots"] == 3


def test_sweep_skips_what_is_unchanged_and_goes_on_after_errors(spark, rows, tmp_path):
    states = [[m("a", 1)], [m("a", 1, price=5.0)], [m("b", 1, usage=1)], []]
    for i, st in enumerate(states):
        rows([(float(i + 1), *r) for r in st], "ts double, " + SLIM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema("ts double, " + SLIM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, log = sinks.Snapshots(spark, str(tmp_path / "s")), sinks.EventLog(spark, str(tmp_path / "e"))
    told = []

    def tell(df):
        told.append(df.count())
        raise RuntimeError("a channel is down")

    sweep(ticks, store, log, str(tmp_path / "c"), tell=tell).awaitTermination(120)
    assert store.count() == 2 and sorted(r.type for r in log.read().collect()) == ["new_leader", "new_model"] and told == [2]


def test_ticks_that_fail_wait_and_are_taken_up_in_order(spark, rows, tmp_path, monkeypatch):
    from rankloom.streaming import sweep as module

    states = [[m("a", 1)], [m("b", 1, usage=1)], [m("c", 1, usage=1)]]
    for i, st in enumerate(states):
        rows([(float(i + 1), *r) for r in st], "ts double, " + SLIM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store, log, real, seen = sinks.Snapshots(spark, str(tmp_path / "s")), sinks.EventLog(spark, str(tmp_path / "e")), module.record, []

    def record(ranked, ts, *rest):
        seen.append(ts)
        if ts == 2.0 and seen.count(2.0) <= 2:
            raise RuntimeError("the disk is full")
        return real(ranked, ts, *rest)

    monkeypatch.setattr(module, "record", record)
    ticks = spark.readStream.schema("ts double, " + SLIM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sweep(ticks, store, log, str(tmp_path / "c")).awaitTermination(120)
    assert seen == [1.0, 2.0, 2.0, 2.0, 3.0] and store.count() == 3 and not [p for p in (tmp_path / "c-waiting").iterdir() if not p.name.startswith((".", "_"))]
    assert [(r.ts, r.type, r.key) for r in log.read().orderBy("batch", "ord").collect()] == [(2.0, "new_leader", "b"), (2.0, "new_model", "b"), (3.0, "new_leader", "c"), (3.0, "new_model", "c")]


def test_models_of_any_number_are_written(spark, rows, tmp_path):
    sinks.write_models(rows([("b", 2, None), ("a", 1, 3.0)], "key string, rank int, score double"), {"x": 1.0}, {"hub": 1.6, "arena": None}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m/head")).first()[0]) == {"count": 2, "weights": {"x": 1.0}, "ages": {"hub": 2, "arena": None}}
    assert {r[0] for r in spark.read.text(str(tmp_path / "m/models")).collect()} == {'{"key":"b","rank":2,"score":null}', '{"key":"a","rank":1,"score":3.0}'}


def test_whole_numbers_of_the_environment(monkeypatch):
    from rankloom.streaming.sweep import whole_number

    assert whole_number("RANKLOOM_TEST", 7) == 7
    monkeypatch.setenv("RANKLOOM_TEST", "12")
    assert whole_number("RANKLOOM_TEST", 7) == 12
    monkeypatch.setenv("RANKLOOM_TEST", "x")
    with pytest.raises(ValueError):
        whole_number("RANKLOOM_TEST", 7)


def test_service_end_to_end(spark, tmp_path):
    from rankloom.plans.model_queries import SIDES
    from rankloom.plans.service import ModelIndex

    (tmp_path / "hub.json").write_text(json.dumps([{"id": "o/x-7b", "downloads": 5, "likes": 1}, {"id": "o/y", "downloads": 9, "likes": 2}]))
    usage = [{"id": "o/x", "name": "X 7B", "hugging_face_id": "o/x-7b", "benchmarks": {"artificial_analysis": {"intelligence_index": 50.0}}}, {"id": "p/z", "name": "Z", "benchmarks": {"artificial_analysis": {"intelligence_index": 60.0}}}]
    (tmp_path / "usage.json").write_text(json.dumps({"data": usage}))
    (tmp_path / "arena.csv").write_text("name,elo\ny,1200\n")
    readers_ = {
        "hub": lambda: readers.hub_rows(spark, str(tmp_path / "hub.json")).withColumn("ordinal", F.monotonically_increasing_id()),
        "usage": lambda: readers.usage_rows(spark, str(tmp_path / "usage.json")),
        "arena": lambda: readers.arena_rows(spark, str(tmp_path / "arena.csv")),
    }
    index = ModelIndex(spark, readers_, str(tmp_path / "work"), SIDES)
    status, answer = index.models("intelligence:10,usage:0", refresh=True)
    got = json.loads(answer)
    assert status == 200 and got["count"] == 3 and got["weights"]["usage"] == 0.0 and got["models"][0]["key"] == "p/z" and {m_["key"]: m_["arena_elo"] for m_ in got["models"]}["o/y"] == 1200.0
    assert json.loads(index.news())["snapshots"] == 1 and index.sweep() == 0
    usage[0]["benchmarks"]["artificial_analysis"]["intelligence_index"] = 99.0
    (tmp_path / "usage.json").write_text(json.dumps({"data": usage}))
    said = []
    index.sweep(said.append)
    assert said and json.loads(index.news())["snapshots"] == 2 and json.loads(index.news(limit=1))["events"][0]["headline"] == said[0]
    index.readers["hub"] = lambda: 1 / 0
    index.ttl = -1
    assert index.models()[0] == 502


def test_download(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from rankloom.sources.web import download, hub_query

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 500)
            self.end_headers()
            self.wfile.write(self.headers["User-Agent"].encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert open(download(f"{base}/ok", str(tmp_path / "a"))).read() == "rankloom"
    with pytest.raises(OSError):
        download(f"{base}/bad", str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()
    for _ in range(2):
        assert spark.read.text(download(f"{base}/ok", str(tmp_path / "c"), spark=spark)).first()[0] == "rankloom"
    with pytest.raises(OSError):
        download(f"{base}/bad", str(tmp_path / "d"), spark=spark)
    assert not (tmp_path / "d").exists() and hub_query("http://x/m", 5) == "http://x/m?sort=downloads&direction=-1&limit=5&filter=text-generation"
    server.shutdown()
