"""Golden cases of merging, scoring, views, fit and events."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import entity, events, fit, score, views
from rankloom.plans.model_queries import SIDES

MODELS = "key string, seq bigint, intelligence_index double, coding_index double, agentic_index double, arena_elo double, usage_rank int, downloads bigint, likes bigint, price_completion double"
FIVE = [
    ("m1", 1, 60.0, 50.0, 40.0, 1200.0, 1, 999, 10, 1e-5), ("m2", 2, 40.0, 30.0, None, 1100.0, 2, 9, 20, 2e-6), ("m3", 3, None, None, None, None, 3, 99999, 30, None),
    ("m4", 4, 50.0, None, 20.0, None, None, None, None, 0.0), ("m5", 5, None, None, None, None, None, None, None, None),
]


def order(df):
    return [(r.key, r.score) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "weights,expected",
    [
        (None, [("m1", 87.5), ("m4", 44.4), ("m3", 26.7), ("m2", 18.3), ("m5", None)]),
        ("intelligence:0,coding:0,agentic:0,arena:0", [("m4", 80.0), ("m1", 51.4), ("m2", 37.7), ("m3", 26.7), ("m5", None)]),
        ("intelligence:0,agentic:0,arena:0,usage:0,downloads:0,likes:0,price:-1,other:9", [("m1", 100.0), ("m2", 0.0), ("m3", None), ("m4", None), ("m5", None)]),
        ("intelligence:0,coding:0,agentic:0,arena:0,usage:0,downloads:0,likes:0,price:0", [(f"m{i}", None) for i in range(1, 6)]),
    ],
)
def test_scores(rows, weights, expected):
    assert order(score.leaderboard(rows(FIVE, MODELS), weights=score.parse_weights(weights))) == expected


def test_breakdown(rows):
    got = {r.key: r.score_breakdown for r in score.leaderboard(rows(FIVE, MODELS)).collect()}
    assert got["m4"] == {"intelligence": 50.0, "agentic": 0.0, "price": 100.0} and got["m5"] == {}
    assert got["m2"] == {"intelligence": 0.0, "coding": 0.0, "arena": 0.0, "usage": 50.0, "downloads": 0.0, "likes": 50.0, "price": 80.0}


def test_constant_and_missing_signals(rows):
    df = rows([("a", 7.0, None), ("b", 7.0, None), ("c", None, None)], "key string, x double, y double")
    got = score.normalised(df, (score.Signal("x", "x"), score.Signal("up", "x", higher_is_better=False), score.Signal("y", "y"))).orderBy("key").collect()
    assert [(r.norm_x, r.norm_up, r.norm_y) for r in got] == [(0.0, 100.0, None), (0.0, 100.0, None), (None, None, None)]


def test_filter_does_not_change_scores(rows):
    whole = score.leaderboard(rows(FIVE, MODELS))
    assert whole.where("key = 'm2'").first().score == 18.3


def test_nothing_to_score(rows):
    assert score.leaderboard(rows([], MODELS)).collect() == []


def test_weights():
    assert score.parse_weights("a:1, b : 2,c,d:x,e:inf,f:1:2") == {"a": 1.0, "b": 2.0} and score.parse_weights("") is None and score.parse_weights(None) is None


def test_numbers_over_parts(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = score.numbered(df, [F.col("g").desc(), F.col("id").asc()]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001)) and [(r.g, r.id) for r in got] == sorted(((r.g, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_numbers_within_groups_begin_anew(spark):
    n = F.col("id")
    df = spark.range(3000).select("id", F.when(n % 3 > 0, F.lit(7)).when(n % 2 == 0, n % 5).alias("g"))  # two thirds in one group, some in none
    got = score.numbered(df, [n.desc()], "place", within=("g",)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.place, -r.id))
    assert len(got) == 3000 and len(groups) == 7 and all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v) == sorted(v, key=lambda x: x[1]) for v in groups.values())


def test_blend_grows_no_faster_than_its_signals(rows):
    import time

    n = 16
    signals = tuple(score.Signal(f"s{i}", f"c{i}", quality=i == 0) for i in range(n))
    df = rows([(f"k{j}", *[float(j + i) if (i + j) % 3 else None for i in range(n)]) for j in range(10)], "key string, " + ", ".join(f"c{i} double" for i in range(n)))
    began = time.perf_counter()
    got = score.blended(score.normalised(df, signals), signals, defaults={s.name: 1.0 for s in signals}).collect()
    assert len(got) == 10 and time.perf_counter() - began < 10


def test_ordinals_of_any_size_keep_to_their_side(rows):
    none = (None,) * 6
    usage = rows([(2**60, "a/1", None, None, 1, None, *none), (5, "a/2", None, None, 2, None, *none)], "n bigint, or_id string, name string, hf_id string, usage_rank int, context_length bigint, price_prompt double, price_completion double, intelligence_index double, coding_index double, agentic_index double, arena_elo double")
    hub = rows([(1, "x/h", 1, 0)], "n bigint, hf_id string, downloads bigint, likes bigint")
    got = entity.merged(usage, hub, rows([("h", 9.0)], "norm string, arena_elo double"), SIDES, primary_ordinal="n", secondary_ordinal="n").orderBy("seq").collect()
    assert [(r.key, r.arena_elo) for r in got] == [("a/2", None), ("a/1", None), ("x/h", 9.0)]


def test_merge(spark, rows):
    none = (None,) * 6
    usage = rows([(i, o, None, h, i, None, *none) for i, (o, h) in enumerate([("a/1", "H1"), ("a/2", None), ("a/3", "H1"), ("a/4", "H9"), (None, "")], 1)], "n int, or_id string, name string, hf_id string, usage_rank int, context_length bigint, price_prompt double, price_completion double, intelligence_index double, coding_index double, agentic_index double, arena_elo double")
    hub = rows([(i, h, d, 0) for i, (h, d) in enumerate([("H1", 10), ("H2", 20), ("H2", 25), ("a/2", 30), ("H1", 11), (None, 1), ("", 1)])], "n int, hf_id string, downloads bigint, likes bigint")
    ratings = rows([("h2", 1200.0), ("", 900.0)], "norm string, arena_elo double")
    got = entity.merged(usage, hub, ratings, SIDES, primary_ordinal="n", secondary_ordinal="n").orderBy("seq").collect()
    assert [(r.key, r.or_id, r.usage_rank, r.downloads, r.sources, r.local) for r in got] == [
        ("H1", "a/3", 3, 11, ["usage", "hub"], True), ("a/2", "a/2", 2, None, ["usage"], False), ("H9", "a/4", 4, None, ["usage"], True), ("H2", None, None, 20, ["hub"], True),
    ]
    assert got[3].arena_elo == 1200.0 and got[0].arena_elo == 900.0  # an empty name finds the empty name


def test_views(rows):
    df = rows([("a", "B_x", None, False, 1, 9.0), ("b", "é", 3.0, False, 2, 8.0), ("c", "a", 1.0, True, 3, None)], "key string, name string, x double, noise boolean, rank int, score double").withColumn("hf_id", F.lit(None).cast("string"))
    keys = lambda d, *o: [r.key for r in d.orderBy(*o).collect()]
    assert keys(df, *views.order_by(df, "x", True)) == ["a", "c", "b"] and keys(df, *views.order_by(df, "x", False)) == ["b", "c", "a"]
    assert keys(df, *views.order_by(df, "name", True)) == ["c", "a", "b"]
    assert keys(views.chosen(df), "rank") == ["a", "b"] and keys(views.chosen(df, hide_noise=False, search="b_X"), "rank") == ["a"] and keys(views.chosen(df, hide_noise=False, scored_only=True), "rank") == ["a", "b"]
    assert views.toggled("rank", True, "rank") == ("rank", False) and views.toggled("rank", True, "score") == ("score", False) and views.toggled("score", False, "name") == ("name", True)
    assert [views.first_rows(df, n).count() for n in (0, 2, 9, -1, -5)] == [0, 2, 3, 2, 0]


def test_fit(rows):
    df = rows([(p, True, False, i, None) for i, p in enumerate([16.0, 36.3, 40.0, 58.0, 70.0, 0.0, None], 1)] + [(1.0, False, False, 8, None), (1.0, True, True, 9, None)], "params_b double, local boolean, noise boolean, rank int, score double")
    assert [r.fit for r in fit.fitted(df, fit.Machine()).orderBy("rank").collect()] == ["fits", "fits", "tight", "offload", "toobig"]
    assert fit.preset("Apple M-series (unified)").budget == 24.0 and fit.preset("Custom").vram == 24.0
    assert {r.fit for r in fit.fitted(df, fit.preset("CPU only")).collect()} == {"offload", "toobig"}
    assert [(r.pos, r.params_b) for r in fit.fit_view(df, fit.Machine(), near=1).orderBy("pos").collect()] == [(1, 16.0), (2, 36.3), (3, 40.0), (4, 58.0)]
    assert fit.best_pick(df, fit.Machine()).first().params_b == 16.0


SLIM = "key string, name string, rank int, score double, intelligence_index double, coding_index double, usage_rank int, arena_elo double, price_completion double, noise boolean"


def m(key, rank, score_=50.0, price=None, noise=False, usage=None, iq=None):
    return (key, key, rank, score_, iq, None, usage, None, price, noise)


OLD = m("old", 400)
CASES = [
    ([], [m("a", 1)], []),
    ([m("a", 1)], [m("a", 1)], []),
    ([m("k1", 1)], [m("k2", 1, noise=True)], [("new_leader", "k2")]),
    ([OLD], [OLD, m("n", 150, usage=5)], [("new_model", "n")]),
    ([OLD], [OLD, m("n", 151, usage=5)], []),
    ([OLD], [OLD, m("n", 9)], []),
    ([OLD], [OLD, m("n", 9, usage=5, noise=True)], []),
    ([m("a", 20)], [m("a", 5)], [("big_climber", "a")]),
    ([m("a", 20)], [m("a", 6)], []),
    ([m("a", 5, 50.1)], [m("a", 8, 52.6)], [("big_climber", "a")]),
    ([m("a", 5, price=4e-6)], [m("a", 5, price=3e-6)], []),
    ([m("a", 5, price=4e-6)], [m("a", 5, price=2.99e-6)], [("price_drop", "a")]),
    ([m("a", 5, price=1e-5)], [m("a", 5, price=7.5e-6)], [("price_drop", "a")]),
    ([m("a", 5, price=4e-6)], [m("a", 5, price=0.0)], []),
    ([OLD, m("a", 5)], [OLD], []),
    ([m("a", 30, price=4e-6)], [m("a", 5, price=2e-6)], [("big_climber", "a"), ("price_drop", "a")]),
]


@pytest.mark.parametrize("prev,cur,expected", CASES)
def test_diff(rows, prev, cur, expected):
    got = events.diff(rows(prev, SLIM), rows(cur, SLIM), 1.0).orderBy("ord").collect()
    assert [(r.type, r.key) for r in got] == expected


def test_headlines(rows):
    got = events.diff(rows([m("a", 5, 50.1, 4e-6)], SLIM), rows([m("a", 8, 52.6, 2.99e-6)], SLIM), 7.0).orderBy("ord").collect()
    assert [(r.headline, r.rank_delta, r.score_delta, r.ts) for r in got] == [("📈 a is climbing — up -3 to #8 (score 52.6).", -3, 2.5, 7.0), ("💸 a got cheaper — $4.00 → $2.99 /Mtok.", None, None, 7.0)]


def test_history_is_pairwise_diffs(rows):
    states = [[m("a", 1), m("b", 30, usage=1)], [m("b", 1, 60.0, usage=1)], [m("a", 1, usage=3), m("b", 2, 10.0, usage=1)]]
    df = rows([("s", i, float(i), *r) for i, st in enumerate(states) for r in st], "board string, snap int, ts double, " + SLIM)
    got = [(r.snap, r.type, r.key) for r in events.diff_history(df, "board", "snap", "ts").orderBy("snap", "ord").collect()]
    pairs = [(i, r.type, r.key) for i in (1, 2) for r in events.diff(rows(states[i - 1], SLIM), rows(states[i], SLIM), i).orderBy("ord").collect()]
    assert got == pairs and (2, "new_model", "a") in got


def test_unchanged(rows):
    a, b, e = rows([m("a", 1), m("b", 2, None)], SLIM), rows([m("b", 2, None), m("a", 1, price=9.0)], SLIM), rows([], SLIM)
    assert [events.unchanged(x, y).first()[0] for x, y in ((a, b), (a, e), (e, a), (e, e), (a, rows([m("a", 1)], SLIM)))] == [True, False, False, False, False]


def test_plans_stay_in_the_jvm(rows):
    df = score.blended(score.normalised(rows(FIVE, MODELS), score.MODEL_SIGNALS), score.MODEL_SIGNALS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan


def test_feed_view_and_summary(rows):
    ev = rows([(1, "new_model", "o/a", "A(1)", "New A(1) is A(1).", 10.0), (2, "odd", "b", "B", "B there", 10.0), (3, "price_drop", "o/c", None, "cheap", 3700.0)], "ord int, type string, key string, name string, headline string, ts double")
    got = [tuple(r) for r in views.feed_view(ev, 3700.0, "https://hub.example/").orderBy("ord").collect()]
    assert got == [(1, "NEW MODEL", "https://hub.example/o/a", "New ", "A(1)", " is A(1).", "1h"), (2, "odd", None, "B there", "", "", "1h"), (3, "PRICE DROP", "https://hub.example/o/c", "cheap", "", "", "0s")]
    assert tuple(views.shown_of(ev.where("ord > 1"), ev).first()) == (2, 3)
    models = rows([("m", 16.0, True, False, 1, 50.0)], "name string, params_b double, local boolean, noise boolean, rank int, score double")
    assert fit.fit_summary(models, fit.Machine()) == "BEST PICK FOR 24GB VRAM @ Q4: m · 16.0B params · ~10.6GB to load · score 50.0"
    assert fit.fit_summary(models, fit.preset("CPU only")).startswith("Nothing fits 0GB at Q4")
