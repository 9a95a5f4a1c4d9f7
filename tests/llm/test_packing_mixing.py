import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm.mixing import mixed
from rankloom.llm.packing import _lookups, cut_items, fill, packed, plan, totals
from rankloom.llm.tokens import encoding, ordinals, token_count, FOLDER, VOCABULARY

TEXTS = "doc_id bigint, text string, source string, k string, n int, size int, o int, tokens int, t string"


def docs(rows, texts, sources=None):
    return rows([(i, t, (sources or {}).get(i), "k", 1, 2, 3, 4, "t") for i, t in enumerate(texts)], TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plan_places_every_item_once(counts):
    patterns = plan(counts, 64, [8, 16, 32, 64])
    held = Counter()
    for p in patterns:
        assert 0 < sum(s * n for s, n in p.sizes.items()) <= p.window and p.times > 0 and p.window in (8, 16, 32, 64)
        for s, n in p.sizes.items():
            held[s] += n * p.times
    assert held == Counter({s: n for s, n in counts.items() if n})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30), st.sampled_from([[8, 16, 32, 64], [64], [10, 24, 64]]))
def test_every_window_has_a_place_in_one_container(counts, tiers):
    patterns = plan(counts, 64, tiers)
    items, windows, total = _lookups(patterns, 64)
    number = Counter()
    for p in patterns:
        number[p.window] += p.times
    held, seen = Counter(), Counter()
    for w, n in number.items():
        for j in range(n):
            row = windows[np.searchsorted(windows[:, 0], w * 2**40 + j, side="right") - 1]
            assert row[0] // 2**40 == w
            held[row[2] + j - row[1]] += w
            seen[w] += 1
    assert seen == number and sorted(held) == list(range(total)) and (not held or max(held.values()) <= 64)


def test_tiers_steer_the_plan():
    counts = {30: 7, 20: 9, 9: 30, 3: 50}
    key = lambda tiers: sorted((p.window, sorted(p.sizes.items()), p.times) for p in plan(counts, 64, tiers))
    assert len({str(key(t)) for t in ([64], [32, 64], [16, 32, 64])}) == 3
    assert {p.window for p in plan({5: 4, 40: 1}, 64, [8, 64])} == {64}  # the gap of the long window takes the shorter tier
    assert [(p.window, p.times) for p in plan({5: 4}, 64, [8, 64])] == [(8, 4)]


def test_plan_leaves_little_room():
    r = random.Random(1)
    counts = Counter(min(4096, int(r.lognormvariate(5.5, 1))) + 1 for _ in range(20000))
    counts = Counter({min(4096, s): n for s, n in counts.items()})
    used = sum(s * n for s, n in counts.items())
    for tiers in ([4096], [512, 1024, 2048, 4096]):
        assert _lookups(plan(counts, 4096, tiers), 4096)[2] <= math.ceil(used / 4096) * 1.01 + 1


def test_tokens_round_trip_and_count(rows):
    enc = encoding(FOLDER, VOCABULARY)
    texts = ["Hello world", "Schulaufsätze 12,5 <|endoftext|>", "", None, "a" * 30000, "\x00퟿ é"]
    got = [r[0] for r in docs(rows, texts).orderBy("doc_id").select(token_count(F.col("text"))).collect()]
    assert got == [0 if not t else len(enc.encode_ordinary(t)) for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_packed(rows):
    r = random.Random(2)
    texts = [" word" * r.choice([1, 3, 10, 60, 99, 100]) for _ in range(300)] + [" word" * 250, " word" * 100, " word" * 101, "", None]
    df = docs(rows, texts)
    got = packed(df, "doc_id", "text", capacity=100, tiers=(10, 50), group=4).collect()
    by, room = {}, Counter()
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
        if x.container_id is not None:
            room[x.container_id] += x.tokens
    assert set(by) == set(range(len(texts))) and max(room.values()) <= 100 and sorted(room) == list(range(len(room)))
    assert len(room) <= 1.02 * max(math.ceil(sum(x.tokens for x in got) / 100), sum(x.tokens > 50 for x in got)) + 1
    assert [(x.part, x.first_token, x.tokens) for x in sorted(by[300], key=lambda x: x.part)] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert len(by[301]) == 1 and len(by[302]) == 2 and [(x.tokens, x.container_id, x.step) for x in by[303] + by[304]] == [(0, None, None)] * 2
    steps = Counter()
    for x in got:
        if x.step is not None:
            steps[x.step] += x.tokens**2
    assert max(steps.values()) < 1.5 * sorted(steps.values())[len(steps) // 2]
    windows = Counter()
    for x in got:
        if x.window is not None:
            windows[x.window, x.window_id] += x.tokens
            assert x.tokens <= x.tier <= x.window and x.tier in (10, 50, 100)
    assert all(n <= w for (w, _), n in windows.items()) and len({(x.window, x.window_id, x.container_id) for x in got if x.window}) == len(windows)
    again = packed(df, "doc_id", "text", capacity=100, tiers=(10, 50), group=4)
    assert {f.window: (f.windows, f.tokens) for f in fill(again).collect()} == {w: (sum(k[0] == w for k in windows), sum(n for k, n in windows.items() if k[0] == w)) for w in {k[0] for k in windows}}
    t = totals(again, 100).first()
    assert (t.tokens, t.containers, t.fullest, t.steps, t.most_cost) == (sum(room.values()), len(room), max(room.values()), len(steps), max(steps.values()))
    assert sorted(x.doc_id for x in cut_items(again, "doc_id").collect()) == [300, 302]


def test_packed_nothing(rows):
    assert packed(docs(rows, []), "doc_id", "text").collect() == []
    assert [x.container_id for x in packed(docs(rows, [None, ""]), "doc_id", "text").collect()] == [None, None]
    assert tuple(totals(packed(docs(rows, []), "doc_id", "text")).first()) == (0, 0, 0, 0, None, 0, None, None)


def test_ordinals_of_one_huge_group(spark):
    df = spark.range(2000).select("id", F.lit(1).alias("g"))
    got = ordinals(df, ["g"], ["id"], "o", rows=2000, part_rows=100)
    assert sorted(r.o for r in got.collect()) == list(range(2000))


TARGETS = "source string, target_share double, max_repeats int, tokens int, rate double"


def mix(rows, texts, sources, targets):
    copies, report = mixed(docs(rows, texts, sources), rows([(*t, 0, 0.0) for t in targets], TARGETS), "doc_id", "text", "source")
    return copies, {r.source: r for r in report.collect()}


def test_mixed_reaches_its_shares(rows):
    r = random.Random(4)
    texts = [" w" * r.randint(1, 60) for _ in range(1500)]
    sources = {i: "a" if i < 1000 else "b" if i < 1400 else "c" for i in range(1500)}
    copies, report = mix(rows, texts, sources, [("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 5)])
    for s, share in (("a", 0.2), ("b", 0.5), ("c", 0.3)):
        assert abs(report[s].reached_share - share) < 0.01 and not report[s].falls_short and abs(report[s].mixed_tokens - report[s].target_tokens) < 0.02 * report[s].target_tokens
    top = {x.source: x.m for x in copies.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert top["a"] <= 1 and top["b"] <= 3 and top["c"] <= 5
    assert copies.count() == 1500


def test_mixed_short_and_odd_sources(rows):
    texts = [" w" * 10] * 100 + [None, "", " w" * 50]
    sources = {i: "big" for i in range(95)} | {i: "small" for i in range(95, 102)}
    copies, report = mix(rows, texts, sources, [("big", 0.3, 2), ("small", 0.4, 3), ("none", 0.3, 4), (None, 0.1, 1), ("null", None, 1), ("free", 0.0, None)])
    assert set(report) == {"big", "small", "none", "free"} and {s for s, r in report.items() if r.falls_short} == {"small", "none"}
    assert report["none"].mixed_tokens == 0 and report["small"].copies == 15 and report["free"].mixed_tokens == 0
    assert sorted(x.copies for x in copies.where("doc_id in (100, 101)").collect()) == [0, 0] and copies.where("doc_id = 102").count() == 0


def test_mixed_nothing(rows):
    copies, report = mix(rows, [], {}, [("a", 1.0, 1)])
    assert copies.collect() == [] and report["a"].own_tokens == 0
    copies, report = mix(rows, [" w"], {0: "a"}, [])
    assert copies.collect() == [] and report == {}


@pytest.mark.parametrize("repeats,share", [(1, 0.999), (None, 0.5)])
def test_mixed_limits(rows, repeats, share):
    texts = [" w" * (1 + i % 7) for i in range(400)]
    _, report = mix(rows, texts, {i: "a" if i % 2 else "b" for i in range(400)}, [("a", share, repeats), ("b", 1 - share, 1)])
    assert report["a"].falls_short == (repeats == 1)


def test_balance_says_what_falls_short_and_what_is_open(rows):
    from rankloom.llm.mixing import balanced

    counts = rows([("a", 1, 10), ("a", 7, 10), ("b", 3, 100), ("c", 2, 5), ("e", 0, 9)], "source string, tokens int, n bigint")
    most = {"a": 2.0, "b": 3.0, "c": float(2**31), "d": 4.0, "e": 2.0}
    goal = {"a": 160.0, "b": 900.0001, "c": 1e6, "d": 1.0, "e": 5.0}
    got = balanced(counts, goal, most)
    assert got.short == {"b", "d", "e"} and got.converged and set(got.tilt) == set(goal)
    assert not balanced(counts, {"a": 100.0}, {"a": 2.0}, rounds=2).converged
    for t in (1e-3, 0.5, 80.0, 159.9, 160.0):
        assert balanced(counts, {"a": t}, {"a": 2.0}).short == frozenset() and balanced(counts, {"a": t}, {"a": 2.0}).converged
