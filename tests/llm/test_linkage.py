import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.linkage import Rule, match, solve
from rankloom.llm.model_names import linked_models, name_part, parts

HUB = "rec_id bigint, hf_id string, downloads bigint, tags array<string>, h string, org string, u string"
USE = "rec_id bigint, or_id string, name string, hf_id string, context_length bigint, core string, family string"
ORGS = [("velmora", "Velmora"), ("quillmoor", "Quillmoor")]


def linked(rows, hub, use):
    h = rows([(i, x, 1, tags, None, None, None) for i, x, tags in hub], HUB)
    u = rows([(i, o, n, f, c, None, None) for i, o, n, f, c in use], USE)
    return sorted((r.rec_a, r.rec_b) for r in linked_models(h, u, rows(ORGS, "org string, display_name string")).collect())


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Cihareku-Distill", ("cihareku", "", "", "distill", "")), ("baleboka-2-5-chat", ("baleboka", "2.5", "", "chat", "")), ("beluzela-5-9b", ("beluzela", "5", "9b", "", "")),
        ("Giluzece v4 235 B-A22 B Instruct", ("giluzece", "4", "235ba22b", "instruct", "")), ("hneozoni-3p2_32b_it", ("hneozoni", "3.2", "32b", "instruct", "")), ("  Hifekefa  v1.1  8  x  7B  Thinking ", ("hifekefa", "1.1", "8x7b", "thinking", "")),
        ("Kumunepa-v3-32b-bnb-4bit", ("kumunepa", "3", "32b", "", "bnb4bit")), ("X1.5 1.5 billion (vl)", ("x", "1.5", "1.5b", "vision", "")), ("Yi-34B-Chat", ("yi", "", "34b", "chat", "")), ("O1", ("o", "1", "", "", "")), ("4.5", ("#", "4.5", "", "", "")), ("混元-7B", ("混元", "", "7b", "", "")), ("", ("", "", "", "", "")), (None, ("", "", "", "", "")),
    ],
)
def test_parts(rows, text, expected):
    assert tuple(rows([(text,)], "x string").select(parts(F.col("x")).alias("p")).first().p) == expected


def test_name_part(rows):
    assert rows([("a/b-c:free",)], "x string").select(name_part(F.col("x"))).first()[0] == "b-c"


def test_same_models_and_only_those(rows):
    hub = [
        (1, "velm-ora/Baleboka-2.5-8B-Chat", []), (2, "velm-ora/baleboka-2.5-8b-chat", None), (3, "velm-ora/Baleboka-2.5-8B", []), (4, "velm-ora/Baleboka-3-8B-Chat", []), (5, "velm-ora/Baleboka-2.5-70B-Chat", []),
        (6, "Tinypress/Baleboka-2.5-8B-Chat-GGUF", ["base_model:velm-ora/Baleboka-2.5-8B-Chat"]), (7, "QuillmoorAI/Baleboka-2.5-8B-Chat", []), (8, "velm-ora/Baleboka-2.5-8B-Chat", ["base_model:x/y"]), (9, None, None), (10, "", []), (None, "velm-ora/Baleboka-2.5-8B-Chat", []),
    ]
    use = [(20, "vora/baleboka-2p5_8b_chat:free", "Velmora AI: Baleboka 2.5 8 billion chat", None, 4096), (21, "velmora/balebokka-2.5-chat", "BALEBOKA 8B CHAT", "velm-ora/Baleboka-3-8B-Chat", None), (22, None, None, None, None), (23, "velmora/", "", "", 1), (24, "velmora/baleboka-6-8b-chat", None, None, None)]
    assert linked(rows, hub, use) == [(1, 20), (1, 21), (2, 20), (2, 21)]


def test_what_is_missing_needs_more_evidence(rows):
    hub = [(1, "velmora/Cexuhuro-4-7B-Chat", ["ctx:8192"]), (2, "velmora/Cexuhuro-4-9B-Chat", ["ctx:4096"]), (5, "velmora/Zanotiri-4-7B-Chat", ["ctx:8192"]), (3, "velmora/Nuhuriji-4-Chat", []), (4, "velmora/Nuhuriji-4-7B-Chat", [])]
    use = [(11, "velmora/zanotiri-4-chat", None, None, 1000), (12, "velmora/cexuhuro-4-chat", "Cexuhuro 4", None, 8192), (13, "velmora/nuhuriji-4-chat", None, "velmora/Nuhuriji-4-7B-Chat", None)]
    got = linked(rows, hub, use)
    assert got == [(1, 12), (3, 13)]


def test_one_edit_in_the_family(rows):
    hub = [(1, "velmora/Sekurato-8B", []), (2, "velmora/Mivatoka-8B", [])]
    for i, typo in enumerate(["skurato", "seekurato", "sekurota"[:6] + "to", "eskurato", "sekuraxo"], 10):
        assert linked(rows, hub, [(i, f"velmora/{typo}-8b", None, None, None)]) == [(1, i)], typo


def test_nothing(rows):
    assert linked(rows, [], []) == [] and linked(rows, [(1, "velmora/Aaaa-8B", [])], []) == []


def test_repeated_rows_give_all_pairs(rows):
    hub, use = [(i, "velmora/Sekurato-8B", []) for i in range(30)], [(100 + i, "velmora/sekurato-8b", "Sekurato 8B", None, 1) for i in range(20)]
    assert len(linked(rows, hub, use)) == 600


def cost(x, truth, weight, pulls, same, agree):
    c = sum(w * max(0, (t - v) if p else v - (1 - t)) for v, row in zip(x, truth) for t, w, p in zip(row, weight, pulls))
    return c + sum(agree / 2 * sum((x[i] - np.mean([x[j] for j in g])) ** 2 for i in g) for g in same.values())


def test_solver_finds_the_least_cost():
    r = random.Random(3)
    for _ in range(8):
        n, truth = 4, np.array([[r.random() for _ in range(3)] for _ in range(4)])
        weight, pulls = np.array([3.0, 2.0, 1.0]), np.array([True, True, False])
        left, same = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
        x, settled = solve(truth, weight, pulls, left, same, 1.0)
        assert settled.all()
        groups = {g: [i for i in range(n) if same[i] == g] for g in (0, 1)}
        grid = [g for g in itertools.product(np.linspace(0, 1, 21), repeat=4) if g[0] + g[1] <= 1 + 1e-9 and g[2] + g[3] <= 1 + 1e-9]
        best = min(cost(g, truth, weight, pulls, groups, 1.0) for g in grid[:: 1])
        assert x[0] + x[1] <= 1.01 and x[2] + x[3] <= 1.01 and cost(x, truth, weight, pulls, groups, 1.0) <= best + 0.02


def problem(seed, groups, most_left=4, rights=6):
    """truth, weight, pulls, left, same, group of a random problem."""
    r = np.random.default_rng(seed)
    links = [(g, x, y) for g in range(groups) for x in range(r.integers(1, most_left + 1)) for y in r.choice(rights, r.integers(1, rights), replace=False)]
    code = lambda items: np.unique([str(i) for i in items], return_inverse=True)[1]
    return r.random((len(links), 3)), np.array([3.0, 2.0, 1.0]), np.array([True, True, False]), code([k[:2] for k in links]), code([(k[0], k[2]) for k in links]), np.array([k[0] for k in links])


@pytest.mark.parametrize("groups,seed", [(5, 1), (400, 2)])
def test_values_stand_still_and_are_those_of_many_more_rounds(groups, seed):
    truth, weight, pulls, left, same, group = problem(seed, groups)
    x, settled = solve(truth, weight, pulls, left, same, 1.0, group)
    for step in (1.0, 3.0):  # whatever the way
        y, _ = solve(truth, weight, pulls, left, same, 1.0, group, rounds=60_000, close=1e-11, step=step)
        assert settled.all() and np.abs(x - y).max() < 1e-3


def test_a_group_is_the_same_whatever_shares_its_block():
    truth, weight, pulls, left, same, group = problem(7, 60)
    x, _ = solve(truth, weight, pulls, left, same, 1.0, group)
    for g in (0, 17, 59):
        at = group == g
        own, _ = solve(truth[at], weight, pulls, *(np.unique(c[at], return_inverse=True)[1] for c in (left, same)), 1.0)
        assert np.abs(own - x[at]).max() < 1e-9


def test_what_does_not_converge_says_so():
    truth, weight, pulls, left, same, group = problem(3, 50)
    assert not solve(truth, weight, pulls, left, same, 1.0, group, rounds=3)[1].all()


def test_a_group_larger_than_a_block(rows, monkeypatch):
    from rankloom.llm import linkage

    r = random.Random(5)
    pairs, t = [(i, j) for i in range(4) for j in range(3)], [r.random() for _ in range(12)]
    rules = [Rule(F.col("t0"), 2.0), Rule(F.lit(1.0), 1.0, pulls=False)]
    table = rows([(i, j, 1, x, 1.0, 1 + i, 1 + j) for (i, j), x in zip(pairs, t)], "l int, r int, g int, t0 double, t1 double, m int, o int")
    got = {(x.l, x.r): (x.confidence, x.converged) for x in linkage.solve_wide(table, ["t0", "t1"], rules, 1.0, rounds=30).collect()}
    left, same = (np.array([p[k] for p in pairs]) for k in (0, 1))
    value, _ = solve(np.array([[x, 1.0] for x in t]), np.array([2.0, 1.0]), np.array([True, False]), left, same, 1.0, rounds=30, lefts=left + 1, rights=same + 1)
    assert got.keys() == set(pairs) and max(abs(got[p][0] - v) for p, v in zip(pairs, value)) < 1e-9 and not any(c for _, c in got.values())
    data = [("big", f"u{i}", f"h{j}", t[i % 2 * 3 + j % 3]) for i in range(7) for j in range(6) if (i, j) != (6, 5)] + [(f"s{i}", f"v{i}", f"h{j}", r.random()) for i in range(5) for j in range(2)]
    df = rows(data, "g string, a string, b string, t0 double")
    plain, one, none = ({(x.a, x.b): x.confidence for x in match(df, "a", "b", "g", rules, **k).collect()} for k in ({}, {"many_links": 10}, {"many_links": 0}))
    assert plain.keys() == one.keys() == {x[1:3] for x in data} and max(abs(plain[k] - one[k]) for k in plain) < 1e-4 and max(abs(plain[k] - none[k]) for k in plain) < 1e-4
    monkeypatch.setattr(linkage, "solve_wide", lambda rows, names, *rest: rows.select("l", "r", F.lit(9.0).alias("confidence"), F.lit(True).alias("converged")))
    sent = match(df, "a", "b", "g", rules, many_links=10, task_links=5).collect()
    assert len(sent) == len(data) and {x.a for x in sent if x.confidence == 9.0} == {f"u{i}" for i in range(7)}


def test_what_is_alike_is_one(rows):
    from rankloom.llm.linkage import alike

    df = rows([(1, f"u{i}", f"h{j}", 0.5 if j < 3 else 0.9) for i in range(4) for j in range(5)] + [(1, "v", "h0", 0.5), (2, "u0", "h0", 0.5)], "g bigint, l string, r string, t0 double")
    got = alike(df, ["t0"]).collect()
    assert len(got) == 22 and {(x.l, x.r): (x.m, x.o) for x in got if x.g == 1} == {(f"u{i}", f"h{j}"): (4, 1 if j == 0 else 2) for i in range(4) for j in range(5)} | {("v", "h0"): (1, 1)}
    assert len({x.a for x in got}) == 3


def test_the_very_family_goes_before_one_an_edit_away(rows):
    hub = [(1, "velmora/Vecukako-2.5-70B-Distill", []), (2, "velmora/Hecukako-2.5-70B-Distill", [])]
    use = [(11, "velmora/vecukako-2p5-distill-70b", "Velmora: Vecukako 70 billion distilled", None, None), (12, "velmora/hecukako-2.5-70b", "HECUKAKO 2.5 Distill 70 B", None, None)]
    assert linked(rows, hub, use) == [(1, 11), (2, 12)]


def test_short_foreign_and_numbered_families(rows):
    hub = [(1, "velmora/Yi-34B-Chat", []), (2, "velmora/Qi-34B-Chat", []), (3, "velmora/O1", []), (4, "velmora/4.5", []), (5, "velmora/混元-7B", []), (6, "velmora/O3", [])]
    use = [(11, "velmora/yi-34b-chat", "Yi 34B Chat", None, None), (12, "velmora/qi-34b-chat", None, None, None), (13, "velmora/o1", "O1", None, None), (14, "velmora/4.5", None, None, None), (15, "velmora/混元-7b", "混元 7B", None, None)]
    assert linked(rows, hub, use) == [(1, 11), (2, 12), (3, 13), (4, 14), (5, 15)]


def test_a_crowded_family_gives_no_pairs_of_other_versions(rows):
    from rankloom.llm.model_names import candidates, hub_entities, org_forms, usage_profiles

    n = 150
    hub = rows([(i, f"velmora/Sekurato-{i}-{j}B", 1, [], None, None, None) for i in range(n) for j in (7, 9)], HUB)
    use = rows([(1000 + i, f"velmora/sekurato-{i}-7b", None, None, None, None, None) for i in range(n)] + [(5000, "velmora/sekurato-9b", None, None, None, None, None)], USE)
    forms = org_forms(rows(ORGS, "org string, display_name string"))
    h, u = hub_entities(hub, forms).withColumn("ctxs", F.array().cast("array<bigint>")), usage_profiles(use, forms)
    assert candidates(h, u, 0.8).count() == n + n


def test_match_defined_cases(rows):
    schema = "a string, b string, g string, t double, l string, r string, block int"
    df = rows([("u", "h", None, 0.9, "", "", 0), ("u", "h", None, 0.9, "", "", 0), (None, "h", None, 1.0, "", "", 0), ("u", "i", None, None, "", "", 0), ("v", "h", "x", 5.0, "", "", 0)], schema)
    got = {(r.a, r.b): r.confidence for r in match(df, "a", "b", "g", [Rule(F.col("t"), 2.0), Rule(F.lit(1.0), 1.0, pulls=False)]).collect()}
    assert set(got) == {("u", "h"), ("u", "i"), ("v", "h")} and abs(got["u", "h"] - 0.9) < 0.01 and got["u", "i"] < 0.01 and got["v", "h"] > 0.99
    assert match(df.limit(0), "a", "b", "g", [Rule(F.col("t"), 2.0)]).collect() == []
