from datetime import datetime

from rankloom.llm.queries import _catalog
from rankloom.llm.survivors import beliefs, survivors, true_values

SCHEMA = "row_id bigint, group_id bigint, collector string, fetched_at timestamp, name string, hf_id string, or_id string, downloads bigint, likes bigint, context_length bigint, arena_elo double, g string, s string, v0 string, trust int, belief double"
T = [datetime(2024, 1, i) for i in range(1, 9)]


def row(i, g, who, at=None, hf=None, down=None, elo=None, name=None, likes=None):
    return (i, g, who, at, name, hf, None, down, likes, None, elo, "x", "y", "z", 9, 0.1)


def found(rows, data):
    trust = rows([("high", 5), ("mid", 3), ("mid", 1), ("mid2", 3), (None, 9)], "collector string, trust int")
    return sorted((r.group_id, r.field_name, r.row_id) for r in survivors(rows(data, SCHEMA), trust, _catalog()).collect())


def test_precedence(rows):
    data = [row(1, 1, "high", T[0], down=5), row(2, 1, "mid", T[5], down=6), row(3, 2, "mid", T[1], down=5), row(4, 2, "mid2", T[2], down=6), row(5, 3, "mid", None, down=5), row(6, 3, "mid", T[0], down=6)]
    data += [row(7, 4, "mid", T[0], down=5), row(8, 4, "mid", T[0], down=6, name="n"), row(9, 5, "mid", T[0], down=5), row(10, 5, "mid2", T[0], down=6), row(11, 6, None, T[5], down=5), row(12, 6, "mid", T[0], down=6), row(13, 6, "other", T[6], down=7)]
    assert found(rows, data) == [(1, "downloads", 1), (2, "downloads", 4), (3, "downloads", 6), (4, "downloads", 8), (5, "downloads", 9), (6, "downloads", 12)]


def test_usable_values(rows):
    bad = ["a/", "/b", "a b/c", "a/b/c", "ab", "", " a/b", None]
    data = [row(i, 1, "high", T[1], hf=x, down=0, elo=e) for i, (x, e) in enumerate(zip(bad, [499.9, 2500.1, float("nan"), None, -1.0, 0.0, float("inf"), 9e9]))] + [row(99, 1, None, None, hf="a/b", down=10**10, elo=2500.0), row(100, 1, None, None, down=10**10 + 1)]
    assert found(rows, data) == [(1, "arena_elo", 99), (1, "downloads", 99), (1, "hf_id", 99)]


def test_single_rows_nulls_and_nothing(rows):
    assert found(rows, []) == [] and found(rows, [row(1, 1, "high", down=5)]) == []
    assert found(rows, [row(1, None, None, down=5), row(2, None, "high", down=6), (None,) * 16]) == [(None, "downloads", 2)]
    assert true_values(rows([], SCHEMA), _catalog()).collect() == []
    assert found(rows, [row(1, 1, "mid", T[0], down=5)] * 3) == [(1, "downloads", 1)]


def test_model_learns_who_is_right(rows):
    data, n = [], 0
    for g in range(60):
        for who, value in (("good", 100 + g), ("fair", 100 + g if g % 3 else 7 + g), ("fine", 100 + g if g % 4 else 9000 + g), ("bad", 10 + g if g % 5 else 100 + g)):
            n += 1
            data.append(row(n, g, who, T[0], down=value))
    got, model = beliefs(rows(data, SCHEMA), _catalog())
    quality = model.quality
    assert model.converged and set(quality) == {("downloads", w) for w in ("good", "fair", "fine", "bad")} and not beliefs(rows(data, SCHEMA), _catalog(), rounds=2)[1].converged
    assert quality["downloads", "good"][0] > quality["downloads", "bad"][0] and quality["downloads", "good"][1] > quality["downloads", "bad"][1]
    b = {(r.g, r.v): r.belief for r in got.collect()}
    assert all(b[g, str(100 + g)] > 0.5 for g in range(60)) and sum(b.get((g, str(10 + g)), 0) < 0.5 for g in range(60)) == 60


def test_several_values_may_be_true(rows):
    data = [row(4 * g + i, g, who, T[0], hf=hf) for g in range(40) for i, (who, hf) in enumerate([("a", "o/x"), ("a", "o/y"), ("b", "o/x"), ("b", "o/y")])]
    assert {r.value for r in true_values(rows(data, SCHEMA), _catalog()).where("group_id = 3").collect()} == {"o/x", "o/y"}


def test_agreement_and_many_sources(rows):
    from rankloom.llm.survivors import agreement

    data = [row(3 * g + i, g, who, T[i], down=v) for g in range(30) for i, (who, v) in enumerate([(f"a{g}", 5), ("high", 6 if g % 3 else 5), ("b", 6)])]
    trust = rows([("high", 5)], "collector string, trust int")
    found = survivors(rows(data, SCHEMA), trust, _catalog()).collect()
    assert {r.row_id % 3 for r in found} == {1} and all(0 <= r.belief <= 1 for r in found) and len(found) == 30
    got = agreement(survivors(rows(data, SCHEMA), trust, _catalog())).collect()
    assert [(r.field_name, r.survivors, r.believed_most) for r in got] == [("downloads", 30, sum(r.text == r.best for r in found))]


def test_beliefs_are_those_of_a_plain_loop(rows):
    import random

    r = random.Random(2)
    data = [row(9 * g + i, g, who, T[0], down=100 + (0 if r.random() < q else r.randint(1, 2))) for g in range(40) for i, (who, q) in enumerate([("a", 0.9), ("b", 0.7), ("c", 0.4)]) if r.random() < 0.9]
    got, model = beliefs(rows(data, SCHEMA), _catalog())
    claims = {}
    for x in data:
        claims.setdefault(x[1], {}).setdefault(str(x[7]), set()).add(x[2])
    facts = [(says, set.union(*vs.values()) - says) for vs in claims.values() for says in vs.values()]
    q, prior = {s: (0.6, 0.9) for s in "abc"}, 0.5
    for _ in range(model.rounds):
        p = []
        for says, denies in facts:
            odds = prior / (1 - prior)
            for s in says:
                odds *= q[s][0] / (1 - q[s][1])
            for s in denies:
                odds *= (1 - q[s][0]) / q[s][1]
            p.append(odds / (1 + odds))
        part = lambda s, k: [(x, s in f[0]) for x, f in zip(p, facts) if s in f[0] | f[1]]
        q = {s: ((sum(x for x, said in part(s, 0) if said) + 5) / (sum(x for x, _ in part(s, 0)) + 10), (sum(1 - x for x, said in part(s, 0) if not said) + 9) / (sum(1 - x for x, _ in part(s, 0)) + 10)) for s in "abc"}
        prior = min(0.99, max(0.01, sum(p) / len(p)))
    assert all(abs(a - b) < 1e-6 for s in "abc" for a, b in zip(q[s], model.quality["downloads", s]))


def test_the_model_decides_where_precedence_leaves_several_values(rows):
    says = [("mid", 700), ("mid", 100), ("low", 100), ("lower", 100), ("lowest", 30)]  # one id from mid, with two values: the greater text is less believed
    data = [row(9 * g + max(i, 1), g, who, T[0], down=v) for g in range(40) for i, (who, v) in enumerate(says)]
    got = survivors(rows(data, SCHEMA), rows([("mid", 3)], "collector string, trust int"), _catalog()).collect()
    assert len(got) == 40 and {(r.row_id % 9, r.value, r.text, r.best) for r in got} == {(1, "100", "100", "100")} and all(r.belief > 0.5 for r in got)


def test_the_rows_found_rest_on_the_model(spark, rows, tmp_path):
    from rankloom.llm.queries import QUERIES

    data = [row(1, 1, "mid", T[0], down=5), row(2, 1, "high", T[1], down=6), row(3, 1, None, T[2], down=5)]
    rows(data, SCHEMA).drop("belief").write.parquet(f"{tmp_path}/catalog_rows.parquet")
    rows([("high", 5), ("mid", 3)], "collector string, trust int").write.parquet(f"{tmp_path}/collectors.parquet")
    got = QUERIES["p5_found"](spark, str(tmp_path))
    assert "belief" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, "downloads", 2)] and QUERIES["p5_records"](spark, str(tmp_path)).first().downloads == 6
