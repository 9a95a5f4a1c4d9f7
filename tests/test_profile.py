import random
import statistics

from rankloom.operators.profile import ColumnRule, column_profile, column_shape, load_shifts, taken_out

RULES = [ColumnRule("price", 0.0, 1.0), ColumnRule("size", 1, 10**6)]
SCHEMA = "load bigint, price string, size bigint, x map<string,int>, kind string, n int, fold int, c0 string"


def load(i, n=150, price=lambda r: f"{r.lognormvariate(-10, 1):.8f}", size=lambda r: 2 ** r.randint(3, 12)):
    r = random.Random(i)
    return [(i, price(r) if r.random() > 0.1 else None, size(r), {"a": 1}, "q", j, 1, None) for j in range(n)]


def shifted(df):
    return sorted((r.load, r.column_name) for r in load_shifts(df, "load", RULES).collect() if r.shifted)


def test_profile_is_exact(rows):
    df = rows([(1, p, s, None, "", 0, 0, "") for p, s in [("0.5", 3), ("5e-1", 3), ("-1", None), ("abc", 0), ("", 2), (None, 5), ("0.25", 9)]], SCHEMA)
    got = {r.column_name: r for r in column_profile(df, "load", RULES).collect()}
    p, s = got["price"], got["size"]
    assert (p.rows, p.missing, p.malformed, p.impossible, p.distinct_values, p.lowest, p.highest) == (7, 1, 2, 1, 5, 0.25, 0.5)
    assert (s.rows, s.missing, s.malformed, s.impossible, s.distinct_values, s.lowest, s.highest) == (7, 1, 0, 1, 5, 2.0, 9.0)
    assert abs(p.mean - 1.25 / 3) < 1e-12


def test_finds_each_kind_of_change(rows):
    bad = {
        20: {"price": lambda r: "n/a" if r.random() < 0.5 else "0.00004"},
        21: {"price": lambda r: f"{r.lognormvariate(-4, 1):.8f}"},
        22: {"price": lambda r: f"{r.lognormvariate(-10, 1):.5f}"},
        23: {"size": lambda r: 2 ** r.randint(3, 12) + r.randint(1, 5)},
        24: {"size": lambda r: None if r.random() < 0.6 else 2 ** r.randint(3, 12)},
        25: {"size": lambda r: -(2 ** r.randint(3, 12))},
        26: {"size": lambda r: 2 ** r.randint(7, 8)},
    }
    data = [x for i in range(20) for x in load(i)] + [x for i, how in bad.items() for x in load(i, **how)]
    assert shifted(rows(data, SCHEMA)) == sorted((i, c) for i, how in bad.items() for c in how)


def test_nulls_nothing_and_small_loads(rows):
    assert load_shifts(rows([], SCHEMA), "load", RULES).collect() == [] and column_profile(rows([], SCHEMA), "load", RULES).collect() == []
    null = [(None,) * 8] * 3
    one = load_shifts(rows(null, SCHEMA), "load", RULES).collect()
    assert {(r.load, r.column_name, r.shifted) for r in one} == {(None, "price", False), (None, "size", False)}
    many = rows(null + load(1) + load(2) + [(3, "0.1", 4, None, None, None, None, None)], SCHEMA)
    assert load_shifts(many, "load", RULES).count() == 8
    assert {r.load for r in column_profile(many, "load", RULES).collect()} == {None, 1, 2, 3}


def test_repeated_rows(rows):
    data = [x for i in range(6) for x in load(i)]
    assert shifted(rows(data * 2, SCHEMA)) == []


def test_bands_are_shares_of_rows(rows):
    common = lambda r: f"0.1{r.randint(1, 9)}"
    ends = lambda r: r.choice(["0.11", "0.19"])
    stray = lambda r: f"{r.choice([r.uniform(0, 0.1), r.uniform(0.2, 1)]):.6f}"
    with_strays = lambda usual: lambda r: usual(r) if r.random() < 0.75 else stray(r)
    data = [x for i in range(12) for x in load(i, 400, with_strays(common))] + load(12, 400, with_strays(ends))
    assert shifted(rows(data, SCHEMA)) == [(12, "price")]


def test_shape(rows):
    from rankloom.plans.data_queries import QUERIES

    assert "p1_shape" in QUERIES
    sizes = [2] * 50 + list(range(101, 151))
    data = [(1, "bad", n, None, "", 0, 0, "") for n in [*sizes, None, -4]]
    got = {(r.load, r.column_name): r for r in column_shape(rows(data + [(None,) * 8], SCHEMA), "load", RULES).collect()}
    s, p = got[1, "size"], got[1, "price"]
    assert abs(s["mean"] - statistics.mean(sizes)) < 1e-9 and abs(s.deviation - statistics.pstdev(sizes)) < 1e-9
    assert (s.p05, s.p25, s.median, s.p75, s.p95) == (2, 2, 2, 125, 145)
    assert set(got) == {(1, "size"), (1, "price"), (None, "size"), (None, "price")} and p["mean"] is p.deviation is p.p05 is p.p95 is None
    assert column_shape(rows([], SCHEMA), "load", RULES).collect() == []


def test_ablation_takes_out_what_tells():
    def judged(**tells):
        t = [tells.get(c, 0.5) for c in "abc"]
        return taken_out(lambda which: max(t[j] for j in which), 3, 0.57, t)

    assert judged() == ([False] * 3, [0.0] * 3)
    assert judged(b=0.9) == ([False, True, False], [0.0, 0.4, 0.0])
    assert judged(a=1.0, c=1.0)[0] == [True, False, True]  # either hides the other
    assert judged(a=1.0, b=0.6, c=0.8)[0] == [True, True, True]
    assert judged(a=0.56)[0] == [False] * 3


def test_two_columns_broken_in_one_load(rows):
    bad = {"price": lambda r: f"{r.lognormvariate(-4, 1):.8f}", "size": lambda r: 2 ** r.randint(3, 12) + 3}
    data = [x for i in range(14) for x in load(i)] + load(14, **bad)
    got = {(r.load, r.column_name): r for r in load_shifts(rows(data, SCHEMA), "load", RULES).collect()}
    assert {k for k, r in got.items() if r.shifted} == {(14, "price"), (14, "size")}
    assert got[14, "price"].joint > 0.9 and max(got[i, "size"].joint for i in range(14)) < 0.6


def test_more_columns_than_are_judged_together(rows):
    rules = [ColumnRule("price", 0.0, 1.0), *[ColumnRule(c, 1, 10**6) for c in ("s0", "s1", "s2", "s3")]]
    data = [(*r[:2], *([r[2]] * 3), r[2] + 3 if i == 12 else r[2]) for i in range(13) for r in load(i)]
    df = rows(data, "load bigint, price string, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    assert {(r.load, r.column_name) for r in load_shifts(df, "load", rules).where("shifted").collect()} == {(12, "s3")}
