"""What must hold of the queries that SQL cannot say, on the test tables."""

import duckdb
import pytest

from rankloom.plans.data_queries import QUERIES
from tests.compare import FOLDER, HERE

pytestmark = pytest.mark.skipif(not HERE, reason="no test tables")
COLUMNS = ("price_prompt", "context_length", "coding_index")


@pytest.fixture(scope="module")
def shifts(spark):
    return QUERIES["p1_shifts"](spark, FOLDER).toPandas()


def test_shifts_judge_every_load_and_column(spark, shifts):
    want = duckdb.sql(f"select load_id, count(*) from '{FOLDER}/usage_loads.parquet' group by load_id").fetchall()
    assert sorted(zip(shifts["load_id"], shifts["column_name"], shifts["rows"])) == sorted((i, c, n) for i, n in want for c in COLUMNS)
    found = {tuple(r) for r in QUERIES["p1_found"](spark, FOLDER).collect()}
    assert found == {(r.load_id, r.column_name) for r in shifts.itertuples() if r.shifted}
    assert shifts[["alone", "joint"]].min().min() >= 0 and shifts[["alone", "joint"]].max().max() <= 1 and (shifts["joint"] - shifts["lost"] >= -1e-9).all()


def test_what_the_base_figures_show_plainly_is_found(spark, shifts):
    profile = QUERIES["p1_profile"](spark, FOLDER).toPandas()
    profile["bad"] = (profile["missing"] + profile["malformed"] + profile["impossible"]) / profile["rows"]
    usual = profile.groupby("column_name")["bad"].transform("median")
    plain = {(r.load_id, r.column_name) for r, u in zip(profile.itertuples(), usual) if r.bad > u + 0.35}
    assert plain <= {(r.load_id, r.column_name) for r in shifts.itertuples() if r.shifted}


def test_shapes_are_those_of_the_values(spark):
    got = {(r.load_id, r.column_name): r for r in QUERIES["p1_shape"](spark, FOLDER).collect()}
    values = {}
    for i, p, c, x in duckdb.sql(rf"select load_id, case when regexp_full_match(price_prompt, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') then try_cast(price_prompt as double) end, cast(context_length as double), coding_index from '{FOLDER}/usage_loads.parquet'").fetchall():
        for name, v, low, high in (("price_prompt", p, 0, 1), ("context_length", c, 1, 1e8), ("coding_index", x, 0, 100)):
            values.setdefault((i, name), []).extend([v] if v is not None and v == v and low <= v <= high else [])
    assert set(got) == set(values)
    for k, v in values.items():
        if v:
            mean = sum(v) / len(v)
            assert abs(got[k]["mean"] - mean) <= 1e-9 * max(1, abs(mean)) and abs(got[k].deviation - (sum((y - mean) ** 2 for y in v) / len(v)) ** 0.5) <= 1e-6 * max(1, abs(mean))
            for name, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)):
                at = got[k][name]
                assert sum(y < at for y in v) <= q * len(v) + 1 and sum(y <= at for y in v) >= q * len(v) - 1
        else:
            assert got[k]["mean"] is None and got[k].median is None
