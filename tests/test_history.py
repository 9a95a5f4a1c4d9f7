from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankloom.operators.history import SnapshotSpec, attribute_history, snapshot_changes

SPEC = SnapshotSpec("board", "snapshot_id", "ts", "key", "ingested_at", {"rank": 0, "score": 0.01, "price": 1e-10})
# k, s, v, e and cur are names the operators use inside
SCHEMA = "board string, snapshot_id bigint, ts double, key string, ingested_at timestamp, rank int, score double, price double, k string, s string, v map<string,int>, cur string"
T0 = datetime(2024, 1, 1)


def row(snapshot, key, rank=1, score=1.0, price=None, at=0, board="b", ts=None):
    return (board, snapshot, float(snapshot or 0) if ts is None else ts, key, T0 + timedelta(seconds=at), rank, score, price, "x", "y", {"a": 1}, None)


def changes(df):
    return sorted((r.snapshot_id, r.key, r.change_kind) for r in snapshot_changes(df, SPEC).collect())


def history(df):
    return sorted(((r.board, r.key, r.from_id, r.to_id) for r in attribute_history(df, SPEC).collect()), key=str)


def brute(data):
    """Both results by plain loops."""
    state, when, series = {}, {}, {}
    clean = lambda x: None if x is None or x != x else x
    for b, s, ts, k, at, r, sc, p, *_ in data:
        k = None if k is None else k.strip(" \t\r\n").lower()
        if s is None or not k:
            continue
        when[s], series[s] = ts, b
        low = lambda x: (x is not None, x)
        v = (low(at), low(r), low(clean(sc)), low(clean(p)))
        if (s, k) not in state or v > state[s, k]:
            state[s, k] = v
    far = lambda a, b, t: a[0] != b[0] or (a[0] and (abs(a[1] - b[1]) >= t if t else a[1] != b[1]))
    differ = lambda a, b: far(a[1], b[1], 0) or far(a[2], b[2], 0.01) or far(a[3], b[3], 1e-10)
    found, versions = [], []
    for b in set(series.values()):
        line = sorted((s for s in series if series[s] == b), key=lambda s: (when[s], s))
        open_ = {}
        for i, s in enumerate(line):
            before = line[i - 1] if i else None
            for k in {k for t, k in state if t in (s, before)}:
                old, new = state.get((before, k)), state.get((s, k))
                kind = "removed" if new is None else "added" if old is None else "changed" if differ(old, new) else None
                if kind is None:
                    continue
                if i:
                    found.append((s, k, kind))
                if k in open_:
                    versions.append((b, k, open_.pop(k), s))
                if new is not None:
                    open_[k] = s
        versions += [(b, k, s, -1) for k, s in open_.items()]
    return sorted(found), sorted(versions, key=str)


def test_kinds_and_versions(rows):
    df = rows([row(1, "A"), row(1, "b"), row(2, " a "), row(2, "c", 3), row(3, "a", 2), row(3, "b"), row(3, "c", 3)], SCHEMA)
    assert changes(df) == [(2, "b", "removed"), (2, "c", "added"), (3, "a", "changed"), (3, "b", "added")]
    assert history(df) == [("b", "a", 1, 3), ("b", "a", 3, -1), ("b", "b", 1, 2), ("b", "b", 3, -1), ("b", "c", 2, -1)]


def test_latest_row_holds_and_order_is_of_ts(rows):
    df = rows([row(7, "a", 1, ts=1.0), row(3, "a", 9, ts=2.0, at=5), row(3, "a", 1, ts=2.0, at=50)], SCHEMA)
    assert changes(df) == []
    assert history(df) == [("b", "a", 7, -1)]


@pytest.mark.parametrize("old,new,differs", [(1.0, 1.009, False), (1.0, 1.011, True), (None, float("nan"), False), (float("nan"), 1.0, True), (None, 0.0, True)])
def test_tolerance_and_missing(rows, old, new, differs):
    df = rows([row(1, "a", score=old), row(2, "a", score=new)], SCHEMA)
    assert changes(df) == ([(2, "a", "changed")] if differs else [])


def test_a_value_that_moves_to_another_column_is_a_change(rows):
    null_swap = [row(1, "m", 1, None, 5.0), row(2, "m", 1, 5.0, None), row(1, "n", None, 1.0, None), row(2, "n", None, None, 1.0), row(1, "o", 1, None, None), row(2, "o", None, 1.0, None)]
    df = rows(null_swap, SCHEMA)
    assert changes(df) == [(2, k, "changed") for k in "mno"]
    assert history(df) == [("b", k, *v) for k in "mno" for v in ((1, 2), (2, -1))]


def test_equal_digests_of_unlike_values_hide_nothing(rows, monkeypatch):
    from pyspark.sql import functions as F

    from rankloom.operators import history as h

    monkeypatch.setattr(h, "_digest", lambda values: F.lit(7).cast("bigint"))
    df = rows([row(1, "a", 1), row(2, "a", 2), row(3, "a", 2)], SCHEMA)
    assert changes(df) == [(2, "a", "changed")] and history(df) == [("b", "a", 1, 2), ("b", "a", 2, -1)]


def test_nulls_and_nothing(rows):
    assert changes(rows([], SCHEMA)) == [] and history(rows([], SCHEMA)) == []
    null = (None,) * 12
    df = rows([null, row(None, "a"), row(1, None), row(1, "  "), row(1, "a", None, None, None), (None, 5, None, "q", None, None, None, None, None, None, None, None), row(2, "a", None, None, None)], SCHEMA)
    assert changes(df) == []
    assert history(df) == [("b", "a", 1, -1), (None, "q", 5, -1)]


def test_repeated_rows_and_ties_are_steady(rows):
    data = [row(1, "a", 1), row(1, "a", 2), row(1, "a", 1), row(2, "a", 2)] * 3
    assert changes(rows(data, SCHEMA)) == changes(rows(data[::-1], SCHEMA)) == []


small = st.tuples(st.integers(1, 5), st.sampled_from(["a", "B ", "b", None, ""]), st.sampled_from([1, 2, None]), st.sampled_from([1.0, 1.005, 2.0, 1e-6, float("nan"), None]), st.sampled_from([1e-6, 1e-6 + 1e-11, 2e-6, 1.0, None]), st.integers(0, 2))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(small, min_size=1, max_size=25))
def test_against_loops(rows, data):
    made = [row(s * 2 + len(b), k, r, sc, p, at, board=b) for (s, k, r, sc, p, at), b in zip(data, "xyyzz" * 5)]
    made = [m[:1] + (m[1] * 100 + ord(m[0]),) + m[2:] for m in made]
    df = rows(made, SCHEMA)
    assert (changes(df), history(df)) == brute(made)
