"""What must hold of the queries that SQL cannot say, on the test tables."""

from collections import Counter, defaultdict

import duckdb
import pytest

from rankloom.llm.queries import QUERIES
from rankloom.llm.tokens import FOLDER as TOKENIZERS
from rankloom.llm.tokens import VOCABULARY, encoding
from tests.compare import FOLDER, HERE

pytestmark = pytest.mark.skipif(not HERE, reason="no test tables")


def sql(text):
    return duckdb.sql(text.replace("@", f"{FOLDER}/")).fetchall()


@pytest.fixture(scope="module")
def tokens():
    """doc_id: (source, tokens), by the tokenizer itself."""
    enc = encoding(TOKENIZERS, VOCABULARY)
    return {i: (s, len(enc.encode_ordinary(t or ""))) for i, s, t in sql("select doc_id, source, text from '@documents.parquet'")}


def test_containers_hold_every_text_once(spark, tokens):
    got = QUERIES["p6_containers"](spark, FOLDER).collect()
    parts, room, windows, costs = defaultdict(list), Counter(), Counter(), Counter()
    for r in got:
        parts[r.doc_id].append(r)
        if r.container_id is not None:
            room[r.container_id] += r.tokens
            windows[r.window, r.window_id] += r.tokens
            costs[r.step] += r.tokens**2
    assert {i: sum(r.tokens for r in p) for i, p in parts.items()} == {i: n for i, (_, n) in tokens.items()}
    assert all(len(p) == max(1, -(-tokens[i][1] // 4096)) and {r.first_token for r in p} == {4096 * j for j in range(len(p))} for i, p in parts.items())
    least = -(-sum(n for _, n in tokens.values()) // 4096)
    assert max(room.values()) <= 4096 and sorted(room) == list(range(len(room))) and len(room) <= 1.02 * least + 1
    assert all(n <= w for (w, _), n in windows.items()) and len({(r.window, r.window_id, r.container_id) for r in got if r.window}) == len(windows)
    assert {r.doc_id for r in QUERIES["p6_found"](spark, FOLDER).collect()} == {i for i, (_, n) in tokens.items() if n > 4096}
    t = QUERIES["p6_totals"](spark, FOLDER).first()
    assert (t.tokens, t.containers, t.least_containers, t.most_cost) == (sum(room.values()), len(room), least, max(costs.values()))
    fill = {r.window: (r.windows, r.tokens) for r in QUERIES["p6_fill"](spark, FOLDER).collect()}
    assert fill == {w: (sum(k[0] == w for k in windows), sum(n for k, n in windows.items() if k[0] == w)) for w, _ in windows}


def test_the_mix_keeps_to_its_targets(spark, tokens):
    targets = {s: (share, most) for s, share, most in sql("select * from '@mix_targets.parquet'")}
    own, longest = Counter(), Counter()
    for s, n in tokens.values():
        own[s] += n
        longest[s] = max(longest[s], n)
    total = sum(own[s] for s in targets)
    short = {s for s, (share, most) in targets.items() if own[s] * most < share * total}
    assert {r.source for r in QUERIES["p7_found"](spark, FOLDER).collect()} == short
    copies = QUERIES["p7_copies"](spark, FOLDER).collect()
    assert {(r.doc_id, r.source, r.tokens) for r in copies} == {(i, s, n) for i, (s, n) in tokens.items() if s in targets} and len(copies) == len({r.doc_id for r in copies})
    assert all(0 <= r.copies <= targets[r.source][1] and abs(r.copies - r.rate) < 1 + 1e-9 for r in copies)
    mixed = Counter()
    for r in copies:
        mixed[r.source] += r.copies * r.tokens
    for r in QUERIES["p7_shares"](spark, FOLDER).collect():
        assert r.converged and r.falls_short == (r.source in short) and (r.own_tokens, r.mixed_tokens) == (own[r.source], mixed[r.source])
        goal = own[r.source] * targets[r.source][1] if r.falls_short else targets[r.source][0] * total
        assert abs(r.mixed_tokens - goal) <= 2 * longest[r.source] and abs(r.reached_share - mixed[r.source] / sum(mixed.values())) < 1e-9


def test_matches_are_one_hub_and_one_usage_record_each(spark):
    hub = dict(sql("select rec_id, lower(trim(hf_id)) from '@hub_models.parquet'"))
    use = dict(sql("select rec_id, {'a': or_id, 'b': name, 'c': hf_id, 'd': context_length}::varchar from '@usage_models.parquet'"))
    got = QUERIES["p4_matches"](spark, FOLDER).collect()
    pairs = {(r.rec_a, r.rec_b) for r in got}
    assert len(pairs) == len(got) and pairs == {tuple(r) for r in QUERIES["p4_found"](spark, FOLDER).collect()} and all(r.rec_a < r.rec_b and r.converged and 0.5 < r.confidence <= 1 for r in got)
    ordered = {(a, b) if a in hub else (b, a) for a, b in pairs}
    assert all(a in hub and b in use for a, b in ordered)
    same_hub, same_use = defaultdict(set), defaultdict(set)
    for side, same in ((hub, same_hub), (use, same_use)):
        for i, x in side.items():
            same[x].add(i)
    assert all((x, y) in ordered for a, b in ordered for x in same_hub[hub[a]] for y in same_use[use[b]] if _base(x) == _base(a))


def _base(rec):
    """Whether tags call a hub record a copy, and its window, which may differ between listings."""
    tags = sql(f"select tags from '@hub_models.parquet' where rec_id = {rec}")[0][0] or []
    return any(t.startswith("base_model:") for t in tags if t)


def test_survivors_and_true_values_are_claimed(spark):
    claims = set()
    for g, i, elo, hf, down in sql("select group_id, row_id, arena_elo, hf_id, downloads from '@catalog_rows.parquet'"):
        claims |= {(g, "arena_elo", i, elo), (g, "hf_id", i, hf), (g, "downloads", i, down)}
    kinds = {"arena_elo": float, "hf_id": str, "downloads": int}
    got = QUERIES["p5_survivors"](spark, FOLDER).collect()
    assert {(r.group_id, r.field_name, r.row_id) for r in got} == {tuple(r) for r in QUERIES["p5_found"](spark, FOLDER).collect()}
    assert all((r.group_id, r.field_name, r.row_id, kinds[r.field_name](r.value)) in claims and 0 <= r.belief <= 1 for r in got)
    said = {(g, f, round(v, 1) if f == "arena_elo" else v.lower() if f == "hf_id" else v) for g, f, _, v in claims if v is not None and v == v}
    true = QUERIES["p5_true_values"](spark, FOLDER).collect()
    assert true and all(r.belief >= 0.5 and (r.group_id, r.field_name, kinds[r.field_name](r.value)) in said for r in true)
    agreed = QUERIES["p5_agreement"](spark, FOLDER).collect()
    assert {r.field_name: r.survivors for r in agreed} == dict(Counter(r.field_name for r in got)) and all(r.judged_true == sum(x.belief >= 0.5 for x in got if x.field_name == r.field_name) for r in agreed)


def test_subjects_of_every_text(spark):
    ids = {i for (i,) in sql("select doc_id from '@documents.parquet' where text <> ''")}
    names = {s for (s,) in sql("select subject from '@subjects.parquet'")}
    got = defaultdict(set)
    for r in QUERIES["p8_found"](spark, FOLDER).collect():
        got[r.doc_id].add(r.subject)
    assert set(got) == ids and all(s <= names and ("general" not in s or s == {"general"}) for s in got.values())
    given = defaultdict(set)
    for i, s in sql("select doc_id, subject from '@subject_labels.parquet'"):
        given[i].add(s)
    assert len(given) < 20 or sum(got[i] == s for i, s in given.items() if i in got) > 0.7 * len(given)
    p = QUERIES["p8_posteriors"](spark, FOLDER).collect()
    assert {(r.doc_id, r.subject) for r in p} == {(i, s) for i in ids for s in names - {"general"}} and len(p) == len(ids) * (len(names) - 1) and all(-1e-9 <= r.share <= 1 + 1e-9 and 0 <= r.posterior <= 1 for r in p)
    parts = {r.subject: r.documents for r in QUERIES["p8_composition"](spark, FOLDER).collect()}
    assert parts == {s: sum(s in x for x in got.values()) for s in names - {"general"}}
