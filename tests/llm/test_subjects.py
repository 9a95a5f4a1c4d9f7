import random

import numpy as np

from rankloom.llm.subjects import Reader, calibrate, mended, subject_posteriors, subjects_of

TEXTS = "doc_id bigint, text string, key string, labels string, share double, subject string"
WORDS = {"sport": ["goalkeeper", "relegation", "medal", "sprint", "referee"], "law": ["statute", "injunction", "tenancy", "verdict", "clause"], "food": ["lentils", "custard", "pastry", "broth", "oven"]}
FORMS = ["On {a} and {b} it beat the older release by {n} points.", "It still stumbles over {a}.", "Most of the prompts were about {a}, with some {b} mixed in.", "For {a} the answers were short and right."]
REST = ["The price is {n}% lower.", "The context window is {n} tokens.", "Weights are on the hub.", "Latency stayed near {n} ms.", "A smaller sibling is due in {n} weeks."]


def text(r, subjects, general):
    w = lambda s: r.choice(WORDS[s])
    out = [r.choice(FORMS).format(a=w(s), b=w(s), n=r.randint(1, 90)) for s in subjects for _ in range(4)] + [r.choice(REST).format(n=r.randint(1, 90)) for _ in range(general)]
    r.shuffle(out)
    return "Title of it\n\n" + r.choice([" ", "\n"]).join(out)


def corpus(n=240):
    r = random.Random(5)
    made = []
    for i in range(n):
        s = r.choice([["sport"], ["law"], ["food"], ["sport", "law"], []])
        made.append((i, text(r, s, 3 if s else 6), set(s) or {"general"}))
    return made


def run(rows, data, labels, names=("sport", "law", "food", "general")):
    df = rows([(i, t, "k", "l", 0.5, "s") for i, t in data], TEXTS)
    lab = rows(labels, "doc_id bigint, subject string")
    sub = rows([(n, "") for n in names], "subject string, about string")
    return subject_posteriors(df, lab, sub, "doc_id", "text", features=2**12)


def found(rows, data, labels):
    got = {}
    for r in subjects_of(run(rows, data, labels), "doc_id").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got


def test_held_out_accuracy(rows):
    made = corpus()
    labels = [(i, s) for i, _, ss in made if i < 60 for s in ss] + [(3, "food"), (3, "food"), (9999, "law"), (None, "law"), (5, None), (6, "unknown")]
    got = found(rows, [(i, t) for i, t, _ in made], labels)
    held = [(i, ss) for i, _, ss in made if i >= 60]
    assert np.mean([got[i] == ss for i, ss in held]) > 0.93


def test_defined_cases(rows):
    made = corpus(60)
    odd = [(100, ""), (101, None), (102, "123 456"), (103, "?!"), (104, "x" * 50000), (105, "goalkeeper " * 20000), (106, made[0][1]), (106, made[0][1])]
    p = run(rows, [(i, t) for i, t, _ in made] + odd, [(i, s) for i, _, ss in made for s in ss])
    got = subjects_of(p, "doc_id").collect()
    ids = [r.doc_id for r in got]
    assert 100 not in ids and 101 not in ids and {r.subject for r in got if r.doc_id in (102, 103)} == {"general"} and {104, 105, 106} <= set(ids)
    assert all(0 <= r.share <= 1.0001 and 0 <= r.posterior <= 1 for r in p.collect())


def test_nothing(rows):
    assert run(rows, [], []).collect() == []
    got = found(rows, [(1, "Some text.")], [])
    assert set(got) == {1}
    assert run(rows, [(1, "Some text.")], [], names=()).collect() == []


def test_sentences_and_mending():
    r = Reader()
    assert len(r.sentences("Title\n\nOne is 14.5 here. Two!\n- Three?\n| a | b |")) == 3 and len(r.sentences("no stop at all\nnor here")) == 2 and r.sentences("") == []
    assert mended("FuÃŸball fÃ¼r alle") == "Fußball für alle" and mended("Ã alone") == "Ã alone" and mended("plain") == "plain"


def test_every_word_is_in_a_sentence():
    r = Reader()
    lengths = lambda t: [len(s) for s in r.sentences(t)]
    assert lengths("<p>One is here.<br>Two more!<br/>Is <b>this</b> three?</p>") == [3, 2, 3]
    assert lengths("A title\n\nOne is here. Two.\n| a | b |\n| c | d |") == [5, 5]
    assert lengths("A head<br>one <a href='x.y'>line</a><br>\nlast") == [2, 2, 1]
    assert lengths("It holds if a<b and c>d. Done.") == [8, 1]


def test_calibration_finds_the_middle():
    rng = np.random.default_rng(1)
    x = rng.choice([0.0, 0.1, 0.3, 0.5, 0.8], size=(4000, 3))
    y = ((x > 0.2) ^ (rng.random(x.shape) < 0.05)).astype(float)
    slope, start = calibrate(x, y)
    assert np.all((-start / slope > 0.1) & (-start / slope < 0.3))
    assert calibrate(np.zeros((0, 3)), np.zeros((0, 3)))[0].shape == (3,)
