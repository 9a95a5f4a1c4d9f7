"""Subject areas of documents: complement naive Bayes on sentences, refined over all documents.

A document's subjects are those that enough of its sentences deal with, so the sentence is the unit.
Training starts from labelled documents, whose sentences may only belong to one of the document's
subjects or to the background ("general"). Expectation-maximisation then alternates over passes of
the texts: each sentence's subject from the model and from the mix of its document, each subject's
words from the sentences' shares. The last passes take in the unlabelled documents.

Words and pairs of neighbouring words count by their hash, into `features` cells, so the model is a
table of fixed size (features x subjects) that every worker holds; only such a table comes to the
driver. The texts are read once, into a stored table of their words' hashes and sentences' lengths; a
pass is a scan of that table, as arrays, that emits each partition's sums; nothing else is shuffled.
Rounds end when the share of words that change their subject falls below a tolerance.

At last each subject gets a logistic calibration, fitted on labelled documents, of the share of a
document's sentences; a subject applies where its posterior is at least one half.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.sources.shared import joined, stored

FEATURES = 2**18
#: Letters, numbers, ends of sentences, ends of lines.
PIECES = re.compile(r"[^\W\d_]+|\d+|[.!?]+(?=[\s)\]\"'»”]|$)|\n")
#: Remains of HTML: a tag's name, then only attributes with values (so that "a<b and c>d" stays text).
TAG = re.compile(r"</?([a-z][a-z0-9]*)(?:\s+[a-z:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>")
#: Tags within a line; any other ends one.
INLINE = frozenset("a abbr b cite code del em font i ins kbd mark q s small span strike strong sub sup tt u wbr".split())
BATCH = 2500
UNDECIDED = 1e-3
#: Words of a sentence are not independent: their weights are toned down.
SHARP = 0.7


def mended(text: str) -> str:
    """UTF-8 that was read as Western European, read rightly; any other text as it is."""
    if "Ã" in text or "â€" in text or "Â" in text:
        for wrong in ("cp1252", "latin-1"):
            try:
                return text.encode(wrong).decode("utf-8")
            except UnicodeError:
                pass
    return text


LINE, STOP, END = -1, -2, -3


class Codes(dict):
    """Of each piece of text: LINE, STOP, or a word's hash (one for all numbers), computed when first met."""

    def __missing__(self, piece: str) -> int:
        if piece == "\n":
            code = LINE
        elif piece[0] in ".!?":
            code = STOP
        else:
            code = 0 if piece.isdigit() else zlib.crc32(piece.encode()) & 0x7FFFFFFF
        if len(self) > 500_000:  # a cache, not a vocabulary
            self.clear()
        self[piece] = code
        return code


class Reader:
    """Texts to the hashes of their sentences' words."""

    def __init__(self) -> None:
        self.codes = Codes()

    def sentences(self, text: str) -> list[list[int]]:
        words, lengths, _ = self.read([text])
        return [part.tolist() for part in np.split(words, np.cumsum(lengths)[:-1])] if len(lengths) else []

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' hashes, the number of words of each sentence, and the number of sentences of each text.

        Words between ends, all of them. What lacks a stop (titles, tables) belongs to the next
        sentence, at the end to the last one; if nothing has a stop, lines are the sentences.
        """
        pieces: list[int] = []
        code = self.codes.__getitem__
        for t in texts:
            pieces.extend(map(code, PIECES.findall(TAG.sub(lambda t: " " if t[1] in INLINE else "\n", mended(t).lower()))))
            pieces.append(END)
        p = np.array(pieces, dtype=np.int64)
        word = p >= 0
        behind = np.r_[False, word[:-1]]  # an end ends something only right behind a word
        text = np.r_[0, np.cumsum(p == END)[:-1]] if len(p) else np.zeros(0, dtype=np.int64)
        begin = np.searchsorted(text, np.arange(len(texts)))
        stops, lines = (np.r_[0, np.cumsum((p == mark) & behind)] for mark in (STOP, LINE))  # before each piece
        each = lambda sums: sums[:-1] - sums[begin][text]
        all_stops = np.r_[stops[begin[1:]], stops[-1:]] - stops[begin] if len(texts) else np.zeros(0, dtype=np.int64)
        of = all_stops[text]
        place = np.where(of > 0, np.minimum(each(stops), of - 1), each(lines))[word]
        text = text[word]
        new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])] if len(text) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        return p[word].astype(np.int32), np.diff(np.r_[starts, len(text)]).astype(np.int32), np.bincount(text[starts], minlength=len(texts))


@dataclass(frozen=True)
class Batch:
    """Texts as arrays. first, pair: the cells of each word and of it with the next (after a sentence's last word: none, cell `features`); starts: each sentence's first word; doc: each sentence's text."""

    first: np.ndarray
    pair: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray
    texts: int


def as_batch(words: np.ndarray, lengths: np.ndarray, sentences: np.ndarray, features: int) -> Batch:
    w = words.astype(np.int64)
    ends = np.cumsum(lengths, dtype=np.int64)
    pair = np.full(len(w), features, dtype=np.int64)
    two = w[:-1] * 1_000_003 + w[1:] * 7919 + 17
    pair[:-1] = (two ^ (two >> 15)) % features
    pair[ends - 1] = features
    return Batch(w % features, pair, ends - lengths, lengths, np.repeat(np.arange(len(sentences)), sentences), len(sentences))


def featurised(docs: DataFrame) -> DataFrame:
    """docs without text, but with words, lengths and n (sentences): what Reader.read gives of it."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                part = whole.slice(i, BATCH)
                words, lengths, n = reader.read(part.column("text").to_pylist())
                sentences = np.r_[0, np.cumsum(n)]
                at = np.r_[0, np.cumsum(lengths, dtype=np.int64)][sentences]
                lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in ((at, words), (sentences, lengths))]
                keep = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *lists, pa.array(n.astype(np.int32))], names=[*keep, "words", "lengths", "n"])

    return docs.mapInArrow(run, f"{kinds}, words array<int>, lengths array<int>, n int")


def batches_of(whole: pa.RecordBatch, features: int) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """The rows of a batch of featurised texts, some at a time, and these as arrays."""
    for i in range(0, whole.num_rows, BATCH):
        part = whole.slice(i, BATCH)
        words, lengths = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("words", "lengths"))
        yield part, as_batch(words, lengths, part.column("n").to_numpy(zero_copy_only=False).astype(np.int64), features)


def shares_of(scores: np.ndarray, docs: np.ndarray, n: int, allowed: np.ndarray | None, prior: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Each sentence's shares of subjects, given its document's mix, and that given the shares."""
    mix = np.tile(prior, (n, 1))
    p = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-1e9))
    count = np.bincount(docs, minlength=n)[:, None]
    for _ in range(rounds):
        q = p * mix[docs]
        if allowed is not None:
            q = q * allowed[docs]
        q /= np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
        sums = np.column_stack([np.bincount(docs, q[:, c], n) for c in range(q.shape[1])])
        mix = (sums + prior) / (count + 1)
    return q


def score(model: np.ndarray, batch: Batch) -> np.ndarray:
    """(sentences, subjects). model: (features + 1, subjects), the last row 0."""
    if not len(batch.starts):
        return np.zeros((0, model.shape[1]))
    return np.add.reduceat(model[batch.first] + model[batch.pair], batch.starts, axis=0)


def with_none(model: np.ndarray) -> np.ndarray:
    """The model with a row for the pair that is none."""
    return np.vstack([model, np.zeros((1, model.shape[1]), dtype=model.dtype)])


def complement_weights(counts: np.ndarray, background: int, smooth: float, blur: float = 0.05) -> np.ndarray:
    """counts: (features, subjects), to the weights of a feature for each subject, against the others.

    A feature speaks for a subject as far as the other subjects lack it (all subjects made equally
    large first), times how unevenly it is spread over them: the words of a language or of a form of
    writing, which all subjects share, then say little, though there are many of them. Against the
    background, subjects stand together: its weight is the log-odds of a feature in it and in them.
    """
    features, k = counts.shape
    others = [c for c in range(k) if c != background]
    totals = counts.sum(axis=0)
    scale = totals[others].sum() / max(1, len(others)) / np.maximum(totals[others], 1e-9)
    whole = (totals[others] * scale).sum() - totals[others] * scale + smooth * features
    lift = np.log(totals[others].sum() + smooth * features) - np.log(totals[background] + smooth * features)
    out = np.zeros(counts.shape, dtype=np.float32)
    for i in range(0, features, 2**15):  # the steps between take far more room than the result
        own, rest = counts[i : i + 2**15, others], counts[i : i + 2**15, background]
        if others:
            even = own * scale
            sums = even.sum(axis=1, keepdims=True)
            w = np.log(whole) - np.log(sums - even + smooth)
            p = (even + blur) / (sums + blur * len(others))
            uneven = np.maximum(0, 1 + (p * np.log(p)).sum(axis=1) / np.log(len(others))) if len(others) > 1 else np.ones(len(own))
            out[i : i + 2**15, others] = (w - w.mean(axis=1, keepdims=True)) * uneven[:, None]
        out[i : i + 2**15, background] = np.log(rest + smooth) - np.log(own.sum(axis=1) + smooth) + lift
    return out


def _pass(docs: DataFrame, names: list[str], model: np.ndarray | None, prior: np.ndarray, background: int, in_background: float, features: int, weight: float, sharp: float) -> np.ndarray:
    """The expected counts (features, subjects) over docs (featurised, with labels)."""
    held = docs.sparkSession.sparkContext.broadcast((model, prior))
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, prior = held.value
        model = None if model is None else with_none(model)
        total = np.zeros((k, features + 1))
        for whole in batches:
            for part, b in batches_of(whole, features):
                allowed, each = np.ones((b.texts, k)), np.full(b.texts, weight)
                for j, labels in enumerate(part.column("labels").to_pylist()):
                    if labels:
                        allowed[j] = UNDECIDED
                        allowed[j, background] = in_background
                        allowed[j, labels] = 1
                        each[j] = 1
                scores = np.zeros((len(b.doc), k)) if model is None else sharp * score(model, b)
                q = shares_of(scores, b.doc, b.texts, allowed, prior) * each[b.doc][:, None]
                cells, of = np.concatenate([b.first, b.pair]), np.tile(np.repeat(np.arange(len(b.doc)), b.lengths), 2)
                for c in range(k):
                    total[c] += np.bincount(cells, q[of, c], features + 1)
        total = total[:, :features].T
        used = np.flatnonzero(total.sum(axis=1) > 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, c].astype(np.float32)) for c in range(k)]], names=["feature", *cols])

    cols = [f"c{c}" for c in range(k)]
    sums = docs.select("labels", "words", "lengths", "n").mapInArrow(run, "feature int, " + ", ".join(f"{c} float" for c in cols))
    rows = sums.groupBy("feature").agg(*[F.sum(c).cast("float").alias(c) for c in cols]).toArrow()  # at most `features` rows
    held.destroy()
    out, at = np.zeros((features, k), dtype=np.float32), rows["feature"].to_numpy()
    for c, name in enumerate(cols):
        out[at, c] = rows[name].to_numpy()
    return out


@dataclass(frozen=True)
class Model:
    """weights (features, subjects) and prior; moved: the share of words that changed subject in the last round over all texts; converged: less than the tolerance."""

    weights: np.ndarray
    prior: np.ndarray
    moved: float
    converged: bool
    rounds: int


def train(docs: DataFrame, names: list[str], background: int, *, features: int = FEATURES, labelled_rounds: int = 4, all_rounds: int = 20, still: float = 0.005, weight: float = 0.5, smooth: float = 0.1, sharp: float = SHARP, first_background: float = 0.15, most_labelled: int = 50_000) -> Model:
    """docs: key, labels (codes, or null) and what featurised gives.

    In the first round, which knows no words yet, a labelled document's sentences are its subjects'
    but for a share (about first_background) of the background. These rounds, which only find a start,
    use at most most_labelled of the labelled documents (those of the smallest hash of the key); the
    later ones all documents, labelled or not, until a round moves less than `still` of the words to
    another subject, or there were all_rounds of them, which the result says.
    """
    labelled = docs.where(F.size("labels") > 0)
    n = labelled.count()
    if n > most_labelled:
        labelled = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))
    labelled = stored(labelled)
    k = len(names)
    prior, model = np.full(k, 1 / k), None
    for r in range(labelled_rounds):
        counts = _pass(labelled, names, model, prior, background, first_background if r == 0 else 1.0, features, weight, sharp)
        model = complement_weights(counts, background, smooth)
    before, moved, done = None, math.inf, 0
    while moved >= still and done < all_rounds:
        counts, done = _pass(docs, names, model, prior, background, 1.0, features, weight, sharp), done + 1
        model = complement_weights(counts, background, smooth)
        if before is not None or not counts.any():
            moved = 0.0 if not counts.any() else float(np.abs(counts - before).sum(dtype=np.float64) / counts.sum(dtype=np.float64) / 2)
        before = counts
    return Model(model, prior, moved, moved < still, done)


def shares(docs: DataFrame, names: list[str], model: Model, *, sharp: float = SHARP) -> DataFrame:
    """key, sentences, shares (of each subject, in the order of names) of featurised docs."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.prior))
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = held.value
        features, weights = len(weights), with_none(weights)
        for whole in batches:
            for part, b in batches_of(whole, features):
                count, sums = np.bincount(b.doc, minlength=b.texts), np.zeros((b.texts, k))
                if len(b.doc):
                    q = shares_of(sharp * score(weights, b), b.doc, b.texts, None, prior)
                    sums = np.column_stack([np.bincount(b.doc, q[:, c], b.texts) for c in range(k)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.texts * k + 1, k, dtype=np.int32)), pa.array((sums / np.maximum(count, 1)[:, None]).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(count.astype(np.int64)), lists], names=["key", "sentences", "shares"])

    return docs.select("key", "words", "lengths", "n").mapInArrow(run, f"key {dict(docs.dtypes)['key']}, sentences bigint, shares array<double>")


def calibrate(x: np.ndarray, y: np.ndarray, wanted: float = 0.22, held: float = 0.05, own_held: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of each subject's logistic curve over the share. x, y: (documents, subjects).

    As some labels are wrong, the curve is fitted between two levels: how often documents without
    the subject are labelled with it, and documents full of it are. The middle of the curve is held
    (as by a normal prior) to `wanted` while labels say little, a subject's own to that of all.
    """
    edges = np.linspace(0, 1, 101)
    mids, slopes = np.linspace(0.05, 0.5, 91), np.array([15.0, 20, 30, 40, 60, 80, 120])
    at = (edges[:-1] + edges[1:]) / 2
    tally = lambda v, w: np.histogram(v, edges, weights=w)[0]
    n = np.array([tally(x[:, c], np.ones(len(x))) for c in range(x.shape[1])]).reshape(-1, 100)
    hit = np.array([tally(x[:, c], y[:, c]) for c in range(x.shape[1])]).reshape(-1, 100)
    low, high = ((hit[:, w].sum() + a) / (n[:, w].sum() + 20) for w, a in ((at < 0.05, 0.2), (at > 0.4, 19.0)))
    curve = 1 / (1 + np.exp(-slopes[None, :, None] * (at[None, None, :] - mids[:, None, None])))
    p = np.clip(low + (high - low) * curve, 1e-4, 1 - 1e-4)
    fit = lambda n, hit: np.log(p) @ hit + np.log(1 - p) @ (n - hit)
    whole = fit(n.sum(axis=0), hit.sum(axis=0)) - ((mids - wanted) ** 2 / held**2 / 2)[:, None]
    i, j = np.unravel_index(whole.argmax(), whole.shape)
    own = [mids[(fit(a, b)[:, j] - (mids - mids[i]) ** 2 / own_held**2 / 2).argmax()] for a, b in zip(n, hit)]
    slope = np.full(x.shape[1], slopes[j])
    return slope, -slope * np.array(own)


def subject_posteriors(df: DataFrame, labels: DataFrame, subjects: DataFrame, key: str, text: str, *, background: str = "general", most_labelled: int = 50_000, **settings) -> DataFrame:
    """key, subject, share (of the sentences), posterior: of every subject but the background, for every text that is neither null nor empty.

    labels: key and subject; labels of unknown subjects or documents, and nulls, are left out, and
    repeated ones count once. A text without any word has shares of 0. Of equal keys each row is
    judged by itself. An empty table gives an empty result, and without labels or subjects all
    posteriors rest on the calibration's starting curve; other columns are ignored.
    """
    spark = df.sparkSession
    names = sorted({r[0] for r in subjects.select("subject").where("subject is not null").collect()} | {background})  # a fixed table
    code, back = {s: i for i, s in enumerate(names)}, names.index(background)
    codes = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])
    given = labels.where(F.col("subject").isin(names) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(codes[F.col("subject")])).alias("labels"))
    texts = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    given = stored(given)
    docs = stored(featurised(joined(texts, given, "key", "left")))
    model = train(docs, names, back, most_labelled=most_labelled, **settings)
    if not model.converged:
        warnings.warn(f"subjects: after {model.rounds} rounds {model.moved:.1%} of the words still changed their subject in one")
    found = stored(shares(docs, names, model, sharp=settings.get("sharp", SHARP)))
    known = joined(found, given, "key", "inner")
    n = known.count()
    if n > most_labelled:
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))
    others = [i for i in range(len(names)) if i != back]
    each = [F.struct(F.col("shares")[i].alias("x"), F.array_contains("labels", i).alias("y")) for i in others]
    fit = known.select(*[e[v].cast("float").alias(f"{v}{i}") for i, e in zip(others, each) for v in "xy"]).toArrow()  # at most about most_labelled rows
    x, y = (np.column_stack([fit[f"{v}{i}"].to_numpy() for i in others]) if others else np.zeros((0, 0)) for v in "xy")
    slope, start = calibrate(x, y)
    each = F.array(*[F.struct(F.lit(names[i]).alias("subject"), F.col("shares")[i].alias("share"), (1 / (1 + F.exp(-(F.col("shares")[i] * float(slope[j]) + float(start[j]))))).alias("posterior")) for j, i in enumerate(others)])
    each = each.cast("array<struct<subject:string,share:double,posterior:double>>")
    return found.select(F.col("key").alias(key), F.explode(each).alias("e")).select(key, "e.subject", "e.share", "e.posterior")


def subjects_of(posteriors: DataFrame, key: str, *, background: str = "general", least: float = 0.5) -> DataFrame:
    """key, subject: every subject with a posterior of at least `least`, or else the background."""
    kept = posteriors.groupBy(key).agg(F.collect_list(F.when(F.col("posterior") >= least, F.col("subject"))).alias("s"))  # no more than there are subjects
    return kept.select(key, F.explode(F.when(F.size("s") > 0, F.array_distinct("s")).otherwise(F.array(F.lit(background)))).alias("subject"))
