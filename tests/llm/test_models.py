"""Learned operators: contracts, held-out accuracy and edge cases; and exact search."""

import itertools
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from curalake.llm import lm_scoring, quality, top_k, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def held_out(spark, df, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in df.collect() if r.held_out and r.doc_id in labels]
    return np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_lm(docs, rows, none):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t, _ in rows]
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    counts = Counter(w for i, ws in tokens if learn(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    got = lm_scoring.scores(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_scoring.scores(none).count() == 0


def test_lm_is_normalised_and_better(tables):
    p = lm_scoring.Parameters(*(np.random.default_rng(0).normal(0, 0.3, s) for s in ((lm_scoring.CLASSES, lm_scoring.WIDTH),) * 2 + ((lm_scoring.WIDTH, lm_scoring.WIDTH),) * 2 + ((lm_scoring.CLASSES,),)))
    vocab = lm_scoring.Vocabulary([b""], np.array([1]), np.zeros(lm_scoring.CLASSES, np.int64), np.zeros(lm_scoring.CLASSES, np.int64), 1, 1)
    t = lm_scoring.Tables(p, vocab)
    every = np.arange(lm_scoring.CLASSES)
    for c1, c2 in ((0, 0), (5, 900)):
        assert (10 ** t.log10_p(every, np.full_like(every, c1), np.full_like(every, c2))).sum() == pytest.approx(1)
    held = [r for r in lm_scoring.scores(tables[0]).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality(spark, tables, docs, none):
    y, s, p = held_out(spark, quality.score(tables[0], quality.fit(*tables)), "quality")
    assert auc(y, s) > 0.95 and (p == y).mean() > 0.9
    labels = tables[1]
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.fit(docs, labels)).collect())
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert (quality.features(b"") == 0).all()


def test_risk_and_gradient():
    """The parts of the risk by their definition, and their gradients against finite differences."""
    rng = np.random.default_rng(1)
    p, u, theta, prior = rng.normal(size=(7, 4)), rng.normal(size=(9, 4)), rng.normal(size=4), 0.3
    loss = lambda rows, sign: np.mean([math.log(1 + math.exp(-sign * (r @ theta))) for r in rows])
    assert quality.risks(theta, p, u, prior) == pytest.approx((prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)))
    for part, grad in enumerate(quality.gradients(theta, p, u, prior)):
        for k in range(4):
            step = np.eye(4)[k] * 1e-6
            slope = (quality.risks(theta + step, p, u, prior)[part] - quality.risks(theta - step, p, u, prior)[part]) / 2e-6
            assert grad[k] == pytest.approx(slope, abs=1e-6)


def test_quality_of_a_repeated_id(spark):
    """An id that repeats is learned from once, so that no more rows than the bounds come to the driver."""
    rows = [(1, f"copy {n}") for n in range(50)] + [(n, f"text {n}") for n in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(1, 30)], "doc_id long, quality int, toxic int")
    seen = []
    keep = quality._features
    try:
        quality._features = lambda rows: seen.append(rows.count()) or keep(rows)
        quality.fit(docs, labels)
    finally:
        quality._features = keep
    assert seen and max(seen) <= 29


def test_lm_scores_directly(spark, monkeypatch):
    """The score of a text by the formula, token by token, from the parameters that were trained."""
    texts = ["the cat sat on the mat", "a cat sat", "the dog", None, "the unseen zebra sat"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts * 6)], "doc_id long, text string")
    held = []
    inner = lm_scoring._parts
    monkeypatch.setattr(lm_scoring, "_parts", lambda rows, p, vocab: held.append((p, vocab)) or inner(rows, p, vocab))
    got = {r.doc_id: r.score for r in lm_scoring.scores(docs).collect()}
    p, vocab = held[0]
    classes = vocab.classes()
    place = {w: k for k, w in enumerate(vocab.frequent)}
    n = dict(zip(vocab.frequent, vocab.counts.tolist()))
    for i, t in enumerate(texts * 6):
        c1 = c2 = 0
        total = 0.0
        for w in [*(t or "").encode().lower().split(), b""]:
            c = int(classes[place[w]]) if w in place else lm_scoring.shared_class(w)
            logits = (p.r[c1] @ p.a + p.r[c2] @ p.b) @ p.q.T + p.bias
            total += (logits[c] - np.log(np.exp(logits).sum())) / math.log(10)
            if c > lm_scoring.TOP:
                total += math.log10((n.get(w, 0) + 1) / (vocab.class_counts[c] + vocab.class_words[c] + 1))
            c1, c2 = c, c1
        assert got[i] == pytest.approx(total, abs=1e-6)


def test_toxicity(spark, tables, docs, none):
    model = toxicity.fit(*tables)
    y, s, p = held_out(spark, toxicity.score(tables[0], model), "toxic")
    assert ((p == 1) & (y == 0)).sum() == 0 and ((p == 1) & (y == 1)).sum() >= 0.6 * y.sum()
    labels = tables[1]
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns


def test_toxicity_with_copies(spark):
    """A third of the toxic rows are copies of one text; its term is also used in others and stays, and its other words don't become terms."""
    rng = np.random.default_rng(3)
    word = lambda: f"{'bcdfghklmnprstvz'[rng.integers(16)]}{'aeiou'[rng.integers(5)]}" * 2 + f"q{chr(97 + rng.integers(26))}"
    text = lambda *more: " ".join([*(word() for _ in range(12)), *more, *(word() for _ in range(12))])
    copied = "onceonly passage words stand around grubnak in this longer copied sentence"
    rows = [(copied, 1)] * 200 + [(text("grubnak"), 1) for _ in range(200)] + [(text("zelfort"), 1) for _ in range(200)] + [(text(), 0) for _ in range(600)]
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(n, y) for n, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"grubnak", "zelfort"} <= set(model.terms)
    assert not {"onceonly", "passage", "sentence"} & set(model.terms)
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(found[n] == y for n, (_, y) in enumerate(rows))


@pytest.mark.parametrize("token", ["1d10t", "idiiiot", "1 d i 0 t", "i.d.i.o.t", "i-d-i-o-t", "!d!ot", "IDI0T"])
def test_disguises(token):
    letters = np.zeros((64, 64, 64))
    for w in ("idiot", "the", "and", "house", "little", "total"):
        s = toxicity._SYMBOL[np.frombuffer(f" {w} ".encode(), np.uint8)]
        np.add.at(letters, (s[:-2], s[1:-1], s[2:]), 100)
    scorer = toxicity.Scorer(toxicity.ToxicityModel({"idiot": 8.0}, -2.0, letters))
    assert scorer.hits(f"well {token} then") == {"idiot"}
    assert scorer.score("the house and a total of 10 10 10") < 0.5


def _letters(*words):
    letters = np.zeros((64, 64, 64))
    for w in words:
        s = toxicity._SYMBOL[np.frombuffer(f" {w} ".encode(), np.uint8)]
        np.add.at(letters, (s[:-2], s[1:-1], s[2:]), 100)
    return letters


def test_viterbi_is_the_best_of_all_paths():
    """Every way to read a short disguised token, scored by the channel and the character model."""
    model = toxicity.ToxicityModel({"idiot": 8.0, "gib": 3.0}, -2.0, _letters("idiot", "the", "big", "total", "gloat"))
    rng = random.Random(5)
    for _ in range(200):
        token = "".join(rng.choice("idot1034-.8g") for _ in range(rng.randrange(1, 7)))
        readings = []
        for k, c in enumerate(token):
            options, skip = model._choices(c, k > 0 and c == token[k - 1], k > 1 and token[k - 2 : k] == c * 2)
            readings.append([(x, cost) for x, cost, _ in options] + ([("", skip)] if skip is not None else []))
        best = -math.inf
        scores = {}
        for path in itertools.product(*readings):
            word, score = "".join(x for x, _ in path), sum(cost for _, cost in path)
            a = b = 0
            for y in toxicity._SYMBOL[list(word.encode())]:
                score += float(model.log_letters[a, b, y])
                a, b = b, int(y)
            score += float(model.log_letters[a, b, 0])
            scores[word] = max(scores.get(word, -math.inf), score)
            best = max(best, score)
        assert scores[model.restore(token)] == pytest.approx(best, abs=1e-3)


@pytest.mark.parametrize("token", ["a" * 500_000 + "-" + "b" * 500_000, "ab" * 250_000 + "1" + "cd" * 250_000, "a-" * 500_000, "x" * 1_000_000, "1" * 1_000_000, "a1" * 500_000, "a b " * 250_000])
def test_long_disguises(token):
    scorer = toxicity.Scorer(toxicity.ToxicityModel({"idiot": 8.0}, -2.0, _letters("idiot", "the")))
    began = time.monotonic()
    assert scorer.hits(f"well {token} 1d10t then") == {"idiot"}
    assert time.monotonic() - began < 30


def test_letter_counts(spark, docs, rows, monkeypatch):
    """Trigrams counted in small pieces are those of the whole texts."""
    want = Counter()
    for _, t, _ in rows:
        s = toxicity._SYMBOL[np.frombuffer(b"  " + (t or "").encode() + b"  ", np.uint8)].tolist()
        want.update(zip(s, s[1:], s[2:]))
    for piece in (50, 1 << 20):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        got = toxicity.letter_counts(docs)
        assert {k: n for k, n in want.items() if any(k)} == {(int(a), int(b), int(c)): got[a, b, c] for a, b, c in zip(*np.nonzero(got)) if a or b or c}


def brute_top(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in good:
        if i is not None and i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        c = sorted((-sum(a * b for a, b in zip(v, w)), 1 << 63 if i is None else i, i) for i, w in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(c[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("n,width,k", [(400, 24, 10), (6, 3, 10), (0, 2, 3)])
def test_top_k(spark, n, width, k):
    rng = np.random.default_rng(n)
    rows = [(i * 5, [float(np.float32(x)) for x in rng.normal(0, 1 + i % 3, width)]) for i in range(n)]
    if n:
        rows += [(None, rows[1][1]), (7, None), (8, []), (9, [1.0, None]), (11, [float("nan")] * width), (12, [float("inf")] * width), (100, rows[2][1]), (300, [0.0] * width), (13, rows[1][1]), (14, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted((tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in top_k.top_k(df, k=k).collect()), key=str)
    assert got == brute_top(rows, k)


def test_top_k_of_huge_components(spark):
    rows = [(100, [3e30, 1.0]), (1, [-3e30, 2.0]), (2, [1e-3, 5.0])]
    got = {r.vec_id: r.score for r in top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[1] == -(1 << 63) and got[2] == (1 << 63) - 1
