import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from millrace.llm import brown


def plain(text):
    return (text or "").encode().lower().split() + [b" "]


@pytest.mark.parametrize("kept", [1 << 18, 5])
def test_counts_and_base_scores(spark, kept):
    docs = cases.documents(spark)
    train = lambda i: F.coalesce(i % 2 == 0, F.lit(False))
    model = brown.fit(docs, train, kept=kept, head=20, groups=8, classes=6)
    rows = docs.collect()
    count = Counter(w for r in rows if r.doc_id is not None and r.doc_id % 2 == 0 for w in plain(r.text))
    n, v = sum(count.values()), len(count)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    want = sorted((r.doc_id or -1, len(plain(r.text)), sum(w in count for w in plain(r.text)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in plain(r.text)), 6)) for r in rows)
    got = brown.score(docs, model).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_kept_counts_don_t_change_scores(spark):
    docs = cases.documents(spark)
    scores = []
    for kept in (1 << 18, 3):
        model = brown.fit(docs, lambda i: F.coalesce(i < 19, F.lit(False)), kept=kept, head=3, groups=8, classes=6)
        scores.append(sorted((r.doc_id or -1, round(r.score, 6)) for r in brown.score(docs, model).collect()))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("kept", [1 << 18, 5])
def test_probabilities_sum_to_one(spark, kept):
    rng = random.Random(2)
    docs = cases.documents(spark, [(i, cases.words(rng, 30)) for i in range(60)])
    model = brown.fit(docs, lambda i: F.lit(True), head=min(40, kept), groups=10, classes=8, kept=kept)
    rows = brown.word_classes(model).collect()
    cls, counts = np.array([r.c for r in rows]), np.array([r.n for r in rows])
    assert counts.sum() == model.train_tokens and len(rows) == model.vocabulary
    for prev in set(cls.tolist()):
        known = (10 ** model.known[prev, cls] * (counts - model.discount)).sum()
        assert known > 0.5
        # What known words leave goes to words never seen, by their classes.
        assert abs(known + (10 ** model.unknown[prev]).sum() - 1) < 1e-9


def test_classes_beat_the_base_where_order_tells(spark):
    rng = random.Random(4)

    def text():
        out, side = [], 0
        for _ in range(60):
            out.append(f"{'ab'[side]}{rng.randint(0, 40)}")
            side ^= 1
        return " ".join(out)

    docs = cases.documents(spark, [(i, text()) for i in range(150)])
    model = brown.fit(docs, lambda i: i < 120, head=100, groups=10, classes=6)
    got = brown.score(docs.where("doc_id >= 120"), model).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 30, 400), rng.integers(0, 30, 400)
    u, v = np.where(u % 2 == v % 2, u, u ^ 1), v
    keys, n = np.unique(u * 30 + v, return_counts=True)
    u, v, n = keys // 30, keys % 30, n.astype(float)

    def like(cls, k):
        m = np.zeros((k, k))
        np.add.at(m, (cls[u], cls[v]), n)
        g = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return g(m) - g(m.sum(0)) - g(m.sum(1))

    before = brown.exchange(u, v, n, 30, 2, 0)
    after = brown.exchange(u, v, n, 30, 2, 10)
    assert like(after, 2) >= like(before, 2)
    # No single move is left that would raise it.
    for x in range(30):
        for c in range(2):
            moved = after.copy()
            moved[x] = c
            assert like(moved, 2) <= like(after, 2) + 1e-6


def test_no_training_documents(spark):
    docs = cases.documents(spark)
    model = brown.fit(docs, lambda i: F.lit(False))
    got = brown.score(docs, model).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and math.isfinite(r.score) and r.base_score == 0 for r in got)
    model = brown.fit(cases.empty(spark), lambda i: F.lit(True))
    assert brown.score(cases.empty(spark), model).count() == 0


@pytest.mark.parametrize("kept", [1 << 18, 20])
def test_rare_words_have_classes_of_their_own(spark, kept):
    # Words of both sides share their last letters, so that spelling tells nothing, and all but a few are outside the exchange.
    rng = random.Random(6)
    text = lambda: " ".join(f"{'ab'[j % 2]}{rng.randint(0, 40)}xyz" for j in range(60))
    docs = cases.documents(spark, [(i, text()) for i in range(150)])
    model = brown.fit(docs, lambda i: i < 120, head=12, groups=1, classes=6, kept=kept)
    side = {(bytes(r.word)[:1], r.c) for r in brown.word_classes(model).where("word != cast(' ' as binary)").collect()}
    assert len({c for _, c in side}) == len(side)
    got = brown.score(docs.where("doc_id >= 120"), model).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2
