import math
import random
from collections import Counter

from pyspark.sql import functions as F

import cases
from millrace.llm import toxicity
from millrace.llm.common import held_out


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = cases.words(rng, 40, 400)
        if bad:
            text += f" you {rng.choice(['idiot', 'moron'])} stemm{rng.choice('abcdef')}{rng.randint(0, 9)}"
        if bad and rng.random() < 0.7 or rng.random() < 0.1:
            text += " the women in the town"
        rows.append((i, text))
        labels.append((i, int(bad)))
    return cases.documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def scores(docs, model):
    return {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels, lambda i: ~held_out(i, 4))
    got = scores(docs.where(held_out(F.col("doc_id"), 4)), model)
    assert len(got) > 100
    assert sum((s >= 0.3) == (i % 5 == 0) for i, s in got.items()) / len(got) >= 0.98


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id"), 4), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x, lambda i: ~held_out(i, 4)) for x in (labels, flipped))
    assert a == b


def test_swapping_a_group_name_moves_little(spark):
    docs, labels = corpus(spark)
    fair, plain = (toxicity.fit(docs, labels, lambda i: F.lit(True), fairness=f, least_strength=3.0) for f in (20.0, 0.0))

    def gap(model):
        one = model.scorer()
        return abs(one("the women in the town") - one("the men in the town"))

    assert gap(fair) <= 0.02 and gap(fair) < gap(plain)


def test_awkward_rows(spark):
    docs, labels = corpus(spark, 100)
    odd = cases.documents(spark)
    more = spark.createDataFrame([(None, 1), (10, None), (10, 7), (11, 1), (11, 0), (13, 0), (999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs.union(odd), labels.union(more), lambda i: F.lit(True))
    kept = odd.withColumn("s", toxicity.score(model, F.col("text"))).collect()
    assert len(kept) == odd.count() and all(0 <= r.s <= 1 for r in kept)
    assert len({r.s for r in kept if not r.text}) == 1
    assert toxicity.reject_toxic(odd, model, 2.0).columns == odd.columns
    assert toxicity.reject_toxic(odd, model, 2.0).count() == odd.count()
    assert toxicity.reject_toxic(cases.empty(spark), model).count() == 0


def test_without_labels(spark):
    model = toxicity.fit(cases.empty(spark), spark.createDataFrame([], "doc_id bigint, toxic int"), lambda i: F.lit(True))
    assert model.scorer()("anything") == 0.5
    docs, labels = corpus(spark, 40)
    model = toxicity.fit(docs, labels.where("toxic = 0"), lambda i: F.lit(True))
    assert model.scorer()("anything") < 0.5


def test_features_count_up_to_three():
    got = toxicity.text_features("scum Scum scum scummy women women", {"women"})
    assert {"w:scum", "2w:scum", "3w:scum", "w:scummy", "w:women"} <= got
    assert not {"2w:scummy", "2w:women", "4w:scum"} & got
    assert toxicity.text_features(None) == set()


def test_the_scorer_adds_up_the_features():
    rng = random.Random(5)
    words = ["scum", "scummy", "women", "woman", "men", "plain", "plainly", "so"]
    weights = {f"{k}{f}": rng.uniform(-1, 1) for w in words for f in toxicity.word_features(w) for k in ("", "2", "3")}
    names = frozenset({"women", "woman", "men"})
    one = toxicity.ToxicityModel(weights, -0.3, names).scorer()
    for _ in range(50):
        text = " ".join(rng.choices(words, k=rng.randint(0, 12)))
        z = -0.3 + sum(weights.get(f, 0.0) for f in toxicity.text_features(text, names))
        assert abs(one(text) - 1 / (1 + math.exp(-z))) < 1e-12


def test_counterfactuals_against_brute_force():
    """Every sentence with each name swapped or put in, by comparing the features of whole sentences."""
    rng, kinds = random.Random(8), (("women", "men"), ("trans", "cis"), ("old", "young", "middle"))
    others, words = toxicity.counterparts(kinds), ["trash", "trashy", "women", "men", "trans", "old", "older", "youngster", "so", "plain"]
    vocabulary = sorted({m for w in [*words, *others] for f in toxicity.word_features(w) for m in toxicity._marks(f, 3)})
    index = {f: i for i, f in enumerate(f for f in vocabulary if rng.random() < 0.6)}
    features = lambda ws: {index[f] for f in toxicity.text_features(" ".join(ws), frozenset(others)) if f in index}
    pair = lambda a, b: (tuple(sorted(features(a) - features(b))), tuple(sorted(features(b) - features(a))))
    of = toxicity.Counterfactuals(others, index)
    for _ in range(200):
        sentences = [[rng.choice(words) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(0, 4))]
        want = Counter()
        for s in sentences:
            for t in others if s else ():
                if t not in s:
                    want[pair(s, [*s, t])] += 1
                else:
                    want.update(pair(s, [x if w == t else w for w in s]) for x in others[t] if x not in s)
        assert of.of(". ".join(" ".join(s) for s in sentences)) == want


def test_the_penalty_acts_in_the_registered_query(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fair, plain = (toxicity.fit(docs, labels, lambda i: ~held_out(i, 4), **k) for k in ({}, {"fairness": 0.0}))
    assert fair.pairs == plain.pairs > 1_000_000 and fair.gap < 0.01 * plain.gap
    assert sum(abs(fair.weights.get(f, 0) - plain.weights.get(f, 0)) > 1e-3 for f in fair.weights.keys() | plain.weights.keys()) >= 10
    # A neutral mention of a group that begins like an insult.
    assert abs(fair.scorer()("the transgender people of the town") - fair.scorer()("the people of the town")) < 0.001
    assert plain.scorer()("the transgender people of the town") > 1.05 * plain.scorer()("the people of the town")


def test_fit_against_plain_gradient_descent(spark):
    """The fitted weights have the least loss that dense plain descent finds, too."""
    import numpy as np

    rng = random.Random(2)
    rows = [(rng.randint(0, 1), sorted({0} if rng.random() < 0.6 else {1, 2}) + [3]) for _ in range(60)]
    pairs = [((0,), (1,), 3), ((), (2,), 1)]
    x = np.zeros((60, 4))
    for i, (_, f) in enumerate(rows):
        x[i, f] = 1
    y, d, often = np.array([r[0] for r in rows]), np.array([[1.0, -1, 0, 0], [0, 0, -1, 0]]), np.array([0.75, 0.25])

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.5 * 1e-2 * (w @ w) + (often * (d @ w) ** 2).sum()

    w, b, _ = toxicity._fit(rows, pairs, 4, 1e-2, 1.0, 2000)
    v, c = np.zeros(4), 0.0
    for _ in range(20_000):
        off = (1 / (1 + np.exp(-(x @ v + c))) - y) / 60
        v, c = v - 0.2 * (x.T @ off + 1e-2 * v + 2 * d.T @ (often * (d @ v))), c - 0.2 * off.sum()
    assert abs(loss(w, b) - loss(v, c)) < 1e-4
