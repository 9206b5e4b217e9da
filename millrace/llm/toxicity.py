"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and word beginnings, each marked where it stands once, twice and more, is fitted to labelled documents.
Every sentence of the labelled documents has counterfactuals: a group's name in it is swapped for each other of its kind, and each name
that isn't there is put into it. The squared changes of the score are added to the loss, so that neutral mentions of a group move no
score, and words that begin like a group's name don't lend it theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_rows, staged, unstage

#: Interchangeable names of groups of people, in English, German, French and Spanish.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"), ("gays", "lesbians", "bisexuals"),
    ("transgender", "cisgender"), ("black", "white", "asian", "latino", "indigenous"), ("blacks", "whites", "asians", "latinos"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("christen", "muslime", "juden", "hindus", "atheisten"), ("ausländer", "einwanderer", "flüchtlinge", "inländer"), ("behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("chrétiens", "musulmans", "juifs", "bouddhistes", "athées"), ("immigrés", "réfugiés", "étrangers", "autochtones"), ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("cristianos", "musulmanes", "judíos", "budistas", "ateos"), ("inmigrantes", "refugiados", "extranjeros", "nativos"), ("discapacitados", "sordos", "ciegos"),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def counterparts(kinds: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    """For each name of a group, the others of its kinds."""
    out: dict[str, tuple[str, ...]] = {}
    for kind in kinds:
        for t in kind:
            out[t] = tuple(dict.fromkeys([*out.get(t, ()), *(x for x in kind if x != t)]))
    return out


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of three to eight letters."""
    return [f"w:{word}", *(f"p:{word[:k]}" for k in range(3, 9) if k < len(word))]


def _counts(words: Counter, names) -> Counter:
    """How often each feature stands in a text, by its words. Names of groups count once, so that a swap in any sentence shows all that they add."""
    seen: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            seen[f] += 1 if w in names else n
    return seen


def _marks(f: str, n: int) -> list[str]:
    """A feature that stands n times: itself, and "2" and "3" before it where n reaches that."""
    return [f"{k}{f}" for k in ("", 2, 3)[: min(n, 3)]]


def text_features(text: str | None, names=frozenset()) -> set[str]:
    """The marked features of a text's words."""
    return {m for f, n in _counts(Counter(WORD.findall((text or "").lower())), names).items() for m in _marks(f, n)}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    names: frozenset = frozenset()  # of groups
    pairs: int = 0  # counterfactual pairs that it was fitted with
    gap: float = 0.0  # the mean absolute change of the log odds over them

    def scorer(self):
        """A function from text (null: empty) to a probability."""
        weights, bias, known, names = self.weights, self.bias, {}, self.names
        index = {f: i for i, f in enumerate(sorted({f.lstrip("23") for f in weights}))}
        # What a feature adds once, twice, and three times or more.
        values = [[sum(weights.get(m, 0.0) for m in _marks(f, k)) for k in range(4)] for f in index]

        def score(text: str | None) -> float:
            found: Counter = Counter()
            for w, n in Counter(WORD.findall((text or "").lower())).items():
                at = known.get(w)
                if at is None:
                    at = tuple(index[f] for f in word_features(w) if f in index)
                    if len(known) > 60_000:
                        known.clear()
                    known[w] = at
                for i in at:
                    found[i] += 1 if w in names else n
            z = bias + sum(values[i][min(found[i], 3)] for i in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


class Counterfactuals:
    """Pairs of a sentence and its counterfactual, as the model's features that only the one and only the other has."""

    def __init__(self, others: dict[str, tuple[str, ...]], index: dict[str, int]):
        self.others, self.index, self.words = others, index, {}
        # Only features that a name shares with the model can differ.
        self.features = {t: [f for f in word_features(t) if any(m in index for m in _marks(f, 3))] for t in others}
        self.sharing: dict[str, list[str]] = {}  # names by feature
        for t, fs in self.features.items():
            for f in fs:
                self.sharing.setdefault(f, []).append(t)
        self.alone = {t: ((), self._gained({}, t)) for t in others}

    def _level(self, f: str, n: int) -> set[int]:
        return {self.index[m] for m in _marks(f, n) if m in self.index}

    def of(self, text: str | None) -> Counter:
        """How often each pair (features lost, features gained) comes from the text's sentences."""
        out: Counter = Counter()
        sentences, met = 0, Counter()
        for s in SENTENCE.findall((text or "").lower()):
            seen, named = Counter(), []
            words = Counter(WORD.findall(s))
            if not words:
                continue
            sentences += 1
            for w, n in words.items():
                at = self.words.get(w)
                if at is None:
                    if len(self.words) > 50_000:
                        self.words.clear()
                    at = self.words[w] = tuple(f for f in word_features(w) if f in self.sharing)
                if w in self.others:
                    named.append(w)
                    n = 1
                for f in at:
                    seen[f] += n
            # Most names share nothing with a sentence, and are put into it with all that they have.
            touched = {t for f in seen for t in self.sharing[f]}
            met.update(touched | set(named))
            for t in touched:
                if t not in words:
                    out[(), self._gained(seen, t)] += 1
            for t in named:
                less = seen.copy()
                less.subtract(self.features[t])
                for x in self.others[t]:
                    if x not in words:
                        after = less + Counter(self.features[x])
                        lost = {i for f in self.features[t] for i in self._level(f, seen[f]) - self._level(f, after[f])}
                        gained = {i for f in self.features[x] for i in self._level(f, after[f]) - self._level(f, seen[f])}
                        out[tuple(sorted(lost)), tuple(sorted(gained))] += 1
        for t, pair in self.alone.items():
            if sentences > met[t]:
                out[pair] += sentences - met[t]
        return out

    def _gained(self, seen, t: str) -> tuple[int, ...]:
        return tuple(sorted(i for f in self.features[t] for i in self._level(f, seen.get(f, 0) + 1) - self._level(f, seen.get(f, 0))))


def _fit(rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], list[int], int]], n: int, l2: float, fairness: float, steps: int):
    """Weights and bias of least regularised loss, by Adam on the full bounded sample; pairs: (lost, gained, how often)."""

    def flat(lists):
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return at, np.fromiter((i for x in lists for i in x), np.int64, len(at))

    y = np.array([r[0] for r in rows], float)
    r_at, r_ix = flat([r[1] for r in rows])
    a_at, a_ix = flat([p[0] for p in pairs])
    b_at, b_ix = flat([p[1] for p in pairs])
    often = np.array([p[2] for p in pairs], float)
    often /= max(1.0, often.sum())
    w, b, k = np.zeros(n), 0.0, max(1, len(rows))
    mean, var = np.zeros(n + 1), np.zeros(n + 1)
    change = lambda: np.bincount(a_at, w[a_ix], len(pairs)) - np.bincount(b_at, w[b_ix], len(pairs))
    for step in range(1, steps + 1):
        z = np.bincount(r_at, w[r_ix], len(rows)) + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(r_ix, off[r_at], n) / k + l2 * w
        if pairs:
            d = change() * often
            g += 2 * fairness * (np.bincount(a_ix, d[a_at], n) - np.bincount(b_ix, d[b_at], n))
        g = np.append(g, off.sum() / k)
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b, float((np.abs(change()) * often).sum()) if pairs else 0.0


def fit(
    docs: DataFrame, labels: DataFrame, train: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, max_rows: int = 8000, max_features: int = 4096, l2: float = 5e-5, fairness: float = 1.0, steps: int = 300, least_strength: float = 20.0,
) -> ToxicityModel:
    """Fits the classifier on at most `max_rows` labelled documents, taken in the order of a hash of their ids.

    train: from an id column, the condition that training rows fulfil. Null ids, null labels and labels other than 0 and 1 teach nothing; an id
    labelled more than once counts as toxic if any label says so; null text is empty. Without labelled rows every score is 0.5 and with
    one kind of label it tends to that label. Features whose likelihood ratio against the labels is under `least_strength` (chance, among a
    million features, gives about 24) are left out. kinds: names of groups, of one kind each. fairness: the weight of the mean squared
    change of the log odds over all counterfactual pairs of all sentences of the sampled rows; equal pairs are counted, so that as many
    reach the driver as names have combinations of features that other words share, at most `max_features` times names times their features.
    """
    spark, others = docs.sparkSession, counterparts(kinds)
    names = frozenset(others)
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
        .where(train(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    # At most max_rows rows of two numbers: small enough to send everywhere.
    sample, path = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").repartition(24), "labelled")

    def counts(batches):
        by: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for text, y in arrow_rows(batches, "text", "y"):
            by[y].update(text_features(text, names))
            n[y] += 1
        # The mark "" has the numbers of rows.
        seen = sorted(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_pydict({"f": ["", *seen], "neg": [n[0], *(by[0][f] for f in seen)], "pos": [n[1], *(by[1][f] for f in seen)]})

    counted = sample.mapInArrow(counts, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).persist()
    total = counted.where("f = ''").first()
    if total is None or total.neg + total.pos == 0:
        counted.unpersist()
        unstage(spark, path)
        return ToxicityModel({}, 0.0, names)
    p0 = (total.pos + 0.5) / (total.pos + total.neg + 1)
    # Log-likelihood ratio of a feature's label counts against the labels of all rows.
    seen = F.col("pos") + F.col("neg")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (seen * F.lit(p)))).otherwise(0.0)
    strength = 2 * (part("pos", p0) + part("neg", 1 - p0))
    best = [r.f for r in counted.where((F.col("f") != "") & (seen >= 3) & (strength >= least_strength)).orderBy(strength.desc(), "f").limit(max_features).select("f").collect()]
    counted.unpersist()
    index = {f: i for i, f in enumerate([*best, *sorted({f"w:{t}" for t in names} - set(best))])}

    def rows(batches):
        of, both = Counterfactuals(others, index), Counter()
        for text, y in arrow_rows(batches, "text", "y"):
            both.update(of.of(text))
            yield batch([(y, sorted({index[f] for f in text_features(text, names) if f in index}), None, None, None)])
        yield batch([(None, None, list(a), list(b), n) for (a, b), n in both.items()])

    def batch(part):
        kinds = {"y": pa.int32(), "x": pa.list_(pa.int32()), "lost": pa.list_(pa.int32()), "gained": pa.list_(pa.int32()), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*part, strict=True)) or [()] * 5, kinds.values(), strict=True)], list(kinds))

    table, learnt = staged(sample.mapInArrow(rows, "y int, x array<int>, lost array<int>, gained array<int>, n long"), "learnt")
    texts = sorted(((r["y"], r["x"]) for r in table.where("y is not null").select("y", "x").toArrow().to_pylist()))
    pairs = table.where("n is not null").groupBy("lost", "gained").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    pairs = sorted((r["lost"], r["gained"], r["n"]) for r in pairs)
    unstage(spark, path, learnt)
    w, b, gap = _fit(texts, pairs, len(index), l2, fairness, steps)
    return ToxicityModel({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, float(b), names, sum(n for *_, n in pairs), gap)


def score(model: ToxicityModel, text: Column) -> Column:
    """The probability that a text is toxic (null: that of the empty text)."""

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return toxic(text)


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose score is below the threshold. Null texts are empty; repeated rows
    stay or go together; an empty table gives an empty one."""
    return docs.where(score(model, F.col(text_col)) < threshold)
