import math
import random
import re

import cases
from millrace.llm import licenses as L

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(i, text, templates=L.TEMPLATES, threshold=0.85):
    w = [x.decode() for x in WORD.findall((text or "").encode().lower())]
    places, labels, notices, share = [], set(), set(), 0.0
    for p, label in L.PHRASES.items():
        q = p.split()
        for j in range(len(w) - len(q) + 1):
            if w[j : j + len(q)] == q:
                places.append(j)
                labels.add(label)
    for label, t in templates:
        stride = max(32, 2 ** math.ceil(math.log2(len(t.split()))))
        for s in range(0, max(1, len(w)), stride):
            block = set(w[s : s + 2 * stride])
            part = len(set(t.split()) & block) / len(set(t.split()))
            if part >= threshold:
                notices.add(label)
                share = max(share, part)
    return i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | notices)), round(1.0 if labels else share, 9)


def check(spark, rows, templates=L.TEMPLATES):
    got = L.scan(cases.documents(spark, rows), templates=templates).collect()
    assert sorted((tuple(r[:-1]) + (round(r.score, 9),) for r in got), key=repr) == sorted((expected(*r, templates) for r in rows), key=repr)


def test_notices_and_phrases(spark):
    rng = random.Random(1)
    rows = []
    for n, (_, t) in enumerate(L.TEMPLATES * 3):
        w = t.split()
        for _ in range(n // len(L.TEMPLATES)):
            w[rng.randrange(len(w))] = "other"
        rows.append((n, cases.words(rng, rng.randint(0, 90)) + " " + " ".join(w).upper() + "\n" + cases.words(rng, rng.randint(0, 90))))
    rows += [(100, "MIT License, mit license; CC-BY cc by/CC BY"), (101, "gnu general public license gnu general public license"), (102, "mit licensé"), (103, "mit-License"), (104, "maKe mİt license mit LICENSE"), (105, "cc\x00by")]
    check(spark, rows)


def test_awkward_rows(spark):
    check(spark, [(r.doc_id, r.text) for r in cases.documents(spark).collect()])
    assert L.scan(cases.empty(spark)).count() == 0


def test_native(spark):
    plan = L.scan(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_templates_of_any_length_from_a_table(spark):
    rng = random.Random(4)
    long = [cases.words(rng, n, 3000) for n in (33, 170, 700, 5000)]
    table = spark.createDataFrame([(f"l{i}", x) for i, x in enumerate(long)] + [(None, "x"), ("y", None), ("z", " .")], "label string, text string")
    templates = L.templates_of(table)
    assert [label for label, _ in templates] == ["l0", "l1", "l2", "l3"]
    rows = []
    for i, (_, t) in enumerate(templates * 3):
        w = t.split()
        for _ in range(len(w) * (i // 4) // 14):
            w[rng.randrange(len(w))] = "other"
        rows.append((i, cases.words(rng, rng.randint(0, 900)) + " " + " ".join(w) + " " + cases.words(rng, rng.randint(0, 900))))
    check(spark, rows, templates)
    got = {r.doc_id: r.labels for r in L.scan(cases.documents(spark, rows), templates=templates).collect()}
    assert [got[i] for i in range(8)] == ["l0", "l1", "l2", "l3"] * 2


def test_no_templates(spark):
    check(spark, [(1, "mit license"), (2, "x")], ())
