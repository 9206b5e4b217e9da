import random

import numpy as np
import pytest

import cases
from millrace.llm import jaccard
from millrace.llm.components import components


def brute(rows, k, num, den):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[n] = frozenset([tuple(w)] if w and len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            null = rows[a][0] is None or rows[b][0] is None
            if sets[a] and sets[b] and (sets[a] == sets[b] if null else den * both >= num * len(sets[a] | sets[b]) or same_id):
                parent[find(a)] = find(b)
    groups = {}
    for n in sets:
        groups.setdefault(find(n), []).append(n)
    out = []
    for g in groups.values():
        ids = [rows[n][0] for n in g if rows[n][0] is not None]
        out += [(rows[n][0], len(sets[n]), min(ids) if ids else None) for n in g]
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    passage, rows = cases.words(rng, 25, 1000), []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            text = " ".join(w)
        else:
            text = cases.words(rng, rng.randint(1, 60), rng.choice([6, 1000])) + (" " + passage if kind > 0.8 else "")
        rows.append((i * 7 % 1000, text))
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100), (3, 1, 1)])
def test_matches_brute_force(spark, k, num, den):
    rows = corpus(k)
    got = jaccard.jaccard_components(cases.documents(spark, rows), words=k, num=num, den=den).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k, num, den)


def test_cost_parameters_don_t_change_results(spark):
    rng = random.Random(9)
    base = cases.words(rng, 60, 1000)
    rows = corpus(1, 60)
    for i in range(80):  # a large group of near copies
        w = base.split()
        w[rng.randrange(60)] = f"y{i}"
        rows.append((2000 + i, " ".join(w)))
    docs = cases.documents(spark, rows)
    for more in ({}, {"long_list": 2, "hot_count": 2}, {"group": 8}, {"hot": 1}, {"group": 16, "pivots": 0, "long_list": 2, "hot_count": 2}, {"group": 12, "pivots": 2, "group_shingles": 300, "long_list": 1}):
        got = jaccard.jaccard_components(docs, words=4, num=85, den=100, **more).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85, 100), more


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.jaccard_components(docs, words=4, num=85, den=100).collect()
    # Empty sets link with nothing and keep their id.
    want = [(i, n, i if n == 0 else c) for i, n, c in brute(rows, 4, 85, 100)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert jaccard.jaccard_components(cases.empty(spark), words=4, num=85, den=100).count() == 0


def test_divide_skip():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 25 if rng.random() < 0.3 else 5))) for _ in range(rng.randint(1, 12))]
        t = rng.randint(1, 8)
        want = sorted(v for v in range(30) if sum(v in x for x in lists) >= t)
        assert sorted(jaccard.divide_skip(lists, t)) == want


def test_search():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = [rng.choice(200, rng.integers(5, 40), replace=False) for _ in range(4)]
        sets = {}
        for _ in range(40):
            s = set(base[rng.integers(0, 4)].tolist())
            for _ in range(rng.integers(0, 6)):
                s ^= {int(rng.integers(0, 200))}
            if s:
                sets.setdefault(tuple(sorted(s)), len(sets))
        arrays, ids = [np.array(s) for s in sets], list(sets.values())
        parent = {i: i for i in ids}
        for _ in ids:
            for a, x in zip(ids, arrays, strict=True):
                for b, y in zip(ids, arrays, strict=True):
                    if jaccard.linked(x, y, 80, 100):
                        parent[a] = parent[b] = min(parent[a], parent[b])
        got = dict(jaccard.search(ids, arrays, 80, 100))
        assert {i: got.get(i, i) for i in ids} == parent


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.a: r.b for r in components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a bigint, b bigint"))[0].collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"))[0].count() == 0


@pytest.mark.parametrize("more", [{}, {"group": 10, "pivots": 2}, {"group": 10, "pivots": 0}, {"group": 6, "pivots": 1, "long_list": 2, "hot_count": 2}])
def test_copies_that_link_with_their_original_alone(spark, more):
    """Copies of one text, each edited elsewhere, link over the original, which isn't the smallest id; another such group shares a passage."""
    rng = random.Random(12)
    rows = [(3, "quite another text of its own here")]
    for at in (100, 500):
        base = [f"{at}w{i}" for i in range(90)] if at == 100 else [f"100w{i}" for i in range(40)] + [f"{at}w{i}" for i in range(50)]
        rows.append((at + 50, " ".join(base)))
        for i in range(45):
            w, j = list(base), 2 * i
            w[j] = f"e{at}{i}"
            w[(j + 1) % 90] = f"f{at}{i}"
            rows.append((at + i, " ".join(w)))
    rng.shuffle(rows)
    got = jaccard.jaccard_components(cases.documents(spark, rows), words=4, num=85, den=100, **more).collect()
    want = brute(rows, 4, 85, 100)
    assert len({c for *_, c in want}) == 3 and sorted(map(tuple, got), key=repr) == want
