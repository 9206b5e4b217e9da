import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import cases
from millrace.llm import iblt

PARAGRAPH = re.compile(iblt.PARAGRAPH)


def near(a, b):
    a, b = set(PARAGRAPH.findall(a)), set(PARAGRAPH.findall(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        x, h = rows[(n + 1) % len(rows)][1], len(t) // 2
        e = t[: len(t) - h] + x[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(t, e), 9), round(near(t, x), 9)))
    return sorted(out, key=repr)


def got(docs):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in iblt.fingerprint_edits(docs).collect()), key=repr)


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_many_rows_and_one(spark):
    rng = random.Random(4)
    rows = [(rng.randint(-50, 400), ". ".join(cases.words(rng, 6) for _ in range(rng.randint(0, 12)))) for _ in range(150)]
    assert got(cases.documents(spark, rows)) == expected(rows)
    assert got(cases.documents(spark, [(3, "Alone. Here.")])) == expected([(3, "Alone. Here.")])
    assert iblt.fingerprint_edits(cases.empty(spark)).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    docs = cases.documents(spark, [(1, "A. B. C."), (2, "A. B. C."), (3, "A. B. D."), (4, None), (5, "")])
    f = {r.doc_id: r.fingerprint for r in iblt.fingerprint_edits(docs).collect()}
    assert f[1] == f[2] != f[3] and f[4] == f[5]


def test_no_exchange_while_peeling(spark):
    pairs = spark.createDataFrame([(1, [1], [2])], "k bigint, l array<bigint>, r array<bigint>")
    plan = iblt._peeled(pairs, "l", "r", ["k"], 0, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("size", [0, 1, 5, 60, 2000])
def test_peeling_recovers_what_differs(spark, size):
    rng = random.Random(size)
    rows = []
    for k in range(20):
        common = [rng.getrandbits(62) for _ in range(size)]
        rows.append((k, common + [rng.getrandbits(62) for _ in range(rng.randint(0, size + 1))], common + [rng.getrandbits(62) for _ in range(rng.randint(0, size + 1))]))
    pairs = spark.createDataFrame(rows, "k bigint, l array<bigint>, r array<bigint>")
    for attempts in (6, 1):  # one attempt: some pairs are settled by their arrays
        out = {r.k: (r.n_left, r.n_right) for r in iblt.peel_differences(pairs, "l", "r", keys=["k"], attempts=attempts)[0].collect()}
        assert out == {k: (len(set(a) - set(b)), len(set(b) - set(a))) for k, a, b in rows}


def test_paragraphs_are_split_alike_by_spark(spark):
    text = "One. Two!! Three\n\nFour " + "x" * 300 + " 日本. é"
    n = spark.createDataFrame([(text,)], "t string").select(F.size(iblt.digests("t"))).first()[0]
    assert n == len(set(PARAGRAPH.findall(text)))


def peeled_by_hand(a: str, b: str, width: int):
    """The differing digests of two fingerprints, by plain peeling of their text; None where it gets stuck."""
    def read(f):
        return [[int(x, 16) for x in c.split(".")] for c in f.split(":")]

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    cells = [[signed(n) - signed(m), k ^ j, c ^ d] for (n, k, c), (m, j, d) in zip(read(a), read(b), strict=True)]
    assert len(cells) == 3 * width
    left = right = 0
    while any(any(c) for c in cells):
        pure = next((c for i, c in enumerate(cells) if abs(c[0]) == 1 and HASHES.get(c[1]) == c[2] and i in SLOTS[c[1]]), None)
        if pure is None:
            return None
        n, key, chk = pure
        left, right = left + (n > 0), right + (n < 0)
        for s in SLOTS[key]:
            cells[s] = [cells[s][0] - n, cells[s][1] ^ key, cells[s][2] ^ chk]
    return left, right


HASHES: dict = {}
SLOTS: dict = {}


def test_likenesses_are_those_of_the_fingerprints(spark):
    """Where the result says that the fingerprints told a likeness, peeling their text by hand tells it too."""
    rng = random.Random(6)
    base = [cases.words(rng, 6) for _ in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(40)] = cases.words(rng, 5)
        rows.append((i, ". ".join(w)))
    docs = cases.documents(spark, rows)
    keys = docs.select(F.explode(iblt.digests("text")).alias("k")).distinct()
    slots = [iblt._slot(F.col("k"), r, F.lit(iblt.KEPT), 0) for r in range(3)]
    for r in keys.select("k", iblt._check(F.col("k")).alias("c"), F.array(*slots).alias("s")).collect():
        HASHES[r.k % 2**64], SLOTS[r.k % 2**64] = r.c % 2**64, r.s
    got = sorted(iblt.fingerprint_edits(docs).collect(), key=lambda r: r.doc_id)
    told = 0
    for a, b in zip(got, got[1:], strict=False):
        if a.cells_next == 3 * iblt.KEPT:
            told += 1
            left, right = peeled_by_hand(a.fingerprint, b.fingerprint, iblt.KEPT)
            assert abs((a.n_paragraphs - left) / (a.n_paragraphs + right) - a.near_next) < 1e-12
    assert told > 10 and any(r.cells_edited > 3 * iblt.KEPT for r in got)


def test_delimiters_alone_are_paragraphs(spark):
    docs = cases.documents(spark, [(1, "!!!"), (2, "???"), (3, ""), (4, "...Yes. No"), (5, "Yes. No"), (6, "\n\n" * 5000)])
    r = {x.doc_id: x for x in iblt.fingerprint_edits(docs).collect()}
    assert len({x.fingerprint for x in r.values()}) == 6 and r[1].near_next == 0.0
    assert got(docs) == expected([(x.doc_id, x.text) for x in docs.collect()])


def test_native(spark):
    plan = iblt.fingerprint_edits(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
