"""Rows that every operator must take: nulls, empty and long texts, repeated rows, and columns named like the operators' own."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, k string, word int, h string, n int, token string, digest int, bucket string, _1 int, _2 int, _k int, rep string, "
    "root int, comp string, norm int, w int, b int, page int, url2 string, cell int, key string, gone string, p int, v int, q int, dim int, i int, j int, score string, label int"
)


def words(rng: random.Random, n: int, pool: int = 60) -> str:
    return " ".join(f"w{rng.randint(0, pool)}{rng.choice(['', '.', ','])}" for _ in range(n))


def row(doc_id, text, *more):
    return (doc_id, text, "en", None, len(text or ""), 1, "x", 2, "y", 3, "z", 4, "b", 5, 6, 7, "r", 8, "c", 9, 10, 11, 12, "u", 13, "k", "g", 14, 15, 16, 17, 18, 19, "s", 20)


def documents(spark, rows=None):
    """A small corpus with every awkward case; rows: (doc_id, text) instead."""
    if rows is None:
        rng = random.Random(5)
        base = words(rng, 80)
        rows = [
            (10, base), (11, base), (11, base), (12, base.replace("w1 ", "w2 ", 1)), (13, None), (14, ""), (15, " \n\t"), (16, "one two"), (17, "One TWO"), (None, base), (None, None), (18, None),
            (19, words(rng, 20_000)), (20, "é" * 5000), (21, "a" * 70_000), (22, "naïve ﬁ 日本語 😀 K İ ſ"), (23, "trash\x00 \x1c\x85 nul"), (24, words(rng, 30)), (25, words(rng, 30, 5)),
        ]
    return spark.createDataFrame([row(*r) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
