"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations alone.

A template's words form a set; a block of words matches a template when it contains at least a threshold's share of that set. Blocks are
cut to the template: those of a template of n words have twice a stride of words, the stride being the power of two from n (and 32) on,
and begin at multiples of it, so that every stretch of so many words lies in one whole. Words of templates have one global order, rare
ones first, counted over all documents. A block that contains enough of a template contains one of its first |T| - need + 1 words (prefix
filter), has at least `need` template words itself (length filter), and at the first common word both still have enough words to come
(positional filter). What is left is compared in full. No matching block is missed; documents without any prefix word are never cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are reported as such, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What license notices, and one whole license, say, by this method's labels.
TEMPLATES = (
    ("notice:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("notice:mit", "released under the mit license"),
    ("notice:apache", "licensed under the apache license version"),
    ("notice:apache", "you may not use this file except in compliance with the license"),
    ("notice:gpl", "this work is licensed under the gnu general public license version"),
    ("notice:gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("notice:cc-by", "licensed under cc by nc"),
    ("notice:cc-by", "this work is licensed under a creative commons attribution license"),
    ("notice:bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("notice:isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("notice:mpl", "this source code form is subject to the terms of the mozilla public license"),
    (
        "text:mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
    ),
)
#: The least stride of blocks, and how many words all templates may have together: they are sent to all workers.
STRIDE, MOST_WORDS = 32, 1_000_000
_BREAK = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: str) -> Column:
    """Words of a text column, A-Z lowered: runs of digits, letters a-z and whatever isn't ASCII, in one string between single spaces.

    lower() changes more than A-Z, but no other character into ASCII, save the Kelvin sign, which gives way to another letter first;
    so words are told apart as they would be, and those of ASCII alone are the same.
    """
    return F.expr(f"concat(' ', trim(regexp_replace(lower(replace(coalesce({text}, ''), '\\u212a', '\\u0101')), '{_BREAK}', ' ')), ' ')")


def _split(norm: str) -> Column:
    return F.when(F.length(norm) > 2, F.split(F.trim(norm), " ")).otherwise(F.array().cast("array<string>"))


def _places(phrase: str) -> Column:
    """Where a phrase's words stand consecutively in the column w."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get("w", i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get("w", i + k) == p)
        return F.coalesce(out, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size("w") - 1), here)


def templates_of(table: DataFrame, *, label_col: str = "label", text_col: str = "text") -> list[tuple[str, str]]:
    """Templates from a table's rows; texts of any length, of at most MOST_WORDS words together. Rows without a label or words are left out."""
    words = F.trim(words_of(text_col))
    rows = table.where(F.col(label_col).isNotNull() & (words != "")).select(F.col(label_col).cast("string").alias("label"), words.alias("text"))
    total = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    if total > MOST_WORDS:
        raise ValueError(f"templates have {total} words; at most {MOST_WORDS} are sent to all workers")
    return sorted((r.label, r.text) for r in rows.collect())


def stride_of(words: int) -> int:
    return max(STRIDE, 1 << (words - 1).bit_length())


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = 0.85,
) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Base columns report all places of the phrases. labels adds those of templates (label, words between spaces; see templates_of) that
    some block contains to at least `threshold`. score is 1 where a phrase stands, else the largest share of a template found, 0 where
    none is. Null texts are empty; without words there are no places (null first and last) and empty labels. Repeated rows are repeated,
    an empty table gives an empty one, other columns play no part.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    sets = [(label, sorted(set(t.split())), stride_of(len(t.split()))) for label, t in templates]
    assert sum(len(s) for _, s, _ in sets) <= MOST_WORDS
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    rows = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("norm"), F.xxhash64(text_col).alias("h"))
    lit = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    # The global order: in how many documents a template's word stands, over all documents. At most as many rows as templates have words.
    found = rows.select(F.explode(F.array_intersect(_split("norm"), lit(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = {r.word: r.n for r in found.collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    index, bodies, words_at = [], [], set()
    for t, (label, s, stride) in enumerate(sets):
        ranks, need = sorted(rank[w] for w in s), math.ceil(threshold * len(s) - 1e-9)
        bodies.append((t, label, ranks))
        index += [(r, stride, t, p, len(ranks), need) for p, r in enumerate(ranks[: len(ranks) - need + 1])]
        words_at |= {(w, rank[w], stride) for w in s}
    # All of at most MOST_WORDS rows or words.
    starts = sorted({order[r - 1] for r, *_ in index})
    least = min((i[-1] for i in index), default=1)
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, stride int, template int, p int, of int, need int"))
    whole = F.broadcast(spark.createDataFrame(bodies, "template int, label string, ranks array<int>"))
    known = F.broadcast(spark.createDataFrame(sorted(words_at), "word string, rank int, stride int"))

    # Words of templates, where they stand in documents with any prefix word; each lies in two blocks of a stride.
    near = rows.withColumn("w", _split("norm")).where(F.arrays_overlap("w", lit(starts)))
    hits = near.select("id", "h", F.posexplode("w").alias("at", "word")).join(known, "word")
    block = F.floor(F.col("at") / F.col("stride")).cast("int")
    hits = hits.select("id", "h", "stride", "rank", F.explode(F.array(block, block - 1)).alias("block")).where("block >= 0")
    blocks = hits.groupBy("id", "h", "stride", "block").agg(F.array_sort(F.collect_set("rank")).alias("b")).where(F.size("b") >= least)
    # A block's template words by their place in the global order.
    pairs = blocks.select("*", F.posexplode("b").alias("q", "rank")).join(prefixes, ["rank", "stride"])
    pairs = pairs.where((F.size("b") >= F.col("need")) & (1 + F.least(F.col("of") - F.col("p") - 1, F.size("b") - F.col("q") - 1) >= F.col("need")))
    pairs = pairs.join(whole, "template").select("id", "h", "label", "need", "of", F.size(F.array_intersect("b", "ranks")).alias("both")).where("both >= need")
    by_text = pairs.groupBy("id", "h").agg(F.collect_set("label").alias("notices"), F.max(F.col("both") / F.col("of")).alias("share"))

    any_phrase = F.lit(False)
    for p in phrases:
        any_phrase = any_phrase | F.contains(F.col("norm"), F.lit(f" {p} "))
    base = rows.withColumn("w", _split("norm")).withColumn("has", any_phrase)
    none = F.array().cast("array<int>")
    base = base.select("id", "h", F.size("w").cast("long").alias("n_words"), *(F.when(F.col("has"), _places(p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(phrases)))
    at = [f"p{i}" for i in range(len(phrases))]
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(x)) for a, x in zip(at, phrases.values(), strict=True))))))
    every = F.concat(*at)
    base = base.select("id", "h", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    got = by_text.withColumnsRenamed({"id": "id2", "h": "h2"})
    out = base.join(got, (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("id2")), "left")
    notices = F.coalesce("notices", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", notices))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
