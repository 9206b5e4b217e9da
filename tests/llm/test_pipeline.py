import shutil
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import cases
import corpus_pipeline
from millrace.llm import jaccard, pii, queries, toxicity
from millrace.llm.common import held_out
from test_jaccard import brute

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.doc_id for r in docs.collect()}
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups = {i: c for i, _, c in brute(sorted(whole.items()), 5, 80, 100)}
    for i in whole:
        if groups[i] == i and labels.get(i) == 0:
            assert i in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == kept


def test_run_against_a_plain_pipeline(spark):
    """run()'s pieces, put together, are the ids of the texts that a plain loop over all documents keeps and rewrites."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{x}.parquet") for x in ("documents", "labels"))
    score = toxicity.fit(docs, labels, lambda i: ~held_out(i, 4)).scorer()
    rows = [(r.doc_id, r.text) for r in docs.collect() if score(r.text) < 0.3]
    assert 0 < len(rows) < docs.count()
    group = {i: c for i, _, c in brute(rows, 5, 80, 100)}
    texts = {i: t for i, t in rows if group[i] in (i, None) or not (t or "").split()}
    assert 0 < len(texts) < len(rows)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in texts.items():
        out = list(t or "")
        for a, b, kind in pii.find(t or ""):
            out[a:b] = pii.pseudonym(kind, t[a:b], queries.TEST_KEY.encode())
        want[i] = [*tokenizer.encode("".join(out), add_special_tokens=False).ids, 0]
    sequences, at = {}, dict.fromkeys(want, 0)
    for r in sorted(corpus_pipeline.run(spark, LARGER).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in want.items()}
    for pieces in sequences.values():
        ends = [0]
        for offset, n in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 1024


def test_awkward_rows(spark, tmp_path):
    shutil.copytree(SF, tmp_path / "sf")
    extra = spark.createDataFrame([(None, "x y z w v u", None, None, None), (5000, None, "en", "s", 0), (5001, "", None, "s", 0), (5002, "a b", "en", "s", 3), (5002, "a b", "en", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(extra).withColumn("gone", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        n = 4 if stage is corpus_pipeline.drop_toxic else 3  # of the repeated row one stays
        assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id >= 5000").count() == n
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_queries_run_on_whole_tables(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    of = {"op6": "embeddings", "op7": "pages"}.get(name[:3], "documents")
    n = spark.read.parquet(f"{SF}/{of}.parquet").count()
    got = df.count()
    assert got >= n if name.startswith("op9") else got == (n // 100 * 10 if of == "embeddings" else n)


def test_op4_matches_brute_force_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = jaccard.jaccard_components(spark.read.parquet(f"{SF}/documents.parquet"), words=4, num=85, den=100).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85, 100)


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten"
    other = text.replace("ten", "eleven") + " " + "a b c d e f g"
    rows = [(5, text), (3, text), (3, text), (3, text + " eleven"), (None, text), (None, other), (None, other), (None, other + " z"), (7, None), (7, None), (7, ""), (None, " "), (None, " "), (9, other + " q r s t u v w x y"), (9, None)]
    docs = cases.documents(spark, rows)
    got = jaccard.one_of_each(docs, words=5, num=80, den=100)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, text), (None, other), (None, other + " z"), (7, None), (7, None), (7, ""), (None, " "), (None, " "), (9, other + " q r s t u v w x y"), (9, None)], key=repr)
