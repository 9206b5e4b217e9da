"""The registered queries of the training-data operators. Each applies its operator to whole tables and derives the result's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, brown, iblt, jaccard, licenses, packing, pii, toxicity, warc
from millrace.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; learns from labelled rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i, 4))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document by the local rank file and decodes the ids."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a class bigram model that learns from those outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents")
    model = brown.fit(docs, lambda i: ~held_out(i, 7))
    return brown.fitted_scores(model).select(
        "doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links documents of like four-word shingle sets (Jaccard 0.85 or more)."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document, its edit and the likeness to its edit and to the next document."""
    return iblt.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", "rank", "vec_id", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a record and reads the archives back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of 1024."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


#: For the test tables only; on real data the session's setting spark.millrace.pii.key has a secret.
TEST_KEY = "millrace test key"


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get("spark.millrace.pii.key", TEST_KEY).encode()


def op10_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaces personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", pii.pseudonymised(F.col("text"), pii_key(spark)).alias("p"))
    return docs.select("doc_id", "p.text", "p.n_found", "p.kinds")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_brown_lm, op4_jaccard_join, op5_iblt_fingerprints, op6_block_matrix_ann, op7_warc, op8_license_scan, op9_harmonic_packing, op10_feistel_pii)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


_JACCARD = f"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
 else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as g from d),
e as (select doc_id, len(g) as n, unnest(g) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n) as n, any_value(b.n) as m from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
r(a, b) as (select doc_id, doc_id from s union select r.a, p.b from r join p on p.a = r.b where 100 * shared >= 85 * (n + m - shared))
select s.doc_id, cast(len(g) as bigint) as n_shingles, c.component_id from s join (select a, min(b) as component_id from r group by 1) c on c.a = s.doc_id"""

_NEAREST = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and len(embedding) > 0),
ok as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) as score from ok q join ok c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from p) where rank <= 10"""

_WARC = """with p as (select page_id, coalesce(html, '') as html from pages), h as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as h from p),
b as (select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + cast(((cast('0x' || substr(h, cast(i // 4 * 5 + 1 as integer), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31) as integer), 1)), '') as payload_digest from h),
f as (select *, min(page_id) over (partition by payload_digest) as first from b)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to from f"""

_LICENSES = f"""with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p(label, words) as (values {", ".join(f"('{label}', {_list(p)})" for p, label in licenses.PHRASES.items())}),
t(label, stride, words) as (values {", ".join(f"('{label}', {licenses.stride_of(len(t.split()))}, list_distinct({_list(t)}))" for label, t in licenses.TEMPLATES)}),
places as (select doc_id, label, i - 1 as place from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), p where w[i] = words[1] and w[i:i + len(words) - 1] = words),
blocks as (select doc_id, stride, list_distinct(w[b * stride + 1:b * stride + 2 * stride]) as b from (select doc_id, w, stride, unnest(range(0, len(w) // stride + 1)) as b from d, (select distinct stride from t))),
hits as (select doc_id, label, len(list_intersect(b, words)) as n, len(words) as of from blocks join t using (stride)),
notices as (select doc_id, label, n / of as share from hits where n >= ceil({0.85} * of - 1e-9)),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by 1),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from places union all select doc_id, label from notices) group by 1),
best as (select doc_id, max(share) as share from notices group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
 case when n_base > 0 then 1e0 else coalesce(share, 0e0) end as score from d left join base using (doc_id) left join every using (doc_id) left join best using (doc_id)"""

#: The others' tokenizers, fitted models, sketches and ciphers are beyond SQL; tests/llm compares them with brute force.
ORACLES = {"op4_jaccard_join": _JACCARD, "op6_block_matrix_ann": _NEAREST, "op7_warc": _WARC, "op8_license_scan": _LICENSES}
