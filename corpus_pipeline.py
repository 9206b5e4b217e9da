"""A corpus pipeline of four stages over the training-data operators; counted as part of millrace.llm.

Each stage works on all rows that the one before it kept: toxic documents go, of near duplicates one stays, personal data gives way to
pseudonyms, and what is left is tokenised and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, pii, queries, toxicity
from millrace.llm.common import held_out, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is under 0.3; learns from labelled documents outside the held-out quarter.

    Null and empty texts are scored as empty ones. Columns stay as they are; an empty table gives an empty one.
    """
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), lambda i: ~held_out(i, 4))
    return toxicity.reject_toxic(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, one of the smallest id, of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    Documents without words (null, empty or white texts) link with nothing and stay; of repeated rows with words one stays, and so of equal
    texts without an id. An empty table gives an empty one; other columns stay.
    """
    return jaccard.one_of_each(docs, words=5, num=80, den=100)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by pseudonyms of the same length; the key is the session's setting spark.millrace.pii.key.

    Null and empty texts stay as they are, repeated rows stay repeated; an empty table gives an empty one; other columns stay.
    """
    return pii.pseudonymise(docs, queries.pii_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids.

    Null and empty texts are an end id alone; rows of repeated ids are packed each; an empty table gives no piece; other columns go.
    """
    return queries.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", hide_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; every stage but the last is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier, a cipher and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares run() with a plain version of it.
ORACLE_SQL = None
