"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_kind, arrow_rows

#: Where every pattern that keeps a word and a following space or line end apart ends a match: between a visible character and a
#: space or line end, and between ASCII letters and digits. What follows such a place is matched as if the text began there.
SAFE = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Longer texts are split at safe places, so that no regular expression runs over more than this and one unbroken run.
LONG = 1 << 16


@functools.lru_cache(maxsize=8)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (a line: base64 of the bytes, rank), once in each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in parts that are encoded apart with the result of the whole."""
    at = 0
    while len(text) - at > long:
        cut = SAFE.search(text, at + long)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, enc: tiktoken.Encoding, long: int = LONG) -> list[int]:
    """Ids of a text (null: empty), special tokens' strings being ordinary text."""
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in pieces(text, long):
        out += enc.encode_ordinary(part)
    return out


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and its ids of tokens (id_col, token_ids). Null and empty texts have none; every row gives one row, repeated ones too;
    an empty table gives an empty one; other columns, whatever their names, play no part."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for i, text in arrow_rows(batches, "_1", "_2"):
            yield pa.RecordBatch.from_arrays([pa.array([i], kind), pa.array([encode(text, enc)], pa.list_(pa.int32()))], ["_1", "ids"])

    kind, sql = arrow_kind(docs, id_col)
    return docs.select(F.col(id_col).alias("_1"), F.col(text_col).alias("_2")).mapInArrow(run, f"_1 {sql}, ids array<int>").select(F.col("_1").alias(id_col), F.col("ids").alias("token_ids"))


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The raw bytes of ids (id_col, decoded); they need not be UTF-8 where ids are part of a text. Null ids give no bytes;
    every row gives one row, repeated ones too; an empty table gives an empty one; other columns play no part."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for i, ids in arrow_rows(batches, "_1", "_2"):
            yield pa.RecordBatch.from_arrays([pa.array([i], kind), pa.array([enc.decode_bytes(ids or [])], pa.binary())], ["_1", "decoded"])

    kind, sql = arrow_kind(encoded, id_col)
    return encoded.select(F.col(id_col).alias("_1"), F.col(ids_col).alias("_2")).mapInArrow(run, f"_1 {sql}, decoded binary").select(F.col("_1").alias(id_col), "decoded")


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: id_col, n_tokens, ids_sha256 and decoded_sha256, so that ids needn't leave the worker.

    Null texts are empty: no ids, digests of no bytes. Every row gives one row, repeated ids and texts too; texts of any length
    are processed whole; an empty table gives an empty one; other columns play no part.
    """

    def run(batches):
        enc, rows = encoding(ranks, pattern), []
        decimal = [str(i) for i in range(enc.n_vocab)]
        for i, text in arrow_rows(batches, "_1", "_2"):
            ids = encode(text, enc)
            rows.append((i, len(ids), hashlib.sha256(",".join([decimal[x] for x in ids]).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            if len(rows) == 1024:
                yield _batch(rows, kind)
                rows = []
        if rows:
            yield _batch(rows, kind)

    kind, sql = arrow_kind(docs, id_col)
    out = docs.select(F.col(id_col).alias("_1"), F.col(text_col).alias("_2")).mapInArrow(run, f"_1 {sql}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_1", id_col)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["_1", "n_tokens", "ids_sha256", "decoded_sha256"])
