"""Harmonic packing of tokenised documents into sequences.

A piece of length in (capacity / (k + 1), capacity / k] is of class k, and k pieces of a class fill a sequence. Documents may be cut, so
what remains after whole sequences is cut into pieces that lie just under a reciprocal of the capacity, where a class wastes little.
Every worker fills the classes of its own documents; what its open sequences hold at the end is joined, cut into full sequences, and its
rest into powers of two, which need no padding. Workers share nothing, and no row is exchanged.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.common import arrow_kind, arrow_rows

#: Texts of these characters alone are split and merged alike by both libraries, and faster by the rank file's.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str, ranks: str | None, pattern: str | None) -> tuple[Tokenizer, tuple[str, ...], tiktoken.Encoding | None]:
    """The tokenizer, the strings that it takes for tokens of their own, and the rank file's encoding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    return t, tuple(sorted(x.content for x in t.get_added_tokens_decoder().values())), bpe.encoding(ranks, pattern) if ranks else None


def token_ids(text: str | None, path: str, ranks: str | None = None, pattern: str | None = None) -> list[int]:
    """Ids of a text (null: empty) by a tokenizers file, none added. ranks: the same vocabulary as a rank file. Strings that the file
    takes for tokens of their own are such in texts too."""
    if not text:
        return []
    t, own, enc = _tokenizer(path, ranks, pattern)
    if any(x in text for x in own):
        return t.encode(text, add_special_tokens=False).ids
    out: list[int] = []
    for part in bpe.pieces(text):
        out += enc.encode_ordinary(part) if enc and PLAIN.fullmatch(part) else t.encode(part, add_special_tokens=False).ids
    return out


def cut(length: int, capacity: int, waste: float) -> list[int]:
    """Lengths of a document's pieces: full ones, and what remains in pieces whose class leaves at most that share of a sequence empty."""
    out, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= waste * capacity:
            out.append(rest)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


def pack(
    docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 0, ranks: str | None = None, pattern: str | None = None, waste: float = 1 / 64,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids.

    A document is its ids and end_id; each id lies in one piece, and pieces lie without gaps in their sequence, the first at offset 0.
    Sequences have at most `capacity` ids; those of a power of two need no padding. Null and empty texts are an end_id. sequence_id is
    unique: the worker's number and its count. Rows of repeated ids are packed each; an empty table gives no piece; other columns play no
    part.
    """

    def run(batches):
        worker = TaskContext.get().partitionId() << 36
        count, rows = 0, []
        open_bins: dict[int, list[tuple]] = {}

        def place(pieces):
            nonlocal count
            at = 0
            for i, start, total, ids in pieces:
                rows.append((i, start, len(ids), zlib.crc32(ids.tobytes()), total, worker + count, at, ids))
                at += len(ids)
            count += 1

        def taken():
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [kind, *[pa.int64()] * 6]
            out = [pa.array(c, t) for c, t in zip(cols[:7], kinds, strict=True)]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for i, text in arrow_rows(batches, "_1", "_2"):
            ids = np.array([*token_ids(text, tokenizer, ranks, pattern), end_id], "<u4")
            start = 0
            for n in cut(len(ids), capacity, waste):
                piece = (i, start, len(ids), ids[start : start + n].copy())
                start += n
                k = capacity // n
                bin_ = open_bins.setdefault(k, [])
                bin_.append(piece)
                if len(bin_) == k:
                    place(open_bins.pop(k))
            if len(rows) > 4096:
                yield taken()
        # What is left open is one stream: full sequences, then powers of two.
        left = [p for k in sorted(open_bins) for p in open_bins[k]]
        total = sum(len(p[3]) for p in left)
        sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
        for size in sizes:
            now = []
            while size:
                i, start, whole, ids = left.pop(0)
                now.append((i, start, whole, ids[:size]))
                if len(ids) > size:
                    left.insert(0, (i, start + size, whole, ids[size:]))
                size -= len(now[-1][3])
            place(now)
        yield taken()

    kind, sql = arrow_kind(docs, id_col)
    names = ["_1", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    out = docs.select(F.col(id_col).alias("_1"), F.col(text_col).alias("_2")).mapInArrow(run, f"_1 {sql}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("_1", id_col)
