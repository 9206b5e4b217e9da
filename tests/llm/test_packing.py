import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import cases
from millrace.llm import packing

PATH, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("capacity", [64, 1024])
@pytest.mark.parametrize("ranks", [None, RANKS])
def test_every_id_lies_in_one_piece(spark, tokenizer, capacity, ranks):
    docs = cases.documents(spark, [(i, t) for i, t in enumerate(r.text for r in cases.documents(spark).collect())])
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs, PATH, ranks=ranks, pattern=P.PATTERN, capacity=capacity, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(x)
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    assert padding <= 0.02 * total


def test_cut():
    for capacity in (8, 64, 1024):
        for n in range(1, 3 * capacity):
            out = packing.cut(n, capacity, 1 / 64)
            assert sum(out) == n and all(0 < x <= capacity for x in out)
            for x in out:
                k = capacity // x
                assert k * x <= capacity and (x in (capacity, capacity // k) or capacity - k * x <= capacity / 64)


def test_plain_texts_are_tokenised_alike_by_both_libraries(tokenizer):
    enc, rng = packing.bpe.encoding(RANKS, P.PATTERN), random.Random(3)
    chars = [c for c in map(chr, range(9, 0x2100)) if packing.PLAIN.fullmatch(c)]
    for _ in range(400):
        text = "".join(rng.choice(chars) if rng.random() < 0.5 else rng.choice(" ab1.'\n") for _ in range(80))
        assert packing.token_ids(text, PATH, RANKS, P.PATTERN) == tokenizer.encode(text, add_special_tokens=False).ids == enc.encode_ordinary(text)


def test_special_strings_nulls_and_no_rows(spark, tokenizer):
    assert packing.token_ids("<|endoftext|>", PATH) == [50256]
    for text in ("a <|endoftext|> b", "x" * 70_000 + " y<|endoftext|><|endoftext|>z 1"):
        assert packing.token_ids(text, PATH, RANKS, P.PATTERN) == tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.token_ids(None, PATH) == []
    assert packing.pack(cases.empty(spark), PATH).count() == 0
    rows = packing.pack(cases.documents(spark, [(None, None), (None, "a b"), (1, "x"), (1, "x")]), PATH).collect()
    assert sum(r.length for r in rows) == 1 + 3 + 2 + 2 and {(r.doc_id, r.doc_tokens) for r in rows} == {(None, 1), (None, 3), (1, 2)}
