import hashlib
import random

import public_tokenizers as P
import tiktoken

import cases
from millrace.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_pieces_encode_like_the_whole():
    enc, rng = bpe.encoding(PATH, P.PATTERN), random.Random(1)
    alphabet = ["a", "Z", "é", "日", "1", "٣", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'", ".", "😀", "can't", "\r\n"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
        assert bpe.encode(text, enc, long=rng.randint(1, 20)) == enc.encode_ordinary(text)
        assert "".join(bpe.pieces(text, 7)) == text


def test_documents(spark):
    docs = cases.documents(spark)
    enc = bpe.encoding(PATH, P.PATTERN)
    got = [tuple(r) for r in bpe.round_trip_digests(docs, PATH, P.PATTERN).collect()]

    def want(i, text):
        ids = enc.encode_ordinary(text or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(got, key=key) == sorted((want(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert bpe.round_trip_digests(cases.empty(spark), PATH, P.PATTERN).count() == 0


def test_encode_and_decode_frames(spark):
    docs = cases.documents(spark)
    encoded = bpe.encode_documents(docs, PATH, P.PATTERN)
    back = bpe.decode_documents(encoded, PATH, P.PATTERN)
    assert sorted(((r.doc_id or -1), bytes(r.decoded).decode()) for r in back.collect()) == sorted(((r.doc_id or -1), r.text or "") for r in docs.collect())


def test_part_of_a_character_decodes_to_its_bytes(spark):
    enc = bpe.encoding(PATH, P.PATTERN)
    ids = enc.encode_ordinary("日本語😀")
    df = spark.createDataFrame([(1, ids[:-1]), (2, None), (3, [])], "doc_id int, token_ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(df, PATH, P.PATTERN).collect()}
    assert got == {1: "日本語😀".encode()[: len(got[1])], 2: b"", 3: b""}


def test_special_strings_are_ordinary():
    assert isinstance(bpe.encoding(PATH, P.PATTERN), tiktoken.Encoding)
    enc = bpe.encoding(PATH, P.PATTERN)
    assert enc.decode(bpe.encode("<|endoftext|>", enc)) == "<|endoftext|>" and len(bpe.encode("<|endoftext|>", enc)) > 1
