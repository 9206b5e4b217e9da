import gzip
import random

import numpy as np
import pytest

from millrace.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "page_id bigint, url string, html string, page int, _digest string, value int")


def expected(rows, least=0):
    first, out = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        d = warc.payload_digest(b)
        if i is not None and len(b) >= least and d in first:
            out.append((i, len(b), d, "revisit", first[d]))
        else:
            if i is not None and len(b) >= least:
                first[d] = i
            out.append((i, len(b), d, "response", None))
    return sorted(out, key=repr)


EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"


def test_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, "same"), (5, "u\r\nWARC-Type: evil", EVIL), (6, "u", None), (7, "u", ""), (None, "u", "same"), (None, "u", None), (8, "u", "é日😀\r\n\n"), (9, "u", "y" * 300_000), (10, "u", EVIL), (11, "u", "r"), (11, "u", "r"), (11, "u", "other"), (12, "u", "r"), (13, "u", "a\x00b\r\n\r\n")]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)
    assert warc.round_trip(pages(spark, []), least=0).count() == 0


def test_small_payloads_are_no_revisits(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = warc.round_trip(pages(spark, rows), least=3).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows, 3)


def record(payload: bytes) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)


def cut(content: bytes):
    pieces = content.split(warc.MAGIC_HEAD)
    magic, head, length = zip(*map(warc.piece, pieces), strict=True)
    return warc.chain(np.array([len(p) for p in pieces]), np.array(magic), np.array(head), np.array(length))


def starts_of(content: bytes) -> list[int]:
    which, begins, _ = cut(content)
    return (begins[which] - len(warc.MAGIC_HEAD)).tolist()


def test_only_the_chain_from_the_start_counts():
    rng = random.Random(1)
    for _ in range(300):
        payloads = [rng.choice([b"", b"abc", EVIL.encode(), record(b"inner"), record(record(b"deep")), b"WARC/1.1\r\n", b"WARC/1.", b"WARC/1.1\r\nContent-Length: 2"]) for _ in range(rng.randint(1, 9))]
        content, starts = b"", []
        for p in payloads:
            starts.append(len(content))
            content += record(p) if rng.random() < 0.7 else record(p).replace(b"WARC-Type", b"Url: x/WARC/1.1/WARC/1.0\r\nWARC-Type", 1)
        assert starts_of(content) == starts


def test_a_broken_record_ends_the_chain():
    for content in (record(b"one") + record(b"two")[:-6] + b"?" * 9 + record(b"three"), b"x" + record(b"one"), record(b"one")[:-1], record(b"one") + b"\r\n"):
        with pytest.raises(ValueError, match="chain of records ends"):
            cut(content)


def test_archives_of_bounded_size(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 50) for i in range(60)]
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_archives(pages(spark, rows), path, archive_bytes=8000, compression=compression)
        records = warc.read_archives(spark, path)
        assert records.count() == 60 and records.select("file").distinct().count() > 5
        assert records.where("payload_digest = claimed_digest").count() == 60


def test_headers_of_any_length(spark):
    rows = [(i, f"http://{i}", f"page {i}") for i in range(6)] + [(6, "data:" + "a" * 200_000, "long"), (7, "u", "long"), (8, "u" * 70_000, EVIL)] + [(i, "u", f"page {i}") for i in range(9, 20)]
    got = warc.round_trip(pages(spark, rows).coalesce(1)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)


def test_many_magic_lines_are_searched_once():
    content = record(warc.MAGIC * 200_000) + record(b"WARC/1.1\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n")
    assert len(starts_of(content)) == 2


@pytest.mark.parametrize("part", [1000, 4096, 1 << 20])
def test_ranges_of_a_file(spark, tmp_path, part):
    """Tasks read ranges of one archive, cut anywhere: in payloads, headers and magic lines."""
    rng = random.Random(part)
    payloads = [rng.choice([b"", b"page %d " % i * rng.randint(1, 300), EVIL.encode() * rng.randint(1, 40), record(record(b"deep")), b"WARC/1." * rng.randint(1, 300)]) for i in range(120)]
    content = b"".join(record(p) if i % 5 else record(p).replace(b"WARC-Type", b"Url: x/WARC/1.1\r\nWARC-Type", 1) for i, p in enumerate(payloads))
    (tmp_path / "a.warc").write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = warc.read_archives(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= min(8, len(content) // part)
        assert sorted((r.offset, r.payload_bytes, r.payload_digest) for r in got.collect()) == [(o, len(p), warc.payload_digest(p)) for o, p in zip(starts_of(content), payloads, strict=True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_missing_records_are_an_error(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(record(b"one") + record(b"two")[:-6] + b"?" * 9 + record(b"three"))
    with pytest.raises(Exception, match="chain of records ends"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_archives_of_any_name_and_version(spark, tmp_path):
    (tmp_path / "crawl-1.warc.gz").write_bytes(b"".join(gzip.compress(record(p).replace(b"WARC/1.1", b"WARC/1.0", 1)) for p in (b"one", b"WARC/1.2\r\n", b"three")))
    (tmp_path / "other.warc").write_bytes(record(b"four"))
    assert sorted(r.payload_bytes for r in warc.read_archives(spark, str(tmp_path)).collect()) == [3, 4, 5, 10]
    assert warc.read_archives(spark, str(tmp_path), glob="*.warc.gz").count() == 3
