"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

Reading cuts archives at every magic line, in tasks that each take a range of a file's bytes. A piece begins with a candidate for a record
and tells where it ends by its own header: (offset, successor). Candidates in payloads lie on no chain from the file's start: pointer
jumping marks what the start reaches, doubling the jump each time, and only those are records. That takes a few numbers for each piece;
payloads stay where they are read, but for those that hold magic lines themselves, whose pieces are put together in the end.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_rows, n_partitions, staged, staged_path

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
#: What is read: the magic lines' common beginning, at which archives are cut, and their ends.
MAGIC_HEAD, MAGIC_ENDS = b"WARC/1.", (b"0\r\n", b"1\r\n")
CRLF = "\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + END
LENGTH = re.compile(rb"^content-length[ \t]*:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A length of more digits is none.
MOST_DIGITS = 18


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digest(rows: DataFrame, text: str, into: str) -> DataFrame:
    """rows with payload_digest of a text column's UTF-8, in Spark's own functions: five bytes at a time make eight digits."""
    out = rows.withColumn("_sha", F.sha1(F.col(text).cast("binary")))
    out = out.withColumns({f"_five{i}": F.conv(F.substring("_sha", 10 * i + 1, 10), 16, 10).cast("long") for i in range(4)})
    digits = [F.substring(F.lit(BASE32), F.shiftright(f"_five{i}", 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(4) for j in range(8)]
    return out.withColumn(into, F.concat(*digits)).drop("_sha", *(f"_five{i}" for i in range(4)))


def firsts(digests: DataFrame, least: int = 0) -> DataFrame:
    """Of (page, _digest, _bytes): for each payload of at least `least` bytes its smallest page, _first, and how often that page has it, _n.

    Null pages are nobody's first. Equal payloads meet as counted minima, not as rows.
    """
    rows = digests.where(F.col("page").isNotNull() & (F.col("_bytes") >= least)).groupBy("_digest", "_bytes", "page").agg(F.count(F.lit(1)).alias("n"))
    low = rows.groupBy("_digest", "_bytes").agg(F.min(F.struct("page", "n")).alias("f"))
    return low.select("_digest", "_bytes", F.col("f.page").alias("_first"), F.col("f.n").alias("_n"))


def record_text(record_id: Column, kind: Column, url: Column, block: Column, payload_sha: Column, refers_to: Column, page: Column) -> Column:
    """A record without its closing line ends."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    return F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<urn:millrace:"), record_id, F.lit(">"))), line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "%0A")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), payload_sha)),
        line("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))), line("WARC-Refers-To", F.concat(F.lit("<urn:millrace:"), refers_to, F.lit(">"))), line("WARC-Source-Page", page),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = 16 << 20, compression: str = "gzip") -> None:
    """Writes a record for every row to archives in the folder path, with as many records each as have archive_bytes on average,
    compressed as a whole ('none': not).

    Spark writes them, so path can be in any store it knows. Null payloads are empty. Rows with a null id are responses that nothing
    refers to. Of repeated rows with the smallest id of a payload one is the response and the others revisit it.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = with_digest(rows, "payload", "_digest").withColumn("_bytes", F.octet_length("payload").cast("long"))
    digests, _ = staged(rows.select("page", "_digest", "_bytes", F.coalesce(F.octet_length("url"), F.lit(0)).alias("_url")), "digests")
    first = firsts(digests, least)
    total = digests.agg(F.avg(F.col("_bytes") + F.col("_url")).alias("size"), F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages")).first()
    # Payloads are exchanged once, by a join that Spark may split where many are alike.
    rows = rows.join(first.withColumnsRenamed({"_digest": "_d", "_bytes": "_b"}), (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left").drop("_d", "_b")
    again = F.lit(False)
    if total.n != total.pages and first.where("_n > 1").limit(1).count():
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("page", "_digest").orderBy("url")))
        again = F.col("_at") > 1
    revisit = F.coalesce(F.col("page").isNotNull() & F.col("_first").isNotNull() & ((F.col("page") != F.col("_first")) | again), F.lit(False))
    kind = F.when(revisit, "revisit").otherwise("response")
    page = F.col("page").cast("string")
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    text = record_text(F.coalesce(page, F.expr("uuid()")), kind, F.col("url"), block, F.col("_digest"), F.when(revisit, F.col("_first").cast("string")), page)
    # Each task of the join writes archives, none of more than so many records.
    most = max(1, int(archive_bytes / ((total["size"] or 0) + 600)))
    rows.select(text.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


#: What is told of a piece of an archive, which begins behind the magic lines' common beginning. start, seq: the byte where its task's range
#: begins, and its place there; size: its bytes; magic: whether it goes on as a magic line; head: where the first empty line in it ends
#: (-1: none); length: the first Content-Length line's before that (-1: none). The rest is of a record that is this piece alone.
PIECES = "file string, start long, seq long, size long, magic boolean, head long, length long, type string, record_id string, refers_to string, page string, payload_bytes long, payload_digest string, claimed_digest string"
_FIELDS = ("type", "record_id", "refers_to", "page", "payload_bytes", "payload_digest", "claimed_digest")


def piece(data: bytes) -> tuple[bool, int, int]:
    """magic, head, length of a piece."""
    head = data.find(b"\r\n\r\n")
    line = data.find(b"\n") + 1  # what stands before belongs to a line that another piece began
    found = LENGTH.search(data, line, head + 2 if head >= 0 else len(data)) if line else None
    return data.startswith(MAGIC_ENDS), head + 4 if head >= 0 else -1, int(found[1]) if found and len(found[1]) <= MOST_DIGITS else -1


def chain(size: np.ndarray, magic: np.ndarray, head: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an archive's pieces in order: which begin a record, where each one's content begins, and where that of a record's block does.

    A header may go on over pieces, as a url may hold the magic line's beginning. Raises where the chain of records ends before the archive.
    """
    n, begins = len(size), np.cumsum(size + len(MAGIC_HEAD)) - size - len(MAGIC_HEAD)
    total = int(begins[-1] + size[-1]) if n else 0
    # The next piece at or after each in which a header ends, and the next that has a length.
    upto = lambda has: np.minimum.accumulate(np.where(has, np.arange(n), n)[::-1])[::-1]
    ends, lengths = upto(head >= 0), upto((length >= 0) | (head >= 0))
    ok = magic & (ends < n) & (lengths < n)
    at = np.where(ok, lengths, 0)
    ok &= length[at] >= 0
    block = np.where(ok, begins[np.where(ok, ends, 0)] + head[np.where(ok, ends, 0)], -1)
    which = np.nonzero(ok)[0]
    offsets = begins[which] - len(MAGIC_HEAD)
    successors = block[which] + length[at[which]] + len(END)
    keep = reachable(offsets, successors, total) & (successors <= total)
    reached = int(successors[keep].max(initial=0))
    if reached != total:
        raise ValueError(f"the chain of records ends at byte {reached} of {total}")
    return which[keep], begins, block


def reachable(offsets: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Which candidates (sorted offsets) the chain from offset 0 reaches, by pointer jumping. A successor that's no candidate ends it."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    hit = (at < n) & (np.append(offsets, -1)[np.minimum(at, n)] == successors)
    jump = np.append(np.where(hit, at, n), n)
    mark = np.zeros(n + 1, bool)
    mark[0] = n > 0 and offsets[0] == 0
    # After step t all within 2^t jumps of the start are marked: those marked mark what they jump to, then jumps double.
    for _ in range(max(1, n).bit_length()):
        mark[jump[mark]] = True
        jump = jump[jump]
    return mark[:n]


def _fields(header: bytes) -> dict[str, str]:
    out = {}
    for line in header.decode("utf-8", "replace").split(CRLF)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _record(header: bytes, body: bytes) -> tuple:
    """_FIELDS of a record's header, without its first line's beginning, and block."""
    f = _fields(header)
    cut = body.find(b"\r\n\r\n")
    payload = body[cut + 4 :] if cut >= 0 and body.startswith(b"HTTP/") else body
    bare = lambda v: v and v.removeprefix("<urn:millrace:").removesuffix(">")
    own = f.get("warc-type") != "revisit"
    return (
        f.get("warc-type"), bare(f.get("warc-record-id")), bare(f.get("warc-refers-to")), f.get("warc-source-page"), len(payload) if own else None,
        payload_digest(payload) if own else None, (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
    )


def _arrow(sql: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in sql.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], list(names))


def _cut(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, start, data) of every piece, in order in its range. Spark cuts files that aren't compressed into ranges of bytes."""
    text = spark.read.option("lineSep", MAGIC_HEAD.decode()).option("pathGlobFilter", glob).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("data"))


def _numbered(batches):
    """(file, start, seq, data) of pieces; a range's pieces come one after another."""
    now, seq = None, 0
    for file, start, data in arrow_rows(batches, "file", "start", "data"):
        now, seq = (file, start), 0 if now != (file, start) else seq + 1
        yield file, start, seq, data


RECORDS = "file string, offset long, type string, record_id string, refers_to string, page string, payload_bytes long, payload_digest string, claimed_digest string"


def read_archives(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """The records of the archives in a folder (all its data files, or those whose names match glob; WARC/1.0 and WARC/1.1): file, offset, type, record_id, refers_to, page, payload_bytes, payload_digest, claimed_digest.

    Offsets are those in the archive without its compression. payload_bytes and payload_digest are of the payload found (after the HTTP
    head); a revisit has none (null). A task holds one record at a time, and of one archive some numbers for each magic line. Bytes that
    the chain doesn't reach are no records; a chain that ends before its archive does is an error, as records would be missing.
    """

    def parse(batches):
        rows = []
        for file, start, seq, data in _numbered(batches):
            magic, head, length = piece(data)
            whole = magic and head >= 0 and len(data) == head + length + len(END)
            rows.append((file, start, seq, len(data), magic, head, length, *(_record(data[: head - 4], data[head : head + length]) if whole else (None,) * 7)))
            if len(rows) == 1024:
                yield _arrow(PIECES, rows)
                rows = []
        yield _arrow(PIECES, rows)

    pieces, _ = staged(_cut(spark, path, glob).mapInArrow(parse, PIECES), "pieces")
    found = ", ".join(["file string", "offset long", *(c for c in PIECES.split(", ")[7:]), "start long", "seq long", "n long", "head long", "length long"])

    def chained(t: pa.Table) -> pa.Table:
        t = t.sort_by([("start", "ascending"), ("seq", "ascending")])
        number = lambda c: t.column(c).to_numpy()
        try:
            first, begins, block = chain(number("size"), number("magic").astype(bool), number("head"), number("length"))
        except ValueError as e:
            raise ValueError(f"{t.column('file')[0]}: {e}") from e
        # head, length: of what a record's pieces make together, the header's and the block's.
        ends = np.append(begins[first[1:]], begins[-1] + t.column("size")[-1].as_py() + len(MAGIC_HEAD))[: len(first)] - len(MAGIC_HEAD)
        head = block[first] - begins[first]
        own = t.take(pa.array(first))
        cols = [own.column("file"), pa.array(begins[first] - len(MAGIC_HEAD)), *(own.column(c) for c in _FIELDS), own.column("start"), own.column("seq")]
        return pa.table([*cols, pa.array(np.diff(np.append(first, t.num_rows))), pa.array(head), pa.array(ends - block[first] - len(END))], names=[c.split()[0] for c in found.split(", ")])

    records, _ = staged(pieces.groupBy("file").applyInArrow(chained, found), "chained")
    whole = records.where("n = 1").drop("start", "seq", "n", "head", "length")
    if not records.where("n > 1").limit(1).count():
        return whole
    # Records whose payloads hold magic lines: their pieces are read again and meet.
    place = Window.partitionBy("file").orderBy("start", "seq")
    parts = records.where("n > 1").select("file", "offset", "start", "seq", "n", "head", "length")
    of = pieces.join(parts.select("file").distinct(), "file", "left_semi").select("file", "start", "seq", F.row_number().over(place).alias("k"))
    firsts_ = of.join(parts, ["file", "start", "seq"]).select("file", "offset", "head", "length", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("n") - 1)).alias("k"))
    wanted = of.join(firsts_, ["file", "k"]).select("file", "start", "seq", "offset", "head", "length", "k")

    def told(batches):
        for file, start, seq, data in _numbered(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "seq": [seq], "data": pa.array([data], pa.binary())})

    again = _cut(spark, path, glob).mapInArrow(told, "file string, start long, seq long, data binary").join(wanted, ["file", "start", "seq"]).select("file", "offset", "k", "head", "length", "data")

    def joined(batches):
        now, held = None, []
        for file, offset, head, length, data in arrow_rows(batches, "file", "offset", "head", "length", "data"):
            if now != (file, offset, head, length):
                if now:
                    yield made(now, held)
                now, held = (file, offset, head, length), []
            held.append(data)
        if now:
            yield made(now, held)

    def made(now, held):
        data, (file, offset, head, length) = MAGIC_HEAD.join(held), now
        return _arrow(RECORDS, [(file, offset, *_record(data[: head - 4], data[head : head + length]))])

    met = again.repartition(n_partitions(spark), "file", "offset").sortWithinPartitions("file", "offset", "k").mapInArrow(joined, RECORDS)
    return whole.unionByName(met)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the rows as archives and reads them back: id_col, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the record it refers to, whose digest must be the one it claims. Null payloads are empty; null ids come
    back as null; repeated rows come back repeated; an empty table gives an empty one; other columns play no part.
    """
    spark = pages.sparkSession
    path = staged_path(spark, "archives")
    write_archives(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col, least=least)
    records, _ = staged(read_archives(spark, path), "records")
    kind = pages.schema[id_col].dataType
    of = records.where("type = 'response'").select(F.col("page").alias("r_page"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes"))
    # Responses of one page and digest are alike.
    of = of.where(F.col("r_page").isNotNull()).dropDuplicates(["r_page", "r_digest"])
    own, revisits = records.where("type = 'response'"), records.where("type = 'revisit'")
    got = revisits.join(of, (F.col("refers_to") == F.col("r_page")) & (F.col("claimed_digest") == F.col("r_digest")), "left")
    cols = lambda n, d, r: (F.col("page").cast(kind).alias(id_col), F.col(n).alias("payload_bytes"), F.col(d).alias("payload_digest"), F.col("type").alias("record_type"), r.cast(kind).alias("refers_to"))
    return own.select(*cols("payload_bytes", "payload_digest", F.lit(None))).unionByName(got.select(*cols("r_bytes", "r_digest", F.col("refers_to"))))
