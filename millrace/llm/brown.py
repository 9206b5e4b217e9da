"""Scoring by a Brown class n-gram model.

P(word | previous word) = P(class | previous class) P(word | class), mixed with P(word). Classes come from exchange clustering: units
move, one at a time, to the class that raises the likelihood of the corpus's class bigrams most. The units are the most frequent
words, one by one, and all other words by groups of like spelling (their last letters), so that the clustering's tables have a fixed
size, whatever the corpus. Then every other word of the corpus leaves its group for the class that its own neighbours make likeliest;
only words never seen keep their group's. Counts and classes are of all words.

Texts are read twice: once to count words, once to write them as numbers of the frequent words that workers hold, beside each text's
own list of its other words. All that follows works on those numbers. The other words meet once, in a table ordered by word, where the
training texts' occurrences give a word's count and class, and every text that has it is told both.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_kind, arrow_rows, most_frequent, n_partitions, staged, unstage

#: What ends every text; white space keeps it apart from any word.
END = b" "
#: Rows of a batch that are worked on at once.
SLICE = 128
#: In a text's codes, the bit of words never seen.
UNSEEN = 128


def tokens(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8 with A-Z lowered, split at ASCII white space, and one end. Very long words are named by a digest."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if max(map(len, words), default=0) > 64:
        words = [w if len(w) <= 64 else b" " + hashlib.sha256(w).hexdigest()[:60].encode() for w in words]
    words.append(END)
    return words


def group_of(word: bytes, groups: int) -> int:
    """The group of the words that end alike."""
    core = word.rstrip(b".,;:!?\"')")
    return zlib.crc32(core[-3:] + b"|" + word[len(core) :][:1]) % groups


def exchange(u: np.ndarray, v: np.ndarray, n: np.ndarray, units: int, classes: int, rounds: int | None) -> np.ndarray:
    """Exchange clustering of units by their bigram counts n of (u, v); returns each unit's class.

    It maximises sum g(N(c, d)) - sum g(N(c, .)) - sum g(N(., c)), g(x) = x log x, moving a unit to the best class until no more
    than one unit in a thousand moves or the rounds, if any are given, are over. Units begin in classes by frequency rank.
    """

    def g(x):
        return x * np.log(np.maximum(x, 1e-300))

    by_u, by_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    at_u, at_v = np.searchsorted(u[by_u], np.arange(units + 1)), np.searchsorted(v[by_v], np.arange(units + 1))
    weight = np.bincount(u, n, units) + np.bincount(v, n, units)
    order = np.argsort(-weight, kind="stable")
    # Less is rounding, and might go round in circles.
    least = 1e-9 + 1e-12 * g(n.sum())
    cls = np.zeros(units, np.int64)
    cls[order] = np.arange(units) % classes
    m = np.zeros((classes, classes))
    np.add.at(m, (cls[u], cls[v]), n)
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = 0
        for x in order:
            if not weight[x]:
                break
            out, into = by_u[at_u[x] : at_u[x + 1]], by_v[at_v[x] : at_v[x + 1]]
            self_n = n[out][v[out] == x].sum()
            right = np.bincount(cls[v[out]], n[out] * (v[out] != x), classes)
            left = np.bincount(cls[u[into]], n[into] * (u[into] != x), classes)
            a = cls[x]
            m[a] -= right
            m[:, a] -= left
            m[a, a] -= self_n
            # The sums of the other rows and columns with x's pairs in them, wherever x goes.
            row, col = m.sum(1) + left, m.sum(0) + right
            r_all, l_all = right.sum() + self_n, left.sum() + self_n
            # The gain of x in class c: row c gets `right`, column c gets `left`, and the diagonal gets both and x's own pairs.
            gain = (g(m + right) - g(m)).sum(1) + (g(m + left[:, None]) - g(m)).sum(0)
            d = np.diagonal(m)
            gain += g(d + right + left + self_n) - g(d + right) - g(d + left) + g(d)
            gain -= g(row + r_all) - g(row) + g(col + l_all) - g(col)
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + least:
                best = a
            moved += best != a
            cls[x] = best
            m[best] += right
            m[:, best] += left
            m[best, best] += self_n
        if moved * 1000 <= units:
            break
    return cls


@dataclass(frozen=True)
class BrownModel:
    name: str  # unique
    words: list[bytes] | None  # those that workers hold, most frequent first; None in workers
    held: object  # broadcast: them, joined by line ends
    counts: np.ndarray  # of the held words and, last, of the end
    units: np.ndarray  # theirs in the exchange
    first: np.ndarray  # class by unit, of the exchange
    cls: np.ndarray  # the final classes of the held words and the end
    heads: int  # so many of the held words are units of their own
    classes: int
    whole: bool  # no other words are known
    sides: np.ndarray  # [class of the left neighbour, then of the right; class]: what an occurrence beside it adds to a word's log likelihood
    discount: float
    train_tokens: int
    vocabulary: int
    known: np.ndarray  # [previous class, class]: log10 of what a known word's count, less the discount, is multiplied by
    unknown: np.ndarray  # [previous class, class]: log10 probability of an unknown word
    encoded: DataFrame | None  # the documents it was fitted beside, as numbers
    coded: DataFrame | None  # their classes, for scoring

    @property
    def end(self) -> int:
        """The end's number; a text's other words come after it."""
        return len(self.counts) - 1

    @property
    def groups(self) -> int:
        return len(self.first) - self.heads - 1

    def light(self) -> BrownModel:
        return replace(self, words=None, encoded=None, coded=None)


def fit(docs: DataFrame, train: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text", head: int = 2000, groups: int = 500, kept: int = 1 << 18, classes: int = 48, rounds: int | None = None, mix: float = 0.9) -> BrownModel:
    """Counts all training documents, clusters all their words, and prepares all of docs for scoring.

    head, groups: units of the exchange (frequent words, spelling groups), which bound its bigram table to (head + groups)^2 cells; other
    words get their classes by their own neighbours. kept: frequent words that every worker holds, of at most 64 bytes each; others are
    sorted and joined. It bounds memory, not results. Null texts are empty: an end only. Without training documents the model gives every
    word one unknown probability.
    """
    spark = docs.sparkSession
    assert 0 < classes < UNSEEN and head + groups < 1 << 16
    texts = docs.select(F.col(id_col).alias("_1"), F.col(text_col).alias("_2"), F.coalesce(train(F.col(id_col)), F.lit(False)).alias("train"))

    def count(batches):
        seen: Counter = Counter()
        for (text,) in arrow_rows(batches, "_2"):
            seen.update(tokens(text))
            if len(seen) > 400_000:
                yield from _counted(seen)
                seen = Counter()
        yield from _counted(seen)

    # Each task sends a word once for all its texts; sums are added before and after the exchange.
    counts, counted = staged(texts.where("train").select("_2").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    one = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("n") == 1, 1)), F.sum(F.when(F.col("n") == 2, 1))).first()
    total, distinct, n1, n2 = (int(x or 0) for x in one)
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ends = [r.n for r in counts.where(F.col("word") == F.lit(END)).collect()]
    own, n_words = counts.where(F.col("word") != F.lit(END)), distinct - len(ends)
    # At most `kept` or `head` words of at most 64 bytes; both are beginnings of one order.
    top, _ = most_frequent(own, "n", kept)
    if top.num_rows < min(head, n_words):
        top = own.orderBy(F.desc("n"), "word").limit(head).toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    words, n_of = top.column("word").to_pylist(), top.column("n").to_numpy()
    unstage(spark, counted)
    heads = min(head, len(words))
    units = np.array([*range(heads), *(heads + 1 + group_of(w, groups) for w in words[heads:]), heads], np.int64)
    held = spark.sparkContext.broadcast(b"\n".join(words))
    model = BrownModel(
        uuid.uuid4().hex, words, held, np.append(n_of, sum(ends)).astype(float), units, np.zeros(heads + 1 + groups, np.int64), np.zeros(len(units), np.int64), heads, classes,
        len(words) >= n_words, np.zeros((2 * classes, classes)), discount, total, distinct, np.zeros(0), np.zeros(0), None, None,
    )
    encoded = _encoded(texts, model, id_col)
    model = replace(model, encoded=encoded)
    learn = encoded.where("train").select("ids", "groups")

    n_units, alone = len(model.first), model.light()

    def pairs(batches):
        out = np.zeros(n_units * n_units, np.int64)
        for _, ids, _, of_rare, _ in _sequences(batches, alone):
            u = np.append(alone.units, of_rare)[ids]
            out += np.bincount(np.append(heads, u[:-1]) * n_units + u, minlength=len(out))
        keys = np.nonzero(out)[0]
        yield from _packed(keys, out[keys], n_units)

    def added(batches):
        yield from _unpacked(batches, n_units, lambda rows, sums: _packed(*_cells(rows, sums), n_units))

    # At most n_units^2 cells, whatever the corpus.
    grams = learn.mapInArrow(pairs, PACKED).repartition(n_partitions(spark), "row").mapInArrow(added, PACKED).toArrow()
    at, n = _flat(grams.column("row"), grams.column("cols"), grams.column("ns"))
    u, v = grams.column("row").to_numpy()[at[0]], at[1]
    order = np.lexsort((v, u))
    u, v, n = u[order], v[order], n[order].astype(float)
    first = exchange(u, v, n, n_units, classes, rounds)
    m = np.zeros((classes, classes))
    np.add.at(m, (first[u], first[v]), n)
    # The log likelihood of a word with a left, of one with a right neighbour of a class (row) by the word's class (column).
    of_left, of_right = np.log((m + 0.5) / (m.sum(0) + 0.5 * classes)), np.log((m.T + 0.5) / (m.sum(1) + 0.5 * classes))
    model = replace(model, first=first, cls=first[units], sides=np.concatenate([of_left, of_right]))

    if heads < len(words):
        beside, sides = model.light(), model.sides

        def neighbours(batches):
            keys, sums, some, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            for _, ids, _, of_rare, _ in _sequences(batches, beside):
                left, right = _beside(beside, ids, of_rare)
                at = np.nonzero((ids >= heads) & (ids < beside.end))[0]
                some += [ids[at] * 2 * classes + left[at], ids[at] * 2 * classes + classes + right[at]]
                size += len(at)
                if size > 1_000_000:
                    keys, sums = _added(keys, sums, some)
                    some, size = [], 0
                if len(keys) > 8_000_000:
                    yield from _packed(keys, sums, 2 * classes)
                    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys, sums = _added(keys, sums, some)
            yield from _packed(keys, sums, 2 * classes)

        def likeliest(batches):
            yield from _unpacked(batches, 2 * classes, lambda rows, sums: [pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(_likeliest(sums, sides))], ["row", "c"])])

        # A number for each held word.
        found = learn.mapInArrow(neighbours, PACKED).repartition(n_partitions(spark), "row").mapInArrow(likeliest, "row long, c long").toArrow()
        model.cls[found.column("row").to_numpy()] = found.column("c").to_numpy()

    coded = _coded(encoded, model, id_col, encoded)
    model = replace(model, coded=coded.where("cell is null").drop("cell", "sum"))
    # Class bigrams, and how many distinct words share a class, by the words' final classes.
    sums = np.zeros(classes * classes + classes)
    for r in coded.where("cell is not null").groupBy("cell").agg(F.sum("sum").alias("sum")).collect():
        sums[r.cell] = r.sum
    m, types = sums[: classes * classes].reshape(classes, classes), np.rint(sums[classes * classes :])
    tokens_of = m.sum(0)
    spread = (tokens_of + 0.5) / (tokens_of.sum() + 0.5 * classes)
    strength = 5.0
    step = (m + strength * spread) / (m.sum(1, keepdims=True) + strength)
    mass = np.where(tokens_of > 0, discount * types / np.maximum(tokens_of, 1), 1.0)
    known = mix * step / np.maximum(tokens_of, 1) + (1 - mix) / max(total, 1)
    # A word never seen takes the discounted mass of its class; over all classes that is what the known words leave.
    unknown = mix * step * mass + (1 - mix) * discount * types / max(total, 1)
    return replace(model, known=np.log10(known), unknown=np.log10(unknown))


def word_classes(model: BrownModel) -> DataFrame:
    """(word, n, c): count and class of every word of the training documents, the end's too where there is one."""
    spark, n = model.encoded.sparkSession, model.counts.astype(np.int64)
    own = [(w, int(n[i]), int(model.cls[i])) for i, w in enumerate([*model.words, END]) if n[i]]
    held = spark.createDataFrame(own, "word binary, n long, c int")
    return held if model.whole else held.unionByName(_met(_others(model.encoded.where("train"), model, False), model, True))


def score(docs: DataFrame, model: BrownModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with n_tokens, n_known, base_score and score (log10 probabilities of the text with its end).

    base_score is the add-one unigram model's. Null texts are empty. Every row gives one row, repeated ids and texts too; an empty table
    gives an empty one; other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("_1"), F.col(text_col).alias("_2"), F.lit(False).alias("train"))
    coded = _coded(_encoded(texts, model, id_col), model, id_col, model.encoded)
    return _scored(coded.where("cell is null").drop("cell", "sum"), model, id_col)


def fitted_scores(model: BrownModel, *, id_col: str = "doc_id") -> DataFrame:
    """What score() gives for the documents that the model was fitted beside, without reading them again."""
    return _scored(model.coded, model, id_col)


def _scored(coded: DataFrame, model: BrownModel, id_col: str) -> DataFrame:
    known, unknown, classes, start = model.known, model.unknown, model.classes, int(model.cls[model.end])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                # Every text has an end, which precedes the next one's first word.
                codes = [np.frombuffer(b, np.uint8) for b in part.column("codes").to_pylist()]
                c = np.concatenate(codes).astype(np.int64)
                cls, new = c & (UNSEEN - 1), c >= UNSEEN
                step = np.append(start, cls[:-1]) * classes + cls
                own = np.where(new, unknown.ravel()[step], known.ravel()[step])
                own = np.add.reduceat(own, np.append(0, np.cumsum([len(x) for x in codes])[:-1])) + part.column("part").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("_1", "n_tokens", "n_known", "base_score")), pa.array(own)], ["_1", "n_tokens", "n_known", "base_score", "score"])

    sql = coded.schema["_1"].dataType.simpleString()
    return coded.mapInArrow(run, f"_1 {sql}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("_1", id_col)


def _encoded(texts: DataFrame, model: BrownModel, id_col: str) -> DataFrame:
    """A row for each text (_1, _2, train): key (unique), _1, train, ids, and its distinct words that workers don't hold: words, groups (their units).

    ids: numbers of the held words, the end's, and from there on places in `words`; see _squeezed.
    """
    alone, (kind, sql) = model.light(), arrow_kind(texts, "_1")

    def run(batches):
        index, end, heads, groups = _index(alone), alone.end, alone.heads, alone.groups
        key, rows, size, cache = TaskContext.get().partitionId() << 36, [], 0, {}
        for i, text, train in arrow_rows(batches, "_1", "_2", "train"):
            words = tokens(text)
            ids = np.fromiter(map(index.get, words, itertools.repeat(-1)), np.int64, len(words))
            at, own = np.nonzero(ids < 0)[0], {}
            if len(at):
                ids[at] = [own.setdefault(words[x], end + 1 + len(own)) for x in at.tolist()]
            of = np.array([heads + 1 + g for g in _groups(own, cache, groups)], np.uint16)
            rows.append((key, i, train, _squeezed(ids), b"\n".join(own), of.tobytes()))
            key, size = key + 1, size + len(words)
            if size > 500_000:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)

    def batch(rows):
        kinds = {"key": pa.int64(), "_1": kind, "train": pa.bool_(), "ids": pa.binary(), "words": pa.binary(), "groups": pa.binary()}
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))

    return staged(texts.mapInArrow(run, f"key long, _1 {sql}, train boolean, ids binary, words binary, groups binary"), "encoded")[0]


def _squeezed(ids: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, the number of planes first."""
    planes = max(1, (int(ids.max()).bit_length() + 7) // 8)
    raw = ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + zstandard.compress(raw, 1)


def _wide(squeezed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(squeezed[1:]), np.uint8).reshape(squeezed[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


def _sequences(batches, model: BrownModel) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of _encoded, a slice at a time: the slice, all its ids in one sequence, the texts' lengths, the units of its other words, and
    each text's number of those. In ids, other words are places in that list of units, after the end's number."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            texts = [_wide(b) for b in part.column("ids").to_pylist()]
            of = [np.frombuffer(b, np.uint16) for b in part.column("groups").to_pylist()]
            lengths, others = np.array([len(x) for x in texts]), np.array([len(x) for x in of])
            ids = np.concatenate(texts)
            ids += np.where(ids > model.end, np.repeat(np.cumsum(others) - others, lengths), 0)
            yield part, ids, lengths, np.concatenate(of).astype(np.int64), others


def _beside(model: BrownModel, ids: np.ndarray, of_rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first classes of the words on both sides of each; ends part texts, and nothing needs what follows one."""
    c = model.first[np.append(model.units, of_rare)[ids]]
    end = model.first[model.units[model.end]]
    return np.append(end, c[:-1]), np.append(c[1:], end)


def _others(encoded: DataFrame, model: BrownModel, keyed: bool) -> DataFrame:
    """A row for each text and word of its that workers don't hold: word, key, at (place in its list, and its group's class), beside (classes on both sides, of
    each occurrence in a training text). Without keyed, key is null: nobody asks."""
    alone, classes = model.light(), model.classes

    def run(batches):
        for part, ids, lengths, of_rare, others in _sequences(batches, alone):
            if not len(of_rare):
                continue
            train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), lengths)
            left, right = _beside(alone, ids, of_rare)
            at = np.nonzero((ids > alone.end) & train)[0]
            which = ids[at] - alone.end - 1
            order = np.argsort(which, kind="stable")
            sides = np.stack([left[at][order], right[at][order] + classes], 1).astype(np.uint8)
            ends = np.cumsum(np.bincount(which, minlength=len(of_rare))) * 2
            words = [w for joined in part.column("words").to_pylist() if joined for w in joined.split(b"\n")]
            place = np.arange(len(of_rare)) - np.repeat(np.cumsum(others) - others, others)
            key = np.repeat(part.column("key").to_numpy(), others) if keyed else None
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(key) if keyed else pa.nulls(len(words), pa.int64()), pa.array(place << 8 | alone.first[of_rare]), _blobs(ends, sides)],
                ["word", "key", "at", "beside"],
            )

    return encoded.select("key", "train", "ids", "words", "groups").mapInArrow(run, "word binary, key long, at long, beside binary")


def _blobs(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in data, by where (in bytes) each ends."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _met(others: DataFrame, model: BrownModel, words: bool) -> DataFrame:
    """key, j, n, c for every row of _others with a key: the word's count in training texts and its class; or with words: word, n, c for every word seen there."""
    alone, classes = model.light(), model.classes

    def run(batches):
        word, sums, asked = None, None, []  # of the last word, whose rows may go on; asked: those not answered yet
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("word")
            starts = np.append(0, np.nonzero(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False))[0] + 1)
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(col))))
            size = pc.binary_length(batch.column("beside")).to_numpy()
            flat = np.frombuffer(b"".join(batch.column("beside").to_pylist()), np.uint8)
            now = np.bincount(np.repeat(which, size) * 2 * classes + flat, minlength=len(starts) * 2 * classes).reshape(len(starts), -1)
            rows = [batch.column("key").to_numpy(zero_copy_only=False), batch.column("at").to_numpy(), which]
            if word == col[0].as_py():
                now[0] += sums
                rows = [np.concatenate(x) for x in zip(*[(k, a, np.zeros(len(k), np.int64)) for k, a in asked], rows, strict=True)]
            elif word is not None:
                yield from answered([word], sums[None], *(np.concatenate(x) for x in zip(*((k, a) for k, a in asked), strict=True)), None) if asked or words else ()
            word, sums, asked = col[len(col) - 1].as_py(), now[-1], []
            # Occurrences in training texts come first, so that a word's count is whole at its first other row.
            cut = len(rows[2]) if size[-1] == 0 and not words else np.searchsorted(rows[2], len(starts) - 1)
            if cut < len(rows[2]):
                asked = [(rows[0][cut:], rows[1][cut:])]
            yield from answered(col.take(pa.array(starts[: len(starts) - bool(words)])).to_pylist() if words else None, now[: len(starts) - 1] if words else now, *(x[:cut] for x in rows))
        if word is not None and (asked or words):
            yield from answered([word], sums[None], *(np.concatenate(x) for x in zip(*asked, strict=True)), None)

    def answered(names, sums, key, at, which):
        n, c = sums[:, :classes].sum(1), _likeliest(sums, alone.sides)
        if words:
            seen = n > 0
            yield pa.RecordBatch.from_arrays([pa.array([w for w, s in zip(names, seen, strict=True) if s], pa.binary()), pa.array(n[seen]), pa.array(c[seen], pa.int32())], ["word", "n", "c"])
            return
        which = np.zeros(len(key), np.int64) if which is None else which
        own = ~np.isnan(key) if key.dtype.kind == "f" else np.ones(len(key), bool)
        key, at, which = key[own].astype(np.int64), at[own], which[own]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at >> 8), pa.array(n[which]), pa.array(np.where(n[which] > 0, c[which], at & 255))], ["key", "j", "n", "c"])

    by_word = others.repartition(n_partitions(others.sparkSession), "word").sortWithinPartitions("word", F.length("beside") == 0)
    return by_word.mapInArrow(run, "word binary, n long, c int" if words else "key long, j long, n long, c long")


def _coded(encoded: DataFrame, model: BrownModel, id_col: str, learnt: DataFrame) -> DataFrame:
    """A row for each text: _1, n_tokens, n_known, base_score, part (what the counts of its known words give its score) and codes (a byte for each
    word: its class, and whether it is known); and rows of cell and sum: of the training texts, class bigrams and, after them, the number
    of distinct words by class. learnt: what else has training texts."""
    if model.whole:
        told = encoded.select("_1", "train", "ids", "groups", F.lit(None).cast("array<struct<j:bigint,n:bigint,c:bigint>>").alias("told"))
    else:
        asked = _others(encoded, model, True)
        if learnt is not encoded:
            asked = asked.union(_others(learnt.where("train"), model, False))
        met = _met(asked, model, False).groupBy(F.col("key").alias("key_")).agg(F.collect_list(F.struct("j", "n", "c")).alias("told"))
        told = encoded.join(met, F.col("key") == F.col("key_"), "left").select("_1", "train", "ids", "groups", "told")
    alone, classes, (kind, sql) = model.light(), model.classes, arrow_kind(encoded, "_1")
    base_all = float(np.log10(model.train_tokens + model.vocabulary + 1))

    def run(batches):
        counted = np.zeros(classes * classes + classes)
        for part, ids, lengths, of_rare, others in _sequences(batches, alone):
            n_of, c_of = np.zeros(len(of_rare)), alone.first[of_rare]
            told = part.column("told")
            given = told.flatten()
            if len(given):
                j, n, c = (given.field(k).to_numpy() for k in range(3))
                at = np.repeat(np.cumsum(others) - others, pc.fill_null(pc.list_value_length(told), 0).to_numpy()) + j
                n_of[at], c_of[at] = n, c
            n, cls = np.append(alone.counts, n_of)[ids], np.append(alone.cls, c_of)[ids]
            seen, starts = n > 0, np.cumsum(lengths) - lengths
            per = lambda x: np.add.reduceat(x, starts)
            learn = np.repeat(part.column("train").to_numpy(zero_copy_only=False), lengths)
            steps = np.append(alone.cls[alone.end], cls[:-1]) * classes + cls
            counted[: classes * classes] += np.bincount(steps[learn], minlength=classes * classes)
            # A word that occurs n times adds n times 1 / n.
            counted[classes * classes :] += np.bincount(cls[learn], 1 / n[learn], classes)
            codes = np.where(seen, cls, cls | UNSEEN).astype(np.uint8)
            own = [part.column("_1"), pa.array(lengths), pa.array(per(seen.astype(np.int64))), pa.array(per(np.log10(n + 1)) - base_all * lengths), pa.array(per(np.log10(np.where(seen, n - alone.discount, 1.0)))), _blobs(np.cumsum(lengths), codes)]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(lengths), pa.int32()), pa.nulls(len(lengths), pa.float64())], names)
        at = np.nonzero(counted)[0]
        none = [pa.nulls(len(at), t) for t in (kind, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array(counted[at])], names)

    names = ["_1", "n_tokens", "n_known", "base_score", "part", "codes", "cell", "sum"]
    return staged(told.mapInArrow(run, f"_1 {sql}, n_tokens long, n_known long, base_score double, part double, codes binary, cell int, sum double"), "coded")[0]


def _likeliest(sums: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The likeliest class of words by how often (columns) a class stands at their left, at their right. Rounded, so that the order of adding doesn't decide."""
    return np.round(sums @ sides, 6).argmax(1)


#: Counts by row and column: a row's columns and their counts, in 16 and 32 bits.
PACKED = "row long, cols binary, ns binary"


def _packed(keys: np.ndarray, sums: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED of sorted keys, row * width + column."""
    row = keys // width
    starts = np.append(0, np.nonzero(np.diff(row))[0] + 1)[: len(keys)]
    # A count that doesn't fit, which takes billions in one task, goes in parts.
    parts = max(1, -(-int(sums.max(initial=0)) // (2**32 - 1)))
    for at in range(0, len(starts), 20_000):
        a, b = starts[at], starts[at + 20_000] if at + 20_000 < len(starts) else len(keys)
        ends = np.append(starts[at + 1 : at + 20_000], b) - a
        for p in range(parts):
            n = sums[a:b] // parts + (p < sums[a:b] % parts)
            yield pa.RecordBatch.from_arrays([pa.array(row[starts[at : at + 20_000]]), _blobs(ends * 2, (keys[a:b] % width).astype(np.uint16)), _blobs(ends * 4, n.astype(np.uint32))], ["row", "cols", "ns"])


def _flat(row: pa.Array, cols: pa.Array, ns: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Which row, which column, and the count, of each cell."""
    col = np.frombuffer(b"".join(cols.to_pylist()), np.uint16).astype(np.int64)
    size = pc.binary_length(cols).to_numpy() // 2
    return (np.repeat(np.arange(len(row)), size), col), np.frombuffer(b"".join(ns.to_pylist()), np.uint32).astype(np.int64)


def _unpacked(batches, width: int, make) -> Iterator[pa.RecordBatch]:
    """make(rows, sums) of the task's rows and their sums by column."""
    index: dict[int, int] = {}
    sums = np.zeros((0, width), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        mine = np.fromiter((index.setdefault(r, len(index)) for r in batch.column("row").to_pylist()), np.int64, batch.num_rows)
        if len(index) > len(sums):
            sums = np.concatenate([sums, np.zeros((max(len(index) - len(sums), len(sums)), width), np.int64)])
        (at, col), n = _flat(*(batch.column(c) for c in ("row", "cols", "ns")))
        np.add.at(sums, (mine[at], col), n)
    rows = np.fromiter(index, np.int64, len(index))
    order = np.argsort(rows)
    for at in range(0, len(rows), 4096):
        some = order[at : at + 4096]
        yield from make(rows[some], sums[some])


def _cells(rows: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts, for _packed, of what isn't zero."""
    a, b = np.nonzero(sums)
    return rows[a] * sums.shape[1] + b, sums[a, b]


def _added(keys: np.ndarray, sums: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their sums with one more for each of the further keys."""
    new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *more]), return_counts=True)
    out, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
    return out, np.bincount(at, np.concatenate([sums, n]), len(out)).astype(np.int64)


def _counted(seen: Counter):
    words = list(seen)
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.binary()), "n": pa.array([seen[w] for w in part], pa.int64())})


def _groups(words, cache: dict[bytes, int], groups: int) -> list[int]:
    """The spelling groups of words."""
    out = []
    for w in words:
        x = cache.get(w)
        if x is None:
            if len(cache) > 50_000:
                cache.clear()
            x = cache[w] = group_of(w, groups)
        out.append(x)
    return out


#: In each worker, the numbers of the last model's words.
_UNPACKED: dict = {}


def _index(model: BrownModel) -> dict[bytes, int]:
    if model.name not in _UNPACKED:
        joined = model.held.value
        _UNPACKED.clear()
        _UNPACKED[model.name] = {w: i for i, w in enumerate(joined.split(b"\n"))} if joined else {}
        _UNPACKED[model.name][END] = model.end
    return _UNPACKED[model.name]
