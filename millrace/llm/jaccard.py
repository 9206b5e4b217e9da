"""N-gram Jaccard join by T-occurrence search.

Texts with equal shingle sets form a class, and one of each class, its representative, is searched for the others:

1. A document's inverted lists are those of its shingles. Frequent shingles have long lists; they are found by counting over all
   documents and come last in the one order of shingles that all documents use.
2. Two sets that overlap in T elements share at least m within their first n - T + m elements (T: the least overlap that the threshold
   allows a set of n). So only these short lists are joined: pairs with m common elements become edges. A very long list
   among them is not expanded into pairs; its members are joined to one of them, which can only add candidates.
3. Connected components of these edges hold every link inside. Each component's sets go to one task, or, above a size, in blocks to
   several, each with the component's pivots: a few sets that share most of their first elements with others, as what others are copies of
   does. There DivideSkip searches, for each set, the components of smaller sets: a heap merges the short lists, long ones are probed by
   bisection, and sets are compared where the required overlap is reached. Of a component in blocks, what these links connect to its
   largest part is settled, as it makes no difference which links inside that part were not looked for. Only the rest meets every block.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_rows, fresh, most_frequent, n_partitions, staged, unstage
from millrace.llm.components import components

#: Odd multipliers, one for each place of a word in a shingle.
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) + 2 * i) % 2**64 | 1 for i in range(64)], np.uint64)
_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of k words (fewer words: of the whole sequence as one; none: of nothing).

    Words are what ASCII white space separates, A-Z lowered.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    if len(_WORDS) > 150_000:
        _WORDS.clear()
    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        ids[i] = h
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += ids[i : i + n] * _ODD[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |x & y| >= num * |x | y|, for sorted arrays of distinct values."""
    if len(x) < len(y):
        x, y = y, x
    both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
    return den * both >= num * (len(x) + len(y) - both)


def divide_skip(lists: list[list[int]], t: int, mu: float = 0.01) -> Iterator[int]:
    """The values that occur in at least t of the sorted lists, each list holding a value once.

    mu weighs merging against probing: the smaller, the more lists are probed. Bisecting costs little beside the heap here.
    """
    if len(lists) < t:
        return
    lists = sorted(lists, key=len)
    n_long = max(0, min(t - 1, int(t / (mu * math.log2(len(lists[-1]) + 1) + 1))))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    need = t - n_long
    heap = [(s[0], i, 0) for i, s in enumerate(short) if s]
    heapq.heapify(heap)
    while len(heap) >= need:
        value, moved = heap[0][0], []
        while heap and heap[0][0] == value:
            moved.append(heapq.heappop(heap))
        count = len(moved)
        if count >= need:
            for j, s in enumerate(long):
                if count >= t or count + len(long) - j < t:
                    break
                at = bisect.bisect_left(s, value)
                count += at < len(s) and s[at] == value
            if count >= t:
                yield value
            to = value + 1
        else:
            # The next value that can still occur often enough is at least what heads the heap after need - 1 lists left it.
            while heap and len(moved) < need - 1:
                moved.append(heapq.heappop(heap))
            if not heap:
                return
            to = heap[0][0]
        for _, i, at in moved:
            at = bisect.bisect_left(short[i], to, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))


def search(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(id, smallest id of its component) for all sets that link with another; sets are distinct.

    Sets come in the order of their sizes. The inverted lists hold components of the sets before: a component whose united shingles
    overlap in fewer than T holds no link, and one link settles a component.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    lists: dict[int, list[int]] = {}
    united: dict[int, set[int]] = {}
    members: dict[int, list[int]] = {}
    for serial, i in enumerate(order):
        x = sets[i]
        t = max(1, -(-num * len(x) // den))
        mine = x.tolist()
        found = list(divide_skip([at for v in mine if (at := lists.get(v))], t))
        joins = [c for c in found if any(num * len(x) <= den * len(sets[y]) and linked(x, sets[y], num, den) for y in reversed(members[c]))]
        to = max(joins, key=lambda c: len(united[c]), default=serial)
        for c in joins:
            if c != to:
                for v in united[c]:
                    at = lists[v]
                    del at[bisect.bisect_left(at, c)]
                    if v not in united[to]:
                        bisect.insort(at, to)
                united[to] |= united.pop(c)
                members[to] += members.pop(c)
        have = united.setdefault(to, set())
        for v in mine:
            if v not in have:
                bisect.insort(lists.setdefault(v, []), to)
        have.update(mine)
        members.setdefault(to, []).append(i)
    out = []
    for group in members.values():
        if len(group) > 1:
            least = min(ids[i] for i in group)
            out += [(ids[i], least) for i in group]
    return out


def jaccard_components(
    docs: DataFrame, *, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text",
    need: int = 3, hot: int = 1 << 18, hot_count: int = 16, long_list: int = 256, group: int = 512, group_shingles: int = 250_000, pivots: int = 8, with_digest: bool = False,
) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links reach, itself included) for every row.

    Documents link when den * |intersection| >= num * |union| of their shingle sets. need: m above. hot: how many frequent shingles
    workers know, at most; hot_count: from which count. They order shingles and so bear on the cost alone, as do long_list (where lists
    join members to one of them), group and group_shingles (above which sets or shingles a component is searched in blocks of half as many),
    and pivots (how many sets every block of a component has). A shingle is known by 64 bits of a hash of its words, so sets of
    n and m shingles are taken to share a wrong one with a chance of nm / 2^64: 10^-10 for two texts of 40 000 words.

    Null and white texts have an empty set, link with nothing and keep their own id. A row with a null id takes part in no link: its
    component is that of equal texts with an id, else null. Rows with one id and unlike texts each keep their own set; the id links
    what they link. Repeated rows are repeated. Other columns play no part. with_digest: also digest, equal for equal sets (null: empty).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def profile(batches):
        held, size, rows = [], 0, []
        for i, text in arrow_rows(batches, "id", "text"):
            s = shingle_set(text, words)
            rows.append((i, len(s), _digest(s), None))
            held.append(s)
            size += len(s)
            if size > 4_000_000:
                yield from _profiled(rows, held)
                held, size, rows = [], 0, []
        yield from _profiled(rows, held)

    all_rows, _ = staged(texts.mapInArrow(profile, "id long, n long, digest binary, token long"), "profile")
    own = all_rows.where("token is null").select("id", "n", "digest")
    classes, _ = staged(own.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")

    # Sets that differ can only link from this size on.
    least = next((u - 1 for u in range(2, 10_000) if den * (u - 1) >= num * u), None)
    links = None
    if least is not None:
        links, more = _links(texts, all_rows, classes, words, num, den, least, need, hot, hot_count, long_list, group, group_shingles, pivots)
        unstage(spark, *more)
    reps = classes.select("digest", "rep")
    if links is not None:
        reps = reps.join(links.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("digest", F.coalesce("root", "rep").alias("rep"))
    out = own.join(reps, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("component_id"), *["digest"] * with_digest)


def one_of_each(docs: DataFrame, *, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without the near copies of others: of every group of rows that links connect one stays.

    That is a row of the smallest id, or where none of the group has an id, any. Rows without words link with nothing and all stay. Of
    rows that repeat the smallest id the one of the least text stays. An empty table gives an empty one.
    """
    found = jaccard_components(docs, words=words, num=num, den=den, id_col=id_col, text_col=text_col, with_digest=True)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(fresh(docs, "gone"))).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col(gone.columns[0]), "left_anti")
    has_words = F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"[^ \t-\r]")), F.lit(False))
    # Ids that several rows with words have, and rows without an id, are the exception; only they are looked at again.
    again = found.where(F.col(id_col).isNotNull() & F.col("digest").isNotNull()).groupBy(F.col(id_col).alias(fresh(docs, "again"))).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.limit(1).count():
        named, one = F.col(id_col) == F.col(again.columns[0]), fresh(docs, "one")
        odd = kept.where(has_words).join(again, named, "left_semi").withColumn(one, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col)))
        kept = kept.where(~has_words | F.col(id_col).isNull()).unionByName(kept.where(has_words & F.col(id_col).isNotNull()).join(again, named, "left_anti")).unionByName(odd.where(F.col(one) == 1).drop(one))
    if found.where(F.col(id_col).isNull() & F.col("digest").isNotNull()).limit(1).count():
        digest, one = fresh(docs, "digest"), fresh(docs, "one")
        digested = F.pandas_udf(lambda texts: texts.map(lambda t: _digest(shingle_set(t, words))), "binary")
        loose = kept.where(has_words & F.col(id_col).isNull()).withColumn(digest, digested(F.col(text_col)))
        with_id = found.where(F.col(id_col).isNotNull() & F.col("digest").isNotNull()).select(F.col("digest").alias(fresh(loose, "have"))).distinct()
        loose = loose.join(with_id, F.col(digest) == F.col(with_id.columns[0]), "left_anti")
        loose = loose.withColumn(one, F.row_number().over(Window.partitionBy(digest).orderBy(text_col))).where(F.col(one) == 1).drop(one, digest)
        kept = kept.where(~has_words | F.col(id_col).isNotNull()).unionByName(loose)
    return kept


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _profiled(rows: list[tuple], held: list[np.ndarray]):
    """A row for each document, and one for each shingle that several of these documents have, with their number."""
    values, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "n", "digest", "token"])
    values, counts = values[counts > 1], counts[counts > 1]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(values), pa.binary()), pa.array(values)], ["id", "n", "digest", "token"])


def _links(texts, all_rows, classes, words, num, den, least, need, hot, hot_count, long_list, group, group_shingles, pivots):
    spark = texts.sparkSession
    # At most `hot` pairs of numbers.
    often, p_often = staged(all_rows.where("token is not null").groupBy("token").agg(F.sum("n").alias("c")).where(F.col("c") >= hot_count), "often")
    top, _ = most_frequent(often, "c", hot)
    unstage(spark, p_often)
    tokens, counts = top.column("token").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(tokens)
    known = spark.sparkContext.broadcast((tokens[order], counts[order]))

    def prefixes(batches):
        frequent, often = known.value
        for i, text in arrow_rows(batches, "id", "text"):
            s = shingle_set(text, words)
            if i is None or len(s) < least:
                continue
            rank = np.zeros(len(s), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                rank = np.where(frequent[at] == s, often[at], 0)
            t = -(-num * len(s) // den)
            first = np.lexsort((s, rank))[: len(s) - t + min(need, t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int64()), pa.array([len(s)], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes())], pa.binary()), pa.array([int(np.count_nonzero(rank[first] == 0))], pa.int64()), pa.array([s[first]], pa.list_(pa.int64()))],
                ["id", "n", "digest", "cold", "first"],
            )

    reps = classes.where(F.col("rep").isNotNull() & (F.col("n") >= least)).select(F.col("rep").alias("id"), "digest")
    lists = (
        texts.mapInArrow(_gathered(prefixes), "id long, n long, digest binary, cold long, first array<long>").dropDuplicates(["id", "digest"])
        .join(reps, ["id", "digest"]).select("id", "n", "cold", F.posexplode("first").alias("at", "token"))
        .select("id", "n", "token", (F.col("at") >= F.col("cold")).alias("hot"))
    )
    w = Window.partitionBy("token")
    lists, p_lists = staged(lists.withColumns({"c": F.count(F.lit(1)).over(w), "head": F.min("id").over(w)}).where("c > 1"), "lists")
    is_long = (F.col("c") > long_list) | (F.col("hot") & (F.col("c") > hot_count))
    stars = lists.where(is_long).select(F.col("id").alias("a"), F.col("head").alias("b"))
    short = lists.where(~is_long).select("token", "id", "n")
    other = short.select(F.col("token").alias("token2"), F.col("id").alias("b"), F.col("n").alias("n2"))
    shared = (
        short.join(other, (F.col("token") == F.col("token2")) & (F.col("id") < F.col("b")) & (den * F.least("n", "n2") >= num * F.greatest("n", "n2")))
        .groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"), F.max(F.least("n", "n2")).alias("n"))
        .where(F.col("c") >= F.least(F.lit(need), F.ceil(F.col("n") * num / den))).select("a", "b")
    )
    candidates, p_candidates = components(shared.union(stars))
    central, p_central = staged(lists.groupBy("id").agg(F.struct(F.count(F.lit(1)), F.sum("c")).alias("central")), "central")
    unstage(spark, p_lists)
    nodes = candidates.union(candidates.select("b", "b").distinct()).toDF("id", "comp")
    # In how many blocks of half the bounds a component is searched.
    shingles = classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("n"))
    times = F.greatest(F.count(F.lit(1)) / group, F.sum("n") / group_shingles)
    sizes = nodes.join(shingles, "id").groupBy("comp").agg(times.alias("times")).select("comp", F.when(F.col("times") > 1, F.ceil(F.col("times") * 2)).otherwise(1).alias("blocks"))
    mixed = F.abs(F.xxhash64("id", F.lit(3)) % (1 << 40))
    members, p_members = staged(nodes.join(sizes, "comp").select("id", "comp", "blocks", (mixed % F.col("blocks")).alias("block")), "members")
    large = members.where("blocks > 1")
    best = Window.partitionBy("comp").orderBy(F.desc_nulls_last("central"), "id")
    some = large.join(central, "id", "left").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= pivots)
    some = some.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where(F.col("with") != F.col("block"))
    wanted = members.union(some.select("id", "comp", "blocks", F.col("with").alias("block")))
    edges, _ = staged(_searched(texts, wanted, words, num, den), "edges")
    links, paths = edges.where("not split").select("a", "b"), [p_candidates, p_members, p_central]
    if not large.limit(1).count():
        return links, paths
    found = edges.where("split").select("a", "b")
    parts, p_parts = components(found)
    # What isn't in the largest part of its component meets every block: its own blocks, each beside each of the component's.
    part = large.join(parts.select(F.col("a").alias("a_"), F.col("b").alias("b_")), F.col("id") == F.col("a_"), "left").select("id", "comp", "blocks", "block", F.coalesce("b_", "id").alias("part"))
    size = part.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("comp").alias("c_")).agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"))
    rest, p_rest = staged(part.join(size, F.col("comp") == F.col("c_")).where("part <> main").select("id", "comp", "blocks"), "rest")
    if not rest.limit(1).count():
        unstage(spark, p_rest)
        return links.union(parts), paths
    turns = rest.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) * 2 / group).alias("turns"))
    mine = rest.join(turns, "comp").select("id", "comp", "blocks", (mixed % F.col("turns")).alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    all_ = large.join(turns, "comp").select("id", "comp", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "block")
    both = mine.unionByName(all_).select("id", "comp", "blocks", (F.col("block") * (1 << 24) + F.col("turn")).alias("block")).distinct()
    more, p_more = staged(_searched(texts, both, words, num, den), "edges")
    joined, _ = components(found.union(more.select("a", "b")))
    return links.union(joined), [*paths, p_parts, p_rest, p_more]


def _searched(texts, wanted, words, num, den) -> DataFrame:
    """The links that search() finds among the ids of each (comp, block) of wanted: a, b; split: whether comp has several blocks."""

    def local(batches):
        now, ids, sets, seen = None, [], [], set()
        for i, text, *at in arrow_rows(batches, "id", "text", "comp", "block", "blocks"):
            if at != now:
                yield from found(now, ids, sets)
                now, ids, sets, seen = at, [], [], set()
            s = shingle_set(text, words)
            if len(s) and (key := s.tobytes()) not in seen:
                seen.add(key)
                ids.append(i)
                sets.append(s)
        yield from found(now, ids, sets)

    def found(now, ids, sets):
        out = [(a, b) for a, b in search(ids, sets, num, den) if a != b] if len(ids) > 1 else []
        if out:
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out], "split": [now[-1] > 1] * len(out)})

    of_reps = texts.where(F.col("id").isNotNull()).join(wanted, "id")
    dealt = of_reps.repartition(n_partitions(texts.sparkSession), "comp", "block").sortWithinPartitions("comp", "block", "id")
    return dealt.mapInArrow(local, "a long, b long, split boolean")


def _gathered(make, size: int = 512):
    """The same batches of one row in batches of many."""

    def run(batches):
        held = []
        for b in make(batches):
            held.append(b)
            if len(held) == size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run
