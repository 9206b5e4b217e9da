"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations alone.

A text's paragraphs (its sentences and lines, long ones cut) have 64-bit digests. A sketch has three rows of cells; a digest is
added to one cell of each row: the cell's number goes up by one, its key and its check are XORed with the digest and its hash.
Subtracting two sketches of one size leaves the digests that differ. A cell with one of them is pure: its check fits its key. Peeling
takes such digests out of their other cells, row after row, until nothing is left; each row is peeled in one pass, in which no digest
is pure twice. A document's fingerprint is a small sketch. Two versions are compared by their fingerprints first, which tell them apart
where few paragraphs differ; where cells remain, or so many differ that they must, the pair is retried with larger sketches.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import n_partitions, staged

#: Up to a sentence's or a line's end, at most 96 characters; or such ends alone, where nothing stands before them.
PARAGRAPH = r"[^\n.!?]{1,96}+[\n.!?\s]*+|[\n.!?][\n.!?\s]*+"
#: Cells of each of the three rows of the fingerprint that is kept with a document.
KEPT = 4
#: Up to so many keys of pairs to retry are broadcast.
FEW = 500_000
#: Names of a cell that isn't one: where digests peeled from either side are counted.
_PLUS, _MINUS = -1, -2


def digests(text: str) -> Column:
    """Distinct digests of the paragraphs in a column of text."""
    return F.expr(f"array_distinct(transform(regexp_extract_all({text}, r'{PARAGRAPH}', 0), p -> xxhash64(p)))")


def _check(key: Column) -> Column:
    return F.hash(key, F.lit(7)).cast("long")


def _slot(key: Column, row: int, width: Column, seed: int) -> Column:
    return row * width + F.pmod(F.xxhash64(key, F.lit(31 * seed + row)), width)


def spread(keys: Column, width: int = KEPT) -> Column:
    """An array of distinct digests with their checks and, for each row of a sketch, their cells. To be kept in a column of its own: sketch() reads it often."""
    slots = lambda k: (_slot(k, r, F.lit(width), 0).cast("int").alias(f"s{r}") for r in range(3))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), _check(k).alias("chk"), *slots(k)))


def sketch(of: Column, width: int = KEPT) -> Column:
    """The sketch of what spread() gave: an array of cells of n, key and chk."""
    zero = F.lit(0).cast("long")

    def one(cell: int) -> Column:
        mine = F.filter(of, lambda e: e[f"s{cell // width}"] == cell)
        xor = lambda c: F.aggregate(mine, zero, lambda a, e: a.bitwiseXOR(e[c]))
        return F.struct(F.size(mine).cast("long").alias("n"), xor("key").alias("key"), xor("chk").alias("chk"))

    return F.array(*(one(cell) for cell in range(3 * width)))


def fingerprint(cells: Column) -> Column:
    """A sketch as text: for each cell its number, key and check in hexadecimal."""
    return F.concat_ws(":", F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["chk"]))))


def subtracted(left: Column, right: Column) -> Column:
    """The cells (cell, n, key, chk) that aren't empty after subtracting one sketch from another."""
    cells = F.transform(left, lambda c, i: F.struct(
        i.cast("long").alias("cell"), (c["n"] - right[i]["n"]).alias("n"), c["key"].bitwiseXOR(right[i]["key"]).alias("key"), c["chk"].bitwiseXOR(right[i]["chk"]).alias("chk"),
    ))
    return F.filter(cells, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))


def peel_differences(pairs: DataFrame, left: str, right: str, *, keys: list[str], attempts: int = 6, per_task: int = 250_000) -> tuple[DataFrame, list[str]]:
    """keys with n_left, n_right: how many digests only the left or the right array of a row has, as their sketches tell; and cells, how
    many these had (null where they weren't asked); staged paths.

    Arrays hold distinct digests and aren't null; keys name a row, and the first of them deals rows out. A sketch has half as many
    cells again as both sides have digests, at least 24; every retry doubles that and hashes anew. per_task: about how many digests a
    task holds in its cells, of some 150 bytes each. A pair left after all attempts
    (none is expected) is settled by comparing the arrays.
    """
    todo, done, paths = pairs.select(*keys, left, right), None, []
    total = todo.agg(F.sum(F.size(left) + F.size(right))).first()[0] or 0
    tasks = max(n_partitions(pairs.sparkSession), -(-total // per_task))
    for attempt in range(attempts):
        with _plain_maps(pairs.sparkSession):
            at, path = staged(_peeled(todo, left, right, keys, attempt, tasks), "peeled")
        paths.append(path)
        ok = at.where("not failed").drop("failed")
        done = ok if done is None else done.unionByName(ok)
        failed = at.where("failed").select(*keys)
        left_over = failed.count()
        if not left_over:
            return done, paths
        # Keys alone are sent to all workers while they are few; beyond that both sides are exchanged.
        todo, path = staged(todo.join(F.broadcast(failed) if left_over <= FEW else failed, keys, "left_semi"), "failed")
        paths.append(path)
    rest = todo.select(*keys, F.size(F.array_except(left, right)).cast("long").alias("n_left"), F.size(F.array_except(right, left)).cast("long").alias("n_right"), F.lit(None).cast("long").alias("cells"))
    return done.unionByName(rest), paths


@contextlib.contextmanager
def _plain_maps(spark: SparkSession):
    """Without the first-level hash maps of partial aggregates: each takes a page of memory when its task begins, and peeling has many in one stage."""
    name = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _peeled(pairs: DataFrame, left: str, right: str, keys: list[str], seed: int, tasks: int) -> DataFrame:
    width = F.greatest(F.lit(8), F.ceil((F.size(left) + F.size(right)) * 0.5)).cast("long") * F.lit(2**seed).cast("long")

    def signed(column: str, sign: int) -> Column:
        return F.transform(F.col(column), lambda k: F.struct(k.alias("key"), F.lit(sign).alias("n")))

    sides = [signed(left, 1), signed(right, -1)]
    # Rows are dealt out once, by key; everything below stays in that partitioning.
    rows = pairs.repartition(tasks, keys[0]).select(*keys, width.alias("width"), F.explode(F.concat(*sides, F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).alias("n"))))).alias("e"))
    rows = rows.select(*keys, "width", F.col("e.key").alias("key"), F.col("e.n").cast("long").alias("n"))
    # A pair with nothing on either side keeps a row of its own: the mark with n = 0.
    spots = F.when(F.col("n") == 0, F.array(F.lit(_PLUS).cast("long"))).otherwise(F.array(*(_slot(F.col("key"), r, F.col("width"), seed) for r in range(3))))
    cells = rows.select(*keys, "width", "n", "key", F.when(F.col("n") == 0, 0).otherwise(_check(F.col("key"))).cast("long").alias("chk"), F.explode(spots).alias("cell"))
    return _peel(_summed(cells, keys), keys, seed)


def _peel(cells: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """keys, n_left, n_right, cells and failed, of differences of sketches: (keys, width, cell, n, key, chk)."""
    for step in range(3 * 6):
        row = step % 3
        inside = (F.col("cell") >= row * F.col("width")) & (F.col("cell") < (row + 1) * F.col("width"))
        pure = inside & (F.abs("n") == 1) & (F.col("chk") == _check(F.col("key"))) & (F.col("cell") == _slot(F.col("key"), row, F.col("width"), seed))
        here = F.struct("cell", "n", "key", "chk")
        away = [F.struct(_slot(F.col("key"), r, F.col("width"), seed).alias("cell"), (-F.col("n")).alias("n"), F.col("key"), F.col("chk")) for r in range(3) if r != row]
        zero = F.lit(0).cast("long")
        count = F.struct(F.when(F.col("n") > 0, _PLUS).otherwise(_MINUS).cast("long").alias("cell"), F.lit(1).cast("long").alias("n"), zero.alias("key"), zero.alias("chk"))
        moves = F.when(pure, F.array(*away, count)).otherwise(F.array(here))
        cells = _summed(cells.select(*keys, "width", F.explode(moves).alias("m")).select(*keys, "width", "m.*"), keys)
    return cells.groupBy(*keys).agg(
        F.sum(F.when(F.col("cell") == _PLUS, F.col("n")).otherwise(0)).alias("n_left"),
        F.sum(F.when(F.col("cell") == _MINUS, F.col("n")).otherwise(0)).alias("n_right"),
        (3 * F.max("width")).alias("cells"),
        F.max(F.col("cell") >= 0).alias("failed"),
    )


def peel_fingerprints(differences: DataFrame, column: str, *, keys: list[str], width: int = KEPT) -> tuple[DataFrame, str]:
    """What peel_differences gives, of the rows whose subtracted sketches tell it; and its path. Rows with more than three quarters of the cells in use, or a null difference, aren't tried."""
    all_ = differences.select(*keys, F.col(column).alias("d")).where(F.size("d") <= 3 * width * 3 // 4)
    same = all_.where(F.size("d") == 0).select(*keys, *(F.lit(n).cast("long").alias(c) for c, n in (("n_left", 0), ("n_right", 0), ("cells", 3 * width))))
    cells = all_.where(F.size("d") > 0).repartition(n_partitions(differences.sparkSession), keys[0]).select(*keys, F.lit(width).cast("long").alias("width"), F.explode("d").alias("c"))
    with _plain_maps(differences.sparkSession):
        peeled = _peel(cells.select(*keys, "width", "c.*"), keys, 0).where("not failed").drop("failed")
        return staged(peeled.unionByName(same), "told")


def _summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells added up; empty ones go."""
    out = cells.groupBy(*keys, "width", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return out.where((F.col("cell") < 0) | (F.col("n") != 0) | (F.col("key") != 0) | (F.col("chk") != 0))


def with_next(docs: DataFrame, *, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(id, text, own, k) and, with next_ before them, the text and digests of the row after it by id (ties: by text), after the last those of the first.

    k is unique. Rows are dealt into ranges of ids by quantiles, and a range also gets copies of the rows with the next range's first
    id, so that each range is ordered alone and none needs all rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = rows.select("*", digests("text").alias("own"))
    ends = rows.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 10_000).alias("s"), F.min("id").alias("a"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).first()
    starts = sorted({s for s in ends.s or [] if s != ends.a})
    # Two levels of about the root of their number each: a row is compared with few of them.
    step = max(1, int(len(starts) ** 0.5))
    chunks = [starts[i : i + step] for i in range(0, len(starts), step)]
    before = lambda of: F.size(F.filter(of, lambda s: s <= F.col("id")))
    mine = F.lit(0)
    if starts:
        group = before(F.array(*(F.lit(c[0]) for c in chunks)))
        inside = before(F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in chunks)), F.greatest(group, F.lit(1))))
        mine = F.when(F.col("id").isNull() | (group == 0), 0).otherwise((group - 1) * step + inside)
    more = [F.when(F.col("id").isin(starts), F.struct((mine - 1).alias("bucket"), F.lit(1).alias("copy")))] if starts else []
    first = F.col("id").isNull() if ends.nulls else F.col("id") == F.lit(ends.a)
    more.append(F.when(first, F.struct(F.lit(len(starts)).alias("bucket"), F.lit(2).alias("copy"))))
    copies = F.array_compact(F.array(F.struct(mine.alias("bucket"), F.lit(0).alias("copy")), *more))
    dealt = told.withColumn("c", F.explode(copies)).select("id", "text", "own", "c.bucket", "c.copy")
    order = Window.partitionBy("bucket").orderBy("copy", F.asc_nulls_first("id"), "text")
    k = F.col("bucket").cast("long") * 2**40 + F.row_number().over(order)
    return dealt.withColumns({**{f"next_{c}": F.lead(c).over(order) for c in ("text", "own")}, "k": k}).where("copy = 0").drop("bucket", "copy")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text, whose last half of code points gives way to the first as many of the next text.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, cells_edited and cells_next. A
    likeness is |common| / |either| of the two paragraph sets, as peeling the sketches' difference tells; 1 where both are empty. Where
    cells_edited (cells_next) is the number of cells of a fingerprint, the two fingerprints and n_paragraphs tell it; else that many cells
    of a larger sketch. Null texts are empty, repeated rows are rows of their own, null ids come first; an empty table gives an empty one;
    other columns play no part.
    """
    spark = docs.sparkSession
    pairs = with_next(docs, id_col=id_col, text_col=text_col, buckets=max(2, min(10_000, 4 * n_partitions(spark))))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = pairs.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("*", digests("edited_text").alias("edited"))
    rows = rows.select("*", *(spread(F.col(c)).alias(f"{c}_at") for c in ("own", "edited", "next_own")))
    rows = rows.select("*", *(sketch(F.col(f"{c}_at")).alias(f"{c}_cells") for c in ("own", "edited", "next_own")))
    # Differences too large for the fingerprints aren't kept.
    few = lambda c: F.filter(F.array(subtracted(F.col("own_cells"), F.col(c))), lambda d: F.size(d) <= 3 * KEPT * 3 // 4)
    rows, _ = staged(
        rows.select(
            "id", "k", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), "own", "edited", F.col("next_own").alias("next"),
            fingerprint(F.col("own_cells")).alias("fingerprint"), fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
            F.get(few("edited_cells"), F.lit(0)).alias("d_edited"), F.get(few("next_own_cells"), F.lit(0)).alias("d_next"),
        ), "digests",
    )
    versions = lambda **of: F.explode(F.array(*(F.struct(F.lit(w).alias("with_next"), *(F.col(c).alias(n) for n, c in zip(of, cs, strict=True))) for w, cs in enumerate(zip(*of.values(), strict=True)))))
    small = rows.select("k", versions(d=("d_edited", "d_next")).alias("p")).select("k", "p.*")
    told, _ = peel_fingerprints(small, "d", keys=["k", "with_next"])
    both = rows.select("k", versions(l=("own", "own"), r=("edited", "next")).alias("p")).select("k", "p.*")
    seen = told.groupBy(F.col("k").alias("k_")).agg(F.collect_set("with_next").alias("seen"))
    # Beyond what workers take, the arrays are exchanged by key, as they are for peeling.
    n_seen = told.count()
    rest = both.join(F.broadcast(seen) if n_seen <= FEW else seen, F.col("k") == F.col("k_"), "left").where(~F.coalesce(F.array_contains("seen", F.col("with_next")), F.lit(False)))
    peeled, _ = peel_differences(rest.select("k", "with_next", "l", "r"), "l", "r", keys=["k", "with_next"])
    of = lambda c, w: F.max(F.when(F.col("with_next") == w, F.col(c)))
    found = peeled.unionByName(told).groupBy(F.col("k").alias("k_")).agg(*(of(c, w).alias(f"{c}_{w}") for c in ("n_left", "n_right", "cells") for w in (0, 1)))
    n_own = F.size("own")
    near = lambda w: F.when(n_own + F.col(f"n_right_{w}") == 0, 1.0).otherwise((n_own - F.col(f"n_left_{w}")) / (n_own + F.col(f"n_right_{w}")))
    out = rows.join(found, F.col("k") == F.col("k_"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near(0).alias("near_edited"), near(1).alias("near_next"),
        n_own.cast("long").alias("n_paragraphs"), F.col("cells_0").alias("cells_edited"), F.col("cells_1").alias("cells_next"),
    )
