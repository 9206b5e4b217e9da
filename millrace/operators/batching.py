"""Batch formation on the control plane.

Every node has, beside its rows, a small table with a row for each batch: batch (id), rank (canonical order), rows, lo and hi (the
interval of source batches it stems from), path (executions on its longest way) and steps (all of them). Forming batches is computed
there; rows are told their new batch by arithmetic where batches are uniform, else by a join with that table. Ranks and running sums are
prefix scans over blocks; only the next-fit fold is sequential.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.errors import SchemaMismatch

#: Names that begin like these are the engine's own: sources and tasks may not have them.
RESERVED = "__"
BATCH, POS, SRC = "__batch", "__pos", "__src"
STEPS = "array<struct<task:string,exec_id:bigint,batch:bigint>>"
#: A control plane's columns. path: the longest way of executions to a batch; steps: all executions that it stems from.
META = f"batch bigint, rank bigint, rows bigint, lo bigint, hi bigint, path {STEPS}, steps {STEPS}"
#: Running sums and ranks go by blocks of so many ranks or source batches, each ordered by a task, and carry one row a block.
BLOCK = 1 << 16


def refuse_reserved(names: Iterable[str], of: str) -> None:
    if bad := sorted(n for n in names if n.lower().startswith(RESERVED)):
        raise SchemaMismatch(of, "the engine, whose own columns begin so", bad)


def _carried(df: DataFrame, origins: int | None, totals: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """df with __block, and for each of `carry` its value over the totals of all blocks before a row's own (null in the first).

    A prefix scan's middle step: only a row for each block meets in one place. Where origins, the number of source batches, is known
    to make one block, nothing is carried.
    """
    if origins is not None and origins <= BLOCK:
        return df.withColumns({"__block": F.lit(0), **{n: F.lit(None).cast("long") for n in carry}})
    df = df.withColumn("__block", F.floor(F.col("lo") / BLOCK).cast("long"))
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(F.col("__block").alias("__b")).agg(*(c.alias(n) for n, c in totals.items()))
    sums = sums.select("__b", *(c.over(before).alias(n) for n, c in carry.items()))
    return df.join(sums, F.col("__block") == F.col("__b")).drop("__b")


def ranked(meta: DataFrame, order: list[str | Column], into: str = "rank", origins: int | None = None) -> DataFrame:
    """meta with each row's place in an order that begins with lo."""
    out = _carried(meta, origins, {"__n": F.count(F.lit(1))}, {"__n": F.sum("__n")})
    at = F.row_number().over(Window.partitionBy("__block").orderBy(*order)) - 1
    return out.withColumn(into, (F.coalesce("__n", F.lit(0)) + at).cast("long")).drop("__block", "__n")


@dataclass(frozen=True)
class Uniform:
    """Batches 0, 1, ... of `size` rows each out of `total`, only the last shorter; ids are ranks."""

    size: int
    total: int


@dataclass(frozen=True)
class Batches:
    """Rows with BATCH and POS, and their control plane. aligned: a batch's id is its only origin. origins: how many source batches there are, if known."""

    data: DataFrame
    meta: DataFrame
    uniform: Uniform | None = None
    aligned: bool = False
    origins: int | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.data.columns if c not in (BATCH, POS, SRC)]


def numbered(df: DataFrame, order_by: list[str], into: str) -> tuple[DataFrame, int, DataFrame]:
    """df with each row's place in the order of order_by, the number of rows, and what to unpersist.

    Rows are dealt into ranges and ordered there; a place is a range's offset and the place in it. Offsets take one number a range.
    The dealt rows are kept, since ranges are drawn anew on every evaluation.
    """
    dealt = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    held = dealt.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["__pid"]: r["n"] for r in held.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    starts = F.array(*(F.lit(o).cast("long") for o in offsets))
    return held.withColumn(into, F.element_at(starts, F.col("__pid") + 1) + F.col("__at")).drop("__pid", "__at"), total, held


def uniform_meta(spark, size: int, total: int, most: int | None = None) -> DataFrame:
    """The control plane of uniform source batches."""
    n = -(-total // size)
    n = n if most is None else min(n, most)
    rows = F.least(F.lit(size), F.lit(total) - F.col("id") * size).cast("long")
    return spark.range(n).select(F.col("id").alias("batch"), F.col("id").alias("rank"), rows.alias("rows"), F.col("id").alias("lo"), F.col("id").alias("hi"), *no_steps())


def no_steps() -> list[Column]:
    return [F.array().cast(STEPS).alias("path"), F.array().cast(STEPS).alias("steps")]


def executed(b: Batches, task: str) -> Batches:
    """The batches after a task: an execution more on their path."""
    step = F.array(F.struct(F.lit(task).alias("task"), F.xxhash64(F.lit(task), "batch").alias("exec_id"), F.col("batch").alias("batch")))
    return Batches(b.data, b.meta.withColumns({"path": F.concat("path", step), "steps": F.concat("steps", step)}), b.uniform, b.aligned, b.origins)


def recounted(b: Batches) -> Batches:
    """The control plane with the numbers of rows that there are; batches without rows stay."""
    n = b.data.groupBy(F.col(BATCH).alias("__b2")).agg(F.count(F.lit(1)).alias("__n"))
    meta = b.meta.join(n, F.col("batch") == F.col("__b2"), "left").select("batch", "rank", F.coalesce("__n", F.lit(0)).alias("rows"), "lo", "hi", "path", "steps")
    return Batches(b.data, meta, None, b.aligned, b.origins)


def _together(branches: list[Batches], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The bag union of the branches' common columns, and of their control planes. The canonical order of batches is _ORDER."""
    data = meta = None
    for k, b in enumerate(branches):
        d, m = b.data.select(*columns, BATCH, POS, F.lit(k).alias(SRC)), b.meta.withColumn(SRC, F.lit(k))
        data, meta = (d, m) if data is None else (data.unionByName(d), meta.unionByName(m))
    return data, meta


_ORDER = ["lo", SRC, "rank"]


def passthrough(branches: list[Batches], columns: list[str]) -> Batches:
    """Every batch as it comes."""
    if len(branches) == 1:
        return branches[0]
    data, meta = _together(branches, columns)
    new = lambda batch: (F.col(batch) * len(branches) + F.col(SRC)).alias(batch)
    meta = ranked(meta, _ORDER, origins=branches[0].origins)
    return Batches(data.select(*columns, new(BATCH), POS), meta.select(new("batch"), "rank", "rows", "lo", "hi", "path", "steps"), origins=branches[0].origins)


def next_fit(meta: DataFrame, n: int, order: list[str] = ["rank"]) -> DataFrame:  # noqa: B006
    """Each batch's SRC, batch, rows, lo, hi, and rank (its place in the order), group, offset and first.

    In order, batches join the open group while it has at most n rows with them, else open the next. offset: the group's rows before a
    batch; first: how many parts of at most n rows the groups before it have. The fold is sequential by nature: one task streams the
    control plane's numbers in order and keeps four.
    """

    def fold(parts):
        group, held, first, rank = -1, 0, 0, 0
        for part in parts:
            out = []
            for rows in part.column("rows").to_pylist():
                if group < 0 or held + rows > n:
                    first += max(1, -(-held // n)) if group >= 0 else 0
                    group, held = group + 1, 0
                out.append((rank, group, held, first))
                held, rank = held + rows, rank + 1
            cols = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 4)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], [*keep, "rank", "group", "offset", "first"])

    keep = [SRC, "batch", "rows", "lo", "hi"]
    narrow = meta if SRC in meta.columns else meta.withColumn(SRC, F.lit(0))
    narrow = narrow.select(*keep, "rank").repartition(1).sortWithinPartitions(*order)
    return narrow.mapInArrow(fold, f"{SRC} int, batch bigint, rows bigint, lo bigint, hi bigint, rank bigint, group bigint, offset bigint, first bigint")


def _closed(u: Uniform, n: int) -> bool:
    """Whether groups of n // size batches are what next-fit makes of uniform batches: the short last one must not join a full group."""
    k, full, rest = n // u.size, u.total // u.size, u.total % u.size
    return k * u.size == n or rest == 0 or full % k != 0 or rest > n - k * u.size


def _ways(order: Column) -> list[Column]:
    """Of a group's batches: the longest of their paths (of several the first), and all their steps."""
    return [F.max_by("path", F.struct(F.size("path"), order)).alias("path"), F.array_distinct(F.flatten(F.collect_list("steps"))).alias("steps")]


def _span() -> list[Column]:
    return [F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]


def max_rows(branches: list[Batches], columns: list[str], n: int) -> Batches:
    """Whole batches accumulate up to n rows (next-fit); one of more is split into parts of n. Parts have all its origins."""
    one = branches[0]
    if len(branches) == 1 and one.uniform and one.uniform.size <= n and _closed(one.uniform, n):
        k, size = n // one.uniform.size, one.uniform.size
        data = one.data.withColumns({BATCH: F.floor(F.col(BATCH) / k), POS: F.col(BATCH) % k * size + F.col(POS)})
        meta = one.meta.withColumn("group", F.floor(F.col("batch") / k)).groupBy("group").agg(*_span(), *_ways(-F.col("rank")))
        return Batches(data, meta.select(F.col("group").alias("batch"), F.col("group").alias("rank"), "rows", "lo", "hi", "path", "steps"), Uniform(k * size, one.uniform.total), False, one.origins)
    data, meta = _together(branches, columns)
    folded = next_fit(meta, n, _ORDER)
    place = folded.select(F.col(SRC).alias("__s2"), F.col("batch").alias("__b2"), F.col("offset").alias("__offset"), F.col("first").alias("__first"))
    at = F.col("__offset") + F.col(POS)
    joined = data.join(place, (F.col(SRC) == F.col("__s2")) & (F.col(BATCH) == F.col("__b2")))
    data = joined.select(*columns, (F.col("__first") + F.floor(at / n)).alias(BATCH), (at % n).alias(POS))
    ways = meta.select(F.col(SRC).alias("__s2"), F.col("batch").alias("__b2"), "path", "steps")
    groups = folded.join(ways, (F.col(SRC) == F.col("__s2")) & (F.col("batch") == F.col("__b2")))
    groups = groups.groupBy("group").agg(*_span(), F.min("first").alias("first"), *_ways(-F.col("rank")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / n)).cast("long")
    meta = groups.select("first", "rows", "lo", "hi", "path", "steps", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    batch = F.col("first") + F.col("part")
    meta = meta.select(batch.alias("batch"), batch.alias("rank"), F.least(F.lit(n), F.col("rows") - F.col("part") * n).cast("long").alias("rows"), "lo", "hi", "path", "steps")
    return Batches(data, meta, origins=one.origins)


def islands(meta: DataFrame, origins: int | None = None) -> DataFrame:
    """meta with comp: numbers of the sets of batches that overlapping origin intervals connect."""
    w = Window.partitionBy("__block").orderBy("lo", F.desc("hi"), "rank")
    out = _carried(meta, origins, {"__hi": F.max("hi")}, {"__hi": F.max("__hi")})
    reach = F.greatest("__hi", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("__fresh", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).drop("__hi", "__block")
    out = _carried(out, origins, {"__n": F.sum("__fresh")}, {"__n": F.sum("__n")})
    here = F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("comp", (F.coalesce("__n", F.lit(0)) + here - 1).cast("long")).drop("__fresh", "__block", "__n")


def common_origin(branches: list[Batches], columns: list[str]) -> Batches:
    """All batches of connected origins as one, branch by branch in canonical order."""
    data, meta = _together(branches, columns)
    aligned, origins = all(b.aligned for b in branches), branches[0].origins
    if aligned:
        meta = meta.withColumn("comp", F.col("lo"))
        data = data.withColumns({"__comp": F.col(BATCH), "__brank": F.col(BATCH)})
    else:
        meta = islands(meta, origins)
        place = meta.select(F.col(SRC).alias("__s2"), F.col("batch").alias("__b2"), F.col("comp").alias("__comp"), F.col("rank").alias("__brank"))
        data = data.join(place, (F.col(SRC) == F.col("__s2")) & (F.col(BATCH) == F.col("__b2")))
    # Ranks are those in their branch, which is all that the order of branches leaves to tell.
    pos = (F.row_number().over(Window.partitionBy("__comp").orderBy(SRC, "__brank", POS)) - 1).cast("long")
    data = data.select(*columns, F.col("__comp").alias(BATCH), pos.alias(POS))
    out = meta.groupBy("comp").agg(*_span(), *_ways(F.struct(-F.col("lo"), -F.col(SRC), -F.col("rank"))))
    return Batches(data, out.select(F.col("comp").alias("batch"), F.col("comp").alias("rank"), "rows", "lo", "hi", "path", "steps"), None, aligned, origins)


def expression(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e
