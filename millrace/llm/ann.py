"""Nearest neighbours by a block matrix join over int8 tiles with error bounds.

Every vector is quantised once: x = s c + e (codes c, scale s, rest e). Codes of queries and candidates are dealt into blocks; a task gets
one block of each and multiplies them. The product of two vectors differs from s_a s_b c_a c_b by at most
|e_a| |s_b c_b| + |s_a c_a| |e_b| + |e_a| |e_b|, so each squared distance has a lower and an upper bound. A pair survives where its lower
bound is within the k-th smallest upper bound of its query, first in its tile, then among all tiles. Only for survivors are the original
vectors fetched; their distances are computed in double precision, and heaps keep the nearest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

#: Largest components beyond these powers of two are scaled, so that squares neither overflow nor vanish.
SAFE = 400


def codes(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes of at most 127, scales, lengths of what codes give and of what they leave, squared lengths."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    code = np.rint(x / scale[:, None])
    near = code * scale[:, None]
    return code.astype(np.int8), scale, np.sqrt((near * near).sum(1)), np.sqrt(((x - near) ** 2).sum(1)), (x * x).sum(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, components added in their order. Differences beyond SAFE are scaled by a power of two, which is exact."""
    with np.errstate(over="ignore", under="ignore"):
        diff = a - b
        most = np.abs(diff).max(1)
        power = np.where(np.isfinite(most) & (most > 0), np.frexp(most)[1], 0)
        power = np.where(np.abs(power) > SAFE, power, 0)
        diff, total = np.ldexp(diff, -power[:, None]), np.zeros(len(a))
        for j in range(diff.shape[1]):
            total += diff[:, j] * diff[:, j]
        return np.ldexp(np.sqrt(total), power)


def tile(queries: tuple[np.ndarray, ...], query_ids: np.ndarray, items: tuple[np.ndarray, ...], item_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query: its place, the places of items of other ids that may be among its k nearest, and their bounds of squared distance."""
    (qc, qs, qn, qe, ql), (ic, si, n, e, il) = queries, items
    # Sums of at most 1040 products of codes are exact in float32; more are added in double precision.
    kind = np.float32 if qc.shape[1] <= 1040 else np.float64
    dot = (qc.astype(kind) @ ic.astype(kind).T).astype(np.float64)
    dot *= qs[:, None] * si
    bound = np.outer(qe, n) + np.outer(qn, e) + np.outer(qe, e)
    length = ql[:, None] + il
    slack = 1e-9 * length + 1e-290  # of the rounding of this very computation
    low, high = length - 2 * (dot + bound) - slack, length - 2 * (dot - bound) + slack
    own = query_ids[:, None] == item_ids
    low[own] = high[own] = np.inf
    for i in range(len(query_ids)):
        limit = np.partition(high[i], k - 1)[k - 1] if k < len(item_ids) else np.inf
        left = np.nonzero((low[i] <= limit) & ~own[i])[0]
        if len(left):
            yield i, left, low[i][left], high[i][left]


def _blocks(f: pd.DataFrame) -> tuple[np.ndarray, ...]:
    code = np.frombuffer(b"".join(f["code"]), np.int8).reshape(len(f), -1)
    return code, *(f[c].to_numpy() for c in ("scale", "near", "rest", "squared"))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, item_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), id_col, score: each query's k nearest rows of other ids by Euclidean distance, ties to smaller ids.

    is_query: a condition on id_col. Every query meets every row, so this is exact, for components of any finite size. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors only meet those of their own number of
    components. Rows of an id that is repeated are all candidates of other ids; a query id's repeated rows are searched once for each
    distinct vector and merged. Fewer candidates than k give fewer rows; an empty table gives none. Other columns play no part.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = v.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(F.forall("v", finite)).where(F.exists("v", lambda x: x != 0)).select("id", "v", F.coalesce("q", F.lit(False)).alias("q"))
    total = v.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    power = math.frexp(total.most or 1.0)[1]
    power = power if abs(power) > SAFE else 0

    def quantised(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = part.column("v").flatten().to_numpy().reshape(-1, dim)
                with np.errstate(under="ignore"):
                    code, *rest = codes(np.ldexp(x, -power))
                own = [pa.array(np.arange(row, row + len(x))), part.column("id"), part.column("q"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, pa.array([int(dim)] * len(x), pa.int32()), *map(pa.array, rest)], ["row", "id", "q", "v", "code", "dim", "scale", "near", "rest", "squared"])
                row += len(x)

    rows, path = staged(v.mapInArrow(quantised, "row long, id long, q boolean, v binary, code binary, dim int, scale double, near double, rest double, squared double"), "quantised")
    again = lambda: vectors.sparkSession.read.schema(rows.schema).parquet(path)
    n_rows, n_cols = max(1, math.ceil(total.q / query_block)), max(1, math.ceil(total.n / item_block))
    at = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    coded = ("dim", "row", "id", "code", "scale", "near", "rest", "squared")
    asked = again().where("q").groupBy("id", "v").agg(F.min("row").alias("row")).select("row")
    queries = rows.join(asked, "row", "left_semi").select(*coded, at(n_rows, 1).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("j"))
    # Of equal vectors no query needs more than the k smallest ids that aren't its own, nor more than k rows of one id. Limits of such
    # ranks are applied before rows are exchanged.
    same = ("same", "same2")
    alike = again().select(*coded, F.xxhash64("v").alias("same"), F.xxhash64(F.lit(1), "v").alias("same2"))
    alike = alike.withColumn("rn", F.row_number().over(Window.partitionBy(*same, "id").orderBy("row"))).where(F.col("rn") <= k).drop("rn")
    alike = alike.withColumn("rn", F.dense_rank().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("rn") <= k + 1)
    items = alike.select(*coded, F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("i"), at(n_cols, 2).alias("j"))

    def join(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            ids, own, qrow, xrow = q["id"].to_numpy(), x["id"].to_numpy(), q["row"].to_numpy(), x["row"].to_numpy()
            for i, left, low, high in tile(_blocks(q), ids, _blocks(x), own, k):
                out.append(pd.DataFrame({"query_id": ids[i], "q": qrow[i], "x": xrow[left], "id": own[left], "low": low, "high": high}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="float64" if c in ("low", "high") else "int64") for c in ("query_id", "q", "x", "id", "low", "high")})

    pair = "query_id long, q long, x long, id long, low double, high double"
    found = queries.groupBy("dim", "i", "j").cogroup(items.groupBy("dim", "i", "j")).applyInPandas(join, pair)

    def within(f: pd.DataFrame) -> pd.DataFrame:
        limit = f.groupby("query_id")["high"].transform(lambda h: np.partition(h.to_numpy(), k - 1)[k - 1] if len(h) > k else np.inf)
        return f[f["low"] <= limit]

    def first(f: pd.DataFrame) -> pd.DataFrame:
        return f.sort_values(["query_id", "score", "id"], kind="stable").groupby("query_id").head(k)

    # What a task has of a query is cut down before its rows meet, which bounds the groups by k rows a task and ties.
    each = lambda cut: lambda frames: map(cut, frames)
    left = found.mapInPandas(each(within), pair).groupBy("query_id").applyInPandas(within, pair).select("query_id", "q", "x", "id")
    originals = lambda r, v: again().select(F.col("row").alias(r), F.col("v").alias(v))
    both = left.join(originals("r1", "v1"), F.col("q") == F.col("r1")).join(originals("r", "v"), F.col("x") == F.col("r"))

    def measured(batches):
        for batch in batches:
            size = pa.compute.binary_length(batch.column("v")).to_numpy()
            score = np.zeros(batch.num_rows)
            for s in np.unique(size):
                here = np.nonzero(size == s)[0]
                a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(here)).to_pylist()), np.float64).reshape(len(here), -1) for c in ("v1", "v"))
                score[here] = distances(a, b)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(score)], ["query_id", "id", "score"])

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(f["score"].tolist(), f["id"].tolist(), strict=True))
        return pd.DataFrame({"query_id": key[0], "rank": range(1, len(best) + 1), "id": [i for _, i in best], "score": [s for s, _ in best]})

    scored = both.select("query_id", "id", "v1", "v").mapInArrow(measured, "query_id long, id long, score double").mapInPandas(each(first), "query_id long, id long, score double")
    merged = scored.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, id long, score double")
    return merged.withColumnRenamed("id", id_col)
