"""What the operators share: the folder that driver and executors share, staged tables, names, training splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests on one machine), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back: lineage ends there, and lost executors cost nothing before it."""
    path = staged_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, *paths: str) -> None:
    """Removes staged tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def held_out(doc_id: Column, of: int, which: int = 2) -> Column:
    """Whether crc32(doc_id as text) mod `of` is `which`; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % of == which


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, a bounded slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def arrow_kind(df: DataFrame, name: str) -> tuple[pa.DataType, str]:
    """Arrow's and Spark's type of a column."""
    kind = df.schema[name].dataType
    return to_arrow_type(kind), kind.simpleString()


def most_frequent(df: DataFrame, count: str, most: int) -> tuple[pa.Table, int]:
    """The rows whose count is at least a threshold, the smallest that at most `most` rows reach, and the threshold.

    The threshold comes from how many rows have each count, so no task orders all rows. A table of the numbers of distinct counts,
    which grow as the root of their sum, and at most `most` rows come to the driver.
    """
    have = df.groupBy(count).agg(F.count(F.lit(1)).alias("rows")).toArrow().sort_by([(count, "descending")])
    total, threshold = 0, None
    for n, rows in zip(have.column(count).to_pylist(), have.column("rows").to_pylist(), strict=True):
        if total + rows > most:
            break
        total, threshold = total + rows, n
    if threshold is None:
        return df.limit(0).toArrow(), (have.column(count)[0].as_py() + 1 if have.num_rows else 1)
    return df.where(F.col(count) >= threshold).toArrow(), threshold
