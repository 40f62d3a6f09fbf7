"""Small Spark helpers of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local session gets a temporary one; a cluster must set it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/scholia/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read from there: cuts lineage and outlives executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the rows that go to a Python worker at once.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, unless the session has a bound of its own: 10,000 rows of long texts fill executors, in the JVM and in Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that executors may hold whole.
MOST_IDS = 2_000_000


def matched(docs: DataFrame, row_id: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose id is (left_anti: is not) one of ids (column id), as they are, whatever their columns are named.

    While the ids are MOST_IDS at most they are broadcast, and the rows stay where they are; beyond that both are shuffled.
    """
    other = written(ids.select(F.col("id").alias(_unused(docs))))
    if other.count() <= MOST_IDS:
        other = F.broadcast(other)
    return docs.join(other, docs[row_id] == other[0], how)


def _unused(docs: DataFrame) -> str:
    """A name that no column has."""
    return "_" * (1 + max((len(c) for c in docs.columns), default=0)) + "id"


#: A key counts as frequent from one in so many rows on: there can be no more frequent keys than that.
FREQUENT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, times: str) -> DataFrame:
    """The rows with the columns of a table of one row a key, in which `times` says how many rows have it; keys that it lacks go.

    Rows of frequent keys, FREQUENT at most, meet a broadcast of these; the others are shuffled by their keys, of which none is large.
    """
    total = table.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    often = F.col(times) * FREQUENT > total
    hot = F.broadcast(table.where(often).drop(times))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table.where(~often).drop(times), key))
