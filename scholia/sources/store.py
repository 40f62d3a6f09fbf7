"""Stored tables that change: keyed rows in buckets, of which a change rewrites only those it touches, and an event log bucketed by learner."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholia.sources.shared import Versions


class Store:
    """Rows of one key each, in a folder that driver and executors share.

    A row's bucket is a hash of its key. A version names the folder of each bucket's files; a change writes the buckets that hold its keys to a new folder and then
    makes the next version, so a reader sees all of a change or nothing, a task or driver that is lost leaves the last version as it was, and files of other buckets stay.
    Of two writers of the same version the second fails. Column `version` counts the rows that a key has had.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/versions")
        found = self.versions.latest()
        self.number, self.state = found or (0, {"keys": list(keys), "buckets": buckets, "schema": None, "at": {}})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.state["keys"]), F.lit(self.state["buckets"])).cast("int")

    def _paths(self, state: dict, buckets: Sequence[int] | None) -> list[str]:
        wanted = state["at"] if buckets is None else {str(b): state["at"][str(b)] for b in buckets if str(b) in state["at"]}
        return [f"{self.root}/data/{made}/bucket={b}" for b, made in sorted(wanted.items())]

    def read(self, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows, with version; of some buckets only, or as they were at an earlier version."""
        state = self.state if version is None else self.versions.read(version)
        if state is None or state["schema"] is None:
            raise ValueError("the store has no such version")
        schema = StructType.fromJson(state["schema"])
        paths = self._paths(state, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        touched = self._touched(keys)
        return self.read(touched).join(keys.select(*self.state["keys"]).distinct(), self.state["keys"], "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.bucket for r in rows.select(self._bucket().alias("bucket")).distinct().collect())  # as many as buckets at most

    def merge(self, changes: DataFrame, order: Sequence[str] = ()) -> None:
        """Upserts rows. Of the rows of a key, stored or new, the largest by `order` stays (ties: a change before a stored row, then the largest row)."""
        columns = changes.columns
        schema = changes.withColumn("version", F.lit(0).cast("long")).schema
        if self.state["schema"] is not None and [(f.name, f.dataType) for f in StructType.fromJson(self.state["schema"])] != [(f.name, f.dataType) for f in schema]:
            raise ValueError("the columns are not those of the store")
        touched = self._touched(changes)
        new = changes.withColumns({"version": F.lit(1).cast("long"), "_new": F.lit(1)})
        old = self.read(touched).withColumn("_new", F.lit(0)) if self.state["schema"] is not None else new.limit(0)
        both = old.unionByName(new).withColumn("bucket", self._bucket()).repartition("bucket")
        place = F.struct(*order, "_new", *(F.hash(c).alias(f"_{c}") for c in columns))
        latest = both.groupBy("bucket", *self.state["keys"]).agg(F.max_by(F.struct(*columns), place).alias("_row"), F.sum("version").alias("version"))
        self._write(latest.select("bucket", "_row.*", "version"), touched, schema)

    def remove(self, keys: DataFrame) -> None:
        """Takes rows out by their keys."""
        touched = self._touched(keys)
        left = self.read(touched).join(keys.select(*self.state["keys"]).distinct(), self.state["keys"], "left_anti")
        self._write(left.withColumn("bucket", self._bucket()).repartition("bucket"), touched, None)

    def update(self, where: Column, values: dict[str, Column]) -> None:
        """Gives the rows that fit new values, which are no keys; only buckets that hold such rows are rewritten."""
        if set(values) & set(self.state["keys"]):
            raise ValueError("a key can't be updated")
        touched = self._touched(self.read().where(where))
        fits = F.coalesce(where, F.lit(False))
        changed = self.read(touched).withColumn("_fits", fits)
        new = {c: F.when(F.col("_fits"), v).otherwise(F.col(c)) for c, v in values.items()} | {"version": F.col("version") + F.col("_fits").cast("long")}
        self._write(changed.withColumns(new).drop("_fits").withColumn("bucket", self._bucket()).repartition("bucket"), touched, None)

    def _write(self, rows: DataFrame, touched: list[int], schema: StructType | None) -> None:
        number = self.number + 1
        made = f"{number}-{uuid.uuid4().hex[:12]}"  # a folder of its own: another writer of this number is not disturbed
        path = f"{self.root}/data/{made}"
        rows.write.partitionBy("bucket").parquet(path)
        there = set(self.versions.folders(path))
        at = {b: was for b, was in self.state["at"].items() if int(b) not in set(touched)} | {str(b): made for b in touched if f"bucket={b}" in there}
        state = self.state | {"at": at}
        if schema is not None:
            state["schema"] = schema.jsonValue()
        self.versions.commit(number, state)
        self.number, self.state = number, state

    def vacuum(self, keep: int = 2) -> None:
        """Drops the folders that none of the last versions names, and those versions' documents."""
        numbers = self.versions.numbers()
        kept = [s for n in numbers[-keep:] if (s := self.versions.read(n)) is not None]
        named = {f"{made}/bucket={b}" for s in kept for b, made in s["at"].items()}
        for made in self.versions.folders(f"{self.root}/data"):
            for bucket in self.versions.folders(f"{self.root}/data/{made}"):
                if f"{made}/{bucket}" not in named:
                    self.versions.drop(f"{self.root}/data/{made}/{bucket}")
        for n in numbers[:-keep]:
            self.versions.drop(f"{self.root}/versions/v{n:010d}.json")


class Log:
    """An append-only log as a bucketed table: rows of a learner lie in one bucket in each append, so replays by learner need no shuffle."""

    def __init__(self, spark: SparkSession, table: str, path: str, key: str = "learner_id", buckets: int = 8) -> None:
        self.spark, self.table, self.path, self.key, self.buckets = spark, table, path, key, buckets

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, events: DataFrame, order: Sequence[str]) -> None:
        """Adds events with seq, which goes on from each learner's last one in `order`. A lost append leaves nothing of itself in the table."""
        place = Window.partitionBy(self.key).orderBy(*order)
        new = events.repartition(self.buckets, self.key).withColumn("seq", F.row_number().over(place).cast("long"))
        if self.spark.catalog.tableExists(self.table):
            last = self.read().groupBy(self.key).agg(F.max("seq").alias("_last"))
            new = new.join(last, self.key, "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last").repartition(self.buckets, self.key)
        new.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).mode("append").saveAsTable(self.table)
