"""Folders and small files that the driver and all executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster must set it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/scholia/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: cuts lineage and outlives executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """Numbered JSON documents in a folder: what a stored table consists of, version by version.

    A version is created as a whole or not at all: its file must not exist yet, and one that a lost driver has left unfinished does not count. Two writers
    of the same number: the second one fails.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._paths(self.path)
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def read(self, number: int) -> dict | None:
        """A version; None if it is not whole."""
        stream = self._fs.open(self._paths(f"{self.path}/v{number:010d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text[:-1]) if text.endswith("\n") else None

    def latest(self) -> tuple[int, dict] | None:
        for n in reversed(self.numbers()):
            if (found := self.read(n)) is not None:
                return n, found
        return None

    def commit(self, number: int, document: dict) -> None:
        """Makes a document the given version. It fails if somebody else has made it."""
        stream = self._fs.create(self._paths(f"{self.path}/v{number:010d}.json"), False)
        try:
            stream.write(bytearray((json.dumps(document) + "\n").encode()))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._paths(path)))

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder."""
        at = self._paths(path)
        return [str(f.getPath().getName()) for f in self._fs.listStatus(at) if f.isDirectory()] if self._fs.exists(at) else []

    def drop(self, path: str) -> None:
        self._fs.delete(self._paths(path), True)
