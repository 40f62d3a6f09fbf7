"""A table store as a Spark data source: format `keyed_table`.

    spark.dataSource.register(KeyedTable)
    spark.read.format("keyed_table").options(path=..., key="id", partitions=8, order="-score").load().where("kind = 'x'")

Batch reads are planned as ranges of the key, cut at the bounds that the store's files state, so no row is looked at to plan them; equality filters go to
the store, which hands over only rows that fit; each range comes in the asked order (of the key itself: the whole table does). Streams read the
files that have come since the last batch. The path is one that pyarrow's file systems read, on the driver and on executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, InputPartition, IsNotNull
from pyspark.sql.types import StructType


@dataclass
class Range(InputPartition):
    """Keys from low (None: all below, and nulls) up to high (None: all above)."""

    low: object
    high: object


@dataclass
class File(InputPartition):
    path: str


def _dataset(path: str):
    import pyarrow.dataset as ds

    return ds.dataset(path, format="parquet")


def _schema(path: str) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(_dataset(path).schema)


def _bounds(path: str, key: str, partitions: int) -> list:
    """Inner bounds of up to so many ranges of the key: least keys of row groups, which hold about as many rows each."""
    lows = []
    for fragment in _dataset(path).get_fragments():
        for group in fragment.row_groups:
            low, high = (group.statistics or {}).get(key, {}).get("min"), (group.statistics or {}).get(key, {}).get("max")
            if low is None:
                continue
            whole = isinstance(low, int) and isinstance(high, int) and not isinstance(low, bool)
            n = max(1, min(partitions, high - low)) if whole else 1  # a large row group of whole numbers is cut evenly
            lows += [low + (high - low) * i // n for i in range(n)] if whole else [low]
    lows = sorted(set(lows))
    step = len(lows) / partitions
    return sorted({lows[int(i * step)] for i in range(1, partitions)} - {lows[0]}) if lows else []


class KeyedTable(DataSource):
    """Options: path (a Parquet file or folder), key (a column; default the first one), partitions (8), order (a column; a leading - for falling)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_table"

    def schema(self) -> StructType:
        return _schema(self.options["path"])

    def reader(self, schema: StructType) -> KeyedReader:
        return KeyedReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> FileReader:
        return FileReader(dict(self.options), schema)


class KeyedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.columns = options["path"], schema.names
        self.key = options.get("key", schema.names[0])
        self.count, self.order = int(options.get("partitions", 8)), options.get("order")
        self.equal: list[tuple[str, object]] = []
        self.known: list[str] = []

    def pushFilters(self, filters: Sequence[Filter]) -> Iterator[Filter]:
        """Equality with a value goes to the store; everything else stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and len(f.attribute) == 1 and f.value is not None:
                self.equal.append((f.attribute[0], f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.known.append(f.attribute[0])
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        cuts = [None, *_bounds(self.path, self.key, self.count), None]
        own = [v for c, v in self.equal if c == self.key]
        ranges = [Range(a, b) for a, b in zip(cuts, cuts[1:])]
        # a range that can't hold the asked key is not read
        return [r for r in ranges if all((r.low is None or r.low <= v) and (r.high is None or v < r.high) for v in own)] or ranges[:1]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        fits = pc.scalar(True)
        key = pc.field(self.key)
        if partition.low is not None:
            fits = fits & (key >= partition.low)
        if partition.high is not None:
            fits = fits & ((key < partition.high) if partition.low is not None else ((key < partition.high) | key.is_null()))
        for column, value in self.equal:
            fits = fits & (pc.field(column) == value)
        for column in self.known:
            fits = fits & ~pc.field(column).is_null()
        rows = _dataset(self.path).scanner(columns=self.columns, filter=fits, batch_size=4096)
        if self.order is None:
            yield from rows.to_batches()
        else:
            falling = self.order.startswith("-")
            yield from rows.to_table().sort_by([(self.order.removeprefix("-"), "descending" if falling else "ascending")]).to_batches(4096)


class FileReader(DataSourceStreamReader):
    """Offsets are numbers of files, in the order of their names: names have to grow, as those of appended logs do."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.columns = options["path"], schema.names

    def _files(self) -> list[str]:
        return sorted(_dataset(self.path).files)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> Sequence[File]:
        return [File(f) for f in self._files()[start["files"] : end["files"]]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from _dataset(partition.path).scanner(columns=self.columns, batch_size=4096).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""
