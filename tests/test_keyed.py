import pytest

from scholia.sources import keyed


@pytest.fixture(scope="module")
def source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(keyed.KeyedTable)
    return spark


ROWS = [(i, i % 3, ["x", "y", None][i % 3], i / 2) for i in range(100)] + [(None, 1, "x", 0.0)]
SCHEMA = "id long, kind int, text string, score double"


@pytest.fixture
def path(source, tmp_path):
    source.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def load(spark, path, **options):
    return spark.read.format("keyed_table").options(path=path, key="id", partitions=5, **options).load()


def test_whole_table_in_ranges_of_the_key(source, path):
    df = load(source, path)
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(ROWS, key=repr)
    reader = keyed.KeyedReader({"path": path, "key": "id", "partitions": "5"}, df.schema)
    parts = reader.partitions()
    held = [[x for b in reader.read(p) for x in b.column("id").to_pylist()] for p in parts]
    assert sorted((x for h in held for x in h if x is not None)) == list(range(100)) and all(held)
    for a, b in zip(held, held[1:]):
        assert max(x for x in a if x is not None) < min(b)


def test_equality_goes_to_the_source(source, path):
    df = load(source, path).where("kind = 1 AND text = 'y' AND score > 10")
    assert sorted(r.id for r in df.collect()) == [i for i in range(100) if i % 3 == 1 and i > 20]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "score" in plan and "kind#" not in plan.split("Filter")[1].split("\n")[0]
    reader = keyed.KeyedReader({"path": path, "key": "id", "partitions": "5"}, df.schema)
    left = list(reader.pushFilters([keyed.EqualTo(("kind",), 1), keyed.EqualTo(("text",), "y"), keyed.IsNotNull(("kind",))]))
    assert left == [] and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 33


def test_an_asked_key_reads_one_range(source, path):
    df = load(source, path).where("id = 42")
    assert [r.id for r in df.collect()] == [42] and df.rdd.getNumPartitions() == 1


def test_order_within_ranges(source, path):
    ids = [r.id for r in load(source, path, order="id").where("id IS NOT NULL").collect()]
    assert ids == list(range(100))
    scores = [[r.score for r in part] for part in load(source, path, order="-score").rdd.glom().collect()]
    assert all(x == sorted(x, reverse=True) for x in scores)


def test_stream_goes_on_from_its_offsets(source, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def add(name, ids):
        source.createDataFrame([(i, 0, "x", 0.0) for i in ids], SCHEMA).toPandas().to_parquet(f"{path}/{name}.parquet")

    def run():
        events = source.readStream.format("keyed_table").option("path", path).schema(SCHEMA).load()
        events.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.id for r in source.read.parquet(out).collect())

    (tmp_path / "in").mkdir()
    add("a", range(5))
    add("b", range(5, 8))
    assert run() == list(range(8))
    add("c", range(8, 12))
    assert run() == list(range(12))


def test_empty_table(source, tmp_path):
    source.createDataFrame([], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "e"))
    assert load(source, str(tmp_path / "e")).where("kind = 1").count() == 0
