"""Neighbourhoods of many queries with few anchors."""

from pyspark.sql import functions as F

from joins import rows_of_joins
from scholia.operators import graph


def test_queries_of_equal_anchors_share_a_neighbourhood(spark):
    pairs = [("a", "s"), ("b", "s"), ("b", "t"), ("c", "t"), ("c", "c"), ("d", "u")]
    edges = spark.createDataFrame([(f"{x}-{y}", x, y, "RELATED_TO") for x, y in pairs], "id string, source string, target string, type string")
    anchors = {q: {"a", "d"} if q % 3 else {"b"} for q in range(30)} | {None: {"c"}}
    rows = spark.createDataFrame([(q, x) for q, ids in anchors.items() for x in ids for _ in range(2)], "query_id int, id string")
    around = {x: {y for p in pairs for y in p if x in p and y != x} for p in pairs for x in p}
    within = {x: {y: 1 for y in near} | {z: 2 for y in near for z in around[y] if z != x and z not in near} for x, near in around.items()}
    expected = {}
    for q, ids in anchors.items():
        for x in ids:
            for y, depth in within[x].items():
                expected[q, y] = min(depth, expected.get((q, y), 9))
    got = graph.subgraph(edges, rows, 2).collect()
    assert len(got) == len(expected) and {(r.query_id, r.id): r.depth for r in got} == expected


def test_anchors_of_a_word_are_ranked_once(spark):
    nodes = spark.range(300).select(F.format_string("n%03d", "id").alias("id"), F.lit("CONCEPT").alias("type"), F.lit("Red ring").alias("label"))
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.array(F.lit("ring"), F.lit("blue")).alias("words"))
    found = graph.anchored(nodes, asked, F.col("words"))
    assert {(r.query_id, r.id) for r in found.collect()} == {(q, f"n00{k}") for q in range(100) for k in range(3)}
    assert rows_of_joins(graph.anchored(nodes, asked, F.col("words"))) == 300
