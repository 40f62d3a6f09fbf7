"""Graph operators on nodes (id, label, status, ...) and edges (source, target, ...), in bounded rounds of joins."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.sources import shared


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, occurrences of each end of an edge."""
    ends = edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), "occurrences").union(edges.select("source", F.lit(0), F.lit(1), "occurrences"))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("occurrences").alias("occurrences"))


def spine(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes of most links, with their strongest neighbours (five, in order)."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "occurrences").union(edges.select("target", "source", "occurrences"))
    linked = both.groupBy("id", "other").agg(F.sum("occurrences").alias("occurrences"))
    order = Window.partitionBy("id").orderBy(F.desc("occurrences"), "other")
    top = linked.withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]), ",").alias("neighbours"))
    sums = linked.groupBy("id").agg(F.count("*").alias("degree"), F.sum("occurrences").alias("occurrences"))
    return sums.orderBy(F.desc("degree"), F.desc("occurrences"), "id").limit(n).join(top, "id")


def neighbours(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """start, id, depth of every node within `depth` links of a start (column id), either way; each at its least depth. The start itself is left out."""
    both = edges.select(F.col("source").alias("from"), F.col("target").alias("to")).union(edges.select("target", "source")).distinct().checkpoint()
    seen = start.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(both, front.id == both["from"]).select("start", F.col("to").alias("id")).distinct()
        front = reached.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d).cast("long"))
        seen = seen.unionByName(front)
        if d % 2 == 0:
            seen, front = seen.checkpoint(), front.checkpoint()
    return seen.where("depth > 0")


def paths(edges: DataFrame, start: str, end: str, depth: int) -> DataFrame:
    """path, hops of each simple directed path of up to `depth` edges."""
    step = edges.select("source", "target").distinct()
    front = step.where(F.col("source") == start).select(F.array("source", "target").alias("nodes"), F.col("target").alias("at"))
    done = front.where(F.col("at") == end)
    for _ in range(1, depth):
        open_ = front.where(F.col("at") != end)
        front = open_.join(step, open_["at"] == step["source"]).where(~F.array_contains("nodes", F.col("target"))).select(F.concat("nodes", F.array("target")).alias("nodes"), F.col("target").alias("at"))
        done = done.unionByName(front.where(F.col("at") == end))
    return done.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).cast("long").alias("hops"))


def reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """start, id, depth, edge, type of each node within `depth` links of a start (column id), either way: the least edge id of those that reach it at its least depth.

    edges: id, source, target, type. They are written once, in one direction; a front that is small meets them as a broadcast.
    """
    kept = shared.written(edges.where(F.col("source") != F.col("target")).select("id", "type", "source", "target"))
    both = kept.select(F.col("id").alias("edge"), "type", F.col("source").alias("from"), F.col("target").alias("to")).union(kept.select("id", "type", "target", "source"))
    front = start.select(F.col("id").alias("start"), "id").distinct().withColumns({"depth": F.lit(0).cast("long"), "edge": F.lit(None).cast("string"), "type": F.lit(None).cast("string")})
    seen = front
    for d in range(1, depth + 1):
        met = front.select("start", F.col("id").alias("from")).join(both, "from").groupBy("start", F.col("to").alias("id")).agg(F.min(F.struct("edge", "type")).alias("e"))
        front = shared.written(met.join(seen, ["start", "id"], "left_anti").select("start", "id", F.lit(d).cast("long").alias("depth"), F.col("e.edge").alias("edge"), F.col("e.type").alias("type")))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def chain(edges: DataFrame, start: DataFrame) -> DataFrame:
    """What two links around a concept hold, by the type of the edge that reaches it: prerequisites, and what is related or supports."""
    around = reached(edges, start, 2)
    part = F.when(F.col("type") == "PREREQUISITE_OF", "prerequisite").when(F.col("type").isin("RELATED_TO", "SUPPORTED_BY"), "related")
    return around.withColumn("part", part).where("part IS NOT NULL").select("start", "id", "depth", "part")


def evidence_chain(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes within three links of a node, whatever the edges' types."""
    return reached(edges, start, 3)


def exam_pattern(nodes: DataFrame, subject: str, year: str) -> DataFrame:
    """Blueprints, papers and schemes (id, type, label, academic_year) whose label holds the subject; those with a year must hold it."""
    kinds = F.col("type").isin("ASSESSMENT_BLUEPRINT", "QUESTION_PAPER", "ANSWER_SCHEME")
    dated = F.col("academic_year").isNull() | F.contains("academic_year", F.lit(year))
    return nodes.where(kinds & F.contains(F.lower("label"), F.lit(subject.lower())) & dated)


def reasoning_paths(edges: DataFrame, start: str, end: str, depth: int = 4) -> DataFrame:
    """path, types of each simple directed path of up to `depth` edges: its nodes, and the types of its edges."""
    step = edges.select("source", "target", "type").distinct().checkpoint()
    front = step.where(F.col("source") == start).select(F.array("source", "target").alias("nodes"), F.array("type").alias("types"), F.col("target").alias("at"))
    done = front.where(F.col("at") == end)
    for _ in range(1, depth):
        open_ = front.where(F.col("at") != end)
        front = open_.join(step, open_["at"] == step["source"]).where(~F.array_contains("nodes", F.col("target"))).select(F.concat("nodes", F.array("target")).alias("nodes"), F.concat("types", F.array("type")).alias("types"), F.col("target").alias("at"))
        done = done.unionByName(front.where(F.col("at") == end))
    return done.select(F.array_join("nodes", ">").alias("path"), F.array_join("types", ">").alias("types"))


def anchored(nodes: DataFrame, queries: DataFrame, words: Column, kind: str = "CONCEPT", most_words: int = 3, most_nodes: int = 3) -> DataFrame:
    """query_id, id of the concept nodes whose label has one of a query's first words (by an equi-join on words): at most `most_nodes` a word, by id."""
    asked = queries.select("query_id", F.explode(F.slice(words, 1, most_words)).alias("word")).select("query_id", F.lower("word").alias("word")).distinct()
    listed = nodes.where(F.col("type") == kind).select("id", F.explode(F.array_distinct(F.split(F.lower("label"), "[^a-z0-9]+"))).alias("word")).where("word <> ''")
    first = listed.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("id"))).where(F.col("r") <= most_nodes)  # the same for every query
    return asked.join(first, "word").select("query_id", "id").distinct()


#: Parts of a neighbourhood that many queries share, so that one of them is no single task's.
PARTS = 16


def subgraph(edges: DataFrame, anchors: DataFrame, depth: int = 2) -> DataFrame:
    """query_id, id, depth: the union of the neighbourhoods of each query's anchors (query_id, id), each node at its least depth.

    Queries of equal anchors share one neighbourhood, which is made once and then given to each of them.
    """
    sets = anchors.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asked = shared.written(sets.withColumn("set", F.sha2(F.to_json("ids"), 256)))
    starts = asked.groupBy("set").agg(F.any_value("ids").alias("ids")).select("set", F.explode("ids").alias("start"))
    around = reached(edges, starts.select(F.col("start").alias("id")).distinct(), depth)
    nodes = starts.join(around, "start").groupBy("set", "id").agg(F.min("depth").alias("depth"))
    each = asked.select("query_id", "set", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return nodes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(each, ["set", "part"]).select("query_id", "id", "depth")


def objects(questions: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (source, target, type) of papers, their questions and the questions' parts."""
    paper = F.concat(F.lit("paper:"), "document_id")
    question = F.concat(F.lit("q:"), "document_id", F.lit(":"), "number")
    part = F.concat(question, F.lit(":"), "part")
    nodes = questions.select(paper.alias("id"), F.lit("QUESTION_PAPER").alias("type"), paper.alias("label")).distinct()
    nodes = nodes.unionByName(questions.select(question.alias("id"), F.lit("QUESTION").alias("type"), F.col("title").alias("label"))).unionByName(parts.select(part.alias("id"), F.lit("QUESTION_PART").alias("type"), F.concat(F.lit("Q"), "q_no", F.lit("("), "part", F.lit(")")).alias("label")).distinct())
    edges = questions.select(paper.alias("source"), question.alias("target"), F.lit("CONTAINS").alias("type")).unionByName(parts.select(question.alias("source"), part.alias("target"), F.lit("CONTAINS").alias("type")).distinct())
    return nodes, edges


def closure(prerequisites: DataFrame, least: float = 0.28) -> DataFrame:
    """Two-hop closure of (concept, prerequisite, score): scores multiply, the best stays, at least `least`."""
    a, b = prerequisites.alias("a"), prerequisites.alias("b")
    hop = a.join(b, F.col("a.prerequisite") == F.col("b.concept")).where(F.col("a.concept") != F.col("b.prerequisite"))
    two = hop.select(F.col("a.concept").alias("concept"), F.col("b.prerequisite").alias("prerequisite"), (F.col("a.score") * F.col("b.score")).alias("score")).where(F.col("score") >= least)
    return prerequisites.select("concept", "prerequisite", "score").unionByName(two).groupBy("concept", "prerequisite").agg(F.max("score").alias("score"))


def levels(edges: DataFrame) -> DataFrame:
    """id, level: the longest way from a node without incoming edges; nodes on or behind a cycle are left out."""
    step = edges.select("source", "target").distinct().checkpoint()
    nodes = step.select(F.col("source").alias("id")).union(step.select("target")).distinct()
    placed = None
    left, rest = nodes, step
    for level in itertools.count():
        free = left.join(rest.select(F.col("target").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level).cast("long")).checkpoint()
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        left = left.join(free, "id", "left_anti").checkpoint()
        rest = rest.join(free.select(F.col("id").alias("source")), "source", "left_anti").checkpoint()
    return placed if placed is not None else nodes.withColumn("level", F.lit(0).cast("long")).limit(0)


def ordered(edges: DataFrame) -> DataFrame:
    """Edges turned one way, from the lesser to the greater end by the concept's number: an acyclic graph."""
    number = lambda c: F.substring(c, 2, 9).cast("int")
    return edges.where(number(F.col("source")) < number(F.col("target")))


def prerequisite_plan(edges: DataFrame, target: str, mastered: DataFrame, depth: int = 4) -> DataFrame:
    """What to learn before a target, in order: concepts up to `depth` edges back without the mastered ones, by level; the target last."""
    step = edges.select("source", "target").distinct().checkpoint()
    front = step.where(F.col("target") == target).select("source").distinct()
    seen = front
    for _ in range(1, depth):
        front = step.join(front.withColumnRenamed("source", "target"), "target", "left_semi").select("source").distinct().join(seen, "source", "left_anti")
        seen = seen.unionByName(front)
    seen = seen.distinct().checkpoint()
    inner = step.join(seen, "source", "left_semi").join(seen.union(seen.sparkSession.createDataFrame([(target,)], "source string")).withColumnRenamed("source", "target"), "target", "left_semi")
    open_ = levels(inner).join(mastered.select(F.col("concept_id").alias("id")), "id", "left_anti")
    return open_.select("id", "level")


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's latest row by `order` (ties: the change), and `version`, the number of its rows."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    latest = both.groupBy(key).agg(F.max_by(F.struct(*current.columns), F.struct(order, "__new")).alias("row"), F.count("*").alias("version"))
    return latest.select("row.*", "version")


def append_sequence(log: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The new rows with seq after each key's largest in the log."""
    last = log.groupBy(key).agg(F.max("seq").alias("__last"))
    window = Window.partitionBy(key).orderBy(*order)
    return new.join(last, key, "left").withColumn("seq", F.row_number().over(window) + F.coalesce("__last", F.lit(0))).drop("__last")


def register(ledger: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of the ledger and, behind them, the found ones whose key it lacks."""
    return ledger.unionByName(found.join(ledger.select(key), key, "left_anti"))


def retract(rows: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """The given ids' rows end at `now`: status retracted."""
    gone = F.broadcast(ids.select(F.col("id").alias("__gone")).distinct()) if ids.isLocal() else ids.select(F.col("id").alias("__gone")).distinct()
    joined = rows.join(gone, rows.id == F.col("__gone"), "left")
    hit = F.col("__gone").isNotNull()
    return joined.withColumns({"status": F.when(hit, "retracted").otherwise(F.col("status")), "valid_until": F.when(hit, F.lit(now)).otherwise(F.col("valid_until"))}).drop("__gone")
