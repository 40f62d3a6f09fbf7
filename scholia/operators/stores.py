"""Scans, counts and changes of stored tables: event log, graph nodes, ledger, assessments, sheets, templates, chunks, audit log.

A table is a DataFrame; a change returns the new rows of the table, for a writer of the caller's choice. Filters are
plain predicates, so that they reach the scan. A limit is an argument of the caller; none is silent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.sources import shared


def event_range(events: DataFrame, learner: object, since: int = 0, limit: int | None = None) -> DataFrame:
    """A learner's events (learner_id, seq, ...) after a sequence number, in order."""
    found = events.where((F.col("learner_id") == learner) & (F.col("seq") > since)).orderBy("seq")
    return found if limit is None else found.limit(limit)


def node_scan(nodes: DataFrame, *, kind: str | None = None, contains: str | None = None, status: str = "draft", limit: int | None = None) -> DataFrame:
    """Nodes (id, type, label, status, ...) by type, part of the label (case does not matter) and status, in order of their ids."""
    found = nodes.where(F.col("status") == status)
    if kind is not None:
        found = found.where(F.col("type") == kind)
    if contains is not None:
        found = found.where(F.contains(F.lower("label"), F.lit(contains.lower())))
    found = found.orderBy("id")
    return found if limit is None else found.limit(limit)


def selected(rows: DataFrame, order: str | None = None, **equal: object) -> DataFrame:
    """Rows whose columns have the given values, in order (a leading - for falling)."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows if order is None else rows.orderBy(F.desc(order[1:]) if order.startswith("-") else F.asc(order))


def _fits(equal: dict[str, object]) -> Column:
    fits = F.lit(True)
    for column, value in equal.items():
        fits = fits & F.col(column).eqNullSafe(F.lit(value))
    return fits


def updated(rows: DataFrame, values: dict[str, object], **equal: object) -> DataFrame:
    """The rows, those that have the given values with new ones in some columns."""
    return rows.withColumns({c: F.when(_fits(equal), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, **equal: object) -> DataFrame:
    """The rows without those that have the given values; with no values given, none goes."""
    return rows.where(~_fits(equal)) if equal else rows


def ledger_status(ledger: DataFrame, status: str | None = None) -> DataFrame:
    """Sources of a ledger by the time of their registration, of one status or all."""
    return (ledger if status is None else ledger.where(F.col("status") == status)).orderBy("registered_at", "source_id")


def newest(rows: DataFrame, column: str, value: object, at: str, tie: str) -> DataFrame:
    """Rows with a value in a column, the newest first: a teacher's or school's assessments, an assessment's or action's audit."""
    return rows.where(F.col(column) == value).orderBy(F.desc(at), tie)


def sheet_counts(sheets: DataFrame) -> DataFrame:
    """Graded sheets (assessment, student): one row with the numbers of sheets, assessments and students."""
    return sheets.agg(F.count("*").alias("sheets"), F.count_distinct("assessment").alias("assessments"), F.count_distinct("student").alias("students"))


def templates_of(schools: DataFrame, templates: DataFrame, builtin: str) -> DataFrame:
    """school, template of schools (school, chosen): the chosen one if it exists, else the school's default, else the built-in one.

    templates: template, school, is_default. Of several defaults the last saved (greatest template id) counts.
    """
    known = templates.select(F.col("template").alias("chosen"), F.lit(True).alias("exists")).distinct()
    default = templates.where("is_default").groupBy("school").agg(F.max("template").alias("default"))
    joined = schools.join(known, "chosen", "left").join(default, "school", "left")
    return joined.select("school", F.coalesce(F.when(F.col("exists"), F.col("chosen")), "default", F.lit(builtin)).alias("template"))


def snapshot(nodes: DataFrame, edges: DataFrame, taken: DataFrame, notes: str = "") -> DataFrame:
    """One row for a history of snapshots: snapshot_id snap:<n + 1>, the one before, and the numbers of nodes and edges."""
    n = nodes.agg(F.count("*").alias("node_count"))
    e = edges.agg(F.count("*").alias("edge_count"))
    t = taken.agg(F.count("*").alias("n"))
    one = n.crossJoin(e).crossJoin(t)  # one row each
    return one.select(F.concat(F.lit("snap:"), F.col("n") + 1).alias("snapshot_id"), F.when(F.col("n") > 0, F.concat(F.lit("snap:"), F.col("n"))).alias("parent_snapshot_id"), "node_count", "edge_count", F.lit(notes).alias("notes"))


def without_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """An index's chunks but those of the documents given (document_id)."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(chunks.columns)


def replaced(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """An index's chunks with all chunks of the new ones' documents replaced by the new ones. Statistics follow from the chunks."""
    return without_documents(chunks, new).unionByName(new)


def appended(log: DataFrame, action: str, entries: DataFrame) -> DataFrame:
    """An audit log (id, at, action, assessment, student, actor, details) with the entries (the same without id and action) behind it."""
    new = entries.withColumn("action", F.lit(action))
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("at", "action", "assessment", "student", "actor", "details")))
    return log.unionByName(new.withColumn("id", F.substring(F.sha2(key, 256), 1, 16)))


def last_put(keys: DataFrame, primary: list[str], order: list[str]) -> DataFrame:
    """Of answer keys with the same primary columns the one of the last file."""
    last = Window.partitionBy(*primary).orderBy(*(F.desc(c) for c in order))
    return keys.withColumn("put", F.row_number().over(last)).where("put = 1").drop("put")


def key_stats(keys: DataFrame) -> DataFrame:
    """Answer keys (paper, option, answer): number, those with an option, those with an answer text, and papers."""
    return keys.agg(F.count("*").alias("keys"), F.count_if(F.col("option").isNotNull()).alias("objective"), F.count_if(F.coalesce("answer", F.lit("")) != "").alias("written"), F.count_distinct("paper").alias("papers"))


def corpus_stats(sources: DataFrame, kind: str) -> DataFrame:
    """kind, sources, characters of a corpus by kind; null is unknown."""
    return sources.groupBy(F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("characters"))


def with_next(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with the value of the row that follows by key (ties: by value; nulls first), as `name`, and whether there is one, as `followed`.

    Keys are dealt to tasks by range, so no task sorts the whole table; the first row of each range stands after the range before it.
    """
    ranged = shared.written(rows.repartitionByRange(F.col(key), F.col(value)).withColumn("__range", F.spark_partition_id()))
    firsts = ranged.groupBy("__range").agg(F.min(F.struct(key, value)).alias("__first"))
    ahead = firsts.select("__range", F.lead("__first").over(Window.orderBy("__range")).alias("__ahead"))  # one row a range
    inside = F.lead(F.struct(key, value)).over(Window.partitionBy("__range").orderBy(key, value))
    held = ranged.withColumn("__next", inside).join(F.broadcast(ahead), "__range").withColumn("__next", F.coalesce("__next", "__ahead"))
    return held.withColumns({name: F.col("__next")[value], "followed": F.col("__next").isNotNull()}).drop("__range", "__next", "__ahead")
