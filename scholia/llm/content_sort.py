"""Exact copies by sorting whole texts: sampled splitters, external sorts, neighbouring comparisons.

All of it is DataFrame functions. Texts are normalised (each run of blanks is one space), range-partitioned by their first
bytes and a hash, and sorted in their partitions, so that equal texts stand next to each other; each row is then compared
with its neighbour over the whole text. The hash only evens out texts that begin alike; no decision rests on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm._spark import written

#: Bytes of a text that a splitter holds at most: what the driver samples stays small however long the texts are.
SPLITTER_BYTES = 32
#: A hash is frequent from one in so many rows on: no more hashes than that can be.
FREQUENT = 1000


def grouped(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """One row for every row: id, keep_id, group_size, kept, text_sha256.

    Rows are copies if their texts are identical after each run of `[\\x20\\x09-\\x0D]` is replaced by one space; nothing is
    trimmed, and a null counts as empty. keep_id is the smallest id of the copies (null only if all are null) and exactly
    one row of them is kept: of repeated rows with this id, one. An empty table gives an empty result; columns other than
    the two named play no part.

    Copies of a frequent hash, at most FREQUENT hashes, are dealt over parts by their ids, each about as large as a
    partition, and the parts' first rows, a few for each such hash, are compared whole in turn.
    """
    norm = F.regexp_replace(F.coalesce(docs[text], F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(docs[row_id].alias("id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    counts = rows.groupBy("h").agg(F.count("*").alias("n"))
    total = docs.count()
    # ceil of the share of 4 * FREQUENT parts: a part of a frequent hash is a fraction of a partition's rows
    often = counts.where(F.col("n") * FREQUENT > total).select("h", F.ceil(F.col("n") * (4 * FREQUENT) / F.lit(max(total, 1))).alias("parts"))
    dealt = rows.join(F.broadcast(often), "h", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id", F.lit(7)), "parts")))
    head = F.substring(F.encode("norm", "UTF-8"), 1, SPLITTER_BYTES)
    sorted_by_content = dealt.withColumn("head", head).repartitionByRange("head", "h", "part")
    # the window's keys begin with the splitters' columns: it sorts the partitions as they are, without another shuffle
    equal = Window.partitionBy("head", "h", "part", "norm")
    found = sorted_by_content.select(
        "id",
        "part",
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        F.row_number().over(equal.orderBy(F.col("id").asc_nulls_last())).alias("place"),
        F.min("id").over(equal).alias("least"),
        F.count("*").over(equal).alias("size"),
        "norm",
    )
    first = (F.col("place") == 1) & F.col("part").isNotNull()
    found = written(found.withColumn("norm", F.when(first, F.col("norm"))))  # beyond digests, only texts of parts' first rows
    plain = found.where("part IS NULL").select("id", F.col("least").alias("keep_id"), F.col("size").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256")
    return plain.unionByName(_joined(found.where("part IS NOT NULL")))


def _joined(parts: DataFrame) -> DataFrame:
    """The rows of frequent hashes: parts of the same text become one group."""
    whole = parts.where("place = 1").groupBy("norm").agg(F.first("text_sha256").alias("text_sha256"), F.min("least").alias("keep_id"), F.sum("size").alias("group_size"))
    # a digest for each text of a frequent hash: FREQUENT rows, or a few more where hashes clash
    known = F.broadcast(whole.drop("norm"))
    kept = (F.col("place") == 1) & F.col("least").eqNullSafe(F.col("keep_id"))
    return parts.join(known, "text_sha256").select("id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def kept(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """The ids (column id) of the rows that stay: one of each group of copies."""
    return grouped(docs, text, row_id).where("kept").select("id")
