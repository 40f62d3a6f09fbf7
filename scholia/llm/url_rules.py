"""URL filters: allow and block rules on hosts and path prefixes, by hash prefixes.

Each URL becomes expressions, a suffix of its host followed by a prefix of its path; rules
are expressions too. Expressions meet rules in an equi-join on the first 32 bits of their
SHA-256, full digests confirm, and the longest rule wins (block before allow between equal
ones). A site that many rows have is no hot key: frequent ones are joined by a broadcast.
Only suffixes of as many labels, and path prefixes of as many characters, as some rule
has are made; both lists are short however many rules there are. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm._spark import looked_up, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judged(pages: DataFrame, url: str, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict; these columns replace any that pages has of the same names.

    rules: host, path, verdict. Null hosts, paths or verdicts of rules are no rule. A null url, or one without ://,
    has an empty host and path, which only a rule with an empty host could fit: the default verdict. An empty
    rules table gives the default to all. Each row is judged by its host and path alone, so repeated ones cost once.
    """
    known = rules.select("host", "path", "verdict").dropna().select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    shape = known.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    labels, lengths = sorted(shape.labels), sorted(shape.lengths)
    hashed = known.withColumn("r_digest", _digest(F.concat("r_host", "r_path"))).select(
        F.substring("r_digest", 1, 8).alias("short"), "r_digest", F.concat("r_host", "r_path").alias("rule"), "r_verdict"
    )
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not labels:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # a path is empty or begins with the / that ends its host, so both in one are still told apart
    site = F.concat("host", "path")
    sites = parsed.select("host", "path").groupBy(site.alias("site"), "host", "path").agg(F.count("*").alias("times"))
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels)))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)))
    expressions = F.when((F.size(suffixes) > 0) & (F.size(prefixes) > 0), F.flatten(F.transform(suffixes, lambda x: F.transform(prefixes, lambda y: F.concat(x, y)))))
    expanded = sites.select("site", "times", F.explode_outer(expressions).alias("expression")).withColumn("digest", _digest(F.col("expression")))
    hits = expanded.withColumn("short", F.substring(F.coalesce("digest", _digest(F.col("site"))), 1, 8)).join(hashed, "short", "left")
    fits = F.struct(F.length("rule").alias("n"), (F.col("r_verdict") == "block").alias("blocks"), "rule", "r_verdict")
    best = hits.groupBy("site").agg(F.max(F.when(F.col("digest") == F.col("r_digest"), fits)).alias("best"), F.max("times").alias("times"))
    name = _unused(parsed, "site")
    judged = looked_up(parsed.withColumn(name, site), written(best.withColumnRenamed("site", name).withColumnsRenamed({"best": _unused(parsed, "best"), "times": _unused(parsed, "times")})), name, _unused(parsed, "times"))
    best = F.col(_unused(parsed, "best"))
    return judged.select(*rest, "host", "path", best["rule"].alias("rule"), F.coalesce(best["r_verdict"], F.lit(default)).alias("verdict"))


def _unused(rows: DataFrame, name: str) -> str:
    """The name, with underscores that no column's name is as long as."""
    return "_" * max((len(c) for c in rows.columns), default=0) + name
