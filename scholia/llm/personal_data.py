"""Personal data: patterns for four kinds, and contextual bootstrapping of further identifiers.

Base spans are leftmost, non-overlapping matches of a kind's pattern that pass its check. The
patterns are written so that no start is tried twice inside one run of characters and no group
recurses: any text takes time in proportion to its length.

Positions come from running sums that are made in steps of a fixed length, so their time
is in proportion to the number of matches too.

Bootstrapping: the base spans are seeds. Every seed and every other word that holds a digit or
an @ is an instance, by its surface; the whole words around it, however long, are lexical patterns (two words to the left; one to
the left and one to the right). In each round a pattern's confidence for a kind is the
confident share of its distinct instances, smoothed; an instance's is the noisy-or of its
patterns that are confident and have enough distinct believed instances, found ones included.
Instances at or over the threshold become spans and count in the next round, until no belief rises. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm._spark import written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, each equal in its matches to the plain form in the comment beside it.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?<![0-9])[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SHARE, SEEDS, THRESHOLD = 0.8, 3, 0.8
#: None: until no belief rises.
ROUNDS = None
#: Elements that a running sum takes at a time: an array grows by copying, so the time is this times the length.
STEP = 128
#: Code points of the pieces that a text is cut into for masking.
PIECE = 1000
#: Parts of the words of one surface in the join with what was found.
PARTS = 16


def _checked(kind: str, found: str) -> str:
    digits = f"regexp_replace({found}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({found}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 4) AS INT), 0) <= 255)"
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    if kind == "card":
        # from the right, every second digit doubled, less 9 when over 9
        luhn = "aggregate(sequence(0, length(d) - 1), 0, (a, i) -> a + IF(i % 2 = 0, CAST(substr(d, length(d) - i, 1) AS INT), IF(CAST(substr(d, length(d) - i, 1) AS INT) > 4, 2 * CAST(substr(d, length(d) - i, 1) AS INT) - 9, 2 * CAST(substr(d, length(d) - i, 1) AS INT))))"
        return f"exists(array({digits}), d -> length(d) BETWEEN 14 AND 19 AND ({luhn}) % 10 = 0)"
    return "true"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


NONE = "CAST(array() AS array<struct<start:int,stop:int,kind:string,surface:string>>)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that makes a value once and names it in the body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, over: Callable[[str, str], str]) -> str:
    """SQL of the running sums (by `over`, whose zero is 0) of an array of integers."""
    parts = f"transform(sequence(0, (size(v) - 1) DIV {STEP}), k -> aggregate(slice(v, k * {STEP} + 1, {STEP}), CAST(array() AS array<int>), (s, x) -> array_append(s, {over('coalesce(try_element_at(s, -1), 0)', 'x')})))"
    carried = f"aggregate(p, array(0), (s, x) -> array_append(s, {over('element_at(s, -1)', 'element_at(x, -1)')}))"
    summed = f"flatten(zip_with(p, slice(c, 1, size(p)), (x, y) -> transform(x, z -> {over('y', 'z')})))"
    return _let("v", values, f"IF(size(v) = 0, CAST(array() AS array<int>), {_let('p', parts, _let('c', carried, summed))})")


def _plus(x: str, y: str) -> str:
    return f"{x} + {y}"


def _most(x: str, y: str) -> str:
    return f"greatest({x}, {y})"


def _placed(text: str, pattern: str, matches: str, kind: str) -> str:
    """Structs (start, stop, kind, surface) in code points from a pattern's matches and the texts between them."""
    sizes = f"zip_with(slice(split({text}, {_quoted(pattern)}, -1), 1, size({matches})), {matches}, (g, m) -> length(g) + length(m))"
    return f"IF(size({matches}) > 0, zip_with({_running(sizes, _plus)}, {matches}, (e, m) -> named_struct('start', e - length(m), 'stop', e, 'kind', '{kind}', 'surface', m)), {NONE})"


def _spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds base (all kinds' spans) and instances: these and the words with a digit or @ that touch none, with the words around."""
    found = docs
    for kind in KINDS:
        condition = f"contains({text}, '{NEEDS[kind]}')" if NEEDS[kind] else f"{text} RLIKE '[0-9]'"
        found = found.withColumn(f"m_{kind}", F.expr(f"IF({condition}, regexp_extract_all({text}, {_quoted(PATTERNS[kind])}, 0), CAST(array() AS array<string>))"))
    found = found.withColumn("words", F.expr(f"IF({text} RLIKE '[0-9@]', regexp_extract_all({text}, '\\\\S++', 0), CAST(array() AS array<string>))"))
    placed = {kind: _placed(text, PATTERNS[kind], f"m_{kind}", kind) for kind in KINDS}
    found = found.withColumn("base", F.expr("concat(" + ", ".join(f"filter({placed[k]}, x -> {_checked(k, 'x.surface')})" for k in KINDS) + ")"))
    found = found.withColumn("places", F.expr(_placed(text, r"\S++", "words", "word")))
    # the numbers of the words in which each base span begins and ends: words that begin up to there
    events = "array_sort(concat(transform(places, w -> struct(w.start AS at, 0 AS asks, 0 AS id)), transform(base, (b, i) -> struct(b.start AS at, 1 AS asks, 2 * i AS id)), transform(base, (b, i) -> struct(b.stop - 1 AS at, 1 AS asks, 2 * i + 1 AS id))))"
    ranks = _let("e", events, f"transform(array_sort(filter(zip_with(e, {_running('transform(e, x -> 1 - x.asks)', _plus)}, (x, n) -> struct(x.asks AS asks, x.id AS id, n AS n)), x -> x.asks = 1)), x -> x.n)")
    found = found.withColumn("ranks", F.expr(f"IF(size(base) > 0, {ranks}, CAST(array() AS array<int>))"))
    numeric = "filter(sequence(1, size(words)), i -> element_at(words, i) RLIKE '[0-9@]')"
    touched = "flatten(transform(base, (b, i) -> sequence(ranks[2 * i], ranks[2 * i + 1])))"
    around = "'two', lower(IF({0} > 2, concat(words[{0} - 3], ' ', words[{0} - 2]), '')), 'one', lower(IF({0} > 1, words[{0} - 2], '')), 'next', lower(IF({1} < size(words), words[{1}], ''))"
    seeds = f"transform(base, (b, i) -> named_struct('start', b.start, 'stop', b.stop, 'kind', b.kind, 'surface', b.surface, {around.format('ranks[2 * i]', 'ranks[2 * i + 1]')}))"
    led, ended = r"regexp_replace(element_at(words, i), '^[^\\p{L}\\p{N}@+]++', '')", r"regexp_replace(t, '(?<![^\\p{L}\\p{N}@])[^\\p{L}\\p{N}@]++$', '')"
    begin = "(places[i - 1].stop - length(t))"
    others = f"transform(array_except({numeric}, {touched}), i -> {_let('t', led, _let('u', ended, f"named_struct('start', {begin}, 'stop', {begin} + length(u), 'kind', 'word', 'surface', u, {around.format('i', 'i')})"))})"
    return found.withColumn("instances", F.expr(f"IF(size(words) > 0, filter(concat({seeds}, {others}), x -> x.stop > x.start), NULL)")).drop(*(f"m_{k}" for k in KINDS), "words", "places", "ranks")


def _bootstrapped(instances: DataFrame, share: float, seeds: int, threshold: float, rounds: int | None) -> DataFrame:
    """surface, kind of the words that confident patterns find. instances: kind ('word' for others), surface, two, one, next."""
    patterns = instances.select(
        F.sha2("surface", 256).alias("surface"), "kind",
        F.explode(F.array(F.when(F.col("two") != "", F.concat(F.lit("L:"), "two")), F.when((F.col("one") != "") & (F.col("next") != ""), F.concat_ws("\t", F.lit("B:"), "one", "next")))).alias("pattern"),
    ).where("pattern IS NOT NULL")
    # one row for each pattern, surface and kind, however often they meet
    edges = written(patterns.select(F.xxhash64("pattern").alias("pattern"), F.xxhash64("surface").alias("surface"), "kind").distinct())
    # a pattern with fewer surfaces than that, of whatever kind, can't count in any round
    sizes = written(edges.groupBy("pattern").agg(F.count_distinct("surface").alias("size")).where(F.col("size") >= seeds))
    graph = written(edges.join(sizes, "pattern"))
    seeded = graph.where("kind != 'word'").select("surface", "kind", F.lit(1.0).alias("belief")).distinct()
    pairs = graph.select("pattern", "surface", "size").distinct()
    found, state, done = seeded, None, 0
    while rounds is None or done < rounds:
        rated = pairs.join(found, "surface").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count("*").alias("n"), F.first("size").alias("size"))
        trusted = rated.withColumn("trust", F.col("mass") / (F.col("size") + 0.5)).where((F.col("trust") >= share) & (F.col("n") >= seeds))
        score = pairs.join(trusted.select("pattern", "kind", "trust"), "pattern").groupBy("surface", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("belief"))
        found = written(score.where(F.col("belief") >= threshold).unionByName(seeded).groupBy("surface", "kind").agg(F.max("belief").alias("belief")))
        done += 1
        # beliefs only rise; the steps are bounded, so this ends
        before, state = state, found.agg(F.count("*"), F.coalesce(F.sum(F.floor(F.col("belief") * 1_000_000)), F.lit(0))).first()
        if before is not None and state[0] <= before[0] and state[1] <= before[1]:
            break
    return found


def _joined(spans: str) -> Column:
    rank = "CASE x.kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 ELSE 3 END"
    ordered = f"array_sort(transform({spans}, x -> struct(x.start AS start, {rank} AS rank, x.stop AS stop, x.kind AS kind)))"
    return F.expr(f"array_join(transform({ordered}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def found(docs: DataFrame, text: str, row_id: str, *, share: float = SHARE, seeds: int = SEEDS, threshold: float = THRESHOLD, rounds: int | None = ROUNDS) -> DataFrame:
    """id, base, added for each row: arrays of (start, stop, kind, surface); base by the patterns, added by context.

    A null or empty text has none. Rows are kept as they are, also repeated ones and null ids.
    """
    slim = _spans(docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text")
    slim = written(slim.select(F.monotonically_increasing_id().alias("row"), "id", "base", "instances"))
    instances = slim.where("instances IS NOT NULL").select("row", F.explode("instances").alias("x")).select("row", "x.*")
    known = _bootstrapped(instances, share, seeds, threshold, rounds)
    words = instances.where("kind = 'word'").withColumn("key", F.xxhash64(F.sha2("surface", 256))).select("row", "start", "stop", "key", F.col("surface").alias("seen"))
    # a surface may be that of very many words: they are dealt to PARTS parts, and what was found is there in each
    parts = known.withColumnRenamed("surface", "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    hits = words.withColumn("part", F.pmod("row", F.lit(PARTS)).cast("int")).join(parts, ["key", "part"])
    chosen = hits.groupBy("row", "start", "stop", "seen").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind"))
    added = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", F.col("seen").alias("surface")))).alias("added"))
    return slim.select("row", "id", "base").join(added, "row", "left").select("id", "base", F.coalesce("added", F.expr(NONE)).alias("added"))


def masked(docs: DataFrame, text: str, row_id: str, **options) -> DataFrame:
    """The rows with each span of the text replaced by <kind>; overlapping spans become one. Other columns stay, whatever their names.

    Null and empty texts stay as they are; repeated rows and null ids are rows like any other; an empty table stays empty.
    """
    # the whole row as one column, so that no name of its columns can clash
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")))
    spans = found(numbered.select("row", F.col("doc")[text].alias("text")), "text", "row", **options).select(F.col("id").alias("row"), F.concat("base", "added").alias("spans")).where("size(spans) > 0")
    joined = numbered.join(spans, "row", "left").withColumn("text", F.col("doc")[text])
    cut = joined.withColumn("cut", F.expr(f"IF(spans IS NULL, NULL, regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0))"))

    def piece(a: str, b: str) -> str:
        """Code points a up to b of the text."""
        of = lambda x: f"CAST({x} DIV {PIECE} AS INT)"
        part = lambda x: f"coalesce(get(cut, {of(x)}), '')"
        apart = f"concat(substring({part(a)}, {a} % {PIECE} + 1), array_join(slice(cut, {of(a)} + 2, greatest(0, {of(b)} - {of(a)} - 1)), ''), substring({part(b)}, 1, {b} % {PIECE}))"
        return f"IF({of(a)} = {of(b)}, substring({part(a)}, {a} % {PIECE} + 1, {b} - {a}), {apart})"

    ordered = "array_sort(transform(spans, x -> struct(x.start AS start, x.stop AS stop, x.kind AS kind)))"
    bodies = f"zip_with(o, concat(array(0), slice(r, 1, size(r) - 1)), (x, at) -> IF(x.start < at, '', concat({piece('at', 'x.start')}, '<', x.kind, '>')))"
    whole = f"concat(array_join({bodies}, ''), {piece('element_at(r, -1)', 'length(text)')})"
    new = _let("o", ordered, _let("r", _running("transform(o, x -> x.stop)", _most), whole))
    kept = [F.when(F.col("spans").isNull(), F.col("doc")[c]).otherwise(F.expr(new)).alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    return cut.select(*kept)
