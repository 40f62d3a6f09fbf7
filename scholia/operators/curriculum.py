"""Curriculum mining: which labels occur together, where first, under which headings, and which is the prerequisite of which."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import scales
from scholia.functions import text as X

# Weights of the criteria in the vote, those that must back a winner, and the threshold.
WEIGHTS = {"TemO": 1, "CMH": 3, "IOLR": 3, "BERTropy": 2, "Text": 2, "HL-A": 3}
STRONG = ("CMH", "IOLR", "Text", "HL-A")
THETA = 0.28
# Verbs of the Bloom levels; a verb counts for the first level that has it.
BLOOM_VERBS = {
    "remember": ("define", "list", "name", "recall", "identify", "recognize", "label", "match", "memorize", "repeat", "state", "locate", "select", "quote", "reproduce", "recite"),
    "understand": ("explain", "describe", "discuss", "summarize", "interpret", "classify", "compare", "contrast", "distinguish", "paraphrase", "translate", "infer", "outline", "relate", "predict", "express", "extend"),
    "apply": ("apply", "use", "solve", "calculate", "compute", "demonstrate", "modify", "operate", "prepare", "produce", "show", "sketch", "complete", "illustrate", "practice", "employ", "examine"),
    "analyze": ("analyze", "examine", "differentiate", "divide", "separate", "categorize", "organize", "investigate", "question", "test", "conclude", "survey", "diagram"),
    "evaluate": ("evaluate", "assess", "judge", "critique", "justify", "appraise", "argue", "defend", "rank", "rate", "recommend", "review", "support", "weigh", "grade"),
    "create": ("create", "design", "construct", "develop", "formulate", "generate", "invent", "compose", "plan", "propose", "build", "devise", "synthesize", "imagine", "improve"),
}
# Base difficulty of a Bloom level.
BASE_DIFFICULTY = {"remember": 1.0, "understand": 2.0, "apply": 2.0, "analyze": 3.0, "evaluate": 4.0, "create": 4.0}


def occurrences(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """label, id, document_id, page, heading of each chunk that has a label's word. labels: label, one word each; few."""
    listed = chunks.select("id", "document_id", "page", "heading", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("label"))
    return listed.join(labels.select("label"), "label")


def cooccurrence(found: DataFrame) -> DataFrame:
    """a, b, n: chunks in which two labels (a < b) occur together, by an equi-join on the chunk."""
    a, b = found.select("label", "id").alias("a"), found.select("label", "id").alias("b")
    return a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.label") < F.col("b.label"))).groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.count("*").alias("n"))


def entropy(found: DataFrame) -> DataFrame:
    """label, entropy (natural) of the headings its chunks stand under, and the number of chunks."""
    by = found.groupBy("label", "heading").agg(F.count("*").alias("n"))
    sums = by.groupBy("label").agg(F.sum("n").alias("chunks"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("l"))
    return sums.select("label", "chunks", (F.log(F.col("chunks").cast("double")) - F.col("l") / F.col("chunks")).alias("entropy"))


def first_pages(found: DataFrame) -> DataFrame:
    return found.groupBy("label", "document_id").agg(F.min("page").alias("page"))


def order_votes(found: DataFrame) -> DataFrame:
    """a, b, ahead, behind: documents in which a comes first, and the others in which both occur."""
    first = first_pages(found)
    x, y = first.alias("x"), first.alias("y")
    both = x.join(y, (F.col("x.document_id") == F.col("y.document_id")) & (F.col("x.label") < F.col("y.label")))
    return both.groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.count_if(F.col("x.page") < F.col("y.page")).alias("ahead"), F.count_if(F.col("x.page") >= F.col("y.page")).alias("behind"))


# Verbs that make the object of a triple a prerequisite of its subject, and the weaker ones that don't count in a text's span.
PREREQUISITE_VERBS = (
    "require", "requires", "needs", "need", "depend", "depends", "depend_on", "depends_on", "necessary", "essential", "use", "uses", "contain", "contains", "include", "includes", "involve", "involves", "help", "helps",
    "enable", "enables", "allow", "allows", "based", "based_on", "derived", "derived_from", "made_of", "consist", "consists", "composed",
)
WEAK_VERBS = ("use", "uses", "help", "helps", "allow", "allows")


def _requires(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("type") == "RELATED_TO") & F.exists("predicates", lambda p: F.trim(F.lower(p)).isin(*PREREQUISITE_VERBS)))


def link_stats(edges: DataFrame, any_predicate: bool = False) -> DataFrame:
    """id, in_degree, out_degree over edges (source, target, type, predicates) with a prerequisite verb, or all that are RELATED_TO."""
    used = edges.where(F.col("type") == "RELATED_TO") if any_predicate else _requires(edges)
    ends = used.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(used.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def text_prerequisites(edges: DataFrame) -> DataFrame:
    """concept, prerequisite of edges (source, target, type, predicates, span) that say so: a verb among the predicates, or a strong one of over three letters in the span."""
    strong = [v for v in PREREQUISITE_VERBS if v not in WEAK_VERBS and len(v) > 3]
    spoken = F.arrays_overlap(F.split(F.lower(F.coalesce("span", F.lit(""))), r"\s+"), F.array(*(F.lit(v) for v in strong)))
    said = F.exists(F.coalesce("predicates", F.array().cast("array<string>")), lambda p: F.trim(F.lower(p)).isin(*PREREQUISITE_VERBS))
    return edges.where((F.col("type") == "RELATED_TO") & (said | spoken)).select(F.col("source").alias("concept"), F.col("target").alias("prerequisite")).distinct()


def _one_way(pairs: DataFrame, earlier: str, later: str, name: str) -> DataFrame:
    """a, b (a < b) and 1 where only a is the earlier of the two, -1 where only b is."""
    way = F.when(F.col(earlier) < F.col(later), 1).otherwise(-1)
    return pairs.where(F.col(earlier) != F.col(later)).select(F.least(earlier, later).alias("a"), F.greatest(earlier, later).alias("b"), way.alias(name)).distinct().groupBy("a", "b").agg(F.sum(name).cast("int").alias(name)).where(F.col(name) != 0)


def votes(
    found: DataFrame, links: DataFrame | None = None, *, grades: DataFrame | None = None, required: DataFrame | None = None, pages: DataFrame | None = None, front_matter: int = 0, least_degree: int = 0, pair_evidence: bool = False,
    least_together: int = 2, least_criteria: int = 2, theta: float = THETA,
) -> DataFrame:
    """prerequisite, concept, score, weight, against of the pairs that enough criteria decide.

    Criteria: order in shared documents (TemO), spread over headings (BERTropy); and where given, grades (document_id, grade) of the documents (CMH: the
    earlier one), links (id, in_degree, out_degree; IOLR, from `least_degree` on), required (concept, prerequisite; Text) and pages (source, target: source's page links to target; HL-A). A pair takes
    part if it occurs together in enough chunks or one page alone links to the other. Pages before `front_matter` don't count.
    The score is the weighed margin; a strong criterion must back the winner where one is active, with `pair_evidence` also one about the pair.
    """
    told = found.where(F.col("page") >= front_matter) if front_matter else found
    pairs = cooccurrence(told).where(F.col("n") >= least_together).select("a", "b")
    present = told.select("label").distinct()
    if pages is not None:
        # the target is linked within the source: it is the source's prerequisite
        contained = _one_way(pages.select(F.col("target").alias("x"), F.col("source").alias("y")), "x", "y", "hl")
        for side in "ab":
            contained = contained.join(present.select(F.col("label").alias(side)), side, "left_semi")
        pairs = pairs.unionByName(contained.select("a", "b")).distinct().join(contained, ["a", "b"], "left")
    pairs = pairs.join(order_votes(told), ["a", "b"], "left" if pages is not None else "inner")
    if required is not None:
        pairs = pairs.join(_one_way(required, "prerequisite", "concept", "tx"), ["a", "b"], "left")
    spread = entropy(told).select("label", "entropy")
    first = None if grades is None else told.select("label", "document_id").distinct().join(grades, "document_id").groupBy("label").agg(F.min("grade").alias("grade"))
    for side in "ab":
        pairs = pairs.join(spread.withColumnsRenamed({"label": side, "entropy": f"e{side}"}), side, "left")
        if links is not None:
            rate = links.where(F.col("in_degree") + F.col("out_degree") >= least_degree).select(F.col("id").alias(side), ((F.col("in_degree") + 1) / (F.col("in_degree") + F.col("out_degree") + 1)).alias(f"r{side}"))
            pairs = pairs.join(rate, side, "left")
        if first is not None:
            pairs = pairs.join(first.withColumnsRenamed({"label": side, "grade": f"g{side}"}), side, "left")
    sign = lambda x: F.when(x > 1e-9, 1).when(x < -1e-9, -1).otherwise(0)
    cast = {"TemO": sign((F.col("ahead") - F.col("behind")).cast("double")), "BERTropy": sign(F.col("ea") - F.col("eb"))}
    if links is not None:
        cast["IOLR"] = sign(F.col("ra") - F.col("rb"))
    if first is not None:
        cast["CMH"] = sign((F.col("gb") - F.col("ga")).cast("double"))
    if required is not None:
        cast["Text"] = F.coalesce("tx", F.lit(0))
    if pages is not None:
        cast["HL-A"] = F.coalesce("hl", F.lit(0))
    of = {k: F.col("v_" + k.lower().replace("-", "")) for k in cast}
    voted = pairs.withColumns({"v_" + k.lower().replace("-", ""): v for k, v in cast.items()})
    va = sum((F.when(v > 0, WEIGHTS[k]).otherwise(0) for k, v in of.items()), F.lit(0))
    vb = sum((F.when(v < 0, WEIGHTS[k]).otherwise(0) for k, v in of.items()), F.lit(0))
    n = sum((F.abs(v) for v in of.values()), F.lit(0))
    decided = voted.withColumns({"va": va, "vb": vb, "n_votes": n}).where(F.col("n_votes") >= least_criteria).withColumn("s", (F.col("va") - F.col("vb")) / (F.col("va") + F.col("vb"))).where(F.abs("s") >= theta)

    def backed(criteria: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for k in criteria:
            if k in of:
                out = out | (of[k] * F.signum("s") > 0)
        return out

    if any(k in STRONG for k in cast):
        decided = decided.where(backed(STRONG))
    if pair_evidence:
        decided = decided.where(backed(("TemO", "Text", "HL-A")))
    a_first = F.col("s") > 0
    return decided.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("prerequisite"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("concept"), F.abs("s").alias("score"), F.greatest("va", "vb").cast("long").alias("weight"), F.least("va", "vb").cast("long").alias("against"))


def edges(voted: DataFrame, difficulty: DataFrame, active: int) -> DataFrame:
    """The votes with confidence, difficulty jump and spacing in days, both ends known. difficulty: label, difficulty."""
    d = difficulty.select(F.col("label").alias("prerequisite"), F.col("difficulty").alias("d0")), difficulty.select(F.col("label").alias("concept"), F.col("difficulty").alias("d1"))
    joined = voted.join(d[0], "prerequisite").join(d[1], "concept")
    total = F.col("weight") + F.col("against")
    sure = F.least(F.lit(1.0), total / active) * (0.5 + 0.5 * (F.col("weight") - F.col("against")) / total)
    jump = F.col("d1") - F.col("d0")
    return joined.select("prerequisite", "concept", "score", sure.alias("confidence"), jump.alias("jump"), F.greatest(F.lit(1.0), F.round(3 * (2 - sure) * (1 + F.greatest(jump, F.lit(0.0))))).cast("long").alias("spacing_days"))


def _one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def bloom_of(verbs: Column) -> Column:
    """The Bloom level of most of the verbs; the higher of equal ones; understand without any."""
    counted, seen = [], set()
    for i, (level, listed) in enumerate(BLOOM_VERBS.items()):
        own = [v for v in listed if v not in seen]
        seen |= set(own)
        counted.append(F.struct(F.size(F.filter(verbs, _one_of(own))).alias("n"), F.lit(i).alias("i"), F.lit(level).alias("level")))
    best = F.array_max(F.array(*counted))
    return F.when(best["n"] > 0, best["level"]).otherwise("understand")


def difficulty_of(bloom: Column, occurrences: Column, documents: Column, prerequisites: Column) -> Column:
    """1 to 5: Bloom level, rarity, spread and prerequisites, rounded half to even."""
    base = scales.looked_up(bloom, BASE_DIFFICULTY, 2.0)
    x = base + F.when(occurrences < 3, 1.0).when(occurrences < 8, 0.5).otherwise(0.0) - F.when(documents >= 3, 0.5).otherwise(0.0) + F.when(prerequisites >= 8, 1.0).when(prerequisites >= 4, 0.5).otherwise(0.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.bround(x, 0)))


def profiles(found: DataFrame, voted: DataFrame) -> DataFrame:
    """label, chunks, documents, difficulty and hours of each label, all of them taken as understood; `outcomes.profiles` has the Bloom level of their texts."""
    by = found.groupBy("label").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"))
    n = voted.groupBy(F.col("concept").alias("label")).agg(F.count("*").alias("prerequisites"))
    joined = by.join(n, "label", "left").fillna(0, ["prerequisites"])
    difficulty = difficulty_of(F.lit("understand"), F.col("chunks"), F.col("documents"), F.col("prerequisites"))
    out = joined.withColumn("difficulty", difficulty)
    return out.withColumns({"hours": 0.5 * F.col("difficulty") + 0.5, "outcome_id": F.concat(F.lit("lo:"), F.substring(F.sha1(F.concat("label", F.lit(":understand"))), 1, 16)), "statement": F.format_string("Learners can explain %s", "label")})


def grade_pairs(found: DataFrame, grades: DataFrame) -> DataFrame:
    """a, b, n: labels met in an earlier grade than others of the same chunk's document: n documents. grades: document_id, grade."""
    met = found.select("label", "document_id").distinct().join(grades, "document_id").groupBy("label").agg(F.min("grade").alias("grade"))
    together = cooccurrence(found)
    return together.join(met.select(F.col("label").alias("a"), F.col("grade").alias("ga")), "a").join(met.select(F.col("label").alias("b"), F.col("grade").alias("gb")), "b").where("ga <> gb").select(F.when(F.col("ga") < F.col("gb"), F.col("a")).otherwise(F.col("b")).alias("prerequisite"), F.when(F.col("ga") < F.col("gb"), F.col("b")).otherwise(F.col("a")).alias("concept"), "n")


def grade_prerequisites(found: DataFrame, grades: DataFrame, least: int = 1) -> DataFrame:
    """prerequisite, concept, n: a label whose first grade is earlier than the other's; n counts the pairs of their grades that stand in this order.

    grades: document_id, grade, one row a document; documents without one or with a null one don't count. Labels meet through the pairs of
    first grades that are in order, of which there are as many as grades allow, so no label is compared with one that it can't precede.
    """
    graded = found.select("label", "document_id").distinct().join(grades.where("grade IS NOT NULL"), "document_id")
    met = graded.groupBy("label").agg(F.array_sort(F.collect_set("grade")).alias("grades")).withColumn("first", F.get("grades", 0))
    firsts = met.select("first").distinct()
    ordered = firsts.agg(F.collect_set("first").alias("all")).select(F.explode("all").alias("first"), "all").select("first", F.explode(F.filter("all", lambda g: g > F.col("first"))).alias("then"))
    earlier = met.select(F.col("label").alias("prerequisite"), "first", F.col("grades").alias("before"))
    later = met.select(F.col("label").alias("concept"), F.col("first").alias("then"), F.col("grades").alias("after"))
    n = F.aggregate("before", F.lit(0).cast("long"), lambda total, g: total + F.size(F.filter("after", lambda h: h > g)))
    return earlier.join(ordered, "first").join(later, "then").select("prerequisite", "concept", n.alias("n")).where(F.col("n") >= least)


def page_links(pages: DataFrame, html: str, labels: DataFrame) -> DataFrame:
    """source, target: labels whose page links to another's. A page is about the first word of its title; a link is about the first word of its text.

    labels: label, few. Null pages, pages without a title and links of a label to itself give nothing.
    """
    first = lambda x: F.get(X.tokens(x), 0)
    titled = pages.where(F.col(html).isNotNull()).select(
        first(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("source"), F.regexp_extract_all(html, F.lit("<a href=[^>]*>([^<]*)</a>"), F.lit(1)).alias("links"),
    )
    mine = titled.join(labels.select(F.col("label").alias("source")), "source")
    linked = mine.select("source", F.explode("links").alias("link")).select("source", first(F.col("link")).alias("target"))
    return linked.join(labels.select(F.col("label").alias("target")), "target").where("source <> target").select("source", "target").distinct()


def told_edges(told: DataFrame, labels: DataFrame) -> DataFrame:
    """source, target, type, predicates, span: what triples (subject, predicate, object) say between two labels, all predicates of a pair together."""
    ends = told.join(labels.select(F.col("label").alias("subject")), "subject").join(labels.select(F.col("label").alias("object")), "object")
    return ends.groupBy(F.col("subject").alias("source"), F.col("object").alias("target")).agg(F.sort_array(F.collect_set("predicate")).alias("predicates")).withColumns({"type": F.lit("RELATED_TO"), "span": F.lit(None).cast("string")})


def triples(rows: DataFrame, text: str) -> DataFrame:
    """subject, predicate, object, n from sentences of the form `A requires B` (also needs, uses, is, has): entities are the words next to the verb."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z]{3,} (requires|needs|uses|is|has) [a-z]{3,})"), F.lit(1))
    parts = rows.select(F.explode(found).alias("m")).select(F.split("m", " ").alias("p"))
    return parts.select(F.get("p", 0).alias("subject"), F.get("p", 1).alias("predicate"), F.get("p", 2).alias("object")).where("subject <> object").groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


def heading_windows(chunks: DataFrame, most: int = 4000) -> DataFrame:
    """Packs of a document's lines under one heading: document_id, heading, pack, lines, characters. A line goes to the pack in which it ends when all are laid end to end in `most` characters each; it never splits."""
    order = Window.partitionBy("document_id", "heading").orderBy(F.split("id", ":")[1].cast("long"))
    ends = chunks.withColumn("end", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ends.groupBy("document_id", "heading", F.floor((F.col("end") - 1) / most).cast("long").alias("pack")).agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("characters"))
