"""Queries of sources, schemes, reviews and small operators over derived tables; they join the suite's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import assessment, curriculum, graph, retrieval, workflow
from scholia.plans import suite
from scholia.plans.suite import query
from scholia.sources import files, views

NAMES = ("Marking Scheme", "QP_12", "model answer of June", "SQP set", "Syllabus 2023", "letter")


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.get(F.array(*(F.lit(x) for x in values)), n.cast("int"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", F.col("turn").cast("int").alias("turn"), "text")


@query
def file_kinds(spark, d):
    docs = views.table(spark, d, "documents").where("text IS NOT NULL")
    name = _pick(NAMES, F.col("doc_id") % 6)
    text = F.concat(F.when(F.col("doc_id") % 12 == 5, F.lit("Time allowed: 3 hours. Maximum Marks 80. ")).when(F.col("doc_id") % 12 == 11, F.lit("A model answer. ")).otherwise(F.lit("")), "text")
    return docs.select("doc_id", files.kind_of_name(name).alias("by_name"), files.kind_of_text(name, text).alias("kind"))


@query
def file_duplicates(spark, d):
    html = views.table(spark, d, "pages").select(F.col("page_id").alias("path"), F.sha2("html", 256).alias("sha256"), F.concat(F.lit("src:"), F.col("page_id")).alias("source_id"))
    return files.deduplicated(html)


@query
def file_gate(spark, d):
    pages = views.table(spark, d, "pages").where("html IS NOT NULL")
    head = F.when(F.col("page_id") % 5 == 0, F.lit("%PDF-1.4 ")).when(F.col("page_id") % 5 == 1, F.lit("PK\x03\x04")).otherwise(F.lit(""))
    content = F.encode(F.concat(head, "html"), "UTF-8")
    found = pages.select("page_id", _pick(("pdf", "zip", "html"), F.col("page_id") % 3).alias("extension"), content.alias("content"), F.octet_length(content).alias("size_bytes"))
    return files.problems(found).select("page_id", F.array_join("problems", ";").alias("problems"))


@query
def upload_gate(spark, d):
    n = F.col("o_orderkey")
    uploads = views.table(spark, d, "orders").select(n.alias("upload_id"), (F.col("o_custkey") + 100 * (n % 2)).alias("source_id"), _pick(("pdf", "exe", "DOCX", "txt"), n % 4).alias("extension"), (n % 3 > 0).alias("copyright_confirmed"))
    ledger = views.table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("source_id"))
    return files.admitted(uploads, ledger).select("upload_id", "verdict")


@query
def path_metadata(spark, d):
    n = F.col("p_partkey")
    path = F.concat(F.lit("/keys/"), _pick(("X", "XII", "IX"), n % 3), F.lit("/"), _pick(("paper_041_a", "social science", "Maths", "set_184 b", "other"), n % 5), F.lit("/"), n)
    code = F.concat(F.lit("Series 3"), n % 3, _pick((" / ", "-", "/"), n % 3), n % 9, F.lit("/1 end"))
    return views.table(spark, d, "part").select("p_partkey", files.subject_of_path(path).alias("subject"), files.grade_of_path(path).alias("grade"), files.paper_code(code).alias("code"))


@query
def answer_key_scan(spark, d):
    t = F.col("turn")
    text = F.concat(F.when(t == 0, F.concat(F.lit("Code 3"), F.col("conv_id") % 3, F.lit("/1/2 "))).otherwise(F.lit("")), F.lit("Section A\n"), t + 1, F.lit(". "), _pick(("A", "(B)", "C", "D"), t % 4), F.lit("\n"), t + 2, F.lit(") (A)\n"), "text")
    return files.answer_keys(_turns(spark, d).select(F.col("conv_id").alias("path"), F.col("turn").alias("page"), text.alias("text")))


@query
def answer_key_lookup(spark, d):
    part = views.table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("id"), _pick(("Science", "English"), F.col("p_partkey") % 2).alias("subject"), _pick(("X", "XII"), F.col("p_size") % 2).alias("grade"), F.concat(F.lit("31/1/"), F.col("p_size") % 4).alias("paper_code"), (F.col("p_size") % 20).cast("int").alias("q_no"))
    s = F.col("s_suppkey")
    keys = views.table(spark, d, "supplier").select(_pick(("Science", "English"), s % 2).alias("subject"), _pick(("X", ""), s % 3 % 2).alias("grade"), F.concat(F.lit("31/1/"), s % 4).alias("paper_code"), (s % 20).cast("int").alias("q_no"), _pick(("A", "B", "C", "D"), s % 4).alias("option"))
    return files.looked_up(asked, keys).select("id", "option")


@query
def question_maps(spark, d):
    maps = _turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("at"), F.col("text").alias("question"))
    return files.latest_maps(maps, "at").select("key", "at")


@query
def fused_pages(spark, d):
    docs = views.table(spark, d, "documents").where("text IS NOT NULL")
    n = F.col("doc_id")
    each = docs.select((n % 50).alias("document_id"), _pick(("native", "ocr", "vlm"), n % 3).alias("provider"), (0.5 + n % 3 / 10).alias("confidence"), F.expr("CAST(doc_id DIV 50 AS BIGINT)").alias("page"), "text", ((n % 10) / 10).alias("quality"))
    return files.fused(each).select("document_id", "page", "provider", "quality")


@query
def stem_options(spark, d):
    stem = F.concat("p_name", F.lit(" (A) "), "p_brand", F.lit("; (B)  "), "p_type", F.lit(" . (C) "), F.col("p_size"))
    return views.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(workflow.options(stem)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("options"))


@query
def scheme_points(spark, d):
    points = F.slice(F.split("p_name", " "), F.lit(1), (1 + F.col("p_size") % 4).cast("int"))
    made = workflow.scheme(points, F.col("p_size"))
    return views.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(made, lambda p: F.concat(p["keyword"], F.lit(":"), p["marks"])), ",").alias("points"))


@query
def evidence_gate(spark, d):
    docs = views.table(spark, d, "documents")
    n = F.col("doc_id")
    rows = docs.select("doc_id", F.when(n % 5 == 0, None).when(n % 5 == 1, "").otherwise(n.cast("string")).alias("document_id"), F.when(n % 10 == 0, None).otherwise(n % 7 / 7).alias("confidence"), F.substring("text", 5, 4 + n % 9).alias("snippet"), F.col("text").alias("source_text"))
    return workflow.evidence_gate(rows).select("doc_id", "reason", "quoted")


@query
def scrubbed_text(spark, d):
    text = F.concat("text", F.lit("\n\nAs an AI I see\n\n"), F.col("source"))
    return views.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", workflow.without_paragraphs(text, ("as an ai", "version")).alias("text"))


@query
def scan_sessions(spark, d):
    lines = views.table(spark, d, "lineitem")
    printed = lines.select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("number"), (F.col("l_partkey") + 50 * (F.col("l_linenumber") % 2)).alias("question_id")).distinct()
    bank = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"))
    segments = lines.where("l_quantity > 20").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("answer")).groupBy("session", "number").agg(F.max("answer").alias("answer"))
    failed = views.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("session"))
    return workflow.sessions(printed, bank, segments, failed).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


@query
def evidence_events(spark, d):
    answers = views.answers(spark, d).select("student", F.array(F.col("concept"), F.col("gap")).alias("chapters"), "awarded", "max_marks", F.when(F.col("awarded") > 40, "easy").when(F.col("awarded") > 20, "medium").otherwise("hard").alias("difficulty"), F.lit(0).cast("long").alias("t_us"))
    return workflow.evidence_events(answers).groupBy("learner_id", "concept_id").agg(F.count("*").alias("n"), F.avg("outcome").alias("outcome"), F.max("difficulty").alias("difficulty"))


@query
def top_evidence(spark, d):
    rows = views.table(spark, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("document_id"), (F.col("n_chars") % 97 / 97).alias("confidence"))
    return workflow.top_evidence(rows, "key", 3).select("key", "document_id", "rank")


@query
def merged_beliefs(spark, d):
    known, more = F.array(F.lit("force keeps things in motion"), F.lit("heavy things fall faster")), F.array(F.col("p_name"), F.concat("p_name", F.lit(" too")), F.lit("heavy things do fall faster"), F.col("p_type"))
    return views.table(spark, d, "part").select("p_partkey", F.array_join(workflow.merged_beliefs(known, more), "|").alias("beliefs"))


@query
def page_tables(spark, d):
    n = F.col("l_linenumber") - 1
    spans = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (50.0 * (n % 3) + F.col("l_suppkey") % 9).alias("x"), (F.floor(n / 3) * 10.0 + n % 3 * 0.5).alias("y"), F.concat("l_returnflag", F.col("l_linenumber")).alias("text"))
    return workflow.table_rows(spans)


@query
def page_quality(spark, d):
    return workflow.page_quality(_turns(spark, d).select(F.col("conv_id").alias("document_id"), F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("text")), ("idiot", "version"))


@query
def status_guard(spark, d):
    steps = ("draft", "reviewed", "published", "archived")
    n = F.col("o_orderkey")
    changes = views.table(spark, d, "orders").select(n.alias("id"), _pick(steps, n % 4).alias("before"), _pick(steps, F.col("o_custkey") % 4).alias("after"))
    return workflow.status_changes(changes, {"draft": ("reviewed",), "reviewed": ("draft", "published"), "published": ("archived",)})


@query
def review_totals(spark, d):
    items = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_quantity").cast("double").alias("awarded"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax").cast("double") * 100).alias("teacher"), F.lit(50.0).alias("max_marks"), _pick(("review", "answered", "noMatch"), F.col("l_partkey") % 3).alias("state"))
    return workflow.reviewed_totals(items)


@query
def json_salvage(spark, d):
    k = F.col("event_id")
    said = F.when(k % 4 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\ndone"))).when(k % 4 == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).when(k % 4 == 2, F.lit("none here")).otherwise(F.concat("props", F.lit("}")))
    return views.table(spark, d, "events").select("event_id", workflow.json_of(said).alias("json"))


@query
def retracted_nodes(spark, d):
    nodes = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("valid_until"))
    gone = views.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return graph.retract(nodes, gone, "2024-02-01")


@query
def candidate_concepts(spark, d):
    return views.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(X.candidates(F.col("text")), ",").alias("concepts"))


@query
def ordered_distinct(spark, d):
    return views.table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.array_join(F.array_distinct(X.tokens(F.col("text"))), " ").alias("words"))


@query
def bloom_votes(spark, d):
    levels = list(curriculum.BLOOM_VERBS.values())
    verbs = F.array(*(F.get(F.array(*(F.lit(v) for v in level)), (F.col("p_partkey") % len(level)).cast("int")) for level in levels))
    used = F.slice(verbs, (1 + F.col("p_size") % 5).cast("int"), F.lit(2))
    return views.table(spark, d, "part").select("p_partkey", curriculum.bloom_of(used).alias("bloom"))


@query
def paper_metrics(spark, d):
    return assessment.paper_metrics(suite.select_paper(spark, d), views.questions(spark, d))


@query
def fallback_paper(spark, d):
    suite._checkpoints(spark)
    bank = views.questions(spark, d)
    return assessment.select_paper(bank.where("chapter <= 'Brand#12'"), assessment.sections(80), {}, bank.where("chapter > 'Brand#12'")).select("section", "place", "id")


@query
def restricted_phrases(spark, d):
    chunks = views.chunks(spark, d)
    wanted = views.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return retrieval.phrase_hits(chunks.join(wanted, "document_id", "left_semi"), spark.createDataFrame([("and the",), ("of",)], "phrase string"))


@query
def nearest_words(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(1).alias("line"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("x"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber")).alias("word"), (F.col("l_linenumber") % 3 == 0).alias("dash"))
    return workflow.nearest(rows.where("dash"), rows.where("NOT dash"))


@query
def contained_concepts(spark, d):
    asked = views.table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.concat_ws(" ", "p_name", "p_type").alias("question"))
    concepts = views.table(spark, d, "part").where("p_partkey % 40 = 0").select(F.explode(F.array(F.element_at(F.split("p_name", " "), 1), F.lower("p_type"))).alias("concept")).distinct()
    return workflow.contained(asked, concepts)


@query
def term_synonyms(spark, d):
    words = views.table(spark, d, "part").select(F.explode(F.array("p_name", "p_type", F.element_at(F.split("p_name", " "), 1), F.lit("Energy"), F.lit("gas"), F.lit("bus"))).alias("term")).distinct()
    return words.select("term", F.array_join(workflow.synonyms(F.col("term")), ",").alias("synonyms"))


@query
def answer_schemes(spark, d):
    n = F.col("p_size")
    asked = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(n % 4 == 0, F.concat("p_name", F.lit(" (A) one (B) two "), "p_type")).otherwise(F.concat("p_name", F.lit(" and "), F.lower("p_type"), F.lit(" energy"))).alias("stem"), F.when(n % 5 == 0, "mcq").otherwise("short_answer").alias("type"), (n % 6).alias("marks"),
        F.when(n % 8 == 0, "B").when(n % 5 == 0, "C").alias("option"), F.when(n % 3 == 0, F.array(F.col("p_name"), F.lit(" "), F.col("p_type"))).alias("value_points"),
    )
    made = workflow.answer_schemes(asked)
    return made.select("id", "objective", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["keyword"], p["marks"], p["required"], F.array_join(p["synonyms"], "+"))), "|").alias("points"))
