"""File sources: a corpus of documents, JSON lines, syllabuses and marking schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions that are read.
EXTENSIONS = ("pdf", "docx", "doc", "txt", "md", "html", "htm", "json", "csv", "zip", "png", "jpg", "jpeg")
# What a file name says about its kind, the first that matches.
NAME_RULES = (
    (r"marking|scheme|answer\s*key", "marking_scheme"), (r"question\s*-?\s*paper|qp[-_\s]|questionpaper", "question_paper"), (r"model\s*answer|modelanswer", "model_answer"), (r"sample\s*paper|sop|sqp|samplequestion", "sample_paper"),
    (r"curriculum", "curriculum"), (r"syllabus", "syllabus"), (r"question\s*bank", "question_bank"), (r"circular", "circular"), (r"bye\s*law|byelaw", "bye_law"), (r"datesheet|date\s*sheet|time\s*table", "datesheet"),
    (r"notification|press\s*release", "notification"), (r"guideline", "guideline"), (r"reference\s*-?material", "reference_material"),
)
# Words in a name, and the hint that each gives.
HINTS = {"marking": "marking_scheme", "scheme": "marking_scheme", "question": "question_paper", "sample": "sample_paper", "curriculum": "curriculum", "syllabus": "syllabus", "circular": "circular", "byelaw": "bye_law", "model": "model_answer", "bank": "question_bank", "compartment": "compartment", "improvement": "improvement", "supplementary": "supplementary"}
# Phrases of question papers.
PAPER_WORDS = ("time allowed", "maximum marks", "general instructions", "section a", "section b", "this question paper", "compartment", "improvement")
# Subjects by their code in file names.
SUBJECT_CODES = {"086": "Science", "041": "Mathematics", "241": "Mathematics", "087": "Social Science", "184": "English", "101": "English"}


def kind_of_name(name: Column) -> Column:
    """Document kind by name; `unknown` if no rule matches."""
    out = F.lit(None).cast("string")
    for pattern, kind in NAME_RULES:
        out = F.when(out.isNull() & F.lower(name).rlike(pattern), kind).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def kind_of_text(name: Column, text: Column) -> Column:
    """Kind by name, else by the words of the first pages."""
    low = F.lower(text)
    paper = sum((F.contains(low, F.lit(w)).cast("int") for w in PAPER_WORDS), F.lit(0))
    has = lambda w: F.contains(low, F.lit(w))
    by_text = F.when(has("marking scheme") & (paper >= 2), "marking_scheme").when(paper >= 2, "question_paper").when(has("model answer"), "model_answer").when(has("curriculum") & (has("learning outcomes") | has("course content")), "curriculum").otherwise("unknown")
    named = kind_of_name(name)
    return F.when(named != "unknown", named).otherwise(by_text)


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every readable file below a folder: path, name, extension, size, hashes, source_id, kind, hints, year; `content` is read only where it is used.

    Hidden files, lock files and names of under 5 characters are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("name", name).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)))
    kept = named.where(F.col("extension").isin(*EXTENSIONS) & ~F.col("name").rlike(r"^(\.|~\$)") & (F.length("name") >= 5))
    low = F.lower("name")
    hints = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), h) for w, h in HINTS.items()]))
    return kept.select(
        "path", "name", "extension", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"), F.concat(F.lit("src:"), F.substring(F.sha2("content", 512), 1, 24)).alias("source_id"),
        kind_of_name(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")).alias("kind"), F.array_distinct(hints).alias("hints"), F.regexp_extract("name", r"(20[0-9]{2})", 1).alias("year"), "content",
    )


def problems(files: DataFrame, least_pdf: int = 2048) -> DataFrame:
    """The files with what is wrong with them; an empty list passes the gate."""
    head = F.decode(F.substring("content", 1, 512), "ISO-8859-1")
    magic = F.hex(F.substring("content", 1, 4))
    pdf, zip_ = F.col("extension") == "pdf", F.col("extension") == "zip"
    found = F.array_compact(F.array(
        F.when(F.col("size_bytes") < 16, "trivially small"), F.when(pdf & (F.col("size_bytes") < least_pdf), "small pdf"), F.when((pdf | zip_) & (F.col("size_bytes") < 4096) & F.lower(head).rlike("<html|<title>|error|not found|500|404"), "html error page"),
        F.when(pdf & (F.col("size_bytes") > 0) & (magic != "25504446"), "no pdf magic"), F.when(zip_ & (F.col("size_bytes") > 0) & (magic != "504B0304"), "no zip magic"),
        # a whole archive ends in a directory, whose record tells the number of its members
        F.when(zip_ & (magic == "504B0304") & ~F.hex("content").rlike("504B0506.{12}(?!0000)"), "no zip members"),
    ))
    return files.withColumn("problems", found)


def deduplicated(files: DataFrame) -> DataFrame:
    """The files with `duplicate_of`: the source of the first path with the same content, null for that one."""
    first = files.groupBy("sha256").agg(F.min("path").alias("__first"))
    return files.join(first, "sha256").withColumn("duplicate_of", F.when(F.col("path") != F.col("__first"), F.col("source_id"))).drop("__first")


def new_sources(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose source the ledger does not have yet."""
    return files.join(ledger.select("source_id"), "source_id", "left_anti")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; corrupt lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def question_key(question: Column) -> Column:
    """Key of a question's normalised text."""
    return F.substring(F.sha1(F.trim(F.regexp_replace(F.lower(question), r"\s+", " "))), 1, 16)


def latest_maps(maps: DataFrame, order: str) -> DataFrame:
    """One row for each question key: the first recorded."""
    keyed = maps.withColumn("key", question_key(F.col("question")))
    return keyed.groupBy("key").agg(F.min_by(F.struct(*maps.columns), order).alias("r")).select("key", "r.*")


SYLLABUS = "subject string, grade int, total_marks int, units array<struct<unit_no:int,name:string,marks:int,chapters:array<struct<id:string,name:string>>>>"


def syllabus(spark: SparkSession, path: str) -> DataFrame:
    """subject, grade, unit_no, unit, marks, chapter_id, chapter; a unit without chapters is its own chapter."""
    docs = spark.read.schema(SYLLABUS).option("multiLine", "true").json(path)
    units = docs.select("subject", "grade", F.explode("units").alias("u"))
    rows = units.select("subject", "grade", F.col("u.unit_no").alias("unit_no"), F.col("u.name").alias("unit"), F.col("u.marks").alias("marks"), F.explode_outer("u.chapters").alias("c"))
    own = F.concat(F.lit("unit-"), F.col("unit_no"))
    return rows.select("subject", "grade", "unit_no", "unit", "marks", F.coalesce("c.id", own).alias("chapter_id"), F.coalesce("c.name", "unit").alias("chapter"))


def subject_of_path(path: Column) -> Column:
    """Subject by its code in the path, else by a folder's name."""
    code = F.regexp_extract(path, r"[_\s/\\](" + "|".join(SUBJECT_CODES) + r")[_\s]", 1)
    pairs = F.create_map(*[x for k, v in SUBJECT_CODES.items() for x in (F.lit(k), F.lit(v))])
    low = F.lower(path)
    named = F.when(F.contains(low, F.lit("social science")), "Social Science").when(F.contains(low, F.lit("science")), "Science").when(F.contains(low, F.lit("math")), "Mathematics").when(F.contains(low, F.lit("english")), "English")
    return F.coalesce(F.try_element_at(pairs, code), named)


def grade_of_path(path: Column) -> Column:
    return F.when(path.rlike(r"(^|[/\\])XII([/\\_\s]|$)"), "XII").when(path.rlike(r"(^|[/\\])X([/\\_\s]|$)"), "X")


def paper_code(raw: Column) -> Column:
    """31/1/1 from any of 31/1/1, 31-1-1, 31 / 1 / 1; empty without one."""
    part = lambda i: F.regexp_extract(raw, r"\b([0-9]{2,3})\s*[/-]\s*([0-9])\s*[/-]\s*([0-9])\b", i)
    return F.when(part(1) != "", F.concat_ws("/", part(1), part(2), part(3))).otherwise("")


def answer_keys(pages: DataFrame) -> DataFrame:
    """path, paper_code, q_no, option from pages (path, page, text) of marking schemes.

    A page without a code has the last one before it; text before SECTION A is left out; the first answer of a question counts.
    """
    coded = pages.withColumn("code", F.when(paper_code(F.col("text")) != "", paper_code(F.col("text"))))
    carried = coded.withColumn("paper_code", F.last("code", ignorenulls=True).over(Window.partitionBy("path").orderBy("page")))
    body = F.regexp_replace("text", r"(?is)^.*?section\s*-?\s*a\b", "")
    found = carried.where("paper_code IS NOT NULL").select("path", "paper_code", "page", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?m)^\s*([0-9]{1,2}[.)]?\s+\(?[A-D]\)?)(?:\s|$)"), F.lit(1))).alias("pos", "m"))
    rows = found.select("path", "paper_code", F.struct("page", "pos").alias("at"), F.regexp_extract("m", "([0-9]{1,2})", 1).cast("int").alias("q_no"), F.regexp_extract("m", r"([A-D])\)?$", 1).alias("option"))
    return rows.where("q_no BETWEEN 1 AND 20").groupBy("path", "paper_code", "q_no").agg(F.min_by("option", "at").alias("option"))


def looked_up(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """Questions (subject, grade, paper_code, q_no) with the option of their key: the same grade before a key without one.

    Keys are collapsed first, so that a question meets two at most, one of its grade and one without, however many say the same.
    """
    k = keys.groupBy(F.col("subject").alias("__s"), F.col("grade").alias("__g"), F.col("paper_code").alias("__p"), F.col("q_no").alias("__q")).agg(F.max("option").alias("__o"))
    fits = (F.col("paper_code") == F.col("__p")) & (F.col("q_no") == F.col("__q")) & (F.col("subject") == F.col("__s")) & ((F.col("grade") == F.col("__g")) | (F.col("__g") == ""))
    joined = questions.join(k, fits, "left")
    return joined.groupBy(*questions.columns).agg(F.max_by("__o", F.struct(F.col("__g") != "", "__o")).alias("option"))


def fused(pages: DataFrame) -> DataFrame:
    """The best provider's pages of each document: confidence x mean quality x share of pages with 80 characters; a page under 0.5 takes another's if better.

    pages: document_id, provider, confidence, page, text, quality.
    """
    scores = pages.groupBy("document_id", "provider").agg((F.max("confidence") * F.avg("quality") * F.avg((F.length("text") >= 80).cast("double"))).alias("score"))
    best = scores.groupBy("document_id").agg(F.max_by("provider", F.struct("score", "provider")).alias("best"))
    by_page = pages.join(best, "document_id").groupBy("document_id", "best", "page").agg(
        F.max(F.when(F.col("provider") == F.col("best"), F.struct("quality", "provider", "text"))).alias("own"), F.max(F.struct("quality", "provider", "text")).alias("top")
    )
    use = F.when(F.col("own.quality") >= 0.5, F.col("own")).otherwise(F.col("top"))
    return by_page.select("document_id", "page", use["provider"].alias("provider"), use["text"].alias("text"), use["quality"].alias("quality"))


def admitted(uploads: DataFrame, ledger: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Uploads (source_id, extension, copyright_confirmed) with the gate's verdict: unsupported type, copyright not confirmed, duplicate of a source in the ledger or of a lesser upload, or accepted."""
    known = ledger.select("source_id", F.lit(True).alias("known")).distinct()
    again = F.row_number().over(Window.partitionBy("source_id").orderBy("upload_id")) > 1
    verdict = F.when(~F.lower("extension").isin(*extensions), "unsupported type").when(~F.coalesce("copyright_confirmed", F.lit(False)), "copyright not confirmed").when(F.coalesce("known", F.lit(False)) | again, "duplicate").otherwise("accepted")
    return uploads.join(known, "source_id", "left").withColumn("verdict", verdict).drop("known")
