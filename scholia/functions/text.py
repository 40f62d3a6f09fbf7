"""Column functions on texts: tokens, predicates and metrics. Patterns use explicit classes, which Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in near-duplicate comparison, and in queries.
CONTENT_STOP = ("the", "a", "an", "of", "in", "is", "are", "to", "and", "or", "for", "on", "at", "it", "its", "this", "that", "which", "with", "from", "by", "as", "be", "following")
QUERY_STOP = ("the", "a", "an", "of", "in", "for", "on", "what", "how", "why", "is", "are", "to", "and", "or", "explain", "define", "list", "state", "describe")
# Phrases that mean that the answer is in a picture.
FIGURE = ("shown in option", "in the given figure", "in the figure given", "given diagram", "following diagram", "figure shown", "in the diagram", "shown in the graph", "given circuit", "following circuit diagram", "in the given map", "given table", "following table", "shown below")
# Phrases that stand for a blank answer.
BLANK = ("not attempted", "no answer", "blank", "skipped", "n/a", "na", "-", "none")
# What Python splits words and lines at.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    """The distinct content words: a letter, then letters, digits or hyphens."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9-]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*CONTENT_STOP)))


def normalized(text: Column) -> Column:
    """Lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\r\\f\\x0B]+", " "))


def keywords(text: Column, n: int = 5) -> Column:
    return F.slice(F.filter(tokens(text), lambda t: ~t.isin(*QUERY_STOP)), 1, n)


# Words of a query that name no concept.
NO_CONCEPT = ("the", "and", "for", "with", "what", "how", "why", "when", "which", "explain", "define", "list", "state", "describe", "marks", "class", "question", "paper", "section", "part", "difference", "between")


def candidates(text: Column, n: int = 5) -> Column:
    """Words of three or more characters that may name a concept, in order, as they stand."""
    return F.slice(F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9-]{2,})"), F.lit(1)), lambda t: ~F.lower(t).isin(*NO_CONCEPT)), 1, n)


def holds_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def needs_figure(text: Column) -> Column:
    low = F.lower(text)
    options = F.contains(low, F.lit("(a)")) & F.contains(low, F.lit("(b)")) & F.contains(low, F.lit("(c)"))
    return holds_any(low, FIGURE) & ~options


def truncated(text: Column) -> Column:
    """Promises options or goes on after a colon, without any."""
    options = F.contains(text, F.lit("(A)")) | (F.contains(text, F.lit("(a)")) & F.contains(text, F.lit("(b)")))
    promise = F.lower(text).rlike("(^|[^a-z0-9_])(select the correct option|which (one )?of the following|the correct (option|answer)|choose the correct|from the following *:|the appropriate term)")
    dangling = F.lower(text).rlike("(is|are|following|respectively|option|options|correct|statement|statements) *[:-] *$")
    return ~options & (promise | dangling)


def broken_options(text: Column) -> Column:
    """An option letter without all the letters before it; or of two or more, one with nothing behind it."""
    low = F.lower(text)
    has = [F.contains(low, F.lit(f"({c})")) for c in "abcd"]
    bodies = F.split(text, "[(][a-dA-D][)]")
    empty = (F.size(bodies) > 2) & F.exists(F.slice(bodies, 2, F.greatest(F.size(bodies), F.lit(1))), lambda x: F.length(F.btrim(x, F.lit(" .:;"))) < 2)
    return (has[3] & ~(has[0] & has[1] & has[2])) | (has[2] & ~(has[0] & has[1])) | (has[1] & ~has[0]) | empty


def broken_fractions(raw: Column) -> Column:
    """Options, and two or more lines of a bare number: numerators and denominators without their bars."""
    bare = F.filter(F.split(raw, LINE_END), lambda x: x.rlike(rf"^{SPACE}*\p{{Nd}}{{1,3}}{SPACE}*\z"))
    return F.contains(F.lower(raw), F.lit("(a)")) & (F.size(bare) >= 2)


def share(text: Column, pattern: str) -> Column:
    """Share of characters that a one-character class matches."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def mangled(text: Column) -> Column:
    """A text in a legacy font: too much noise, too many sigils or words with $ { } | in its first 600 characters; or none at all."""
    head = F.substring(text, 1, 600)
    parts = F.filter(F.split(head, f"{SPACE}+"), lambda x: x != "")
    odd = F.size(F.filter(parts, lambda x: x.rlike("[${}|]"))) > 0.08 * F.size(parts)
    return (F.length(text) == 0) | (share(head, "[^A-Za-z0-9 .,;:'\"()\\[\\]/\\-–—+=%°?!*&#\\n\\t→×÷±≤≥√∞²³]") > 0.15) | (share(head, "[${}|~^\\\\`©¡«»¥¤§¨ª¬¯µ¶·¸¹º½¾]") > 0.03) | odd


def non_latin(text: Column) -> Column:
    """More than 30 % of the letters above U+02FF."""
    return share(F.regexp_replace(text, r"\P{L}", ""), r"[^\x{0}-\x{2FF}]") > 0.3


def clean_label(label: Column) -> Column:
    """Two or more of A-Z, a-z, 0-9, space, point and hyphen, not digits and marks only."""
    ascii = label.rlike(r"^[A-Za-z0-9 .-]+\z") & ~label.rlike(r"^[0-9. -]+\z")
    return F.coalesce((F.length(F.trim(label)) >= 2) & ascii, F.lit(False))


def ocr_flags(text: Column) -> Column:
    """What points to a wrong transcription."""
    return F.array_compact(F.array(F.when(text.rlike("(^|[^0-9A-Za-z_])[0-9]{5,}($|[^0-9A-Za-z_])"), "fused_number"), F.when(F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))) > 2, "unresolved"), F.when(non_latin(text), "mixed_script")))


def cleaned(text: Column) -> Column:
    """A question without page furniture: star marks, bare numbers, P.T.O., paper codes, leading numbers, section banners, trailing marks; the first of inner alternatives."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike("[*][A-Za-z0-9/-]+[*]") & ~x.rlike("^[0-9]{1,3}$") & ~F.upper(x).rlike("^P[.]? ?T[.]? ?O[.]? ?[.]?$"))
    out = F.array_join(kept, " ")
    for pattern, into in ((r"[0-9]{2,3}/[0-9]{1,2}/[0-9]{1,2}", " "), (r"^ *[0-9]{1,3} *[.)\]] *", ""), (r" *SECTION *-? *[A-EIVX]( .*)?$", ""), (r" +[0-9]{0,2} *OR +.*$", ""), (r" +[0-9]{1,2} *$", "")):
        out = F.regexp_replace(out, pattern, into)
    return F.trim(F.regexp_replace(out, " +", " "))


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: (n + F.least(count(a, t), count(b, t))).cast("int"))


def token_f1(reference: Column, candidate: Column) -> Column:
    a, b = tokens(reference), tokens(candidate)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * common_tokens(a, b) / both)


def bleu1(reference: Column, candidate: Column) -> Column:
    a, b = tokens(reference), tokens(candidate)
    n, m = F.size(b), F.size(a)
    p = common_tokens(a, b) / n
    return F.when(n == 0, 0.0).when(m == 0, 1.0).otherwise(F.when(n < m, F.exp(1 - m / n)).otherwise(1.0) * p)


def exact_match(reference: Column, candidate: Column) -> Column:
    return (normalized(reference) == normalized(candidate)).cast("double")


def lcs_f1(reference: Column, candidate: Column) -> Column:
    """ROUGE-L by the longest common subsequence of tokens, one row of the table at a time."""
    a, b = tokens(reference), tokens(candidate)
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(prev: Column, t: Column) -> Column:
        best = lambda out, i: F.concat(out, F.array(F.greatest(F.when(F.element_at(b, i) == t, F.element_at(prev, i) + 1).otherwise(0), F.element_at(prev, i + 1), F.element_at(out, -1))))
        return F.when(F.size(b) == 0, prev).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0)), best))

    n = F.element_at(F.aggregate(a, start, row), -1)
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * n / both)


def groundedness(answer: Column, evidence: Column) -> Column:
    """Share of an answer's sentences of over 4 characters that stand in the evidence; ones under 8 count as found."""
    sentences = F.filter(F.transform(F.split(F.lower(answer), "[.!?\\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 4)
    found = F.filter(sentences, lambda x: (F.length(x) < 8) | F.contains(F.lower(evidence), x))
    return F.when(F.size(sentences) > 0, F.size(found) / F.size(sentences)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)
