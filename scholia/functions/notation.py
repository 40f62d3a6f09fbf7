"""Notation that plain text has lost: subscripts, exponents, charges, arrows and fractions, as one column function.

A text becomes tokens with the space behind each: words of letters and digits, arrows, and single other characters. What a token is (a formula, a unit, a number, a sign) it
tells by itself; whether its digits are raised or lowered is decided by its neighbours in the list of tokens. Then the tokens are
joined again. Each step of it is named once, so the expression stays small whatever the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chemical symbols that formulas are made of.
ELEMENTS = (
    "Ag", "Al", "Ar", "As", "Au", "B", "Ba", "Be", "Bi", "Br", "C", "Ca", "Cd", "Cl", "Co", "Cr", "Cs", "Cu", "F", "Fe", "Ga", "Ge", "H", "He", "Hg", "I", "Ir", "K", "Kr", "Li", "Mg", "Mn", "N", "Na", "Nb", "Ne",
    "Ni", "O", "Os", "P", "Pb", "Pd", "Pt", "Ra", "Rb", "Rh", "S", "Sb", "Sc", "Se", "Si", "Sn", "Sr", "Ta", "Th", "Ti", "U", "Ur", "V", "Va", "W", "Xe", "Y", "Zn", "Zr",
)
# Elements whose molecules are of one element, and their numbers of atoms.
MOLECULES, ATOMS = ("H", "O", "N", "Cl", "Br", "I", "F", "P", "S"), "2348"
# Beginnings of words that make a text one about chemistry.
CHEMISTRY = (
    "acid", "alcohol", "base", "carbonate", "chemical", "chloride", "combust", "compound", "electrolys", "element", "equation", "ester", "gas", "hydroxide", "ion", "metal", "mole", "molecul", "nitrate", "oxide", "precipitat",
    "reaction", "salt", "solution", "sulphate", "sulphuric",
)
# Units that take exponents, names that look like one, and units behind a power of ten.
UNITS = ("J", "K", "L", "N", "V", "W", "cm", "dm", "g", "kg", "km", "m", "mm", "mol", "ms", "s", "Ω")
NAMES = ("g1", "m1", "s1")
MEASURED = ("Hz", "J", "K", "N", "W", "cm", "g", "kg", "km", "m", "mm", "s")
# Words before a fraction, and fractions with a character of their own: numerator, denominator, character.
RATIOS = ("fraction", "index", "indices", "probability", "ratio")
FRACTIONS = ((1, 2, "½"), (1, 3, "⅓"), (2, 3, "⅔"), (1, 4, "¼"), (3, 4, "¾"), (1, 5, "⅕"), (2, 5, "⅖"), (3, 5, "⅗"), (1, 8, "⅛"), (3, 8, "⅜"), (5, 8, "⅝"), (1, 6, "⅙"))

BELOW, ABOVE = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"
TOKEN = r"([0-9]+(?=x10\b)|x(?=10\b)|[\p{L}\p{Nd}Ω]+|<\s*[-=]+\s*>|[-=]{2,}>|[^\s\p{L}\p{Nd}Ω])(\s*)"


def _one_of(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _kinds(word: Column) -> Column:
    """A token with what it is by itself. symbol: one element, with its digits."""
    is_ = lambda pattern: word.rlike(f"^(?:{pattern})$")
    symbols = _one_of(ELEMENTS)
    return F.struct(
        word.alias("w"),
        is_(rf"[0-9]*(?:(?:{symbols})[0-9]*){{2,}}").alias("formula"),
        is_(rf"[0-9]*(?:{_one_of(MOLECULES)})[{ATOMS}]").alias("molecule"),
        is_("[A-Z][a-z]?[0-9]*").alias("symbol"),
        is_("[0-9]+").alias("number"),
        is_("[+−–-]").alias("sign"),
        is_(_one_of(UNITS)).alias("unit"),
        (is_(rf"(?:{_one_of(UNITS)})[0-9]") & ~F.lower(word).isin(*NAMES)).alias("powered"),
    )


def _digits(word: Column, into: str) -> Column:
    """A word with the digits behind its first letter translated: a coefficient stays."""
    return _let(F.regexp_extract(word, "^[0-9]*", 0), lambda n: F.concat(n, F.translate(F.substr(word, F.length(n) + 1), "0123456789", into)))


def _raised(word: Column) -> Column:
    return F.translate(word, "0123456789+−–-", ABOVE + "⁺⁻⁻⁻")


def _fraction(a: Column, b: Column) -> Column:
    out = F.concat(a, F.lit("/"), b)
    for n, d, sign in FRACTIONS:
        out = F.when((a == str(n)) & (b == str(d)), sign).otherwise(out)
    return out


def _token(t: Column, i: Column, about: Column, lowered: Column) -> Column:
    """The i-th token as it is printed, with the space behind it."""
    at = lambda k: F.get(t, i + k)
    has = lambda k, field: F.coalesce(at(k)[field], F.lit(False))
    word = lambda k: F.coalesce(at(k)["w"], F.lit(""))
    gap = lambda k: F.coalesce(at(k)["g"], F.lit(""))
    apart = lambda k: gap(k) != ""
    short = lambda k, n: has(k, "number") & (F.length(word(k)) <= n)

    # a sign on the word before it: attached, with nothing but an end behind it, or apart from it before the word ion
    carries = lambda k: has(k, "symbol") | has(k, "formula")
    attached = lambda k: about & has(k, "sign") & carries(k - 1) & ~apart(k - 1) & (apart(k) | (word(k + 1) == "") | word(k + 1).isin(",", ".", ")"))
    spaced = lambda k: about & has(k, "sign") & (word(k) != "-") & has(k - 1, "symbol") & apart(k - 1) & apart(k) & F.lower(word(k + 1)).isin("ion", "ions")
    # ten to a power: k is the exponent, behind a factor, before a unit, or with a sign
    ten = lambda k: (word(k) == "10")
    factor = lambda k: short(k, 3) & ten(k - 1) & apart(k - 1) & word(k - 2).isin("×", "x") & has(k - 3, "number")
    measured = lambda k: short(k, 3) & ten(k - 1) & apart(k - 1) & word(k + 1).isin(*MEASURED)
    signed = lambda k: short(k, 3) & has(k - 1, "sign") & (word(k - 1) != "+") & ten(k - 2)
    power = lambda k: factor(k) | measured(k) | signed(k)
    # the exponent of a unit, with or without a sign
    exponent = lambda k: short(k, 1) & ((has(k - 1, "unit") & ~F.lower(F.concat(word(k - 1), word(k))).isin(*NAMES)) | ((word(k - 1) == "-") & ~apart(k - 1) & has(k - 2, "unit")))
    # two numbers for one: k is the numerator
    before = lambda k: F.lower(word(k)).isin(*RATIOS)
    told = lambda k: before(k - 1) | ((F.lower(word(k - 2)) == "of") & before(k - 3))
    ratio = lambda k: short(k, 1) & short(k + 1, 1) & apart(k) & (word(k) < word(k + 1)) & ~has(k + 2, "number") & (told(k) | (F.lower(word(k - 1)).isin("is", "are", "=") & told(k - 1)))

    glued = attached(1) | spaced(1)
    moved = power(0) | exponent(0)
    text = (
        F.when(word(0).rlike("^<.*>$"), " ⇌ ")
        .when(word(0).rlike("^[-=]+>$"), " → ")
        .when(ratio(0), _fraction(word(0), word(1)))
        .when(ratio(-1), "")
        .when(attached(0) | spaced(0) | moved | ((word(0) == "-") & ~apart(0) & exponent(1)) | (has(0, "sign") & signed(1)), _raised(word(0)))
        .when((word(0) == "x") & factor(2), "×")
        .when(glued & word(0).rlike("^[A-Z][a-z]?[0-9]$") & ~has(0, "molecule"), _digits(word(0), ABOVE))  # the number of a charge
        .when(has(0, "formula") | (lowered & has(0, "molecule")), _digits(word(0), BELOW))
        .when(lowered & has(0, "number") & (word(-1) == ")") & ~apart(-1), _digits(F.concat(F.lit("x"), word(0)), BELOW).substr(F.lit(2), F.length(word(0))))
        .when(has(0, "powered"), F.concat(F.regexp_extract(word(0), "^[^0-9]*", 0), _raised(F.regexp_extract(word(0), "[0-9]$", 0))))
        .otherwise(word(0))
    )
    closes = spaced(1) | power(1) | (ten(0) & has(1, "sign") & signed(2)) | (has(0, "sign") & signed(1)) | exponent(1) | ratio(-1)
    opens = ((word(0).isin("×", "x")) & factor(2)) | factor(3) | measured(0)
    space = F.when(ratio(0), gap(1)).when(ratio(-1), "").when(opens, " ").when(closes, "").otherwise(gap(0))
    return F.concat(text, space)


def restored(text: Column) -> Column:
    """The text with its notation: null stays null, and what has only one reading is changed, all else stays as it is.

    Arrows of two or more strokes; subscripts of formulas (two or more symbols), and in a text about chemistry or beside another formula of molecules and groups in
    parentheses; charges of ions in a text about chemistry, where one digit behind a single symbol counts as the charge's number (Fe3+ is Fe³⁺); exponents of ten
    and of units; proper fractions behind a word such as ratio.
    """
    words, gaps = (F.regexp_extract_all(text, F.lit(TOKEN), F.lit(k)) for k in (1, 2))
    listed = F.zip_with(words, gaps, lambda w, g: _let(_kinds(w), lambda k: F.struct(*(k[f].alias(f) for f in ("w", "formula", "molecule", "symbol", "number", "sign", "unit", "powered")), g.alias("g"))))
    chemistry = text.rlike(rf"(?i)\b(?:{_one_of(CHEMISTRY)})")

    def printed(t: Column) -> Column:
        # subscripts of 2 or 3 in a formula make the molecules beside it formulas too
        shown = F.exists(t, lambda x: x["formula"] & x["w"].rlike("[A-Za-z)][0-9]*[23]"))
        flags = F.struct(chemistry.alias("about"), (chemistry | shown).alias("lowered"))
        return _let(flags, lambda f: F.array_join(F.transform(t, lambda _, i: _token(t, i, f["about"], f["lowered"])), ""))

    return F.concat(F.regexp_extract(text, r"^\s*", 0), _let(listed, printed))
