import pytest
from pyspark.sql import functions as F

from scholia.functions import notation

CASES = [
    ("Zn + H2SO4 --> ZnSO4 + H2, a reaction", "Zn + H₂SO₄  →  ZnSO₄ + H₂, a reaction"),
    ("2CH3COOH and (CH3COO)2 are a base and an acid", "2CH₃COOH and (CH₃COO)₂ are a base and an acid"),
    ("N2 + 3H2 <=> 2NH3 gas", "N₂ + 3H₂  ⇌  2NH₃ gas"),
    ("the ion Na+ and Cl-, H + ions", "the ion Na⁺ and Cl⁻, H⁺ ions"),
    ("speed 3 × 10 8 m/s", "speed 3 × 10⁸ m/s"),
    ("charge 1.6 10 –19 C", "charge 1.6 10⁻¹⁹ C"),
    ("area 5 cm2 and s-1 of m1", "area 5 cm² and s⁻¹ of m1"),
    ("the refractive index of glass is 3 4", "the refractive index of glass is ¾"),
    ("probability is 2 7 here, ratio 3 2", "probability is 2/7 here, ratio 3 2"),
    ("the cost is 2 3 rupees, CONCAVE, No CO", "the cost is 2 3 rupees, CONCAVE, No CO"),
    ("a solution of Fe3+, Ca2+ and SO4-.", "a solution of Fe³⁺, Ca²⁺ and SO₄⁻."),
    ("  two\nlines of CaCO3\n", "  two\nlines of CaCO₃\n"),
    ("3x10 8 and 10 -9 N, 10 6 Hz", "3 × 10⁸ and 10⁻⁹ N, 10⁶ Hz"),
    ("ratio = 1 2 3, odds 1 2", "ratio = 1 2 3, odds 1 2"),
    ("x -> y, a - b, Na + Cl", "x -> y, a - b, Na + Cl"),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def restored(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, t string")
    return {r.i: r.out for r in df.select("i", notation.restored(F.col("t")).alias("out")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_restored(restored, i):
    assert restored[i] == CASES[i][1]


def test_expression_stays_small():
    """Steps are named once: the input stands in the expression only a few times."""
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is not None
    assert str(notation.restored(F.col("a_column_name"))).count("a_column_name") <= 5
