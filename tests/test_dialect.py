"""Search patterns mean what they mean in the linear-time dialect; those that it does not know are refused before any job."""

import duckdb
import pytest

from linkgraph.functions.dialect import to_java
from linkgraph.functions.idgrammar import natural_key, natural_key_of
from linkgraph.operators import text as T

TEXTS = ["a", "A", "ab", "abc", "b", "alpha", "1", "a1", "-", "]", "a-b", "x y", "x\ty", "x\x0by", "ünder", "foo", "foobar", "a.b", "axb", "Ä", "ä", "a\r", "{", "a{x", "aa", "aaa", "^a$", "\\", "[", "&&", "Ω", "ω", "é", "_", "K", "ſ", " ", ":"]
PATTERNS = [
    "(?P<n>a)b", "(?P<one>a)(?P<two_b>b)", "[[:alpha:]]", "[[:^alpha:]]", "^[[:punct:]]$", "[^[:^digit:]a-z]", r"\bfoo\b", r"a\B", "a{2,3}", "a{2,}?", "a{x", "^a$", "(?m)^a$", r"[\d\-\]]", r"\Qa.b\E", "(?-i)A", "(?i:a)b",
    "[]a]", r"\pL", r"\p{Lu}", r"\P{L}", r"\p{Greek}", r"\p{^Greek}", "(?s:a.b)", "a.", "[&]+", "[a-c&&b]", r"\x41", r"\x{3a9}", r"[\x41-\x43]", r"\s", r"\S\s\S", r"\w", r"[^\W]", r"\v", "a|b|", "()", r"\.", "[[]", "[^a]", r"\d+", "(a|b)*c", r"\101", "k", "(?U)a+", r"\t", "$", "x*",
]
FAULTY = ["(", "a)", "*a", "a**", "a*+", "a{2}{3}", r"\1", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", "(?#x)", "[a", "[z-a]", "a{1001}", "a{3,2}", "[[:foo:]]", r"\Z", r"\R", "(?P<a>x)(?P<a>y)", "(?P<>a)", "\\", r"\p{", r"\x{zz}", "(?x)a", "[a-\\d]"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_as_the_other_engine_reads_them(spark, pattern):
    con = duckdb.connect()
    want = {t for t in TEXTS if con.execute("SELECT regexp_matches(?, ?)", [t, f"(?i){pattern}"]).fetchone()[0]}
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert {r.text for r in T.search(rows, pattern).collect()} == want


@pytest.mark.parametrize("pattern", FAULTY)
def test_faulty_patterns(pattern):
    with pytest.raises(ValueError, match="."):
        to_java(pattern)


def test_long_numbers_in_natural_order(spark):
    ids = ["R-9", "R-10", "R-010", "R-1", f"R-{'9' * 24}", f"R-1{'0' * 24}", "R-1.2", "R-1.10", "R", "Q-5", "R-00"]
    got = [r.id for r in spark.createDataFrame([(i,) for i in ids], "id string").orderBy(natural_key("id"), "id").collect()]
    assert got == sorted(ids, key=lambda i: (natural_key_of(i), i))
    assert got.index(f"R-{'9' * 24}") < got.index(f"R-1{'0' * 24}") and got.index("R-9") < got.index("R-10")
