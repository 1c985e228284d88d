"""Points in intervals, sums over what stands before, and many aliases at once, against plain loops."""

import random
import re

import regex
from pyspark.sql import functions as F

from linkgraph.operators import intervals
from linkgraph.operators import text as T
from linkgraph.operators.prefix import running


def test_blocks_cover_an_interval_once(spark):
    spans = [(a, b) for a in range(20) for b in range(a - 2, 40, 3) if b >= 0] + [(2**40 - 3, 2**40 + 5)]
    rows = intervals.blocks(spark.createDataFrame(spans, "low long, high long")).collect()
    for a, b in spans:
        own = sorted(n for r in rows if (r.low, r.high) == (a, b) for n in range(r.block << r.level, (r.block + 1) << r.level))
        assert own == list(range(a, b + 1))


def test_least_value_of_the_intervals_around_a_point(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.randrange(0, 60), f"p{rng.randrange(900):03}") for a in (rng.randrange(500) for _ in range(80))]
    points = [(n, f"x{n}") for n in range(600)]
    got = {r.n: r.value for r in intervals.stabbed(spark.createDataFrame(points, "n long, id string"), spark.createDataFrame(spans, "low long, high long, value string")).collect()}
    want = {n: min(v for a, b, v in spans if a < n < b) for n, _ in points if any(a < n < b for a, b, _ in spans)}
    assert got == want


def test_many_points_and_intervals_make_no_pairs(spark):
    points = spark.range(100_000).select(F.col("id").alias("n"))
    spans = spark.range(100_000).select((F.col("id") % 1000).alias("low"), (F.lit(100_000) - F.col("id") % 777).alias("high"), F.format_string("p%06d", "id").alias("value"))
    found = intervals.stabbed(points, spans)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    (r,) = found.agg(F.count("*").alias("n"), F.min("value").alias("least")).collect()
    assert (r.n, r.least) == (99_999, "p000000")


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), k, rng.randrange(5)) for k in range(500)] + [(None, 1, 7), (None, 2, 1)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = {(r.g, r.k): r.before for r in running(df, ["g"], ["k"], "v").collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
    total = {r.k: r.before for r in running(df.where("g = 'b'"), [], ["k"], "v").collect()}
    assert total == {k: b for (g, k), b in got.items() if g == "b"}


def stands(text, alias):
    """By look-around, one pattern an alias."""
    kinds = ("[0-9A-Za-z_]", r"\p{Han}", r"[\p{Katakana}ー]")
    before, after = (next((k for k in kinds if regex.match(k, c)), None) for c in (alias[0], alias[-1]))
    return bool(regex.search((f"(?<!{before})" if before else "") + re.escape(alias) + (f"(?!{after})" if after else ""), text))


def test_aliases_against_one_pattern_each(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abA_1 -漢字カー ひ."
    aliases = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None]
    rows = spark.createDataFrame([*enumerate(texts)], "line int, text string")
    named = spark.createDataFrame([(a,) for a in aliases] + [("",)], "alias string")
    want = sorted((i, a) for i, t in enumerate(texts) for a in aliases if t and stands(t, a))
    assert sorted((r.line, r.alias) for r in T.alias_hits(rows, named).collect()) == want
    monkeypatch.setattr(T, "SENT", 40)  # in parts
    assert sorted((r.line, r.alias) for r in T.alias_hits(rows, named).collect()) == want
    assert T.alias_hits(rows, named.limit(0)).collect() == []


def test_five_thousand_aliases_are_one_pass(spark):
    rows = spark.createDataFrame([(1, "word77 and word4999, word12x")], "line int, text string")
    found = T.alias_hits(rows, spark.range(5000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("alias")))
    assert len(found._jdf.queryExecution().toString()) < 20_000
    assert sorted(r.alias for r in found.collect()) == ["word4999", "word77"]
