from pyspark.sql import functions as F

from ledgerlens import functions as fn


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr).first()[0]


def test_money(spark):
    cases = {"$1,234.50": 1234.5, " 12 ": 12.0, "NA": None, "N/A": None, ".": None, "": None, "-3.5x": -3.5, "abc": None}
    got = {v: one(spark, v, fn.money("v")) for v in cases}
    assert got == cases
    assert [one(spark, v, fn.price("v")) for v in ('"1,200.00"', "-", "-5")] == [1200.0, None, None]


def test_severity_and_dispute_thresholds(spark):
    rows = spark.createDataFrame([(m,) for m in (0.5, 1.0, 2.0, 2.1, 5.0, 5.1, 10.0, 11.0, 100.0, None)], "m double")
    got = [r[0] for r in rows.select(fn.severity("m")).collect()]
    assert got == ["low", "low", "low", "medium", "medium", "high", "high", "extreme", "extreme", None]
    d = spark.createDataFrame([("exact_code_only", "pfs", 2.6), ("exact_code_only", "pfs", 1.6), ("exact_code_only", "asp", 2.6), ("unmatched", "none", 9.0)], "mode string, s string, m double")
    assert [r[0] for r in d.select(fn.dispute_strength("mode", "s", "m")).collect()] == ["strong", "moderate", "moderate", None]


def test_codes(spark):
    d = spark.createDataFrame([("36415",), ("80053",), ("0202U",), ("J1100",), ("8002F",), ("12001",)], "c string")
    got = [tuple(r) for r in d.select(fn.is_lab("c"), fn.is_drug("c"), fn.is_surgical("c"), fn.is_wound_repair("c"), fn.number_prefix("c")).collect()]
    assert got == [(True, False, True, False, 36415), (True, False, False, False, 80053), (True, False, False, False, 202), (False, True, False, False, None), (False, False, False, False, 8002), (False, False, True, True, 12001)]


def test_names_and_dates(spark):
    assert one(spark, "3/7/24", fn.iso_date("v")) == "2024-03-07"
    assert one(spark, "12-25-2023", fn.iso_date("v")) == "2023-12-25"
    assert one(spark, "2024-01-02", fn.iso_date("v")) == "2024-01-02"
    assert one(spark, "The Mercy Hospital", fn.name_similarity(fn.plain_name("v"), F.lit("mercy"))) == 1.0
    assert one(spark, "mer zz", fn.name_similarity(F.col("v"), F.lit("mercy east"))) == 0.4


def test_money_text(spark):
    rows = spark.createDataFrame([(1234.5,), (0.0,), (-1234567.891,), (None,)], "v double")
    assert [r[0] for r in rows.select(fn.money_text("v")).collect()] == ["$1,234.50", "$0.00", "$-1,234,567.89", None]


def test_join_by_the_rarest_substring(spark):
    """Against all pairs: strings shorter than a gram, wildcards, repeats, signs, case."""
    from ledgerlens.operators.matching import join_holding

    texts = ["abc def", "ABCDEF", "a%b", "x", "", None, "aaaa", "abab ab", "the mercy hospital", "mercy", "é ü"]
    parts = ["abc", "ab", "a", "%", "mercy", "aaa", "zzz", "é", "mercy h", "abab"]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, said string")
    a = spark.createDataFrame([(p,) for p in parts], "p string")
    got = {(r.p, r.k) for r in join_holding(a, F.array("p"), t, F.col("said"), least=1).collect()}
    assert got == {(p, k) for p in parts for k, x in enumerate(texts) if x is not None and p in x.lower()}
    two = spark.createDataFrame([(p, q) for p in parts for q in parts if len(p) > 2 and len(q) > 2], "p string, q string")
    got = {(r.p, r.q, r.k) for r in join_holding(two, F.array("p", "q"), t, F.col("said")).collect()}
    assert got == {(p, q, k) for p in parts for q in parts for k, x in enumerate(texts) if x is not None and len(p) > 2 and len(q) > 2 and p in x.lower() and q in x.lower()}


def test_money_and_prices_are_read_in_one_pass(spark):
    """One replacement and one extraction a value; -0 stays a price, negative numbers don't."""
    texts = ["$1,234.50", " 5 ", "-5", "-0.00", "-0.05", "-", " - ", "", ".", "NA", "n/a", "12 MG", '"$7"', "-0", "-00.5", ".5", "-.0", "x1", None]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", fn.money("t").alias("m"), fn.price("t").alias("p")).orderBy("k")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    rows = d.collect()
    assert [r.m for r in rows] == [1234.5, 5, -5, 0, -0.05, None, None, None, None, None, None, 12, None, 0, -0.5, 0.5, 0, None, None]
    assert [r.p for r in rows] == [1234.5, 5, None, 0, None, None, None, None, None, None, None, 12, 7, 0, None, 0.5, 0, None, None]
