"""Stored steps, and the joins that replaced all pairs: against brute force, on skewed keys, and what they leave behind."""

import os
import random
import re
import time

from pyspark.sql import functions as F

from ledgerlens.operators import audit, descriptions, extraction, insurance, matching, prices
from ledgerlens.plans import bindings, registry
from ledgerlens.plans.bindings import Tables
from ledgerlens.plans.rates import found, placed, stored_found
from ledgerlens.sources.steps import Steps, shared_folder

FOLDER = "/root/testdata/sf0.001"


def left_in(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {f"{d}/{f}" for d, _, files in os.walk(folder) for f in files if "/steps-" in d and f.endswith(".parquet")}


def test_steps_are_built_once_and_go(spark):
    before, built = left_in(spark), []

    def build():
        built.append(1)
        return spark.range(1000).withColumn("k", F.col("id") % 7)

    with Steps(spark) as steps:
        for _ in range(3):
            assert steps.keep("a", build, "k").count() == 1000 and steps.keep("b", build).count() == 1000
        assert len(built) == 2 and left_in(spark) > before
        by = steps.keep("a", build, "k").groupBy("k").count()
        assert by.count() == 7 and "Exchange hashpartitioning" not in by._jdf.queryExecution().executedPlan().toString()
    assert left_in(spark) == before


def test_a_context_deletes_a_query_s_steps(spark):
    before = left_in(spark)
    with Tables(spark, FOLDER) as t:
        assert stored_found(t).count() == placed(t).count() == 6000
    assert left_in(spark) == before


def test_savings_summary_reads_steps_only(spark):
    """A22 reads findings, lines and the rate card from steps; each given table is scanned at most twice besides."""
    plan = registry.QUERIES["a22_savings_summary"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"InMemoryFileIndex\(\d+ paths?\)\[file:[^\]]*/(\w+)\.parquet", plan)
    assert scans and all(scans.count(n) <= 2 for n in set(scans)), scans
    assert plan.count("FileScan") < 20 and "NestedLoop" not in plan
    plan = registry.QUERIES["t06_resolved_lines"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 20


def brute_line(found, eob):
    out = {}
    for bill, line, code, said in found:
        near = [(n, a) for b, n, c, a, d in eob if b == bill and ((code is not None and c == code) or (d is not None and said is not None and said[:10].lower() in d.lower()))]
        if near:
            out[bill, line] = min(near, key=lambda x: x[0])
    return out


def test_line_for_finding_against_all_pairs(spark):
    rng = random.Random(2)
    said = ["Blood draw and panel", "blood", "", None, "X-ray chest two views", "x-ray", "Lab é test of blood", "A"]
    found = [(b, n, rng.choice(["1", "2", "3", None]), rng.choice(said)) for b in range(12) for n in range(8)]
    eob = [(b, n, rng.choice(["2", "3", "9", None]), rng.choice([None, 1.5, 2.0]), rng.choice([*said, "the blood draw and panel B", "chest X-RAY CHEST TWO"])) for b in range(12) for n in range(6)]
    f = spark.createDataFrame(found, "bill_id int, line_number int, code string, description string")
    e = spark.createDataFrame(eob, "bill_id int, line_number int, code string, allowed_amount double, description string")
    got = {(r.bill_id, r.line_number): (r.eob_line, r.allowed_amount) for r in insurance.line_for_finding(f, e).collect()}
    want = brute_line(found, eob)
    assert got == want and len(want) > 60
    assert {(r.bill_id, r.line_number) for r in insurance.line_for_finding(f, e.drop("description")).collect()} == set(brute_line(found, [(*x[:4], None) for x in eob]))


def test_line_for_finding_is_linear_in_a_bill(spark):
    n = 60_000
    f = spark.range(n).select(F.lit(1).alias("bill_id"), F.col("id").cast("int").alias("line_number"), F.lit("99213").alias("code"), F.lit("office visit").alias("description"))
    e = f.withColumn("allowed_amount", F.lit(1.0))
    began = time.time()
    got = insurance.line_for_finding(f, e).agg(F.count("*"), F.max("eob_line")).first()
    assert tuple(got) == (n, 0) and time.time() - began < 60


def test_price_look_up_on_a_common_code(spark):
    """A code with most prices, many requests for the same, ties, nulls: against all pairs, 20 rows a request."""
    rng = random.Random(3)
    rows = [(k, rng.choice(["99213"] * 8 + ["80053"]), rng.choice(["Mercy East", "mercy west", "General"]), rng.choice([None, "Acme", "acme plus", "Other"]), float(rng.randrange(50))) for k in range(4000)]
    asked = [(k, rng.choice(["99213", "99213", "80053", "none"]), rng.choice([None, "mercy", "GENERAL", ""]), rng.choice([None, "acme", "x"])) for k in range(60)]
    p = spark.createDataFrame(rows, "price_seq long, billing_code string, hospital_name string, payer_name string, gross_charge double").withColumns({"cash_discount_price": F.col("gross_charge"), "negotiated_rate": F.col("gross_charge") / 2})
    q = spark.createDataFrame(asked, "request_id long, code string, hospital string, payer string")
    want = set()
    for i, code, hospital, payer in asked:
        ok = [r for r in rows if r[1] == code and (hospital is None or hospital.lower() in r[2].lower()) and (payer is None or (r[3] is not None and payer.lower() in r[3].lower()))]
        ok.sort(key=lambda r: (r[2], r[3] is not None, r[3] or "", r[0], r[4]))
        want |= {(i, n + 1, r[0]) for n, r in enumerate(ok[:20])}
    got = {(r.request_id, r.rank, r.price_seq) for r in prices.look_up_prices(q, p, 20).collect()}
    assert got == want and len(want) > 400
    least = {r.request_id: r.cash_price for r in prices.lowest_prices(q, p).collect()}
    assert least == {i: min(r[4] for r in rows if r[1] == c and (h is None or h.lower() in r[2].lower()) and r[4] > 0) for i, c, h, _ in asked if c != "none"}


def test_sketches_of_a_replaced_source(spark, tmp_path):
    from ledgerlens.sources import sinks

    p = lambda source, n: spark.range(n).selectExpr(f"{source} AS source_id", "concat('c', id % 5) AS billing_code", f"concat('h', {source}, '-', id % 700) AS hospital_name", "concat('p', id % 40) AS payer_name", "id % 90 - 3.0D AS cash_discount_price", "id + 1.5D AS negotiated_rate", "-1.0D AS gross_charge")
    table = str(tmp_path / "sketches")
    sinks.replace_source(prices.price_sketches(p(1, 4000).unionByName(p(2, 3000))), table)
    first = {f for f in (tmp_path / "sketches").rglob("*.parquet") if "source_id=1" in str(f)}
    sinks.replace_source(prices.price_sketches(p(2, 9000)), table)
    assert first == {f for f in (tmp_path / "sketches").rglob("*.parquet") if "source_id=1" in str(f)}
    held, now = spark.read.parquet(table), p(1, 4000).unionByName(p(2, 9000))
    a, b = prices.merged_stats(held).first(), prices.price_stats(now).first()
    assert (a.n, a.codes) == (b.n, b.codes) and abs(a.hospitals - b.hospitals) <= 0.05 * b.hospitals and abs(a.payers - b.payers) <= 2
    want = {r.billing_code: r for r in prices.price_summary(now).collect()}
    for r in prices.merged_summary(held).collect():
        w = want[r.billing_code]
        assert (r.min_cash, r.max_cash, r.min_negotiated, r.max_negotiated, r.min_gross) == (w.min_cash, w.max_cash, w.min_negotiated, w.max_negotiated, None) and abs(r.hospitals - w.hospitals) <= 0.05 * w.hospitals


def test_registry_by_state_and_alias(spark):
    entries = [(0, "Mercy Hospital", ["Zebra Clinic"], ["CA", "NY"]), (1, "Mercy East", None, ["ny"]), (2, "General", ["Mercy"], []), (3, "Unlike Place", ["Zz"], ["CA"])]
    r = spark.createDataFrame(entries, "ord int, name string, aliases array<string>, states array<string>")
    names = spark.createDataFrame([("mercy", "ca"), ("mercy", None), ("mercy", "NY"), ("mercy", "TX"), ("zebra", None)], "name string, state string")
    got = {}
    for x in prices.registry_matches(names, r).orderBy("rank").collect():
        got.setdefault((x.query, x.state), []).append((x.ord, x.matched_on))
    assert got["mercy", "CA"] == [(0, "Mercy Hospital")] and [k for k, _ in got["mercy", "NY"]] == [0, 1]
    assert got["mercy", None][:2] == [(0, "Mercy Hospital"), (2, "Mercy")] and ("mercy", "TX") not in got
    assert got["zebra", None] == [(0, "Zebra Clinic")]
    assert prices.registry_matches(names.select("name"), r.select("ord", "name")).count() > 0


def test_fuzzy_matches_by_rarest_words_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["the"] * 6 + ["blood", "draw", "panel", "chest", "view", "knee", "left", "right", "two", "lab", "x", "test", "drug", "unit"]
    said = [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(160)]
    names = sorted({" ".join(rng.choices([*words, "other", "more"], k=rng.randrange(1, 11))) for _ in range(150)} | {"no such words", "the"})
    synonyms = spark.createDataFrame([(k, s.upper(), f"c{k}") for k, s in enumerate(said)], "ord long, description string, code string")
    rates = spark.createDataFrame([(k % 3, k, f"r{k}", s) for k, s in enumerate(said)], "ord int, seq long, code string, said string")
    texts = descriptions.dictionary(synonyms, rates)
    n = spark.createDataFrame([(x,) for x in names], "name string")
    share = lambda a, b: len(set(a.split()) & set(b.split())) / min(len(set(a.split())), len(set(b.split())))
    fuzzy = {}
    for x in names:
        best = max(((share(x, s), -k) for k, s in enumerate(said)), default=(0, 0))
        if best[0] >= 0.7:
            fuzzy[x] = f"c{-best[1]}"
    assert {r.name: r.code for r in descriptions.match(n, texts, ("fuzzy",)).collect()} == fuzzy and len(fuzzy) > 50
    exact = {x: f"c{said.index(x)}" for x in names if x in said}
    assert {r.name: r.code for r in descriptions.match(n, texts, ("exact",)).collect()} == exact
    inside = {x: f"r{min(((k % 3, k) for k, s in enumerate(said) if x in s))[1]}" for x in names if any(x in s for s in said)}
    assert {r.name: r.code for r in descriptions.match(n, texts, ("inside",)).collect()} == inside
    all_steps = {r.name: (r.step, r.code) for r in descriptions.match(n, texts).collect()}
    assert all(all_steps[x] == ("exact", c) for x, c in exact.items())
    assert all(all_steps[x] == ("fuzzy", c) for x, c in fuzzy.items() if x not in exact)
    assert {x for x, (s, _) in all_steps.items() if s == "inside"} == set(inside) - set(fuzzy) - set(exact)
    split = descriptions.resolve(n.withColumnRenamed("name", "description"), texts)
    assert {r.description: (r.step, r.code) for r in split.collect()} == {x: (s, c) for x, (s, c) in all_steps.items() if s != "words" or x in {r.name for r in descriptions.match(n, texts, ("words",)).where("confidence >= 0.6").collect()}}


def test_equal_descriptions_are_indexed_a_few_times(spark):
    """Copies of a text don't grow the index, names alike in their first longer words ask once, and the results are those of all rows."""
    rng = random.Random(5)
    words = ["blood", "draw", "panel", "chest", "view", "two", "of"]
    kinds = [" ".join(rng.sample(words, 4)) for _ in range(12)]
    said = [(k % 3, k, f"r{k}", rng.choice(kinds)) for k in rng.sample(range(5000), 2000)]
    synonyms = [(k, rng.choice(kinds[:2]), f"c{k}") for k in range(300)]
    texts = descriptions.dictionary(spark.createDataFrame(synonyms, "ord long, description string, code string"), spark.createDataFrame(said, "ord int, seq long, code string, said string")).cache()
    assert texts.where("entry").count() == 2 and texts.where("NOT entry").count() <= 12 * 3 * descriptions.FIRST_ROWS
    names = sorted({" ".join(rng.sample(words, n)) for n in (2, 3, 5) for _ in range(40)})
    want = {}
    for x in names:
        t, longer = x.split(), [w for w in x.split() if len(w) > 2]
        for o in range(3):
            five = sorted(r for r in said if r[0] == o and len(longer) > 1 and longer[0] in r[3] and longer[1] in r[3])[:5]
            scored = [(-len({*t} & {*r[3].split()}) / min(len(t), 4), r[1], r[2]) for r in five]
            scored = [s for s in scored if s[0] <= -0.5]
            if scored:
                want[x] = min(scored)[2]
                break
    n = spark.createDataFrame([(x,) for x in names], "name string")
    assert {r.name: r.code for r in descriptions.match(n, texts, ("words",)).collect()} == want and len(want) > 30
    first = {x: f"c{min(k for k, s, _ in synonyms if s == x)}" for x in kinds[:2]}
    both = spark.createDataFrame([(x,) for x in first], "name string")
    assert {r.name: r.code for r in descriptions.match(both, texts, ("exact",)).collect()} == first == {r.name: r.code for r in descriptions.match(both, texts, ("fuzzy",)).collect()}


def test_documents_are_built_by_one_grouping(spark, tmp_path):
    """Lines of an order are shuffled once and joined with parts once; the texts are those of the view, also where lines have no part."""
    t = Tables(spark, FOLDER)
    plan = t.bill_docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Window" not in plan
    for n in ("orders", "lineitem", "part"):
        d = getattr(t, n)
        (d.where("p_partkey % 7 > 0") if n == "part" else d).write.parquet(f"{tmp_path}/{n}.parquet")
    less = Tables(spark, str(tmp_path))
    for x in (t, less):
        lines = x.doc_lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda v: v["line"]), "\n").alias("body"))
        assert x.bodies.count() == lines.count() > 1000 and x.bodies.exceptAll(lines).isEmpty()
    assert less.doc_lines.count() < t.doc_lines.count()


def test_extraction_by_hand(spark):
    """Lines of the shapes that bills have, with the answers written out."""
    rows = [
        ("1  99285  25  ER visit level 5   1   $1,850.00", ["99285"], [1850.0]), ("J1100 Dexamethasone inj $45.50", ["J1100"], [45.5]), ("a0429 ambulance 1,200.00", ["A0429"], [1200.0]),
        ("80053 metabolic panel 212.00", ["80053"], [212.0]), ("70450 CT head $2,100.00 $1,900.00", ["70450"], [2100.0, 1900.0]), ("00000 ignored $5.00", [], [5.0]), ("99213 no amount", ["99213"], []),
        ("00100 anesthesia $ 12", ["00100"], [12.0]), ("", [], []), ("plain words", [], []), ("99213 99213 36415 $1", ["99213", "36415"], [1.0]), ("123456 too long", [], []),
    ]
    d = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(rows)], "k int, t string").select("k", extraction.codes_in("t").alias("c"), extraction.amounts_in("t").alias("a"), extraction.clean_description("t").alias("d")).orderBy("k").collect()
    for (text, codes, amounts), r in zip(rows, d, strict=True):
        assert r.c == codes, text
        assert r.a == amounts, text
    assert d[0].d == "1 25 ER visit level 5 1" and d[1].d == "Dexamethasone inj"
    one = lambda text, c: spark.createDataFrame([(text,)], "text string").select(c.alias("v")).first().v
    kind = extraction.facility_type("text")
    assert [one(x, kind) for x in ("Mercy Emergency  Dept", "emergency room", "Emergency exit", "Urgent Care", "City HOSPITAL", "hospitality", "x clinic", "")] == ["er", "er", "unknown", "er", "hospital", "unknown", "clinic", "unknown"]
    assert one("99213 26 visit", extraction.modifier_after("text", F.lit("99213"))) == "26" and one("99213 ZZ visit", extraction.modifier_after("text", F.lit("99213"))) is None
    assert one("Service date: 3/7/24", extraction.service_date("text")) == "2024-03-07" and one("Patient Name: Ann B. Lee", extraction.patient_name("text")) == "Ann B. Lee"
    name = lambda text, groups, most=100: one(text, extraction.labelled_name("text", groups, most))
    assert name("Provider: $55\nFacility: North   Wing", extraction.PROVIDER_LABELS) == "North Wing"
    assert name("Doctor: X\nRendering provider: ab", extraction.PROVIDER_LABELS) is None
    assert name("Member: $1\nMember name: Al Berg", extraction.PATIENT_LABELS) in ("Al Berg", None) and name("Patient: Bo Lund", extraction.PATIENT_LABELS, 4) == "Bo L"


def test_look_ups_against_rates_of_one_row_a_code(spark):
    """The best of all rates that fit, by brute force; codes have one row, and look-ups aren't multiplied by keys."""
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rates = [(k, pick("1", "2", "3"), pick(None, "25", "59"), pick(None, "7", "8"), pick(None, 0.0, 5.0, 9.0), pick(None, 0.0, 4.0)) for k in range(60)]
    asked = [(c, m, p, "facility") for c in ("1", "2", "4") for m in (None, "25", "26") for p in (None, "7", "9")]
    pfs = spark.createDataFrame(rates, "rate_seq long, code string, modifier string, locality string, facility_rate double, non_facility_rate double")
    none = spark.createDataFrame([], "rate_seq long, code string, modifier string, rate double, payment_limit double, payment_rate double")
    packs = matching.rate_packs(pfs, none.drop("payment_limit", "payment_rate"), none.select("code", "payment_limit"), none.select("code", "payment_rate"))
    assert packs.count() == 3
    found = matching.match_rates(spark.createDataFrame(asked, "code string, modifier string, locality string, context string"), packs)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r[:3]): (r.facility_rate, r.non_facility_rate) for r in found.collect()}
    for c, m, p, _ in asked:
        fit = [r for r in rates if r[1] == c and (m is None or r[2] in (None, m)) and (p is None or r[3] in (None, p))]
        best = min(fit, key=lambda r: (not (r[4] or 0) > 0, not (r[5] or 0) > 0, r[0]), default=None)
        assert got[c, m, p] == (best[4:] if best and (best[4] or best[5]) else (None, None))
    assert len(got) == len(asked)


def test_alerts_of_lines_ask_for_no_rate(spark):
    plan = registry.QUERIES["a18_line_alerts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan and "steps-" not in plan and "step_" not in plan


def test_findings_move_no_texts(spark):
    """Lines of findings have no description; reports are dealt by bill once, as findings."""
    with Tables(spark, FOLDER) as t:
        assert "description" not in placed(t).columns and "description" in placed(t, said=True).columns
        plan = audit.reports(found(t, "bill_id"), t.bills)._jdf.queryExecution().executedPlan().toString()
        assert "p_name" not in plan and "description" not in plan
        assert len(re.findall(r"Exchange hashpartitioning\(bill_id#\d+L, ", plan)) == 2  # findings, and heads of bills


def test_codes_are_those_of_the_views(spark):
    d = spark.sql("SELECT explode(sequence(-90, 20000)) AS l_partkey UNION ALL SELECT NULL").selectExpr("CAST(l_partkey AS BIGINT) AS l_partkey")
    assert d.selectExpr(f"{bindings._code('l_partkey')} <=> {bindings._code_by_place('l_partkey')} AS same").where("NOT same").count() == 0
    assert "WHEN 26 THEN" not in bindings._spark(bindings.VIEWS["eob_lines"])
