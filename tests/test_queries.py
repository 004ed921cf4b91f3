"""Queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ledgerlens.plans import files, registry

FOLDER = "/root/testdata/sf0.001"
#: One query of each area; the driver compares all of them at a larger scale.
NAMES = ["j05_multi_source_match", "j06_tiered_match", "a01_bill_totals", "a17_billing_errors", "a18_line_alerts", "a22_savings_summary", "j24_description_cascade", "j25_registry_matches", "a30_price_summary", "t07_bill_lines", "k07_upsert", "a28_event_trend", "a03_reports", "u04_alerts_union", "j13_line_for_finding", "j15_price_lookup", "j16_lowest_prices", "t06_resolved_lines", "t13_bills_from_text", "t16_claim_number", "t19_resolved_codes", "w05_seek_page"] + list(files.QUERIES) + ["f02_code_numbers", "f05_word_sets", "f14_money_texts"]


def rows(df):
    cell = lambda v: None if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)]
    return sorted([tuple(map(str, map(cell, r))) for r in df.itertuples(index=False)])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, FOLDER).toPandas()
    theirs = duck.sql(registry.ORACLES[name]).df()
    assert len(ours) and set(ours.columns) == set(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_audit_invariants(spark):
    from ledgerlens.operators import audit
    from ledgerlens.plans.bindings import Tables
    from ledgerlens.plans.rates import found

    t = Tables(spark, FOLDER)
    f = found(t).cache()
    assert f.count() == t.bill_lines.count() == f.select("bill_id", "line_number").distinct().count()
    totals = audit.bill_totals(f, t.bills).selectExpr("sum(matched + unmatched)").first()[0]
    assert totals == f.count()
