"""Queries for table maintenance and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..sources import sinks
from ..streaming import streams
from .bindings import Tables, with_views
from .rates import FOUND, found, r


QUERIES = {
    "k02_fresh_snapshot": (
        lambda t: sinks.fresh_snapshot(t.snapshots, "pfs", 2022, F.lit("2024-02-01").cast("date")).select("snapshot_id", "row_count"),
        "SELECT snapshot_id, row_count FROM {snapshots} WHERE source_type = 'pfs' AND effective_year = 2022 AND fetched_at > DATE '2024-02-01' - INTERVAL 90 DAY ORDER BY fetched_at DESC, snapshot_id DESC LIMIT 1",
    ),
    "k03_saved_audits": (
        lambda t: sinks.saved_audits(audit.reports(found(t, "bill_id"), t.bills), F.lit("2024-01-31").cast("timestamp")).select("report_id", "finding_count", F.get_json_object("report_json", "$.matched").cast("long").alias("matched")),
        f"WITH {FOUND} SELECT CAST(bill_id AS STRING) AS report_id, CAST(count(*) AS INT) AS finding_count, count(*) FILTER (mode != 'unmatched') AS matched FROM found GROUP BY bill_id",
    ),
    "j28_saved_reports": (
        lambda t: sinks.saved_reports(sinks.saved_audits(audit.reports(found(t, "bill_id"), t.bills), F.lit("2024-01-31").cast("timestamp")), t.audits.where("finding_count = 3").select(F.substring("report_id", 2, 20).alias("report_id"))).select(
            "report_id", "report.matched", F.size("report.findings").cast("long").alias("n"), F.get("report.findings", F.lit(0))["code"].alias("first_code"), F.element_at("report.overcharge_by_severity", F.lit("extreme")).alias("extreme")
        ),
        f"WITH {FOUND} SELECT CAST(bill_id AS STRING) AS report_id, count(*) FILTER (mode != 'unmatched') AS matched, count(*) AS n, arg_min(code, line_number) AS first_code, {r('sum(overcharge) FILTER (severity = ' + chr(39) + 'extreme' + chr(39) + ')', 2)} AS extreme FROM found WHERE bill_id IN (SELECT CAST(substr(report_id, 2) AS BIGINT) FROM {{audits}} WHERE finding_count = 3) GROUP BY bill_id",
    ),
    "k04_price_load_counts": (lambda t: sinks.split_prices(t.hospital_prices)[1], "SELECT count(*) FILTER (billing_code_type IN ('CPT', 'HCPCS')) AS inserted, count(*) FILTER (billing_code_type NOT IN ('CPT', 'HCPCS')) AS skipped FROM {hospital_prices}"),
    "k06_insert_or_ignore": (
        lambda t: sinks.insert_or_ignore(t.zip_locality.where("CAST(zip_code AS BIGINT) % 3 = 0"), t.zip_locality.withColumn("county_name", F.lit("new")), ["zip_code"], "locality").select("zip_code", "county_name"),
        "SELECT zip_code, county_name FROM {zip_locality} WHERE CAST(zip_code AS BIGINT) % 3 = 0 UNION ALL SELECT DISTINCT zip_code, 'new' FROM {zip_locality} WHERE CAST(zip_code AS BIGINT) % 3 != 0",
    ),
    "k07_upsert": (
        lambda t: sinks.upsert(t.zip_locality, t.zip_locality.where("CAST(zip_code AS BIGINT) % 3 = 0").withColumn("county_name", F.lit("new")), ["zip_code"], "locality").select("zip_code", "county_name"),
        "SELECT zip_code, CASE WHEN CAST(zip_code AS BIGINT) % 3 = 0 THEN 'new' ELSE county_name END AS county_name FROM {zip_locality}",
    ),
    "k08_last_wins": (
        lambda t: sinks.upsert(t.community_prices.limit(0), t.community_prices, ["billing_code"], "price_id").select("billing_code", "price_id"),
        "SELECT billing_code, max(price_id) AS price_id FROM {community_prices} GROUP BY billing_code",
    ),
    "k09_deleted_audits": (
        lambda t: sinks.without(t.audits, t.audits.where("finding_count = 3").select("report_id"), "report_id").groupBy("finding_count").agg(F.count("*").alias("n")),
        "SELECT finding_count, count(*) AS n FROM {audits} WHERE finding_count != 3 GROUP BY finding_count",
    ),
    "k10_community_rows": (
        lambda t: sinks.community_rows(t.community_prices.withColumns({"payer_name": F.when(F.col("price_id") % 2 == 0, " ").otherwise("p"), "is_insured": F.when(F.col("price_id") % 3 == 0, F.lit(False))})).groupBy("payer_name", "is_insured").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN price_id % 2 = 0 THEN NULL ELSE 'p' END AS payer_name, price_id % 3 != 0 AS is_insured, count(*) AS n FROM {community_prices} WHERE amount_paid > 0 GROUP BY ALL",
    ),
    "st2_daily_counts": (
        lambda t: streams.daily_counts(t.analytics_events).withColumn("day", F.col("day").cast("string")),
        "SELECT CAST(CAST(created_at AS DATE) AS STRING) AS day, event_type, count(*) AS n FROM {analytics_events} GROUP BY ALL",
    ),
    # windows that open at a key's first event are sequential per key, so there is no SQL; tests use brute force
    "st3_quota": (lambda t: streams.quota_batch(t.analytics_events, 6 * 3600, 1), None),
}
QUERIES = {k: (f, with_views(sql) if sql else None) for k, (f, sql) in QUERIES.items()}
