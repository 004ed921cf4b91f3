"""Aggregates over audits, events, loads and usage. Times relative to now take ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_to

EVENT_TYPES = ("page_view", "audit", "signup", "upgrade", "feature_use", "share")


def audit_totals(audits: DataFrame) -> DataFrame:
    """Count, sums, mean and largest savings over all audits."""
    total = lambda c: F.coalesce(round_to(F.sum(c), 0), F.lit(0.0))
    return audits.agg(
        F.count("*").alias("audits"), total("total_billed").alias("billed"), total("total_cms").alias("cms"), total("total_savings").alias("savings"),
        round_to(F.avg("total_savings"), 0).alias("mean_savings"), F.max("total_savings").alias("max_savings"),
    )


def top_codes(found: DataFrame, k: int = 10) -> DataFrame:
    """The codes with the largest total overcharge, and their mean multiplier."""
    d = found.where("overcharge > 0").groupBy("code").agg(F.count("*").alias("n"), round_to(F.sum("overcharge"), 0).alias("overcharge"), round_to(F.avg("multiplier"), 1).alias("mean_multiplier"))
    return d.orderBy(F.desc("overcharge"), "code").limit(k)


def audit_page(audits: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of audits, newest first (W05); limits above 200 count as 200."""
    return audits.orderBy(F.desc("created_at"), F.desc("report_id")).offset(offset).limit(min(limit, 200))


def audit_page_after(audits: DataFrame, created_at: object, report_id: str, limit: int = 50) -> DataFrame:
    """The page that follows an audit (W05): a bounded top of what lies beyond the cursor, however deep the page is."""
    beyond = (F.col("created_at") < F.lit(created_at)) | ((F.col("created_at") == F.lit(created_at)) & (F.col("report_id") < F.lit(report_id)))
    return audits.where(beyond).orderBy(F.desc("created_at"), F.desc("report_id")).limit(min(limit, 200))


def top_audits(audits: DataFrame, k: int = 5) -> DataFrame:
    return audits.orderBy(F.desc("total_savings"), "report_id").limit(k)


def latest_audits(audits: DataFrame, k: int = 10) -> DataFrame:
    return audits.orderBy(F.desc("created_at"), "report_id").limit(k)


def _since(as_of: Column, days: int) -> Column:
    return F.col("created_at") > as_of - F.expr(f"INTERVAL {days} DAYS")


def page_views(events: DataFrame, as_of: Column) -> DataFrame:
    """Views by page, in the last 7 and 30 days."""
    d = events.where("event_type = 'page_view'").withColumn("page", F.get_json_object("event_data", "$.k"))
    return d.groupBy("page").agg(F.count_if(_since(as_of, 7)).alias("last_7"), F.count_if(_since(as_of, 30)).alias("last_30"))


def audit_events(events: DataFrame, as_of: Column) -> DataFrame:
    """Audit events: all, last 7 days, mean figure of their JSON."""
    size = F.get_json_object("event_data", "$.k").try_cast("double")
    return events.where("event_type = 'audit'").agg(F.count("*").alias("audits"), F.count_if(_since(as_of, 7)).alias("last_7"), round_to(F.avg(size), 2).alias("mean_size"))


def event_trend(events: DataFrame, as_of: Column) -> DataFrame:
    """Per day: audits, signups and feature uses of the last 30 days."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    return events.where(_since(as_of, 30)).groupBy(F.to_date("created_at").alias("day")).agg(n("audit").alias("audits"), n("signup").alias("signups"), n("upgrade").alias("upgrades"), n("feature_use").alias("feature_uses"))


def daily_rollup(events: DataFrame) -> DataFrame:
    """(day, event_type, page, n, n_first, size_sum, size_n): what the dashboards need of each day, with each event parsed once.

    n_first counts events at the very beginning of the day, which 'later than midnight' leaves out. Rollups of parts of the
    events are one rollup when put together.
    """
    page = F.when(F.col("event_type") == "page_view", F.get_json_object("event_data", "$.k")).alias("page")
    size = F.when(F.col("event_type") == "audit", F.get_json_object("event_data", "$.k").try_cast("double"))
    first = F.col("created_at").cast("timestamp") == F.to_date("created_at").cast("timestamp")
    return events.groupBy(F.to_date("created_at").alias("day"), "event_type", page).agg(F.count("*").alias("n"), F.count_if(first).alias("n_first"), F.sum(size).alias("size_sum"), F.count(size).alias("size_n"))


def _after(as_of: Column, days: int) -> Column:
    """Events of a rollup row later than the midnight ``days`` before ``as_of``."""
    edge = F.date_sub(as_of.cast("date"), days)
    return F.when(F.col("day") > edge, F.col("n")).when(F.col("day") == edge, F.col("n") - F.col("n_first")).otherwise(0)


def page_views_of(rollup: DataFrame, as_of: Column) -> DataFrame:
    """``page_views`` from a rollup; ``as_of`` is the beginning of a day."""
    return rollup.where("event_type = 'page_view'").groupBy("page").agg(F.sum(_after(as_of, 7)).alias("last_7"), F.sum(_after(as_of, 30)).alias("last_30"))


def audit_events_of(rollup: DataFrame, as_of: Column) -> DataFrame:
    """``audit_events`` from a rollup."""
    d = rollup.where("event_type = 'audit'")
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("audits"), F.coalesce(F.sum(_after(as_of, 7)), F.lit(0)).alias("last_7"), round_to(F.sum("size_sum") / F.nullif(F.sum("size_n"), F.lit(0)), 2).alias("mean_size"))


def event_trend_of(rollup: DataFrame, as_of: Column) -> DataFrame:
    """``event_trend`` from a rollup."""
    n = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("m")).otherwise(0))
    d = rollup.withColumn("m", _after(as_of, 30)).where("m > 0")
    return d.groupBy("day").agg(n("audit").alias("audits"), n("signup").alias("signups"), n("upgrade").alias("upgrades"), n("feature_use").alias("feature_uses"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def zip_states(zips: DataFrame, k: int = 10) -> DataFrame:
    """The states with most ZIPs, and how many of them are rural."""
    d = zips.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("urban_rural") == "R").alias("rural"), F.count_if(F.coalesce("urban_rural", F.lit("U")) == "U").alias("urban"))
    return d.orderBy(F.desc("n"), "state").limit(k)


def rate_spread(pfs: DataFrame) -> DataFrame:
    """Mean and range of positive facility rates of each code over localities."""
    d = pfs.where("facility_rate > 0").groupBy("code")
    return d.agg(F.count("*").alias("n"), round_to(F.avg("facility_rate"), 2).alias("mean"), F.min("facility_rate").alias("least"), F.max("facility_rate").alias("most"))


def load_check(pfs: DataFrame) -> DataFrame:
    """Rows with and without description and distinct codes per snapshot."""
    return pfs.groupBy("snapshot_id").agg(F.count_if(F.coalesce("description", F.lit("")) != "").alias("described"), F.count_if(F.coalesce("description", F.lit("")) == "").alias("bare"), F.countDistinct("code").alias("codes"))


def monthly_usage(audits: DataFrame, limit: int = 3) -> DataFrame:
    """Audits per user and calendar month, and whether one more is allowed."""
    d = audits.groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    return d.withColumn("allowed", F.col("used") < limit)
