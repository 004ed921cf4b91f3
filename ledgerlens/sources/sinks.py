"""Loads and table maintenance over Parquet folders."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


SNAPSHOT = "snapshot_id long, source_type string, effective_year int, fetched_at timestamp, data_hash string, row_count long"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_load(rates: DataFrame, table: str, snapshots: str, snapshot_id: int, source_type: str, year: int, fetched_at: datetime.datetime, data_hash: str) -> int:
    """Load rates as a partition of their own, then commit them by a snapshot row with their count.

    The snapshot row is the commit: ``committed`` shows only rows that have one. A load that stopped before it left a
    partition that nobody sees and that the next try overwrites; a source and hash that are committed load no second time.
    """
    spark = rates.sparkSession
    if _exists(spark, snapshots):
        done = spark.read.schema(SNAPSHOT).parquet(snapshots).where((F.col("source_type") == source_type) & (F.col("data_hash") == data_hash)).first()
        if done:
            return done["row_count"]
    part = f"{table}/snapshot_id={snapshot_id}"
    rates.write.mode("overwrite").parquet(part)
    n = spark.read.schema(rates.schema).parquet(part).count()
    row = (snapshot_id, source_type, year, fetched_at, data_hash, n)
    spark.createDataFrame([row], SNAPSHOT).coalesce(1).write.mode("append").parquet(snapshots)
    return n


def committed(spark: SparkSession, table: str, snapshots: str) -> DataFrame:
    """Rows of ``table`` whose load was committed; others' partitions aren't read."""
    done = [r["snapshot_id"] for r in spark.read.schema(SNAPSHOT).parquet(snapshots).select("snapshot_id").distinct().collect()]  # one a load
    return spark.read.parquet(table).where(F.col("snapshot_id").isin(done))


def fresh_snapshot(snapshots: DataFrame, source_type: str, year: int, as_of: Column, days: int = 90) -> DataFrame:
    """The newest snapshot of a type and year that is younger than ``days``."""
    d = snapshots.where((F.col("source_type") == source_type) & (F.col("effective_year") == year) & (F.col("fetched_at") > as_of - F.expr(f"INTERVAL {days} DAYS")))
    return d.orderBy(F.desc("fetched_at"), F.desc("snapshot_id")).limit(1)


def saved_audits(reports: DataFrame, created_at: Column) -> DataFrame:
    """Audit rows with the whole report as JSON."""
    return reports.select(F.col("bill_id").cast("string").alias("report_id"), "total_billed", F.col("baseline").alias("total_cms"), F.col("savings").alias("total_savings"), F.size("findings").alias("finding_count"), F.to_json(F.struct(*reports.columns)).alias("report_json"), created_at.alias("created_at"))


#: What a saved report is parsed to.
REPORT = (
    "bill_id long, baseline double, matched long, unmatched long, avg_multiplier double, total_billed double, savings double, "
    "findings array<struct<line_number int, code string, modifier string, billed_amount double, source string, mode string, rate_used double, overcharge double, multiplier double, severity string, dispute string>>, "
    "overcharge_by_severity map<string, double>, top_overcharges array<struct<code string, overcharge double>>"
)


def saved_reports(audits: DataFrame, wanted: DataFrame, schema: str = REPORT) -> DataFrame:
    """Saved reports parsed again (J28): those whose report_id is in ``wanted``; JSON that doesn't parse gives null fields."""
    return audits.join(wanted.select("report_id").distinct(), "report_id", "left_semi").select("report_id", F.from_json("report_json", schema).alias("report"))


def split_prices(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices that load, and the counts inserted and skipped."""
    ok = F.coalesce(F.col("billing_code_type").isin("CPT", "HCPCS") & (F.trim("billing_code") != ""), F.lit(False))
    return rows.where(ok), rows.agg(F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("skipped"))


def replace_source(rows: DataFrame, table: str, key: str = "source_id") -> None:
    """Replace the partitions of the sources in ``rows``, leaving others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(table)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows and, of the new, the first per key that isn't there."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return existing.unionByName(first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, new before old, among new the last by ``order`` (K07; with an empty ``existing``, K08)."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def create_table(rows: DataFrame, table: str, keys: list[str], order: str, buckets: int = 64) -> None:
    """A table for ``merge_into``: one row per key (the last by ``order``), in a partition by the hash of its key."""
    upsert(rows.limit(0), rows, keys, order).withColumn("bucket", _bucket(keys, buckets)).repartition(buckets, "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(table)


def merge_into(new: DataFrame, table: str, keys: list[str], order: str, buckets: int = 64, ignore: bool = False) -> int:
    """Upsert ``new`` (K07, K08), or with ``ignore`` insert what isn't there (K06), rewriting only the partitions that new keys fall in.

    Partitions without a new key keep their files. Replaced partitions are staged and moved at the job's commit. Gives the
    number of partitions rewritten. ``new`` has the table's columns; at most ``buckets`` numbers come to the driver.
    """
    spark = new.sparkSession
    keyed = new.withColumn("bucket", _bucket(keys, buckets))
    hit = sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect())
    if not hit:
        return 0
    schema = T.StructType([*new.schema.fields, T.StructField("bucket", T.IntegerType())])
    old = spark.read.schema(schema).parquet(table).where(F.col("bucket").isin(hit))
    rows = (insert_or_ignore if ignore else upsert)(old, keyed.select(*old.columns), keys, order)
    rows.repartition(len(hit), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    return len(hit)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def community_rows(rows: DataFrame) -> DataFrame:
    """Submitted prices with defaults (K10): code and amount needed, blanks null, insured unless said otherwise."""
    blank = [n for n, t in rows.dtypes if t == "string" and n != "billing_code"]
    d = rows.withColumns({n: F.nullif(F.trim(n), F.lit("")) for n in blank})
    return d.where("trim(billing_code) != '' AND amount_paid > 0").withColumn("is_insured", F.coalesce("is_insured", F.lit(True)))


def overwrite_safely(spark: SparkSession, rows: DataFrame, table: str) -> None:
    """Write beside ``table``, then exchange the folders, since a table can't be overwritten while it is read.

    The old folder is renamed aside before the new one takes its place and is deleted last, so a crash loses neither.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(table.rstrip("/") + end) for end in ("", ".new", ".old"))
    rows.write.mode("overwrite").parquet(new.toString())
    fs = old.getFileSystem(conf)
    fs.delete(aside, True)
    for a, b in ((old, aside), (new, old)):
        if fs.exists(a) and not fs.rename(a, b):
            raise OSError(f"can't rename {a.toString()} to {b.toString()}")
    fs.delete(aside, True)
