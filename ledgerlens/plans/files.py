"""Queries that go through files: the domain tables are written in the layouts that providers publish, read by the readers
or loaded by the sinks, and must come back as the SQL derives them from the given tables.

Files are written by tasks, a layout with blanks, lower case, money texts and rows that a reader has to refuse.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources import readers, sinks
from ..streaming import streams
from .bindings import Tables, with_views
from .rates import r


def as_csv(df: DataFrame, sep: str = ",", header: bool = True, **options: str) -> Callable[[str], None]:
    """Writes ``df`` with blanks kept and nulls as empty fields."""
    return lambda path: df.write.csv(path, sep=sep, header=header, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options)


def as_documents(df: DataFrame, bucket: Column, order: str, name: str | None = None) -> Callable[[str], None]:
    """Writes one JSON document a bucket: the array of its rows by ``order``, or an object that holds it under ``name``."""
    fields = [c for c in df.columns if c != order]
    rows = df.select(bucket.alias("b"), F.struct(F.col(order).alias("__o"), *fields).alias("x")).groupBy("b").agg(F.sort_array(F.collect_list("x")).alias("a"))
    array = F.transform("a", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return lambda path: rows.select("b", F.to_json(F.struct(array.alias(name)) if name else array).alias("value")).repartition("b").write.partitionBy("b").text(path)


def dollars(c: Column | str) -> Column:
    return fn.money_text(fn.round_to(c, 2))


def plain(c: Column | str) -> Column:
    return fn.col(c).cast("decimal(18,4)").cast("string")


def four(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,4)) AS DOUBLE)"


def sloppy(c: Column | str) -> Column:
    """A code as people type it."""
    return F.concat(F.lit(" "), F.lower(c), F.lit(" "))


# ---- rate files -------------------------------------------------------------------------------------------------------


def physician_file(t: Tables) -> DataFrame:
    d = t.pfs_rates
    year = F.when(F.col("rate_seq") % 13 == 0, "year").otherwise("2026")  # no year, no row
    d = d.select(year, "carrier", "locality", sloppy("code"), "modifier", dollars("facility_rate"), plain("non_facility_rate"), F.lit("x"), F.lit("y"), "status_indicator").toDF(*[f"c{k}" for k in range(10)])
    path = t.files("pfs", as_csv(d, header=False))
    return readers.read_pfs(t.spark, path, 2026).select("code", "modifier", "facility_rate", "non_facility_rate", "carrier", "locality", "status_indicator", "effective_year")


PFS_FILE = f"""SELECT code, modifier, {r('facility_rate', 2)} AS facility_rate, {four('non_facility_rate')} AS non_facility_rate, carrier, locality, status_indicator, effective_year
FROM {{pfs_rates}} WHERE rate_seq % 13 != 0 AND (coalesce(facility_rate, 0) != 0 OR coalesce(non_facility_rate, 0) != 0)"""


def older_physician_files(t: Tables) -> DataFrame:
    """One half separated by tabs, one by commas, under other names and in another order."""
    d = t.pfs_rates.withColumn("text", F.concat("description", F.lit(', "long"')))
    tabs = d.where("rate_seq % 2 = 0").select(sloppy("code").alias("HCPCS"), F.col("modifier").alias("MOD"), F.col("text").alias("DESCRIPTION"), dollars("facility_rate").alias("FACILITY FEE"), plain("non_facility_rate").alias("NON-FACILITY FEE"), F.col("locality").alias("LOC"))
    commas = d.where("rate_seq % 2 = 1").select(F.col("code").alias("HCPC"), F.col("locality").alias("LOCALITY"), plain("non_facility_rate").alias("PPAR_NFAC_AMOUNT"), dollars("facility_rate").alias("PPAR_FAC_AMOUNT"), F.col("text").alias("DESC"), F.col("modifier").alias("MOD1"), F.col("status_indicator").alias("STATUS"))
    paths = [t.files("older_tabs", as_csv(tabs, "\t")), t.files("older_commas", as_csv(commas))]
    return readers.read_pfs_with_header(t.spark, paths, 2020).select("code", "modifier", "description", "locality", "status_indicator", "facility_rate", "non_facility_rate", "effective_year")


OLDER = f"""SELECT code, modifier, description || ', "long"' AS description, locality, CASE WHEN rate_seq % 2 = 1 THEN status_indicator END AS status_indicator, {r('facility_rate', 2)} AS facility_rate, {four('non_facility_rate')} AS non_facility_rate, 2020 AS effective_year
FROM {{pfs_rates}} WHERE coalesce(facility_rate, 0) != 0 OR coalesce(non_facility_rate, 0) != 0"""


def laboratory_file(t: Tables) -> DataFrame:
    names = ["YEAR", "HCPCS", "MOD", "EFF_DATE", "INDICATOR", "RATE", "SHORTDESC", "LONGDESC"]
    d = t.clfs_rates.select(F.lit("2026"), sloppy("code"), "modifier", F.lit("20260101"), F.lit("N"), plain("rate"), "short_desc", F.concat(F.lit('"'), "long_desc", F.lit('", panel'))).toDF(*names)
    return readers.read_clfs(t.spark, t.files("clfs", as_csv(d)), 2026).select("code", "modifier", "rate", "short_desc", "long_desc", "effective_date")


CLFS_FILE = f"""SELECT code, nullif(modifier, '') AS modifier, {four('rate')} AS rate, short_desc, '"' || long_desc || '", panel' AS long_desc, '20260101' AS effective_date FROM {{clfs_rates}} WHERE rate != 0"""


def drug_file(t: Tables) -> DataFrame:
    names = ["HCPCS Code", "Short Description", "HCPCS Code Dosage", "Payment Limit", "Co-Insurance Percentage", "Vaccine AWP%", "Vaccine Limit", "Blood AWP%", "Blood Limit", "Clotting Factor", "Notes"]
    none = F.lit(None).cast("string")
    limit = F.when(F.col("rate_seq") % 7 == 0, "NA").otherwise(plain("payment_limit"))
    code = F.when(F.col("rate_seq") % 11 == 0, F.substring("code", 1, 4)).otherwise(sloppy("code"))  # codes of four characters are refused
    d = t.asp_rates.select(code, "short_desc", F.lit("1 MG"), limit, F.lit("20"), none, none, none, F.lit("N/A"), none, none).toDF(*names)
    return readers.read_asp(t.spark, t.files("asp", as_csv(d)), 2026).select("code", "short_desc", "dosage", "payment_limit", "coinsurance_pct", "blood_limit")


ASP_FILE = f"""SELECT code, short_desc, '1 MG' AS dosage, {four('payment_limit')} AS payment_limit, CAST(20 AS DOUBLE) AS coinsurance_pct, CAST(NULL AS DOUBLE) AS blood_limit FROM {{asp_rates}} WHERE rate_seq % 7 != 0 AND rate_seq % 11 != 0"""


def outpatient_files(t: Tables) -> DataFrame:
    """Two files of unlike column order, read as one folder each."""
    names = ["HCPCS Code", "Short Descriptor", "SI", "APC", "Relative Weight", "Payment Rate", "National Unadjusted Copayment", "Minimum Unadjusted Copayment"]
    none = F.lit(None).cast("string")
    code = F.when(F.col("rate_seq") % 11 == 0, "E1").otherwise(sloppy("code"))  # codes of two characters are refused
    d = t.opps_rates.select("rate_seq", *[c.alias(n) for c, n in zip((code, F.col("short_desc"), F.col("status_indicator"), F.col("apc"), F.lit("1.5"), dollars("payment_rate"), none, plain("payment_rate")), names, strict=True)])
    one = t.files("opps_one", as_csv(d.where("rate_seq % 2 = 0").select(*names)))
    two = t.files("opps_two", as_csv(d.where("rate_seq % 2 = 1").select(names[0], *names[:0:-1])))
    return readers.read_opps(t.spark, [one, two], 2026).select("code", "short_desc", "status_indicator", "apc", "relative_weight", "payment_rate", "national_copay", "min_copay")


OPPS_FILE = f"""SELECT code, short_desc, status_indicator, apc, CAST(1.5 AS DOUBLE) AS relative_weight, {r('payment_rate', 2)} AS payment_rate, CAST(NULL AS DOUBLE) AS national_copay, {four('payment_rate')} AS min_copay FROM {{opps_rates}} WHERE rate_seq % 11 != 0"""


def zip_file(t: Tables) -> DataFrame:
    d = t.zip_locality
    carrier = F.when(F.col("urban_rural") == "R", F.lit("     ")).otherwise(F.rpad("carrier", 5, " "))  # no carrier, no row
    fields = [F.rpad("state", 2, " "), F.rpad("zip_code", 5, " "), carrier, F.rpad("locality", 2, " "), F.coalesce("urban_rural", F.lit(" ")), F.rpad("locality", 2, " "), F.rpad(F.lit("0"), 58, " "), F.lit("20261")]
    path = t.files("zips", lambda p: d.select(F.concat(*fields).alias("value")).write.text(p))
    return readers.read_zip_locality(t.spark, path).select("zip_code", "carrier", "locality", "state", "urban_rural", "lab_locality", "rural_2", "year_quarter")


ZIP_FILE = "SELECT zip_code, carrier, locality, state, coalesce(urban_rural, 'U') AS urban_rural, locality AS lab_locality, '0' AS rural_2, '20261' AS year_quarter FROM {zip_locality} WHERE coalesce(urban_rural, 'U') != 'R'"


# ---- price files ------------------------------------------------------------------------------------------------------


def price_files(t: Tables) -> DataFrame:
    """Half of the sources name a code type and write dollars; the others give plain numbers, '-' for none, and no type."""
    d = t.hospital_prices
    one = d.where("source_id < 5").select(
        "hospital_name", F.col("hospital_ein").alias("EIN"), F.col("payer_name").alias("payer"), F.col("plan_name").alias("plan"), F.col("billing_code_type").alias("code_type"), sloppy("billing_code").alias("code"),
        dollars("gross_charge").alias("standard_charge|gross"), dollars("cash_discount_price").alias("standard_charge|discounted_cash"), dollars("negotiated_rate").alias("standard_charge|negotiated_dollar"), F.lit("Both").alias("setting"),
    )
    two = d.where("source_id >= 5").select(
        plain("negotiated_rate").alias("negotiated_rate"), F.coalesce(plain("cash_discount_price"), F.lit("-")).alias("cash price"), plain("gross_charge").alias("Gross Charge"), F.col("billing_code").alias("CPT"),
        F.col("plan_name").alias("product_name"), F.col("payer_name").alias("Insurer"), F.col("hospital_ein").alias("tax_id"), F.col("hospital_name").alias("facility"), F.lit("Inpatient care").alias("patient_class"),
    )
    paths = [t.files("prices_one", as_csv(one)), t.files("prices_two", as_csv(two))]
    return readers.read_hospital_prices(t.spark, paths, "mrf").select("hospital_name", "hospital_ein", "payer_name", "plan_name", "billing_code_type", "billing_code", "setting", "gross_charge", "cash_discount_price", "negotiated_rate", "source_url")


_ROUNDED = ", ".join(f"CASE WHEN source_id < 5 THEN {r(c, 2)} ELSE {four(c)} END AS {c}" for c in ("gross_charge", "cash_discount_price", "negotiated_rate"))
PRICE_FILES = f"""SELECT hospital_name, hospital_ein, payer_name, plan_name, kind AS billing_code_type, billing_code, CASE WHEN source_id < 5 THEN 'both' ELSE 'inpatient' END AS setting, {_ROUNDED}, 'mrf' AS source_url
FROM (SELECT *, CASE WHEN source_id < 5 THEN billing_code_type WHEN length(billing_code) != 5 THEN NULL WHEN regexp_full_match(billing_code, '[0-9]+') THEN 'CPT' WHEN regexp_full_match(billing_code, '[A-Z][0-9]+') THEN 'HCPCS' END AS kind FROM {{hospital_prices}}) p WHERE kind IN ('CPT', 'HCPCS')"""


# ---- bills and statements ---------------------------------------------------------------------------------------------


def bill_files(t: Tables) -> DataFrame:
    """Bills as JSON, one a line; line numbers, units and facility types are missing here and there."""
    item = F.struct(
        "line_number", F.when(F.col("bill_id") % 2 == 0, F.col("line_number")).alias("lineNumber"), F.col("code").alias("cptCode"), "modifier", "description",
        F.when(F.col("line_number") % 3 > 0, F.col("units")).alias("units"), F.col("billed_amount").alias("billedAmount"), F.col("service_date").cast("string").alias("serviceDate"),
    )
    lines = t.bill_lines.groupBy("bill_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("line_number")).alias("lineItems"))
    head = t.bills.select(
        "bill_id", F.concat("facility_name", F.lit(" / "), F.col("bill_id").cast("string")).alias("facilityName"), F.nullif("facility_type", F.lit("office")).alias("facilityType"), F.col("statement_date").cast("string").alias("statementDate"),
        F.col("total_billed").alias("totalBilled"), F.col("parse_confidence").alias("parseConfidence"), F.col("source_type").alias("sourceType"),
    )
    path = t.files("bills", lambda p: head.join(lines, "bill_id").drop("bill_id").write.json(p, compression="gzip"))
    return readers.read_bill_rows(t.spark, path).select("facility_name", "facility_type", "statement_date", "total_billed", "line_number", "code", "modifier", "description", "units", "billed_amount", "service_date")


BILL_FILES = """SELECT facility_name || ' / ' || CAST(b.bill_id AS STRING) AS facility_name, CASE WHEN facility_type = 'office' THEN 'unknown' ELSE facility_type END AS facility_type, CAST(statement_date AS STRING) AS statement_date, total_billed,
line_number, code, modifier, description, CAST(CASE WHEN line_number % 3 > 0 THEN units ELSE 1 END AS DOUBLE) AS units, billed_amount, CAST(service_date AS STRING) AS service_date FROM {bills} b JOIN {bill_lines} l ON b.bill_id = l.bill_id"""


def statement_files(t: Tables) -> DataFrame:
    item = F.struct(
        "line_number", F.lower("code").alias("cptCode"), F.col("billed_amount").alias("billedAmount"), F.col("allowed_amount").alias("allowedAmount"), F.col("insurance_paid").alias("insurancePaid"),
        F.col("patient_responsibility").alias("patientResponsibility"), F.col("adjustment_reason").alias("adjustmentReason"),
    )
    lines = t.eob_lines.groupBy("bill_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("line_number")).alias("lineItems"))
    head = t.eobs.select("bill_id", F.col("bill_id").cast("string").alias("claimNumber"), F.lower("plan_type").alias("planType"), F.col("amount_billed").alias("totalBilled"), F.col("total_allowed").alias("totalAllowed"), F.col("plan_paid").alias("totalInsurancePaid"))
    path = t.files("statements", lambda p: head.join(lines, "bill_id").drop("bill_id").write.json(p, compression="gzip"))
    return readers.read_eob_rows(t.spark, path).select(
        "claim_number", "plan_type", "amount_billed", "total_allowed", "plan_paid", "line_number", "code", "billed_amount", "allowed_amount", "insurance_paid", "patient_responsibility", "copay", "adjustment_reason"
    )


STATEMENT_FILES = """SELECT CAST(e.bill_id AS STRING) AS claim_number, upper(plan_type) AS plan_type, amount_billed, total_allowed, plan_paid, line_number, code, billed_amount, allowed_amount, insurance_paid, l.patient_responsibility,
CAST(0 AS DOUBLE) AS copay, adjustment_reason FROM {eobs} e JOIN {eob_lines} l ON e.bill_id = l.bill_id"""


# ---- lists, digests, events -------------------------------------------------------------------------------------------


def nonprofit_files(t: Tables) -> DataFrame:
    n = F.col("ein").cast("long")
    d = t.charity_hospitals.select(n.alias("n"), F.when(n % 7 == 0, " ").otherwise(F.col("ein")).alias("ein"), F.concat(F.lit(" "), F.replace("name", F.lit(" "), F.lit("  "))).alias("name"), "city", F.lower("state").alias("state"), F.concat("zip_code", F.lit("-1234")).alias("zip_code"), "fap_url")
    path = t.files("nonprofits", as_documents(d, F.floor(F.col("n") / 100), "n"))
    return readers.read_nonprofits(t.spark, path)


NONPROFITS = "SELECT substr(ein, 1, 2) || '-' || substr(ein, 3) AS ein, name, city, upper(state) AS state, zip_code, fap_url FROM {charity_hospitals} WHERE CAST(ein AS BIGINT) % 7 != 0"


def provider_file(t: Tables) -> DataFrame:
    n = F.col("ein").cast("long")
    d = t.charity_hospitals.select(
        F.when(n % 5 == 0, "02").when(n % 2 == 0, "1").otherwise("01").alias("PRVDR_CTGRY_CD"), (n % 6).cast("string").alias("GNRL_CNTL_TYPE_CD"), F.col("ein").alias("PRVDR_NUM"),
        F.concat(F.lit("José  "), "name").alias("FAC_NAME"), F.col("city").alias("CITY_NAME"), F.lower("state").alias("STATE_CD"), F.col("zip_code").cast("int").cast("string").alias("ZIP_CD"),
    )
    path = t.files("providers", as_csv(d, encoding="ISO-8859-1"))
    return readers.read_providers(t.spark, path)


PROVIDERS = "SELECT 'CMS-' || ein AS ein, 'José ' || name AS name, city, upper(state) AS state, zip_code, CAST(NULL AS VARCHAR) AS fap_url FROM {charity_hospitals} WHERE CAST(ein AS BIGINT) % 5 != 0 AND CAST(ein AS BIGINT) % 6 IN (1, 2, 3)"

RANGE = 1024  #: bytes of a range here, so that files of the small tables have several


def by_nation(t: Tables) -> str:
    """A text file of customers for each nation."""
    d = t.customer.select(F.col("c_nationkey").cast("string").alias("nation"), "c_custkey", F.concat_ws("|", "c_custkey", "c_name").alias("value"))
    return t.files("by_nation", lambda p: d.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").text(p))


def text_documents(t: Tables) -> DataFrame:
    """Whole text files as documents."""
    d = readers.read_documents(t.spark, by_nation(t))
    return d.select(F.regexp_extract("doc_id", r"nation=(\d+)", 1).alias("nation"), F.length("text").cast("long").alias("length"), F.sha2("text", 256).alias("text_sha256"), "confidence")


DOCUMENTS = "SELECT nation, length(body) AS length, sha256(body) AS text_sha256, CAST(0.95 AS DOUBLE) AS confidence FROM (SELECT CAST(c_nationkey AS VARCHAR) AS nation, string_agg(CAST(c_custkey AS VARCHAR) || '|' || c_name || chr(10), '' ORDER BY c_custkey) AS body FROM {customer} GROUP BY 1) f"


def file_digests(t: Tables) -> DataFrame:
    """Digest trees of the same files."""
    return readers.tree_fingerprints(t.spark, by_nation(t), RANGE).select(F.regexp_extract("path", r"nation=(\d+)", 1).alias("nation"), "length", "data_hash")


DIGESTS = f"""WITH f AS (SELECT CAST(c_nationkey AS VARCHAR) AS nation, string_agg(CAST(c_custkey AS VARCHAR) || '|' || c_name || chr(10), '' ORDER BY c_custkey) AS body FROM {{customer}} GROUP BY 1),
x AS (SELECT nation, body, unnest(generate_series(0, (length(body) - 1) // {RANGE})) AS k FROM f)
SELECT nation, max(length(body)) AS length, 'sha256-tree:' || sha256(unhex(string_agg(sha256(substr(body, k * {RANGE} + 1, {RANGE})), '' ORDER BY k))) AS data_hash FROM x GROUP BY nation"""


def stored_events(t: Tables) -> DataFrame:
    """JSON events through the ingesting stream, which drops types that aren't allowed."""
    path = t.files("events", lambda p: t.analytics_events.select("event_type", "event_data", "user_id", "created_at").write.json(p))

    def ingest(out: str) -> None:
        streams.store_events(readers.read_events(t.spark, path, streaming=True), f"{out}/rows", f"{out}/state").awaitTermination()

    stored = t.spark.read.parquet(t.files("stored", ingest) + "/rows")
    return stored.groupBy("event_type", F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count("event_data").alias("with_data"))


STORED = "SELECT event_type, CAST(CAST(created_at AS DATE) AS STRING) AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(event_data) AS with_data FROM {analytics_events} WHERE event_type != 'other' GROUP BY ALL"


def registry_files(t: Tables) -> DataFrame:
    d = t.mrf_registry.select("ord", "name", F.when(F.col("alias").isNotNull(), F.array("alias")).alias("aliases"), "mrf_url", F.lit("hospital").alias("type"), F.array("state", "also").alias("states"))
    path = t.files("registry", as_documents(d, F.floor(F.col("ord") / 50), "ord", "hospitals"))
    return readers.read_registry(t.spark, path).select(F.col("ord").cast("long").alias("ord"), "name", "mrf_url", "type", F.array_join("states", ",").alias("states"))


REGISTRY = """WITH x AS (SELECT row_number() OVER (PARTITION BY ord // 50 ORDER BY ord) - 1 AS ord, name, alias, mrf_url, 'hospital' AS type, state || ',' || also AS states FROM {mrf_registry})
SELECT ord, name, mrf_url, type, states FROM x UNION ALL SELECT ord, alias, mrf_url, type, states FROM x WHERE alias IS NOT NULL"""


# ---- loads ------------------------------------------------------------------------------------------------------------


def committed_loads(t: Tables) -> DataFrame:
    """Two loads, one of them tried twice and one that stopped before its commit, as readers see them."""

    def load(path: str) -> None:
        d, when = t.clfs_rates, datetime.datetime(2026, 1, 1)
        for snapshot, rows, source in ((1, d, "a"), (2, d, "a"), (3, d.where("rate_seq % 3 = 0"), "b")):
            sinks.append_load(rows, f"{path}/rates", f"{path}/snapshots", snapshot, "clfs", 2026, when, source)
        d.write.parquet(f"{path}/rates/snapshot_id=4")

    path = t.files("loads", load)
    counts = t.spark.read.schema(sinks.SNAPSHOT).parquet(f"{path}/snapshots").select(F.col("snapshot_id"), "row_count")
    rows = sinks.committed(t.spark, f"{path}/rates", f"{path}/snapshots").groupBy(F.col("snapshot_id").cast("long").alias("snapshot_id")).agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"), F.max("rate").alias("highest"))
    return rows.join(counts, "snapshot_id")


LOADS = """SELECT CAST(1 AS BIGINT) AS snapshot_id, count(*) AS n, count(DISTINCT code) AS codes, max(rate) AS highest, count(*) AS row_count FROM {clfs_rates}
UNION ALL SELECT CAST(3 AS BIGINT), count(*), count(DISTINCT code), max(rate), count(*) FROM {clfs_rates} WHERE rate_seq % 3 = 0"""


def replaced_source(t: Tables) -> DataFrame:
    """Price table by source, two of whose sources come again with other prices."""

    def load(path: str) -> None:
        d = t.hospital_prices.select("source_id", "price_seq", "billing_code", "gross_charge")
        sinks.replace_source(d, path)
        sinks.replace_source(d.where("source_id IN (3, 8) AND gross_charge > 20000").withColumn("gross_charge", F.col("gross_charge") * 2), path)

    stored = t.spark.read.parquet(t.files("by_source", load))
    return stored.groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.count("*").alias("n"), F.min("gross_charge").alias("lowest"), F.max("gross_charge").alias("highest"), F.countDistinct("billing_code").alias("codes"))


REPLACED = """SELECT CAST(source_id AS BIGINT) AS source_id, count(*) AS n, min(charge) AS lowest, max(charge) AS highest, count(DISTINCT billing_code) AS codes
FROM (SELECT source_id, billing_code, CASE WHEN source_id IN (3, 8) THEN gross_charge * 2 ELSE gross_charge END AS charge FROM {hospital_prices} WHERE source_id NOT IN (3, 8) OR gross_charge > 20000) p GROUP BY source_id"""


def merged_table(t: Tables) -> DataFrame:
    """A stored table by code: upserted with later prices of some codes, then with rows for codes that are there already, which are ignored."""
    d = t.community_prices.select("billing_code", "price_id", "amount_paid")

    def load(path: str) -> None:
        sinks.create_table(d.where("price_id % 5 < 3"), path, ["billing_code"], "price_id")
        sinks.merge_into(d.where("price_id % 5 = 3"), path, ["billing_code"], "price_id")
        sinks.merge_into(d.withColumn("price_id", -F.col("price_id")), path, ["billing_code"], "price_id", ignore=True)

    return t.spark.read.parquet(t.files("merged", load)).select("billing_code", "price_id", "amount_paid")


MERGED = """SELECT billing_code, CASE WHEN later IS NOT NULL THEN later WHEN first IS NOT NULL THEN first ELSE -last END AS price_id, amount_paid FROM (
SELECT p.*, last_of.later, last_of.first, last_of.last FROM {community_prices} p JOIN (SELECT billing_code, max(price_id) FILTER (price_id % 5 = 3) AS later, max(price_id) FILTER (price_id % 5 < 3) AS first, max(price_id) AS last FROM {community_prices} GROUP BY billing_code) last_of
ON p.billing_code = last_of.billing_code AND p.price_id = coalesce(later, first, last)) x"""


QUERIES = {
    "s01_physician_file": (physician_file, PFS_FILE),
    "s02_older_physician_files": (older_physician_files, OLDER),
    "s03_laboratory_file": (laboratory_file, CLFS_FILE),
    "s04_drug_file": (drug_file, ASP_FILE),
    "s05_outpatient_files": (outpatient_files, OPPS_FILE),
    "s06_zip_file": (zip_file, ZIP_FILE),
    "s07_price_files": (price_files, PRICE_FILES),
    "s08_bill_files": (bill_files, BILL_FILES),
    "s09_statement_files": (statement_files, STATEMENT_FILES),
    "s10_text_documents": (text_documents, DOCUMENTS),
    "s11_nonprofit_files": (nonprofit_files, NONPROFITS),
    "s12_provider_file": (provider_file, PROVIDERS),
    "s13_file_digests": (file_digests, DIGESTS),
    "s15_registry_files": (registry_files, REGISTRY),
    "st1_stored_events": (stored_events, STORED),
    "k01_committed_loads": (committed_loads, LOADS),
    "k05_replaced_source": (replaced_source, REPLACED),
    "k07_merged_table": (merged_table, MERGED),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
