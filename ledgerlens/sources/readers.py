"""Readers of rate files, price files, bills, statements and lists.

Only header lines come to the driver; the rows are plain scans and projections.
"""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import care_setting, clean_code, code_type, ein, money, price, zip5

LINE = T.StructType().add("lineNumber", "integer").add("cptCode", "string").add("modifier", "string").add("description", "string").add("units", "double").add("billedAmount", "double").add("serviceDate", "string").add("revenueCode", "string")
BILL = T.StructType().add("facilityName", "string").add("facilityType", "string").add("statementDate", "string").add("totalBilled", "double").add("parseConfidence", "double").add("sourceType", "string").add("lineItems", T.ArrayType(LINE))
EOB_LINE = T.StructType().add("lineNumber", "integer").add("cptCode", "string").add("modifier", "string").add("description", "string")
for _name in ("billedAmount", "allowedAmount", "insurancePaid", "patientResponsibility", "copay", "coinsurance", "deductible"):
    EOB_LINE = EOB_LINE.add(_name, "double")
EOB_LINE = EOB_LINE.add("adjustmentReason", "string")
EOB = T.StructType()
for _name in ("insurerName", "planType", "claimNumber", "dateOfService", "providerName", "patientName"):
    EOB = EOB.add(_name, "string")
for _name in ("totalBilled", "totalAllowed", "totalInsurancePaid", "totalPatientResponsibility"):
    EOB = EOB.add(_name, "double")
EOB = EOB.add("lineItems", T.ArrayType(EOB_LINE))

HEADER_LINES = 60  #: a preamble is shorter than this

#: Header names of the older physician fee schedule layout.
PFS_HEADERS = {
    "code": ("HCPCS", "HCPC", "CPT", "HCPCS CODE"),
    "modifier": ("MOD", "MODIFIER", "MOD1"),
    "description": ("DESCRIPTION", "DESC", "SHORT DESCRIPTION"),
    "facility_rate": ("PPAR_FAC_AMOUNT", "PPAR_FAC_FEE", "FACILITY FEE", "FAC_FEE", "FACILITY_AMOUNT", "PAR_FAC_AMOUNT"),
    "non_facility_rate": ("PPAR_NFAC_AMOUNT", "PPAR_NFAC_FEE", "NON-FACILITY FEE", "NFAC_FEE", "NONFACILITY_AMOUNT", "NONFAC_AMOUNT", "PAR_NFAC_AMOUNT"),
    "locality": ("LOCALITY", "LOC", "CARRIER"),
    "locality_name": ("LOCALITY_NAME", "LOC_NAME", "CARRIER_NAME", "LOCALITY NAME"),
    "status_indicator": ("STATUS", "STATUS_CODE", "STATUS_INDICATOR", "STATUS CODE"),
}

#: Header names of hospital price files.
PRICE_HEADERS = {
    "hospital_name": ("hospital_name", "name", "hospital", "facility_name", "facility", "organization_name", "org_name", "provider_name"),
    "hospital_ein": ("ein", "hospital_ein", "employer_id", "employer_identification_number", "tax_id", "federal_tax_id"),
    "payer_name": ("payer_name", "payer", "insurance_company", "insurer", "insurance", "payor_name", "payor"),
    "plan_name": ("plan_name", "plan", "insurance_plan", "benefit_plan", "product_name", "plan_type"),
    "billing_code_type": ("billing_code_type", "code_type", "type", "billing_code_type_code", "code_category"),
    "billing_code": ("billing_code", "code", "cpt_code", "hcpcs_code", "procedure_code", "cpt", "hcpcs", "service_code"),
    "description": ("description", "service_description", "item_description", "procedure_description", "desc", "charge_description", "standard_charge_description"),
    "setting": ("setting", "patient_class", "care_setting", "standard_charge|setting", "inpatient_outpatient"),
    "gross_charge": ("gross_charge", "standard_charge|gross", "gross_charges", "chargemaster_amount", "standard_charge_gross", "standard_charges|gross", "charge_amount"),
    "cash_discount_price": ("discounted_cash_price", "standard_charge|discounted_cash", "cash_discount_price", "self_pay_price", "cash_price", "standard_charge_discounted_cash", "standard_charges|discounted_cash", "discounted_cash"),
    "negotiated_rate": ("payer_specific_negotiated_charge", "standard_charge|negotiated_dollar", "negotiated_rate", "negotiated_charge", "negotiated_dollar", "standard_charge_negotiated_dollar", "standard_charges|negotiated_dollar", "negotiated_dollar_amount"),
    "negotiated_type": ("additional_payer_specific_negotiated_charge-type", "standard_charge|negotiated_percentage", "standard_charge|negotiated_algorithm", "negotiated_type", "charge_type", "rate_type", "methodology", "standard_charge_methodology"),
    "min_negotiated": ("de_identified_min_negotiated_charge", "standard_charge|min", "min_negotiated", "min_charge", "deidentified_min", "standard_charge_min", "standard_charges|min"),
    "max_negotiated": ("de_identified_max_negotiated_charge", "standard_charge|max", "max_negotiated", "max_charge", "deidentified_max", "standard_charge_max", "standard_charges|max"),
    "modifier": ("modifier", "modifiers", "billing_code_modifier", "cpt_modifier", "mod"),
}


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _positional(spark: SparkSession, path: list[str] | str, sep: str = ",", width: int = 24, **options: str) -> DataFrame:
    """CSV rows as columns _c0.. of text, short rows padded with nulls."""
    schema = ", ".join(f"_c{k} string" for k in range(width))
    return spark.read.options(quote='"', escape='"', mode="PERMISSIVE", **options).csv(path, schema=schema, sep=sep)


def _first_lines(spark: SparkSession, paths: list[str] | str, count: int = 1) -> list[tuple[str, list[str]]]:
    """(file, its first lines) of all files in one job: each split that begins a file gives its first rows."""

    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, 0
        for batch in rows:
            take = []
            for k, file in enumerate(batch.column(0).to_pylist()):
                last, had = (last, had + 1) if file == last else (file, 1)
                if had <= count:
                    take.append((k, had))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array([k for k, _ in take], pa.int64())) for c in range(2)] + [pa.array([n for _, n in take], pa.int32())], ["file", "value", "n"])

    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("start"))
    found: dict[str, list[str]] = {}
    for r in sorted(text.where("start = 0").select("file", "value").mapInArrow(first, "file string, value string, n int").collect(), key=lambda r: (r["file"], r["n"])):
        found.setdefault(r["file"], []).append(r["value"])
    return list(found.items())


def _by_header(spark: SparkSession, path: list[str] | str, read: Callable[[list[str], list[str], list[str]], DataFrame], *words: str, first: str | None = None) -> DataFrame:
    """``read(files, header cells, lines up to the header)`` for the files of each header, united.

    A file's header is its first line that holds all words (upper-cased), or whose first cell is ``first``.
    """
    groups: dict[tuple[str, ...], tuple[list[str], list[str]]] = {}
    for file, lines in _first_lines(spark, path, HEADER_LINES):
        for k, line in enumerate(lines):
            cells = [c.strip().strip('"') for c in line.replace("\t", ",").split(",")]
            if (first is not None and cells[0].upper() == first and len(cells) >= 6) or (first is None and all(w in line.upper() for w in words)):
                files, seen = groups.setdefault((*cells, "\t" if "\t" in line else ","), ([], []))
                files.append(file)
                seen += [x for x in lines[: k + 1] if x not in seen]
                break
        else:
            raise ValueError(f"no header with {words or first} in {file}")
    if not groups:
        raise ValueError(f"no lines in {path}")
    out = None
    for cells, (files, seen) in groups.items():
        part = read(files, list(cells), seen)
        out = part if out is None else out.unionByName(part)
    return out


def _sequence(d: DataFrame) -> Column:
    """A number that a row's content fixes, whatever the splits; it only breaks ties, and rows alike are ties for good."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in d.columns]).alias("rate_seq")


# ---- row rules: which rows of a file load; readers and queries share them --------------------------------------------


def has_pfs_rate() -> Column:
    """Physician rows need a code and a rate that isn't zero."""
    return (F.col("code") != "") & ((F.coalesce("facility_rate", F.lit(0.0)) != 0) | (F.coalesce("non_facility_rate", F.lit(0.0)) != 0))


def has_clfs_rate() -> Column:
    """Laboratory rows need a code and a rate that isn't zero."""
    return (F.col("code") != "") & (F.coalesce("rate", F.lit(0.0)) != 0)


def has_asp_limit() -> Column:
    """Drug rows need a code of five letters or digits and a limit."""
    return F.col("code").rlike("^[A-Za-z0-9]{5}$") & F.col("payment_limit").isNotNull()


def has_opps_code() -> Column:
    """Outpatient rows need a code of 4 to 7 characters that begins with a letter or digit; the rate may be missing."""
    return F.length("code").between(4, 7) & F.col("code").rlike("^[A-Za-z0-9]") & ~F.startswith("code", F.lit("HCPCS"))


def has_locality() -> Column:
    """ZIP rows need ZIP, carrier and locality."""
    return (F.col("zip_code") != "") & (F.col("carrier") != "") & (F.col("locality") != "")


def urban_rural(c: Column | str) -> Column:
    """A blank mark is urban."""
    return F.coalesce(_blank_to_null(F.col(c) if isinstance(c, str) else c), F.lit("U"))


def read_pfs(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Physician fee schedule without a header (S01): ten or more columns, the first a year."""
    d = _positional(spark, path).where(F.col("_c0").rlike(r"^\d{4}$") & F.col("_c9").isNotNull())
    d = d.select(
        _sequence(d), clean_code("_c3").alias("code"), _blank_to_null(F.col("_c4")).alias("modifier"), F.lit(None).cast("string").alias("description"), money("_c5").alias("facility_rate"), money("_c6").alias("non_facility_rate"),
        F.trim("_c1").alias("carrier"), F.trim("_c2").alias("locality"), _blank_to_null(F.col("_c9")).alias("status_indicator"), F.lit(year).alias("effective_year"),
    )
    return d.where(has_pfs_rate())


def read_pfs_with_header(spark: SparkSession, path: list[str] | str, year: int) -> DataFrame:
    """Older layout with a header (S02), separated by tabs if there are any; files of one folder may differ."""

    def read(files: list[str], header: list[str], _: list[str]) -> DataFrame:
        *cells, sep = header
        upper = [c.upper() for c in cells]
        at = {name: next((upper.index(a) for a in aliases if a in upper), None) for name, aliases in PFS_HEADERS.items()}
        d = _positional(spark, files, sep, width=len(cells))
        get = lambda n: F.lit(None).cast("string") if at[n] is None else F.col(f"_c{at[n]}")
        return d.where(F.upper(F.trim(F.col("_c0"))) != upper[0]).select(
            _sequence(d), clean_code(get("code")).alias("code"), *[_blank_to_null(get(n)).alias(n) for n in ("modifier", "description", "locality", "locality_name", "status_indicator")],
            money(get("facility_rate")).alias("facility_rate"), money(get("non_facility_rate")).alias("non_facility_rate"), F.lit(year).alias("effective_year"),
        )

    return _by_header(spark, path, read, "HCPC").where(has_pfs_rate())


def _by_name(spark: SparkSession, files: list[str], header: list[str], seen: list[str]) -> DataFrame:
    """Rows past the header, columns named by it. The few lines up to it are known by their text, so files stay splittable."""
    *cells, _ = header
    schema = ", ".join(f"_c{k} string" for k in range(len(cells)))
    d = spark.read.text(files).where(~F.col("value").isin(*seen) & (F.trim("value") != ""))
    d = d.select(F.from_csv("value", schema, {"quote": '"', "escape": '"'}).alias("r"))
    return d.select(*[F.col(f"r._c{k}").alias(c.upper()) for k, c in enumerate(cells)])


def read_clfs(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Laboratory fee schedule (S03, P04): a preamble, then a header with YEAR, HCPCS and RATE."""

    def read(files: list[str], header: list[str], seen: list[str]) -> DataFrame:
        d = _by_name(spark, files, header, seen)
        return d.where("RATE IS NOT NULL").select(
            _sequence(d), clean_code("HCPCS").alias("code"), _blank_to_null(F.col("MOD")).alias("modifier"), money("RATE").alias("rate"), F.col("SHORTDESC").alias("short_desc"), F.col("LONGDESC").alias("long_desc"),
            F.col("INDICATOR").alias("indicator"), F.col("EFF_DATE").alias("effective_date"), F.lit(year).alias("effective_year"),
        )

    return _by_header(spark, path, read, "YEAR", "HCPCS", "RATE").where(has_clfs_rate())


def read_asp(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Drug limits (S04, P05): a header with HCPCS CODE and PAYMENT LIMIT; five-character codes with a limit."""

    def read(files: list[str], header: list[str], seen: list[str]) -> DataFrame:
        d = _by_name(spark, files, header, seen)
        return d.select(
            _sequence(d), clean_code("HCPCS CODE").alias("code"), F.col("SHORT DESCRIPTION").alias("short_desc"), F.col("HCPCS CODE DOSAGE").alias("dosage"), money("PAYMENT LIMIT").alias("payment_limit"),
            money("CO-INSURANCE PERCENTAGE").alias("coinsurance_pct"), money("VACCINE LIMIT").alias("vaccine_limit"), money("BLOOD LIMIT").alias("blood_limit"), F.col("NOTES").alias("notes"), F.lit(year).alias("effective_year"),
        )

    return _by_header(spark, path, read, "HCPCS CODE", "PAYMENT LIMIT").where(has_asp_limit())


def read_opps(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Outpatient rates (S05, P06): the header's first cell is HCPCS CODE; rows without a rate stay."""

    def read(files: list[str], header: list[str], seen: list[str]) -> DataFrame:
        d = _by_name(spark, files, header, seen)
        return d.select(
            _sequence(d), clean_code("HCPCS CODE").alias("code"), F.col("SHORT DESCRIPTOR").alias("short_desc"), _blank_to_null(F.col("SI")).alias("status_indicator"), _blank_to_null(F.col("APC")).alias("apc"),
            money("RELATIVE WEIGHT").alias("relative_weight"), money("PAYMENT RATE").alias("payment_rate"), money("NATIONAL UNADJUSTED COPAYMENT").alias("national_copay"), money("MINIMUM UNADJUSTED COPAYMENT").alias("min_copay"), F.lit(year).alias("effective_year"),
        )

    return _by_header(spark, path, read, first="HCPCS CODE").where(has_opps_code())


def read_zip_locality(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width ZIP to locality file."""
    cut = lambda lo, n: F.trim(F.substring("value", lo, n))
    d = spark.read.text(path).where(F.length("value") >= 14).select(
        cut(3, 5).alias("zip_code"), cut(8, 5).alias("carrier"), cut(13, 2).alias("locality"), cut(1, 2).alias("state"), urban_rural(cut(15, 1)).alias("urban_rural"),
        cut(16, 2).alias("lab_locality"), cut(18, 1).alias("rural_2"), cut(21, 1).alias("plus_four"), cut(23, 1).alias("part_b"), cut(76, 5).alias("year_quarter"),
    )
    return d.where(has_locality())


def normal_header(name: str) -> str:
    """Lower case; anything but letters, digits, '|' and '_' becomes one '_' (F07)."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9|_]", "_", name.lower())).strip("_")


def resolve_headers(names: list[str]) -> dict[str, str | None]:
    """Column of each field: by alias, else the first header that holds an alias or is held by one."""
    normal = {normal_header(n): n for n in reversed(names)}
    order = [normal_header(n) for n in names]
    out: dict[str, str | None] = {}
    for field, aliases in PRICE_HEADERS.items():
        hit = next((a for a in aliases if a in normal), None) or next((h for h in order if h and any(h in a or a in h for a in aliases)), None)
        out[field] = normal[hit] if hit else None
    return out


def read_hospital_prices(spark: SparkSession, paths: list[str] | str, source_url: str | None = None, hospital_name: str | None = None) -> DataFrame:
    """Hospital price files (S07, P08, P02, P09). Files with one header are one scan; the scans are united."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, (line,) in _first_lines(spark, paths):
        groups.setdefault(tuple(c if c else f"_c{k}" for k, c in enumerate(next(csv.reader([line])))), []).append(file)
    out = None
    for names, files in groups.items():
        at = resolve_headers(list(names))
        d = spark.read.csv(files, header=True, escape='"', schema=", ".join(f"`{n}` string" for n in names))
        get = lambda n, at=at: F.lit(None).cast("string") if at[n] is None else F.col(f"`{at[n]}`")
        d = d.select(
            (F.lit(hospital_name) if hospital_name else _blank_to_null(get("hospital_name"))).alias("hospital_name"), *[_blank_to_null(get(n)).alias(n) for n in ("hospital_ein", "payer_name", "plan_name", "description", "negotiated_type", "modifier")],
            code_type(get("billing_code_type"), get("billing_code")).alias("billing_code_type"), clean_code(get("billing_code")).alias("billing_code"), care_setting(get("setting")).alias("setting"),
            *[price(get(n)).alias(n) for n in ("gross_charge", "cash_discount_price", "negotiated_rate", "min_negotiated", "max_negotiated")], F.coalesce(F.lit(source_url), F.col("_metadata.file_path")).alias("source_url"),
        )
        d = d.where(F.col("billing_code_type").isin("CPT", "HCPCS") & (F.col("billing_code") != "") & F.coalesce("gross_charge", "cash_discount_price", "negotiated_rate", "min_negotiated", "max_negotiated").isNotNull())
        out = d if out is None else out.unionByName(d)
    return out


def _records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """JSON records with a bill_id made from file and content, so that each has its own; a record repeated in a file is one."""
    d = spark.read.schema(schema).json(path, multiLine=multi_line)
    return d.withColumn("bill_id", F.sha2(F.concat_ws("\n", F.col("_metadata.file_path"), F.to_json(F.struct(*schema.names))), 256)).dropDuplicates(["bill_id"])


def _bill_head() -> list[Column]:
    return [F.col("facilityName").alias("facility_name"), F.coalesce("facilityType", F.lit("unknown")).alias("facility_type"), F.col("statementDate").alias("statement_date"), F.col("totalBilled").alias("total_billed"), F.col("parseConfidence").alias("parse_confidence"), F.col("sourceType").alias("source_type")]


def _bill_line() -> list[Column]:
    return [
        F.coalesce("l.lineNumber", F.col("at") + 1).alias("line_number"), F.col("l.cptCode").alias("code"), F.col("l.modifier").alias("modifier"), F.col("l.description").alias("description"),
        F.coalesce("l.units", F.lit(1.0)).alias("units"), F.col("l.billedAmount").alias("billed_amount"), F.col("l.serviceDate").alias("service_date"), F.col("l.revenueCode").alias("revenue_code"),
    ]


def read_bills(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bill headers and lines from JSON (S08): units default to 1, facility type to unknown.

    Files hold one record a line and are read in splits; with ``multi_line`` each holds one record or an array of them.
    """
    d = _records(spark, path, BILL, multi_line)
    return d.select("bill_id", *_bill_head()), d.select("bill_id", F.posexplode("lineItems").alias("at", "l")).select("bill_id", *_bill_line())


def read_bill_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The lines of ``read_bills`` with their headers, in one pass over the records and without a join."""
    x = _records(spark, path, BILL, multi_line).select("bill_id", F.struct(*_bill_head()).alias("h"), F.posexplode("lineItems").alias("at", "l"))
    return x.select("bill_id", "h.*", *_bill_line())


def _eob_head() -> list[Column]:
    return [F.col("insurerName").alias("insurer_name"), F.upper("planType").alias("plan_type"), F.col("claimNumber").alias("claim_number"), F.col("totalBilled").alias("amount_billed"), F.col("totalAllowed").alias("total_allowed"), F.col("totalInsurancePaid").alias("plan_paid"), F.col("totalPatientResponsibility").alias("total_patient_responsibility")]


def _eob_line() -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.coalesce("l.lineNumber", F.col("at") + 1).alias("line_number"), clean_code("l.cptCode").alias("code"), F.col("l.description").alias("description"), F.col("l.billedAmount").alias("billed_amount"), F.col("l.allowedAmount").alias("allowed_amount"),
        F.col("l.insurancePaid").alias("insurance_paid"), F.col("l.patientResponsibility").alias("patient_responsibility"), zero("l.copay").alias("copay"), zero("l.coinsurance").alias("coinsurance"), zero("l.deductible").alias("deductible"), F.col("l.adjustmentReason").alias("adjustment_reason"),
    ]


def read_eobs(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Statement headers and lines from JSON as in ``read_bills`` (S09): plan type and codes in upper case."""
    d = _records(spark, path, EOB, multi_line)
    head = d.select("bill_id", *_eob_head()).withColumnRenamed("total_patient_responsibility", "patient_responsibility")
    return head, d.select("bill_id", F.posexplode("lineItems").alias("at", "l")).select("bill_id", *_eob_line())


def read_eob_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The lines of ``read_eobs`` with their headers, whose patient share is ``total_patient_responsibility``, as in ``read_bill_rows``."""
    x = _records(spark, path, EOB, multi_line).select("bill_id", F.struct(*_eob_head()).alias("h"), F.posexplode("lineItems").alias("at", "l"))
    return x.select("bill_id", "h.*", *_eob_line())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"), F.lit(0.95).alias("confidence"))


def read_nonprofits(spark: SparkSession, path: str) -> DataFrame:
    """Nonprofit hospitals from JSON."""
    d = spark.read.json(path, schema="ein string, name string, city string, state string, zip_code string, fap_url string", multiLine=True)
    return d.where("trim(ein) != '' AND trim(name) != ''").select(ein("ein").alias("ein"), F.regexp_replace(F.trim("name"), r"\s+", " ").alias("name"), "city", F.upper("state").alias("state"), zip5("zip_code").alias("zip_code"), "fap_url")


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    """Hospitals of a provider-of-services file (S12, P27): short-term hospitals (01) under nonprofit control (01-03)."""
    d = spark.read.csv(path, header=True, encoding="ISO-8859-1", quote="")
    keep = (F.lpad("PRVDR_CTGRY_CD", 2, "0") == "01") & F.lpad("GNRL_CNTL_TYPE_CD", 2, "0").isin("01", "02", "03")
    return d.where(keep).select(F.concat(F.lit("CMS-"), "PRVDR_NUM").alias("ein"), F.regexp_replace(F.trim("FAC_NAME"), r"\s+", " ").alias("name"), F.col("CITY_NAME").alias("city"), F.upper("STATE_CD").alias("state"), zip5("ZIP_CD").alias("zip_code"), F.lit(None).cast("string").alias("fap_url"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file (S13, F16); a file is one row's content here, so at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("data_hash"))


RANGE = 1 << 24  #: bytes of a range of a digest tree; part of the digest's definition


def tree_fingerprints(spark: SparkSession, path: str, size: int = RANGE, tasks: int | None = None) -> DataFrame:
    """(path, length, data_hash) of files of any size (S13): the sha256 of the sha256 digests of their ranges of ``size`` bytes, in order.

    Only the listing comes from Spark's file source, which doesn't read contents that aren't asked for. Ranges are dealt
    over ``tasks``, whatever file they belong to, each is read by itself through Arrow's file systems, and only digests are
    shuffled. The digest depends on ``size``, never on how ranges are dealt. Empty files give no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.withColumn("at", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size) - 1))).select("path", "length", F.col("at").cast("long").alias("at"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with store.open_input_file(name) as f:
                    f.seek(at * size)
                    left, h = size, hashlib.sha256()
                    while left and (piece := f.read(min(left, 1 << 20))):
                        h.update(piece)
                        left -= len(piece)
                out.append(h.digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["path", "length", "at", "digest"])

    dealt = ranges.repartition(tasks or spark.sparkContext.defaultParallelism, "path", "at")
    leaves = dealt.mapInArrow(digest, "path string, length long, at long, digest binary").groupBy("path", "length").agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("d"))
    joined = F.aggregate("d", F.lit(b""), lambda whole, x: F.concat(whole, x["digest"]))
    return leaves.select("path", "length", F.concat(F.lit("sha256-tree:"), F.sha2(joined, 256)).alias("data_hash"))


EVENT_SCHEMA = "event_type string, event_data string, user_id long, created_at timestamp"


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Analytics events of the allowed types from JSON lines (S14, ST1)."""
    from ..operators.stats import EVENT_TYPES

    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT_SCHEMA).json(path).where(F.col("event_type").isin(*EVENT_TYPES))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Price-file registry from JSON (S15): one row per name or alias."""
    d = spark.read.json(path, multiLine=True, schema="hospitals array<struct<name string, aliases array<string>, mrf_url string, type string, states array<string>>>")
    x = d.select(F.posexplode("hospitals").alias("ord", "h")).select("ord", "h.*")
    return x.select("ord", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), "mrf_url", "type", "states")
