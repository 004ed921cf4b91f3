"""Queries for text extraction, and for row rules of price files."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import extraction as ex
from ..sources import readers
from .bindings import Tables, with_views
from .prices import dictionary, resolved_sql
from .rates import r

#: The operators' own patterns, which are data.
LETTERS, DIGITS, DOLLAR, DECIMAL, MONEY = ex.LETTER_CODE, ex.DIGIT_CODE, ex.DOLLAR, ex.DECIMAL, ex.MONEY


def found(pattern: str, line: str = "line") -> str:
    return f"regexp_extract_all({line}, '{pattern}', 1)"


def amounts(line: str = "line") -> str:
    """Amounts of a line as SQL."""
    numbers = lambda p: f"list_transform({found(p, line)}, lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))"
    dollars, bare = f"list_filter({numbers(DOLLAR)}, lambda v: v > 0)", f"list_filter({numbers(DECIMAL)}, lambda v: v > 0 AND v < 1000000)"
    return f"CASE WHEN len({dollars}) > 0 THEN {dollars} ELSE {bare} END"


_EVERY_CODE = rf"list_concat(list_transform(list_concat({found(r'(?i)\b(J\d{4})\b')}, {found(LETTERS)}), lambda x: upper(x)), list_filter({found(DIGITS)}, lambda x: CAST(x AS INT) >= 100))"
#: Distinct codes of a line in order, as SQL.
CODES = f"list_filter({_EVERY_CODE}, lambda x, i: list_position({_EVERY_CODE}, x) = i)"
AMOUNTS = amounts()
CLEAN = f"substr(trim(regexp_replace(regexp_replace(line, '{ex.DROPPED}', '', 'g'), '{ex.DRAWN}', ' ', 'g')), 1, 120)"
MODS = ", ".join(f"'{m}'" for m in ex.MODIFIERS)
AFTER = rf"upper(regexp_extract(ltrim(substr(line, instr(upper(line), code) + length(code))), '{ex.AFTER_CODE}', 1))"

#: CTEs over the documents' lines: bl has the coded lines (T01-T05, T07), u the others with an amount and a word.
LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM <bill_docs>)"
CODED = f"""{LINES}, nx AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS following FROM ln),
am AS (SELECT *, {CODES} AS codes, coalesce(({AMOUNTS})[-1], ({amounts('following')})[-1]) AS billed_amount FROM nx),
cd AS (SELECT doc_id, line_no, line, billed_amount, unnest(codes) AS code, generate_subscripts(codes, 1) AS nth FROM am WHERE billed_amount > 0),
md AS (SELECT *, {AFTER} AS m FROM cd)"""
FIRST = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, nth) AS line_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code, billed_amount ORDER BY line_no, nth) AS rn FROM {}) WHERE rn = 1"
BL = f"{CODED}, bl AS ({FIRST.format('md')})"
U = f"u AS (SELECT * FROM (SELECT doc_id, line_no, {CLEAN} AS description, ({AMOUNTS})[-1] AS billed_amount FROM ln WHERE len({CODES}) = 0) WHERE billed_amount IS NOT NULL AND regexp_matches(description, '[A-Za-z]{{5}}'))"
_RESOLVED = lambda table: resolved_sql(table).replace("{", "<").replace("}", ">")
ALL_LINES = f"{CODED}, {U}, {_RESOLVED('u')}, al AS (SELECT doc_id, line_no, code, nth, billed_amount FROM md UNION ALL SELECT doc_id, line_no, code, 0, billed_amount FROM u JOIN resolved USING (description)), bl AS ({FIRST.format('al')})"

#: Statement lines (T18) and labelled amounts.
_WORDS = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_HEADS = " OR ".join(f"(contains(lower(said), '{x}') AND contains(lower(said), '{y}'))" for x, y in ex.HEAD_PAIRS)
_GIVEN = f"list_transform({found(MONEY)}, lambda x: {r("TRY_CAST(replace(x, ',', '') AS DOUBLE)", 2)})"
_LEFT = f"regexp_replace(line, '{MONEY}', '', 'g')"
EOB_LINES = rf"""{LINES}, sm AS (SELECT doc_id, line_no, list_filter({_GIVEN}, lambda v: v IS NOT NULL) AS a, {_WORDS(_LEFT)} AS said FROM ln),
sk AS (SELECT *, nullif(regexp_extract(said, '\b([A-Z0-9]\d{{4}})\b', 1), '') AS code FROM sm WHERE len(a) >= 2 AND regexp_matches(said, '[A-Za-z]{{3}}') AND NOT ({_HEADS})),
el AS (SELECT doc_id, line_no, code, coalesce(nullif({_WORDS("replace(said, coalesce(code, ''), '')")}, ''), 'Unknown service') AS description, a[1] AS billed_amount, a[2] AS allowed_amount, a[3] AS insurance_paid, a[4] AS patient_responsibility FROM sk)"""


def _label(name: str) -> str:
    has = " OR ".join(f"contains(lower(line), '{v}')" for v in ex.LABELS[name])
    return f"{r(f'arg_min(v, line_no) FILTER (v IS NOT NULL AND ({has}))', 2)} AS {name}"


SUMMARY = rf"""lv AS (SELECT doc_id, line_no, line, TRY_CAST(replace(coalesce(nullif(regexp_extract(line, '{MONEY}', 1), ''), regexp_extract(line, '([\d,]+\.\d{{2}})\s*$', 1)), ',', '') AS DOUBLE) AS v FROM ln),
sa AS (SELECT doc_id, {', '.join(_label(n) for n in ex.LABELS)} FROM lv GROUP BY doc_id),
su AS (SELECT doc_id, {', '.join(f"CASE WHEN {' + '.join(f'CAST({m} IS NOT NULL AS INT)' for m in ex.LABELS)} >= 2 THEN {n} END AS {n}" for n in ex.LABELS)} FROM sa)"""


def _first(groups: tuple, value: str) -> str:
    """The first of several patterns' values that isn't empty, as SQL."""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{ex.after_label(g, value)}', 1), '')" for g in groups) + ")"


def _name(groups: tuple, most: int) -> str:
    """The first labelled value that is no amount and has over two letters, as SQL."""
    values = [rf"regexp_replace(trim(regexp_extract(text, '{ex.after_label(g, '([^' + chr(92) + 'n]+)')}', 1)), '\s{{2,}}', ' ', 'g')" for g in groups]
    return "coalesce(" + ", ".join(f"CASE WHEN length({v}) > 2 AND NOT starts_with({v}, '$') THEN substr({v}, 1, {most}) END" for v in values) + ")"


#: Documents led by labels whose values are amounts, too short, or names.
LABELLED = (
    "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Provider: $55.00' || chr(10) || 'Facility: North  Wing' WHEN 1 THEN 'Services provided by  Dr.   Ann Lee' WHEN 2 THEN 'Doctor: X' || chr(10) || 'Rendering provider: ab'"
    " WHEN 3 THEN 'Physician: Jo Day' || chr(10) || 'Member: $1' ELSE 'Member: ab' || chr(10) || 'Member name: Al Berg' END || chr(10) || text"
)
DAY = rf"coalesce(nullif(regexp_extract(text, '(?i)(?:date\s+of\s+service|service\s+date|dos|date)[:\s]+{ex.DAY}', 1), ''), nullif(regexp_extract(text, '\b{ex.DAY}\b', 1), ''))"
ISO = "CASE WHEN regexp_matches(day, '^[0-9]{4}-') THEN day ELSE CASE WHEN length(p[3]) = 2 THEN '20' || p[3] ELSE p[3] END || '-' || lpad(p[1], 2, '0') || '-' || lpad(p[2], 2, '0') END"
_LOW = r"regexp_replace(lower({}), '\s+', ' ', 'g')"
_FACILITY = f"regexp_matches({_LOW.format('x')}, '{'|'.join(ex.FACILITY_WORDS)}')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches({_LOW.format('text')}, '{p}') THEN '{k}'" for k, p in ex.FACILITY_TYPES.items()) + " ELSE 'unknown' END"
GATE = rf"CASE WHEN regexp_matches(text, '\b[A-Z0-9]\d{{4}}\b') THEN 0.95e0 WHEN regexp_matches(text, '\$\s*[\d,]|\d\.\d{{2}}\b') AND regexp_matches({_LOW.format("text || ' '")}, '{'|'.join(ex.MEDICAL)}') THEN 0.8e0 END"
HAS = lambda p: f"regexp_matches(text, '(?i){p}')"


def _sql(s: str) -> str:
    """SQL whose views stand in angle brackets, since patterns hold braces."""
    s = re.sub(r"<(\w+)>", "\x01\\1\x02", s).replace("{", "\x03").replace("}", "\x04").replace("\x01", "{").replace("\x02", "}")
    return with_views(s).replace("\x03", "{").replace("\x04", "}")


def lines(t: Tables):
    return t.line_texts


def docs(t: Tables):
    """The documents, stored: the cascade's queries read them several times."""
    return t.step("docs", lambda: t.bill_docs)


def bill_lines(t: Tables):
    return ex.bill_lines_from_text(docs(t), dictionary(t), t.keep)


QUERIES = {
    "t01_line_codes": (lambda t: lines(t).select("doc_id", "line_no", F.array_join(ex.codes_in("line"), ",").alias("codes")), f"SELECT doc_id, line_no, array_to_string({CODES}, ',') AS codes FROM <line_texts>"),
    "t02_line_amounts": (
        lambda t: lines(t).select("doc_id", "line_no", F.size(ex.amounts_in("line")).cast("long").alias("n"), F.array_max(ex.amounts_in("line")).alias("most")),
        f"SELECT doc_id, line_no, len({AMOUNTS}) AS n, list_max({AMOUNTS}) AS most FROM <line_texts>",
    ),
    "t03_billed_amount": (
        lambda t: lines(t).select("doc_id", "line_no", ex.billed_amount(F.col("line"), F.lit("")).alias("amount")),
        f"SELECT doc_id, line_no, ({AMOUNTS})[-1] AS amount FROM <line_texts>",
    ),
    "t04_modifier": (
        lambda t: lines(t).where(F.size(ex.codes_in("line")) > 0).select("doc_id", "line_no", ex.modifier_after("line", F.get(ex.codes_in("line"), F.lit(0))).alias("modifier")),
        f"WITH c AS (SELECT *, ({CODES})[1] AS code FROM <line_texts> WHERE len({CODES}) > 0), m AS (SELECT *, {AFTER} AS m FROM c) SELECT doc_id, line_no, CASE WHEN m IN ({MODS}) THEN m END AS modifier FROM m",
    ),
    "t05_clean_description": (lambda t: lines(t).select("doc_id", "line_no", ex.clean_description("line").alias("description")), f"SELECT doc_id, line_no, {CLEAN} AS description FROM <line_texts>"),
    "t06_uncoded_lines": (
        lambda t: ex.uncoded_lines(lines(t).select("doc_id", F.col("line").alias("text"))).select("doc_id", "description", "billed_amount"),
        f"WITH ln AS (SELECT * FROM <line_texts>), {U} SELECT doc_id, description, billed_amount FROM u",
    ),
    "t06_resolved_lines": (
        lambda t: bill_lines(t).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "code", "billed_amount"),
        f"WITH {ALL_LINES} SELECT doc_id, line_number, code, billed_amount FROM bl",
    ),
    "t07_bill_lines": (
        lambda t: ex.bill_lines_from_text(t.bill_docs).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "code", "modifier", "billed_amount"),
        f"WITH {BL} SELECT doc_id, line_number, code, CASE WHEN m IN ({MODS}) THEN m END AS modifier, billed_amount FROM bl",
    ),
    "t08_facility_type": (lambda t: t.bill_docs.select("doc_id", ex.facility_type("text").alias("facility_type")), f"SELECT doc_id, {_KIND} AS facility_type FROM <bill_docs>"),
    "t09_facility_name": (
        lambda t: t.bill_docs.select("doc_id", ex.facility_name("text").alias("name")),
        rf"WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != '') AS l FROM <bill_docs>) SELECT doc_id, coalesce(list_filter(l[1:8], lambda x: length(x) BETWEEN 6 AND 119 AND {_FACILITY})[1], list_filter(l[1:5], lambda x: length(x) > 5 AND regexp_matches(x, '^\D') AND regexp_matches(x, '[A-Za-z]{{3}}'))[1]) AS name FROM f",
    ),
    "t10_service_date": (lambda t: t.bill_docs.select("doc_id", ex.service_date("text").alias("day")), f"SELECT doc_id, {ISO} AS day FROM (SELECT doc_id, {DAY} AS day, string_split_regex({DAY}, '[/-]') AS p FROM <bill_docs>)"),
    "t11_patient_name": (
        lambda t: t.bill_docs.select("doc_id", ex.patient_name("text").alias("patient")),
        r"SELECT doc_id, nullif(regexp_extract(text, 'Patient\s+Name\s*:?\s*([A-Z][a-z]+(?: [A-Z]\.? [A-Z][a-z]+| [A-Z][a-z]+)?)', 1), '') AS patient FROM <bill_docs>",
    ),
    "t12_document_gate": (
        lambda t: t.bill_docs.select("doc_id", ex.document_gate(F.regexp_replace("text", r"\b[A-Z0-9]\d{4}\b", F.when(F.col("doc_id") % 2 == 0, F.lit("-")).otherwise(F.lit("99213")))).alias("gate")),
        rf"SELECT doc_id, {GATE} AS gate FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '\b[A-Z0-9]\d{{4}}\b', '-', 'g') ELSE regexp_replace(text, '\b[A-Z0-9]\d{{4}}\b', '99213', 'g') END AS text FROM <bill_docs>)",
    ),
    "t13_bills_from_text": (
        lambda t: ex.bills_from_text(docs(t), dictionary(t), t.keep).select("doc_id", "total_billed", "n_lines", "facility_type", "parse_confidence"),
        f"WITH {ALL_LINES}, s AS (SELECT doc_id, {r('sum(billed_amount)', 2)} AS total, count(*) AS n FROM bl GROUP BY doc_id) SELECT b.doc_id, coalesce(total, 0) AS total_billed, coalesce(n, 0) AS n_lines, {_KIND} AS facility_type, {GATE} AS parse_confidence FROM <bill_docs> b LEFT JOIN s ON b.doc_id = s.doc_id",
    ),
    "t14_eob_detection": (
        lambda t: ex.eobs_from_text(t.bill_docs).select("doc_id", F.col("hits").cast("long").alias("hits"), "is_eob", fn.round_to("confidence", 2).alias("confidence")),
        "WITH h AS (SELECT doc_id, confidence, " + " + ".join(f"CAST(contains(lower(text), '{p}') AS BIGINT)" for p in ex.EOB_PHRASES) + f" AS hits FROM <bill_docs>) SELECT doc_id, hits, hits >= 2 AS is_eob, {r('least(1, confidence + least(hits * 0.05, 0.15))', 2)} AS confidence FROM h",
    ),
    "t15_insurer_plan": (
        lambda t: ex.eobs_from_text(t.bill_docs).select("doc_id", "insurer", "plan_type"),
        "SELECT doc_id, CASE " + " ".join(f"WHEN {HAS(p)} THEN '{n}'" for p, n in ex.INSURERS) + " END AS insurer, CASE " + " ".join(f"WHEN {HAS(p)} THEN '{n}'" for p, n in ex.PLANS) + " END AS plan_type FROM <bill_docs>",
    ),
    "t16_claim_number": (
        lambda t: ex.eobs_from_text(t.bill_docs.withColumn("text", F.expr(LABELLED))).select("doc_id", "claim_number", "service_date", "patient", "provider"),
        f"SELECT doc_id, {_first(ex.CLAIM_LABELS, '([A-Z0-9]{4,20})')} AS claim_number, {_first(ex.DAY_LABELS, r'(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})')} AS service_date, {_name(ex.PATIENT_LABELS, 80)} AS patient, {_name(ex.PROVIDER_LABELS, 100)} AS provider FROM (SELECT doc_id, {LABELLED} AS text FROM <bill_docs>)",
    ),
    "t17_summary": (lambda t: ex.eobs_from_text(t.bill_docs).select("doc_id", *ex.LABELS), f"WITH {LINES}, {SUMMARY} SELECT * FROM su"),
    "t18_eob_lines": (
        lambda t: ex.eob_lines_from_text(t.bill_docs).select("doc_id", "code", "description", "billed_amount", "allowed_amount", "insurance_paid", "patient_responsibility"),
        f"WITH {EOB_LINES} SELECT doc_id, code, description, billed_amount, allowed_amount, insurance_paid, patient_responsibility FROM el",
    ),
    "t19_resolved_codes": (
        lambda t: ex.with_resolved_codes(t.keep("statement_lines", ex.eob_lines_from_text(docs(t))), dictionary(t), t.keep).select("doc_id", "description", "code", "billed_amount"),
        f"WITH {EOB_LINES}, uc AS (SELECT DISTINCT description FROM el WHERE code IS NULL), {_RESOLVED('uc')} SELECT doc_id, el.description, coalesce(el.code, resolved.code) AS code, billed_amount FROM el LEFT JOIN resolved ON el.description = resolved.description",
    ),
    "t20_eob_documents": (
        lambda t: ex.eob_documents(t.bill_docs).select("doc_id", "description", "billed_amount", "allowed_amount"),
        f"WITH {EOB_LINES}, {SUMMARY} SELECT doc_id, description, billed_amount, allowed_amount FROM el UNION ALL SELECT doc_id, 'Summary', amount_billed, {r('amount_billed - coalesce(network_discount, 0)', 2)} FROM su WHERE amount_billed IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM el)",
    ),
    "t21_bills_or_statements": (
        lambda t: ex.bills_or_statements(t.bill_docs).groupBy("code").agg(F.count("*").alias("n"), F.max("line_number").cast("long").alias("most")),
        f"WITH {BL}, {EOB_LINES.removeprefix(LINES + ', ')} SELECT code, count(*) AS n, max(line_number) AS most FROM (SELECT code, line_number FROM bl UNION ALL SELECT code, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) FROM el WHERE code IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM bl)) GROUP BY code",
    ),
    "w12_next_line": (
        lambda t: ex.bill_lines_from_text(t.bill_docs).where("code = '99213'").select("doc_id", "billed_amount"),
        f"WITH {BL} SELECT doc_id, billed_amount FROM bl WHERE code = '99213'",
    ),
    "p01_money_text": (
        lambda t: t.orders.select("o_orderkey", fn.money(F.when(F.col("o_orderkey") % 5 == 0, "N/A").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" ")))).alias("v")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS v FROM <orders>",
    ),
    "p02_price_text": (
        lambda t: t.orders.select("o_orderkey", fn.price(F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.concat(F.lit('"'), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.format_number("o_totalprice", 2), F.lit('"')))).alias("v")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS v FROM <orders>",
    ),
    "p03_pfs_rows": (lambda t: t.pfs_rates.where(readers.has_pfs_rate()).select("rate_seq"), "SELECT rate_seq FROM <pfs_rates> WHERE coalesce(facility_rate, 0) != 0 OR coalesce(non_facility_rate, 0) != 0"),
    "p04_clfs_rows": (lambda t: t.clfs_rates.where(readers.has_clfs_rate()).select("rate_seq", "code"), "SELECT rate_seq, code FROM <clfs_rates> WHERE code != '' AND coalesce(rate, 0) != 0"),
    "p05_asp_rows": (
        lambda t: t.asp_rates.withColumns({"code": F.when(F.col("rate_seq") % 5 == 0, F.concat("code", F.lit("X"))).otherwise(F.lower("code")), "payment_limit": F.when(F.col("rate_seq") % 7 > 0, F.col("payment_limit"))}).where(readers.has_asp_limit()).select("rate_seq", fn.clean_code("code").alias("code")),
        "SELECT rate_seq, upper(code) AS code FROM <asp_rates> WHERE rate_seq % 5 > 0 AND rate_seq % 7 > 0 AND payment_limit IS NOT NULL AND length(code) = 5",
    ),
    "p06_opps_rows": (
        lambda t: t.opps_rates.withColumn("code", F.when(F.col("rate_seq") % 5 == 0, F.substring("code", 1, 3)).when(F.col("rate_seq") % 5 == 1, F.concat(F.lit("*"), "code")).when(F.col("rate_seq") % 5 == 2, F.lit("HCPCS")).otherwise(F.col("code"))).where(readers.has_opps_code()).select("rate_seq", "payment_rate"),
        "SELECT rate_seq, payment_rate FROM <opps_rates> WHERE rate_seq % 5 > 2 AND length(code) BETWEEN 4 AND 7",
    ),
    "p07_zip_rows": (
        lambda t: t.zip_locality.withColumn("carrier", F.when(F.col("zip_code").endswith("3"), "").otherwise(F.col("carrier"))).where(readers.has_locality()).select("zip_code", readers.urban_rural("urban_rural").alias("urban_rural")),
        "SELECT zip_code, coalesce(urban_rural, 'U') AS urban_rural FROM <zip_locality> WHERE zip_code NOT LIKE '%3'",
    ),
    "p08_price_rows": (
        lambda t: t.hospital_prices.withColumn("kind", fn.code_type(F.when(F.col("price_seq") % 2 == 0, F.col("billing_code_type")), "billing_code")).where("kind IN ('CPT', 'HCPCS')").groupBy("kind").agg(F.count("*").alias("n")),
        "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN price_seq % 2 = 0 THEN billing_code_type WHEN regexp_matches(billing_code, '^[0-9]{5}$') THEN 'CPT' WHEN regexp_matches(billing_code, '^[A-Z][0-9]{4}$') THEN 'HCPCS' END AS kind FROM <hospital_prices>) WHERE kind IN ('CPT', 'HCPCS') GROUP BY kind",
    ),
    "p09_care_setting": (
        lambda t: t.orders.select("o_orderkey", fn.care_setting(F.when(F.col("o_orderkey") % 4 == 0, " Inpatient ").when(F.col("o_orderkey") % 4 == 1, "BOTH").when(F.col("o_orderkey") % 4 == 2, "Outpatient/Inpatient").otherwise("Office")).alias("setting")),
        "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'inpatient' WHEN 3 THEN 'office' ELSE 'both' END AS setting FROM <orders>",
    ),
    "f01_rounding": (lambda t: t.lineitem.select("l_orderkey", fn.round_to(F.col("l_extendedprice") * F.col("l_tax"), 1).alias("v")), f"SELECT l_orderkey, {r('l_extendedprice * l_tax', 1)} AS v FROM <lineitem>"),
    "f09_iso_dates": (lambda t: t.bill_docs.select("doc_id", fn.iso_date(F.regexp_extract("text", ex.DAY, 1)).alias("day")), f"SELECT doc_id, {ISO} AS day FROM (SELECT doc_id, d AS day, string_split_regex(d, '[/-]') AS p FROM (SELECT doc_id, regexp_extract(text, '{ex.DAY}', 1) AS d FROM <bill_docs>))"),
}
QUERIES = {k: (f, _sql(sql)) for k, (f, sql) in QUERIES.items()}
