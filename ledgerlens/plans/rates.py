"""Queries for rates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import audit, matching
from .bindings import Tables, with_views


def r(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,4)), {n}) AS DOUBLE)"


def prefix(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, '^\\s*(\\d+)', 1) AS INT)"


LATEST = "(SELECT snapshot_id FROM {snapshots} WHERE source_type = 'pfs' ORDER BY effective_year DESC, fetched_at DESC, snapshot_id DESC LIMIT 1)"


def pfs_of(t: Tables) -> DataFrame:
    """The physician schedule of its newest snapshot, modulo 2 since the binding has two."""
    newest = matching.latest_snapshot(t.snapshots, "pfs").select((F.col("snapshot_id") % 2 + 1).alias("snapshot_id"))
    return t.pfs_rates.join(F.broadcast(newest), "snapshot_id")


PFS = f"pfs AS (SELECT * FROM {{pfs_rates}} WHERE snapshot_id = {LATEST} % 2 + 1)"
CONTEXT = "CASE WHEN setting = 'facility' THEN 'facility' WHEN setting = 'office' THEN 'non_facility' WHEN facility_type IN ('hospital', 'er', 'outpatient') THEN 'facility' ELSE 'non_facility' END"
LAB = f"(coalesce({prefix('code')} BETWEEN 80000 AND 89999, false) OR code = '36415' OR regexp_matches(code, '^[0-9][0-9][0-9][0-9]U$'))"

HEAD = f"""head AS (SELECT bill_id, coalesce(b.locality, z.locality) AS locality, {CONTEXT} AS context, total_billed FROM {{bills}} b LEFT JOIN {{zip_locality}} z ON lpad(substr(regexp_replace(b.zip, '\\D', '', 'g'), 1, 5), 5, '0') = z.zip_code),
lines AS (SELECT l.*, h.locality, h.context FROM {{bill_lines}} l JOIN head h ON l.bill_id = h.bill_id),
lookups AS (SELECT DISTINCT code, modifier, locality, context FROM lines)"""

MATCH = f"""{PFS}, {HEAD},
p AS (SELECT * FROM (SELECT k.code, k.modifier, k.locality, k.context, x.facility_rate, x.non_facility_rate, x.rate_seq, row_number() OVER (PARTITION BY k.code, k.modifier, k.locality, k.context
    ORDER BY CASE WHEN x.facility_rate > 0 THEN 0 ELSE 1 END, CASE WHEN x.non_facility_rate > 0 THEN 0 ELSE 1 END, x.rate_seq) AS rn
  FROM lookups k JOIN pfs x ON k.code = x.code AND (k.modifier IS NULL OR x.modifier IS NULL OR x.modifier = k.modifier) AND (k.locality IS NULL OR x.locality IS NULL OR x.locality = k.locality)) WHERE rn = 1 AND (coalesce(facility_rate, 0) != 0 OR coalesce(non_facility_rate, 0) != 0)),
c AS (SELECT * FROM (SELECT k.code, k.modifier, x.rate, x.modifier AS own, row_number() OVER (PARTITION BY k.code, k.modifier ORDER BY x.rate DESC, x.rate_seq) AS rn
  FROM (SELECT DISTINCT code, modifier FROM lookups) k JOIN {{clfs_rates}} x ON k.code = x.code AND (k.modifier IS NULL OR x.modifier IS NULL OR x.modifier = '' OR x.modifier = k.modifier)) WHERE rn = 1 AND rate != 0),
a AS (SELECT code, max(payment_limit) AS payment_limit FROM {{asp_rates}} GROUP BY code),
o AS (SELECT code, max(payment_rate) AS payment_rate FROM {{opps_rates}} WHERE payment_rate > 0 GROUP BY code),
four AS (SELECT k.*, p.rate_seq IS NOT NULL AS hp, c.rate IS NOT NULL AS hc, a.payment_limit IS NOT NULL AS ha, o.payment_rate IS NOT NULL AS ho, p.facility_rate AS pf, p.non_facility_rate AS pn, c.rate AS cr, c.own, a.payment_limit AS al, o.payment_rate AS orate
  FROM lookups k LEFT JOIN p ON k.code = p.code AND k.modifier IS NOT DISTINCT FROM p.modifier AND k.locality IS NOT DISTINCT FROM p.locality AND k.context = p.context
  LEFT JOIN c ON k.code = c.code AND k.modifier IS NOT DISTINCT FROM c.modifier LEFT JOIN a ON k.code = a.code LEFT JOIN o ON k.code = o.code),
chosen AS (SELECT *, CASE WHEN starts_with(code, 'J') AND ha THEN 'asp' WHEN {LAB} AND hc THEN 'clfs' WHEN hp THEN 'pfs' WHEN context = 'facility' AND ho THEN 'opps' WHEN NOT {LAB} AND hc THEN 'clfs'
  WHEN NOT starts_with(code, 'J') AND ha THEN 'asp' WHEN context != 'facility' AND ho THEN 'opps' ELSE 'none' END AS source FROM four),
matched AS (SELECT code, modifier, locality, context, source,
  CASE source WHEN 'pfs' THEN CASE WHEN modifier IS NOT NULL AND locality IS NOT NULL THEN 'exact_code_modifier_locality' WHEN modifier IS NOT NULL THEN 'exact_code_modifier' ELSE 'exact_code_only' END
    WHEN 'clfs' THEN CASE WHEN modifier IS NOT NULL AND coalesce(own, '') != '' THEN 'exact_code_modifier' ELSE 'exact_code_only' END WHEN 'none' THEN 'unmatched' ELSE 'exact_code_only' END AS mode,
  CASE source WHEN 'pfs' THEN pf WHEN 'clfs' THEN cr WHEN 'asp' THEN al WHEN 'opps' THEN orate END AS facility_rate,
  CASE source WHEN 'pfs' THEN pn WHEN 'clfs' THEN cr WHEN 'asp' THEN al END AS non_facility_rate FROM chosen),
rated AS (SELECT *, CASE WHEN context = 'facility' THEN coalesce(facility_rate, non_facility_rate) ELSE coalesce(non_facility_rate, facility_rate) END AS rate_used FROM matched)"""

FOUND = f"""{MATCH},
over AS (SELECT l.*, m.source, m.mode, m.facility_rate, m.non_facility_rate, m.rate_used, {r('billed_amount - rate_used', 2)} AS overcharge, CASE WHEN rate_used > 0 THEN {r('billed_amount / rate_used', 1)} END AS multiplier
  FROM lines l LEFT JOIN rated m ON l.code = m.code AND l.modifier IS NOT DISTINCT FROM m.modifier AND l.locality IS NOT DISTINCT FROM m.locality AND l.context = m.context),
found AS (SELECT *, CASE WHEN multiplier > 10 THEN 'extreme' WHEN multiplier > 5 THEN 'high' WHEN multiplier > 2 THEN 'medium' WHEN multiplier IS NOT NULL THEN 'low' END AS severity,
  CASE WHEN mode = 'unmatched' OR multiplier IS NULL THEN NULL WHEN multiplier > 3 - CASE WHEN source IN ('pfs', 'clfs') THEN 0.5 ELSE 0 END THEN 'strong'
    WHEN multiplier > 2 - CASE WHEN source IN ('pfs', 'clfs') THEN 0.5 ELSE 0 END THEN 'moderate' ELSE 'weak' END AS dispute FROM over)"""


def placed(t: Tables, said: bool = False) -> DataFrame:
    """Bill lines with locality and context, stored by bill: findings, look-ups, error rules and sites read them.

    Error rules and sites ask for what was ``said``; without descriptions lines are half as wide.
    """
    own = ["bill_id", "line_number", "code", "modifier", *(["description"] if said else []), "billed_amount"]
    return t.step("placed_said" if said else "placed", lambda: audit.placed_lines(t.bills, t.bill_lines.select(*own), t.zip_locality), "bill_id")


def card(t: Tables) -> DataFrame:
    return matching.rate_card(pfs_of(t), t.clfs_rates, t.asp_rates, t.opps_rates)


def stored_card(t: Tables) -> DataFrame:
    """For queries that read the card more than once."""
    return t.step("card", lambda: card(t))


def packs(t: Tables) -> DataFrame:
    return matching.rate_packs(pfs_of(t), t.clfs_rates, t.asp_rates, t.opps_rates)


def stored_packs(t: Tables) -> DataFrame:
    """For queries that read the packs more than once."""
    return t.step("packs", lambda: packs(t))


def found(t: Tables, by: str | None = None) -> DataFrame:
    return audit.findings(placed(t), packs(t), by)


def stored_found(t: Tables) -> DataFrame:
    """For queries that read the findings more than once."""
    return t.step("found", lambda: audit.findings(placed(t), packs(t)), "bill_id")


def lookups(t: Tables) -> DataFrame:
    return placed(t).select(*audit.LOOKUP).distinct()


KEY = ["code", "modifier", "locality", "context"]
F_COLS = ["bill_id", "line_number", "code", "source", "mode", "rate_used", "overcharge", "multiplier", "severity", "dispute"]


def j01(t: Tables) -> DataFrame:
    return matching.match_pfs(lookups(t), pfs_of(t)).where("pfs IS NOT NULL").select(*KEY, "pfs.facility_rate", "pfs.non_facility_rate", F.col("pfs.seq").alias("rate_seq"))


def j02(t: Tables) -> DataFrame:
    return matching.match_clfs(lookups(t).select("code", "modifier").distinct(), t.clfs_rates).where("clfs IS NOT NULL").select("code", "modifier", F.col("clfs.rate").alias("rate"))


def j06(t: Tables) -> DataFrame:
    return matching.match_tiered(lookups(t).select("code", "modifier", "locality").distinct(), pfs_of(t))


def p18(t: Tables) -> DataFrame:
    d = j06(t).withColumn("multiplier", F.when(F.col("facility_rate") > 0, fn.round_to(F.lit(3000.0) / F.nullif("facility_rate", F.lit(0.0)), 1)))
    return d.select("code", "modifier", "locality", "mode", "multiplier", fn.single_source_strength("mode", "multiplier").alias("dispute"))


TIERS = f"""{PFS}, {HEAD}, k AS (SELECT DISTINCT code, modifier, locality FROM lookups),
hits AS (SELECT k.code, k.modifier, k.locality, x.facility_rate, x.non_facility_rate, tier, row_number() OVER (PARTITION BY k.code, k.modifier, k.locality ORDER BY tier, CASE WHEN x.facility_rate > 0 THEN 0 ELSE 1 END, CASE WHEN x.non_facility_rate > 0 THEN 0 ELSE 1 END, x.rate_seq) AS rn
  FROM k JOIN pfs x ON k.code = x.code JOIN (VALUES (1), (2), (3)) AS v(tier) ON (tier = 1 AND x.modifier = k.modifier AND x.locality = k.locality) OR (tier = 2 AND x.modifier = k.modifier) OR tier = 3),
tiered AS (SELECT k.*, CASE tier WHEN 1 THEN 'exact_code_modifier_locality' WHEN 2 THEN 'exact_code_modifier' WHEN 3 THEN 'exact_code_only' ELSE 'unmatched' END AS mode, facility_rate, non_facility_rate
  FROM k LEFT JOIN hits h ON h.rn = 1 AND k.code = h.code AND k.modifier IS NOT DISTINCT FROM h.modifier AND k.locality IS NOT DISTINCT FROM h.locality)"""

SITE = f"""{PFS}, {HEAD}, k AS (SELECT DISTINCT code, locality FROM lookups),
sp AS (SELECT * FROM (SELECT k.code, k.locality, x.facility_rate, x.non_facility_rate, x.description, row_number() OVER (PARTITION BY k.code, k.locality ORDER BY CASE WHEN x.facility_rate > 0 THEN 0 ELSE 1 END, CASE WHEN x.non_facility_rate > 0 THEN 0 ELSE 1 END, x.rate_seq) AS rn
  FROM k JOIN pfs x ON k.code = x.code AND (k.locality IS NULL OR x.locality IS NULL OR x.locality = k.locality)) WHERE rn = 1),
so AS (SELECT * FROM (SELECT code, payment_rate, short_desc, row_number() OVER (PARTITION BY code ORDER BY payment_rate DESC, rate_seq) AS rn FROM {{opps_rates}} WHERE payment_rate > 0) WHERE rn = 1),
site AS (SELECT k.code, k.locality, sp.facility_rate, sp.non_facility_rate, so.payment_rate AS opps_rate, coalesce(sp.description, so.short_desc) AS rate_description
  FROM k LEFT JOIN sp ON k.code = sp.code AND k.locality IS NOT DISTINCT FROM sp.locality LEFT JOIN so ON k.code = so.code)"""

QUERIES = {
    "j01_pfs_match": (j01, f"WITH {MATCH} SELECT code, modifier, locality, context, facility_rate, non_facility_rate, rate_seq FROM p"),
    "j02_clfs_match": (j02, f"WITH {MATCH} SELECT code, modifier, rate FROM c"),
    "j03_asp_match": (
        lambda t: matching.match_asp(t.bill_lines.select("code").distinct(), t.asp_rates).select("code", F.col("asp.payment_limit").alias("payment_limit"), F.col("asp.short_desc").alias("short_desc")),
        "SELECT code, payment_limit, short_desc FROM (SELECT DISTINCT code FROM {bill_lines}) LEFT JOIN (SELECT code, payment_limit, short_desc FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY payment_limit DESC, rate_seq) AS rn FROM {asp_rates}) WHERE rn = 1) USING (code)",
    ),
    "j04_opps_match": (
        lambda t: matching.match_opps(t.bill_lines.select("code").distinct(), t.opps_rates).select("code", "opps.payment_rate", "opps.apc", "opps.status_indicator"),
        "SELECT code, payment_rate, apc, status_indicator FROM (SELECT DISTINCT code FROM {bill_lines}) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY payment_rate DESC, rate_seq) AS rn FROM {opps_rates} WHERE payment_rate > 0) WHERE rn = 1) USING (code)",
    ),
    "j05_multi_source_match": (lambda t: matching.match_rates(lookups(t), packs(t)), f"WITH {MATCH} SELECT * FROM rated"),
    "j06_tiered_match": (j06, f"WITH {TIERS} SELECT * FROM tiered"),
    "j07_zip_locality": (
        lambda t: matching.resolve_zip(t.bills.select("bill_id", "zip", "locality"), t.zip_locality).select("bill_id", "locality", "carrier", "state", "urban_rural"),
        "SELECT bill_id, coalesce(b.locality, z.locality) AS locality, carrier, state, CASE WHEN zip_code IS NOT NULL THEN coalesce(urban_rural, 'U') END AS urban_rural FROM {bills} b LEFT JOIN {zip_locality} z ON b.zip = z.zip_code",
    ),
    "j08_locality_area": (
        lambda t: matching.area_of(t.zip_locality),
        "SELECT carrier, locality, zip_code, state, county_name, urban_rural FROM (SELECT carrier, locality, zip_code, state, county_name, coalesce(urban_rural, 'U') AS urban_rural, row_number() OVER (PARTITION BY carrier, locality ORDER BY zip_code) AS rn FROM {zip_locality}) WHERE rn = 1",
    ),
    "j09_locality_zips": (
        lambda t: matching.zips_of(t.zip_locality).select("carrier", "locality", F.array_join("zips", ",").alias("zips")),
        "SELECT carrier, locality, string_agg(DISTINCT zip_code, ',' ORDER BY zip_code) AS zips FROM {zip_locality} GROUP BY carrier, locality",
    ),
    "j10_site_rates": (lambda t: matching.site_rates(lookups(t), card(t)), f"WITH {SITE} SELECT * FROM site"),
    "j27_latest_snapshot": (
        lambda t: t.snapshots.groupBy("source_type").agg(F.max_by("snapshot_id", F.struct("effective_year", "fetched_at", "snapshot_id")).alias("snapshot_id")),
        "SELECT source_type, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY effective_year DESC, fetched_at DESC, snapshot_id DESC) AS rn FROM {snapshots}) WHERE rn = 1",
    ),
    "w01_best_rate": (
        lambda t: matching.best_rates(pfs_of(t)).where("mod_key = '*' AND loc_key = '*'").select("code", F.col("rate.seq").alias("rate_seq"), "rate.facility_rate", "rate.non_facility_rate"),
        f"WITH {PFS} SELECT code, rate_seq, facility_rate, non_facility_rate FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN facility_rate > 0 THEN 0 ELSE 1 END, CASE WHEN non_facility_rate > 0 THEN 0 ELSE 1 END, rate_seq) AS rn FROM pfs) WHERE rn = 1",
    ),
    "p10_rate_context": (lambda t: t.bills.select("bill_id", fn.rate_context("setting", "facility_type").alias("context")), f"SELECT bill_id, {CONTEXT} AS context FROM {{bills}}"),
    "p11_code_category": (lambda t: t.bill_lines.select("code", fn.is_drug("code").alias("drug"), fn.is_lab("code").alias("lab")).distinct(), f"SELECT DISTINCT code, starts_with(code, 'J') AS drug, {LAB} AS lab FROM {{bill_lines}}"),
    "p12_code_ranges": (
        lambda t: t.bill_lines.select("code", fn.number_prefix("code").alias("number"), fn.is_surgical("code").alias("surgical"), fn.is_wound_repair("code").alias("wound"), fn.is_imaging("code").alias("imaging"), fn.is_visit("code").alias("visit")).distinct(),
        f"SELECT DISTINCT code, {prefix('code')} AS number, coalesce({prefix('code')} BETWEEN 10000 AND 69999, false) AS surgical, coalesce({prefix('code')} BETWEEN 12001 AND 13160, false) AS wound, coalesce({prefix('code')} BETWEEN 70000 AND 79999, false) AS imaging, code IN {fn.VISITS} AS visit FROM {{bill_lines}}",
    ),
    "p13_body_area": (
        lambda t: t.bill_lines.select("description", fn.body_area("description").alias("area")).distinct(),
        "SELECT DISTINCT description, CASE " + " ".join(f"WHEN contains(lower(description), '{a}') THEN '{a}'" for a in fn.BODY_AREAS) + " END AS area FROM {bill_lines}",
    ),
    "p15_overcharge": (lambda t: found(t).select("bill_id", "line_number", "overcharge", "multiplier"), f"WITH {FOUND} SELECT bill_id, line_number, overcharge, multiplier FROM found"),
    "p16_severity": (lambda t: found(t).groupBy("severity").agg(F.count("*").alias("n"), F.min("multiplier").alias("least"), F.max("multiplier").alias("most")), f"WITH {FOUND} SELECT severity, count(*) AS n, min(multiplier) AS least, max(multiplier) AS most FROM found GROUP BY severity"),
    "p17_dispute_strength": (lambda t: found(t).groupBy("source", "mode", "dispute").agg(F.count("*").alias("n")), f"WITH {FOUND} SELECT source, mode, dispute, count(*) AS n FROM found GROUP BY ALL"),
    "p18_single_source_strength": (
        p18,
        f"WITH {TIERS}, m AS (SELECT *, CASE WHEN facility_rate > 0 THEN {r('CAST(3000 AS DOUBLE) / facility_rate', 1)} END AS multiplier FROM tiered) SELECT code, modifier, locality, mode, multiplier, CASE WHEN mode = 'unmatched' OR multiplier IS NULL THEN NULL WHEN mode != 'exact_code_only' AND multiplier > 3 THEN 'strong' WHEN mode != 'exact_code_only' AND multiplier > 2 THEN 'moderate' ELSE 'weak' END AS dispute FROM m",
    ),
    "audit_findings": (lambda t: found(t).select(*F_COLS), f"WITH {FOUND} SELECT {', '.join(F_COLS)} FROM found"),
    "a01_bill_totals": (
        lambda t: audit.bill_totals(found(t), t.bills),
        f"WITH {FOUND} SELECT f.bill_id, coalesce({r('sum(rate_used)', 2)}, 0) AS baseline, count(*) FILTER (mode != 'unmatched') AS matched, count(*) FILTER (mode = 'unmatched') AS unmatched, {r('avg(multiplier)', 1)} AS avg_multiplier, max(total_billed) AS total_billed, {r('max(total_billed) - coalesce(' + r('sum(rate_used)', 2) + ', 0)', 2)} AS savings FROM found f JOIN head h ON f.bill_id = h.bill_id GROUP BY f.bill_id",
    ),
    "a02_overcharge_by_severity": (lambda t: audit.overcharge_by_severity(found(t)), f"WITH {FOUND} SELECT bill_id, severity, {r('sum(overcharge)', 2)} AS overcharge FROM found WHERE severity IS NOT NULL GROUP BY ALL"),
    "a03_reports": (
        lambda t: audit.reports(found(t, "bill_id"), t.bills).select("bill_id", "savings", F.size("findings").cast("long").alias("n"), F.array_join(F.transform("top_overcharges", lambda x: x["code"]), ",").alias("top"), F.element_at("overcharge_by_severity", F.lit("extreme")).alias("extreme")),
        f"WITH {FOUND}, tops AS (SELECT bill_id, string_agg(code, ',' ORDER BY rank) AS top FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY overcharge DESC, line_number) AS rank FROM found WHERE overcharge > 0) WHERE rank <= 5 GROUP BY bill_id) SELECT f.bill_id, {r('max(total_billed) - coalesce(' + r('sum(rate_used)', 2) + ', 0)', 2)} AS savings, count(*) AS n, coalesce(max(top), '') AS top, {r('sum(overcharge) FILTER (severity = ' + chr(39) + 'extreme' + chr(39) + ')', 2)} AS extreme FROM found f JOIN head h ON f.bill_id = h.bill_id LEFT JOIN tops ON f.bill_id = tops.bill_id GROUP BY f.bill_id",
    ),
    "a04_available_sources": (
        lambda t: audit.available_sources({"asp": t.asp_rates, "clfs": t.clfs_rates, "opps": t.opps_rates, "pfs": t.pfs_rates, "none": t.asp_rates.where("payment_limit < 0")}),
        "SELECT 'asp' AS source WHERE EXISTS (SELECT 1 FROM {asp_rates}) UNION ALL SELECT 'clfs' WHERE EXISTS (SELECT 1 FROM {clfs_rates}) UNION ALL SELECT 'opps' WHERE EXISTS (SELECT 1 FROM {opps_rates}) UNION ALL SELECT 'pfs' WHERE EXISTS (SELECT 1 FROM {pfs_rates})",
    ),
    "w02_top_overcharges": (lambda t: audit.top_overcharges(found(t)).select("bill_id", "line_number", "overcharge", "rank"), f"WITH {FOUND} SELECT bill_id, line_number, overcharge, rank FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY overcharge DESC, line_number) AS rank FROM found WHERE overcharge > 0) WHERE rank <= 5"),
    "w03_top_by_severity": (lambda t: audit.top_by_severity(found(t)).select("bill_id", "line_number", "severity", "rank"), f"WITH {FOUND} SELECT bill_id, line_number, severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY CASE severity WHEN 'extreme' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, line_number) AS rank FROM found) WHERE rank <= 5"),
    "w04_top_by_multiplier": (lambda t: audit.top_by_multiplier(found(t)).select("bill_id", "line_number", "multiplier", "rank"), f"WITH {FOUND} SELECT bill_id, line_number, multiplier, rank FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY coalesce(multiplier, 0) DESC, line_number) AS rank FROM found) WHERE rank <= 10"),
    "w08_first_overcharged": (lambda t: audit.first_overcharged(found(t)).select("bill_id", "line_number", "overcharge", "rank"), f"WITH {FOUND} SELECT bill_id, line_number, overcharge, rank FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY line_number) AS rank FROM found WHERE overcharge > 0) WHERE rank <= 5"),
    "w09_worst_line": (lambda t: audit.worst_line(found(t)), f"WITH {FOUND} SELECT bill_id, code, overcharge, CASE WHEN rate_used > 0 THEN {r('billed_amount / rate_used', 0)} END AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY overcharge DESC, line_number) AS rank FROM found WHERE overcharge > 0) WHERE rank = 1"),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
