"""Queries for billing errors, balance billing, insurer statements and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import audit, balance, errors, insurance, matching
from .bindings import Tables, with_views
from .rates import FOUND, SITE, found, packs, placed, prefix, r, stored_card, stored_packs


def sites(t: Tables) -> DataFrame:
    lines = placed(t, said=True).select("bill_id", "line_number", "code", "description", "locality")
    return balance.site_of_service(lines, matching.site_rates(lines, stored_card(t)))


SURG, WOUND, IMG = (f"coalesce({prefix('code')} BETWEEN {a} AND {b}, false)" for a, b in ((10000, 69999), (12001, 13160), (70000, 79999)))
VISIT = f"code IN {fn.VISITS}"
BUNDLE = " UNION ALL ".join(f"SELECT {n} AS n, '{role}' AS role, code FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in codes)}) AS v(code)" for n, p, q in fn.BUNDLES for role, codes in (("primary", p), ("bundled", q)))
AREA = "CASE " + " ".join(f"WHEN contains(lower(description), '{a}') THEN '{a}'" for a in fn.BODY_AREAS) + " END"
TOPS = ", ".join(f"('{a}', '{b}')" for a, b in fn.TOP_VISITS.items())
RATE_USED = "CASE WHEN context = 'facility' THEN coalesce({0}.facility_rate, {0}.non_facility_rate) ELSE coalesce({0}.non_facility_rate, {0}.facility_rate) END"

RULES = {
    "upcoding": f"SELECT bill_id, 'upcoding' AS rule, 'upcoding' AS type, 'warning' AS severity, l.code AS codes, CASE WHEN {r(RATE_USED.format('s1') + ' - ' + RATE_USED.format('s2'), 2)} > 0 THEN {r(RATE_USED.format('s1') + ' - ' + RATE_USED.format('s2'), 2)} END AS saving FROM lines l JOIN (VALUES {TOPS}) AS v(top, low) ON l.code = v.top LEFT JOIN site s1 ON s1.code = top AND s1.locality IS NOT DISTINCT FROM l.locality LEFT JOIN site s2 ON s2.code = low AND s2.locality IS NOT DISTINCT FROM l.locality",
    "bundle": f"SELECT bill_id, 'bundle', 'unbundling', 'alert', string_agg(code, ',' ORDER BY role DESC, code), {r('sum(first) FILTER (role = ' + chr(39) + 'bundled' + chr(39) + ')', 2)} FROM (SELECT b.bill_id, b.n, b.role, b.code, arg_min(billed_amount, line_number) AS first FROM bl b JOIN both_roles USING (bill_id, n) GROUP BY ALL) GROUP BY bill_id, n",
    "wound": f"SELECT bill_id, 'wound_repair', 'unbundling', 'warning', concat_ws(',', string_agg(code, ',' ORDER BY line_number) FILTER ({SURG} AND NOT {WOUND}), string_agg(code, ',' ORDER BY line_number) FILTER ({WOUND})), {r(f'sum(billed_amount) FILTER ({WOUND})', 2)} FROM lines GROUP BY bill_id HAVING count(*) FILTER ({WOUND}) > 0 AND count(*) FILTER ({SURG} AND NOT {WOUND}) > 0",
    "visit": f"SELECT bill_id, 'visit_with_procedure', 'unbundling', 'warning', concat_ws(',', string_agg(code, ',' ORDER BY line_number) FILTER ({VISIT} AND coalesce(modifier, '') != '25'), string_agg(code, ',' ORDER BY line_number) FILTER ({SURG})), NULL FROM lines GROUP BY bill_id HAVING count(*) FILTER ({SURG}) > 0 AND count(*) FILTER ({VISIT} AND coalesce(modifier, '') != '25') > 0",
    "imaging": f"SELECT bill_id, 'repeated_imaging', 'unbundling', 'info', string_agg(code, ',' ORDER BY line_number), NULL FROM (SELECT *, {AREA} AS area FROM lines WHERE {IMG}) WHERE area IS NOT NULL GROUP BY bill_id, area HAVING count(*) > 1",
    "duplicate": f"SELECT bill_id, 'duplicate', 'duplicate', 'warning', code, CASE WHEN {r('sum(billed_amount) - arg_min(billed_amount, line_number)', 2)} > 0 THEN {r('sum(billed_amount) - arg_min(billed_amount, line_number)', 2)} END FROM lines GROUP BY bill_id, code HAVING count(*) > 1",
    "missing": f"SELECT bill_id, 'missing_59', 'modifier', 'info', code, NULL FROM bl JOIN both_roles USING (bill_id, n) WHERE role = 'bundled' AND (modifier IS NULL OR modifier NOT IN {fn.DISTINCT_MODIFIERS})",
    "m25": f"SELECT l.bill_id, 'modifier_25', 'modifier', 'info', l.code || ',' || p, NULL FROM lines l JOIN (SELECT bill_id, string_agg(code, ',' ORDER BY line_number) AS p FROM lines WHERE {SURG} GROUP BY bill_id) USING (bill_id) WHERE {VISIT} AND modifier = '25'",
}
# the rates of lower codes are looked up whether or not a line has them
LOW_SITE = SITE.replace("k AS (SELECT DISTINCT code, locality FROM lookups)", f"k AS (SELECT DISTINCT code, locality FROM lookups UNION SELECT DISTINCT low, locality FROM lookups JOIN (VALUES {TOPS}) AS v(top, low) ON code = top)")
assert LOW_SITE != SITE
BL = f"bl AS (SELECT l.*, b.n, b.role FROM lines l JOIN ({BUNDLE}) b ON l.code = b.code), both_roles AS (SELECT bill_id, n FROM bl GROUP BY bill_id, n HAVING count(DISTINCT role) = 2)"


def _rule_sql(name: str) -> str:
    return f"WITH {LOW_SITE}, {BL}, e(bill_id, rule, type, severity, codes, saving) AS ({RULES[name]}) SELECT bill_id, rule, type, severity, codes, CAST(saving AS DOUBLE) AS saving FROM e"


ERRORS = f"errs(bill_id, rule, type, severity, codes, saving) AS ({' UNION ALL '.join(RULES.values())})"

FIRST = "first_found AS (SELECT bill_id, code, arg_min(billed_amount, line_number) AS billed FROM found GROUP BY bill_id, code), w AS (SELECT e.bill_id, e.code, allowed_amount, patient_responsibility AS owed, billed FROM {eob_lines} e JOIN first_found USING (bill_id, code))"
ALERTS = {
    "line": f"SELECT bill_id, 'billed_over_owed' AS rule, 'balance_billing' AS type, 'alert' AS severity, code, {r('billed - owed', 2)} AS excess FROM w WHERE owed >= 0 AND billed > owed AND owed < coalesce(allowed_amount, billed) AND {r('billed - owed', 2)} > 1 UNION ALL SELECT bill_id, 'owed_over_allowed', 'balance_billing', 'alert', code, {r('owed - allowed_amount', 2)} FROM w WHERE allowed_amount > 0 AND {r('billed - allowed_amount', 2)} > 0 AND {r('owed - allowed_amount', 2)} > 1",
    "surprise": f"SELECT bill_id, 'no_discount' AS rule, 'surprise_bill' AS type, 'warning' AS severity, 'ALL' AS code, {r('patient_responsibility - amount_billed * CAST(0.2 AS DOUBLE)', 2)} AS excess FROM {{eobs}} WHERE coalesce(network_discount, 0) = 0 AND amount_billed > 0 AND patient_responsibility / amount_billed > CAST(0.5 AS DOUBLE)",
    "arithmetic": f"SELECT bill_id, 'arithmetic' AS rule, 'balance_billing' AS type, 'alert' AS severity, 'ALL' AS code, excess FROM (SELECT bill_id, expected, {r('patient_responsibility - expected', 2)} AS excess FROM (SELECT *, {r('amount_billed - plan_paid - coalesce(network_discount, 0)', 2)} AS expected FROM {{eobs}})) WHERE excess > 1 AND expected >= 0",
    "markup": f"SELECT bill_id, 'markup' AS rule, 'excessive_markup' AS type, CASE WHEN billed_amount / rate_used >= 10 THEN 'alert' ELSE 'warning' END AS severity, code, {r('billed_amount - rate_used', 2)} AS excess FROM found WHERE rate_used > 0 AND billed_amount / rate_used >= 4",
}
REASON = "CASE " + " ".join(f"WHEN {('code = ' + chr(39) + '36415' + chr(39)) if a == b else f'{prefix("code")} BETWEEN {a} AND {b}'} THEN '{w}'" for a, b, _, w in fn.SHOPPING) + " WHEN starts_with(code, 'J') THEN 'drug' ELSE 'depends' END"
GOOD = ", ".join(f"'{w}'" for w in sorted({w for *_, ok, w in fn.SHOPPING if ok}))
SITES = f"""sited AS (SELECT *, coalesce(rate_description, description) AS said, reason IN ({GOOD}) AS shoppable, CASE WHEN facility_rate > 0 AND non_facility_rate > 0 AND facility_rate > non_facility_rate THEN {r('facility_rate - non_facility_rate', 2)} END AS saving
  FROM (SELECT l.bill_id, l.line_number, l.code, l.description, s.* EXCLUDE (code, locality), {REASON.replace('code', 'l.code')} AS reason FROM lines l LEFT JOIN site s ON l.code = s.code AND l.locality IS NOT DISTINCT FROM s.locality))"""
# FOUND and SITE share their first CTEs
SITE_ONLY = "k AS" + LOW_SITE.split(", k AS", 1)[1]
FS = f"{FOUND}, {SITE_ONLY}"

BEST_EOB = "best_eob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill_id, code ORDER BY coalesce(allowed_amount, -1) DESC, line_number) AS rn FROM {eob_lines} WHERE code IS NOT NULL) WHERE rn = 1)"
PLAN = "CASE WHEN contains(lower(coalesce(plan_type, '')), 'hmo') THEN 'hmo' WHEN contains(lower(coalesce(plan_type, '')), 'oon') OR contains(lower(coalesce(plan_type, '')), 'out') THEN 'oon' ELSE 'ppo' END"
MID = "CASE plan " + " ".join(f"WHEN '{p}' THEN {r('(' + r(f'rate_used * CAST({lo} AS DOUBLE)', 2) + ' + ' + r(f'rate_used * CAST({hi} AS DOUBLE)', 2) + ') / 2', 2)}" for p, (lo, hi) in fn.PLAN_MULTIPLES.items()) + " END"
COMPARED = f"{FOUND}, {BEST_EOB}, compared AS (SELECT f.*, b.allowed_amount, b.insurance_paid, b.patient_responsibility, {PLAN} AS plan FROM found f LEFT JOIN best_eob b ON f.bill_id = b.bill_id AND f.code = b.code JOIN {{eobs}} e ON f.bill_id = e.bill_id), mids AS (SELECT *, {MID} AS midpoint FROM compared)"


def _insight_sql(rules: list[tuple[str, str, str]]) -> str:
    parts = " UNION ALL ".join(f"SELECT bill_id, line_number, code, '{k}' AS kind, '{lv}' AS level FROM mids WHERE rate_used IS NOT NULL AND {c}" for k, lv, c in rules)
    return f"WITH {COMPARED} {parts}"


def a18(t: Tables) -> DataFrame:
    return balance.line_alerts(t.bill_lines.join(t.bills.select("bill_id"), "bill_id"), t.eob_lines)


def a22(t: Tables) -> DataFrame:
    lines = placed(t, said=True)
    f = audit.findings(lines, stored_packs(t), sites=True)
    return balance.savings_summary(f, t.bills, errors.billing_errors(lines, stored_packs(t)), balance.billing_alerts(lines, t.eob_lines, t.eobs))


_err = lambda f: lambda t: f(t.bill_lines)
EST = {f"{p}_{e}": m for p, ends in fn.PLAN_MULTIPLES.items() for e, m in zip(("low", "high"), ends, strict=True)} | {"national_avg": fn.NATIONAL_AVERAGE}

QUERIES = {
    "j11_upcoding": (lambda t: errors.upcoding(placed(t), packs(t)), _rule_sql("upcoding")),
    "a10_bundled": (_err(errors.bundled), _rule_sql("bundle")),
    "a11_wound_repair": (_err(errors.wound_repair), _rule_sql("wound")),
    "a12_visit_with_procedure": (_err(errors.visit_with_procedure), _rule_sql("visit")),
    "a13_repeated_imaging": (_err(errors.repeated_imaging), _rule_sql("imaging")),
    "a14_duplicates": (_err(errors.duplicates), _rule_sql("duplicate")),
    "a15_missing_distinct_modifier": (_err(errors.missing_distinct_modifier), _rule_sql("missing")),
    "a16_modifier_25": (_err(errors.modifier_25), _rule_sql("m25")),
    "a17_billing_errors": (lambda t: errors.billing_errors(placed(t, said=True), packs(t)), f"WITH {LOW_SITE}, {BL}, {ERRORS} SELECT bill_id, rule, type, severity, codes, CAST(saving AS DOUBLE) AS saving FROM errs"),
    "u04_alerts_union": (
        lambda t: balance.alerts(found(t), placed(t), t.eob_lines, t.eobs).groupBy("rule", "type", "severity").agg(F.count("*").alias("n"), fn.round_to(F.sum("excess"), 0).alias("excess")),
        f"WITH {FOUND}, {FIRST}, al AS ({' UNION ALL '.join(ALERTS.values())}) SELECT rule, type, severity, count(*) AS n, {r('sum(excess)', 0)} AS excess FROM al GROUP BY ALL",
    ),
    "a18_line_alerts": (a18, f"WITH {FOUND}, {FIRST} {ALERTS['line']}"),
    "a19_surprise_bills": (lambda t: balance.surprise_bills(t.eobs), ALERTS["surprise"]),
    "a20_wrong_arithmetic": (lambda t: balance.wrong_arithmetic(t.eobs), ALERTS["arithmetic"]),
    "a21_excessive_markups": (lambda t: balance.excessive_markups(found(t)), f"WITH {FOUND} {ALERTS['markup']}"),
    "p14_shoppable": (lambda t: t.bill_lines.select("code", fn.shopping_reason("code").alias("reason"), fn.is_shoppable("code").alias("shoppable")).distinct(), f"SELECT DISTINCT code, {REASON} AS reason, {REASON} IN ({GOOD}) AS shoppable FROM {{bill_lines}}"),
    "p30_site_of_service": (
        lambda t: sites(t).select("bill_id", "line_number", "description", "saving", "saving_percent", "shoppable", "advice"),
        f"WITH {FS}, {SITES} SELECT bill_id, line_number, said AS description, saving, {r('saving / facility_rate * 100', 1)} AS saving_percent, shoppable, CASE WHEN NOT shoppable THEN reason WHEN facility_rate > non_facility_rate AND non_facility_rate > 0 THEN 'cheaper_in_office' WHEN facility_rate = non_facility_rate THEN 'same_rate' WHEN non_facility_rate IS NOT NULL AND facility_rate IS NULL THEN 'only_office' WHEN facility_rate IS NOT NULL AND non_facility_rate IS NULL THEN 'only_facility' ELSE 'compare' END AS advice FROM sited",
    ),
    "a22_savings_summary": (
        a22,
        f"""WITH {FS}, {BL}, {ERRORS}, {FIRST}, al AS ({' UNION ALL '.join(ALERTS.values())}), {SITES},
tot AS (SELECT f.bill_id, coalesce({r('sum(rate_used)', 2)}, 0) AS baseline, max(total_billed) AS total_billed FROM found f JOIN head h ON f.bill_id = h.bill_id GROUP BY f.bill_id),
e AS (SELECT bill_id, coalesce({r('sum(saving)', 2)}, 0) AS error_savings, coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (saving > 0), '') AS error_types FROM errs GROUP BY bill_id),
s AS (SELECT bill_id, coalesce({r('sum(saving) FILTER (shoppable AND saving > 0)', 2)}, 0) AS site_savings, count(*) FILTER (shoppable AND saving > 0) AS shoppable_count FROM sited GROUP BY bill_id),
b AS (SELECT bill_id, coalesce({r("sum(excess) FILTER (type != 'excessive_markup')", 2)}, 0) AS balance_savings, count(*) FILTER (type = 'excessive_markup') AS markup_count, coalesce({r("sum(excess) FILTER (type = 'excessive_markup')", 2)}, 0) AS markup_excess FROM al GROUP BY bill_id),
d AS (SELECT tot.*, CASE WHEN baseline > 0 THEN {r('baseline * CAST(1.2 AS DOUBLE)', 2)} ELSE 0 END AS target, coalesce(error_savings, 0) AS error_savings, coalesce(site_savings, 0) AS site_savings, coalesce(balance_savings, 0) AS balance_savings, coalesce(error_types, '') AS error_types, coalesce(shoppable_count, 0) AS shoppable_count, coalesce(markup_count, 0) AS markup_count, coalesce(markup_excess, 0) AS markup_excess FROM tot LEFT JOIN e USING (bill_id) LEFT JOIN s USING (bill_id) LEFT JOIN b USING (bill_id))
SELECT *, baseline > 0 AND total_billed / baseline > 3 AS over_three_times, CASE WHEN baseline > 0 THEN greatest(0, {r('total_billed - target', 2)}) ELSE 0 END AS uninsured_savings, {r('error_savings + site_savings + balance_savings', 2)} AS total_savings FROM d""",
    ),
    "j12_best_eob_line": (lambda t: insurance.best_eob_lines(t.eob_lines), f"WITH {BEST_EOB} SELECT bill_id, code, allowed_amount, insurance_paid, patient_responsibility FROM best_eob"),
    "p19_estimates": (
        lambda t: insurance.compare(found(t), t.eob_lines).select("bill_id", "line_number", *EST, "over_cms", "over_estimated", "over_actual", "allowed_over_cms"),
        f"WITH {COMPARED} SELECT bill_id, line_number, " + ", ".join(f"{r(f'rate_used * CAST({m} AS DOUBLE)', 2)} AS {k}" for k, m in EST.items()) + f", {r('billed_amount - rate_used', 2)} AS over_cms, {r('billed_amount - ' + r('rate_used * CAST(1.43 AS DOUBLE)', 2), 2)} AS over_estimated, {r('billed_amount - allowed_amount', 2)} AS over_actual, {r('allowed_amount - rate_used', 2)} AS allowed_over_cms FROM compared",
    ),
    "p20_plan_midpoint": (
        lambda t: found(t).join(t.eobs.select("bill_id", fn.plan_type("plan_type").alias("plan")), "bill_id").select("bill_id", "line_number", "plan", fn.plan_midpoint("rate_used", "plan").alias("midpoint")),
        f"WITH {COMPARED} SELECT bill_id, line_number, plan, midpoint FROM mids",
    ),
    "p21_plan_type": (lambda t: t.eobs.select("bill_id", fn.plan_type("plan_type").alias("plan")), f"SELECT bill_id, {PLAN} AS plan FROM {{eobs}}"),
    "p22_bill_validation": (
        lambda t: insurance.validate_bills(t.bills, t.bill_lines).select("bill_id", "reasons", "valid"),
        "SELECT bill_id, CASE WHEN n IS NULL THEN 'lines' ELSE '' END AS reasons, n IS NOT NULL AS valid FROM {bills} LEFT JOIN (SELECT bill_id, count(*) AS n FROM {bill_lines} GROUP BY bill_id) USING (bill_id)",
    ),
    "p23_eob_validation": (
        lambda t: insurance.validate_lines(t.eob_lines).select("bill_id", "line_number", "reasons", "valid"),
        "SELECT bill_id, line_number, concat_ws(',', CASE WHEN code IS NULL THEN 'code' END, CASE WHEN allowed_amount IS NULL THEN 'allowed_amount' END) AS reasons, code IS NOT NULL AND allowed_amount IS NOT NULL AS valid FROM {eob_lines}",
    ),
    "p24_eob_coherence": (lambda t: insurance.validate_lines(t.eob_lines).select("bill_id", "line_number", "incoherent"), "SELECT bill_id, line_number, coalesce(abs(allowed_amount - (insurance_paid + patient_responsibility)) > CAST(0.1 AS DOUBLE), false) AS incoherent FROM {eob_lines}"),
    "a05_eob_totals": (
        lambda t: insurance.eob_totals(t.eob_lines, t.eobs),
        f"SELECT bill_id, coalesce(total_allowed, summed) AS total_allowed, coalesce(abs(total_allowed - summed) > 1, false) AS differs FROM {{eobs}} LEFT JOIN (SELECT bill_id, {r('sum(allowed_amount)', 2)} AS summed FROM {{eob_lines}} GROUP BY bill_id) USING (bill_id)",
    ),
    "a06_eob_audit": (
        lambda t: insurance.eob_audit(found(t, "bill_id"), t.eob_lines, t.eobs).drop("write_off", "write_off_percent"),
        f"WITH {COMPARED} SELECT bill_id, plan, " + ", ".join(f"{r(f'sum({c})', 2)} AS {n}" for c, n in (("billed_amount", "billed"), ("allowed_amount", "allowed"), ("midpoint", "midpoint"), ("insurance_paid", "paid"), ("patient_responsibility", "patient"))) + " FROM mids GROUP BY bill_id, plan",
    ),
    "a09_write_off": (
        lambda t: insurance.eob_audit(found(t, "bill_id"), t.eob_lines, t.eobs).select("bill_id", "write_off", "write_off_percent"),
        f"WITH {COMPARED}, s AS (SELECT bill_id, {r('sum(billed_amount)', 2)} AS billed, {r('sum(allowed_amount)', 2)} AS allowed FROM mids GROUP BY bill_id) SELECT bill_id, {r('billed - allowed', 2)} AS write_off, CASE WHEN billed > 0 THEN {r(r('billed - allowed', 2) + ' / billed * 100', 1)} END AS write_off_percent FROM s",
    ),
    "a07_eob_insights": (
        lambda t: insurance.insights(found(t, "bill_id"), t.eob_lines, t.eobs),
        _insight_sql([("allowed_over_cms", "info", "allowed_amount > CAST(1.5 AS DOUBLE) * rate_used"), ("billed_over_allowed", "warning", "billed_amount > 5 * allowed_amount"), ("billed_over_plan", "alert", "billed_amount > 3 * midpoint"), ("drug_markup", "alert", "starts_with(code, 'J') AND billed_amount > 3 * allowed_amount")]),
    ),
    "a08_inline_insights": (
        lambda t: insurance.insights(found(t, "bill_id"), t.eob_lines, t.eobs, inline=True),
        _insight_sql([("allowed_over_cms", "info", "allowed_amount > CAST(1.5 AS DOUBLE) * rate_used"), ("billed_over_allowed", "warning", "billed_amount > 2 * allowed_amount"), ("billed_over_share", "info", "patient_responsibility > 0 AND billed_amount > 3 * patient_responsibility")]),
    ),
    "j13_line_for_finding": (
        lambda t: insurance.line_for_finding(t.bill_lines, t.eob_lines.withColumn("description", F.lower("adjustment_reason"))),
        "SELECT l.bill_id, l.line_number, min(e.line_number) AS eob_line, arg_min(struct_pack(a := e.allowed_amount), e.line_number).a AS allowed_amount FROM {bill_lines} l JOIN {eob_lines} e ON l.bill_id = e.bill_id AND (l.code = e.code OR coalesce(contains(lower(e.adjustment_reason), lower(substr(l.description, 1, 10))), false)) GROUP BY l.bill_id, l.line_number",
    ),
    "j14_allowed_fallback": (
        lambda t: insurance.allowed_fallback(t.bill_lines, insurance.line_for_finding(t.bill_lines, t.eob_lines), t.eobs),
        f"WITH m AS (SELECT l.bill_id, l.line_number, arg_min(struct_pack(a := e.allowed_amount), e.line_number).a AS allowed_amount FROM {{bill_lines}} l JOIN {{eob_lines}} e ON l.bill_id = e.bill_id AND l.code = e.code GROUP BY l.bill_id, l.line_number), n AS (SELECT bill_id, count(*) AS n FROM {{bill_lines}} GROUP BY bill_id) SELECT l.bill_id, l.line_number, coalesce(allowed_amount, CASE WHEN n = 1 AND network_discount IS NOT NULL THEN {r('billed_amount - network_discount', 2)} END) AS allowed_amount FROM {{bill_lines}} l JOIN n USING (bill_id) LEFT JOIN m ON l.bill_id = m.bill_id AND l.line_number = m.line_number LEFT JOIN {{eobs}} e ON l.bill_id = e.bill_id",
    ),
    "p28_appeal_type": (
        lambda t: insurance.appeal_types(t.bills, t.eobs),
        "SELECT b.bill_id, CASE WHEN uninsured THEN 'billing_dispute' WHEN amount_billed IS NOT NULL AND patient_responsibility > CAST(0.5 AS DOUBLE) * plan_paid THEN 'balance_billing_complaint' ELSE 'denial_appeal' END AS appeal FROM {bills} b LEFT JOIN {eobs} e ON b.bill_id = e.bill_id",
    ),
    "p29_effective_rate": (
        lambda t: insurance.effective_rates(found(t)).select("bill_id", "line_number", "effective_rate"),
        f"WITH {FOUND} SELECT bill_id, line_number, coalesce(rate_used, non_facility_rate, facility_rate) AS effective_rate FROM found WHERE mode != 'unmatched' AND coalesce(rate_used, non_facility_rate, facility_rate) > 0",
    ),
    "a38_appeal_facts": (
        lambda t: insurance.appeal_facts(found(t)),
        f"WITH {FOUND}, u AS (SELECT *, coalesce(rate_used, non_facility_rate, facility_rate) AS er FROM found), s AS (SELECT bill_id, {r('sum(billed_amount)', 2)} AS billed, {r("sum(er) FILTER (mode != 'unmatched' AND er > 0)", 2)} AS cms, count(*) FILTER (mode != 'unmatched' AND er > 0) AS matched, count(*) AS lines FROM u GROUP BY bill_id) SELECT *, CASE WHEN cms > 0 THEN {r('billed / cms', 1)} END AS markup, {r('cms * CAST(1.2 AS DOUBLE)', 2)} AS fair_price FROM s",
    ),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
