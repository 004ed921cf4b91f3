"""Balance billing, surprise bills, statement arithmetic and markups; savings per bill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_shoppable, round_to, shopping_reason

MATERIAL, MARKUP, MARKUP_ALERT, TARGET, COINSURANCE = 1.0, 4.0, 10.0, 1.2, 0.2


def _alert(d: DataFrame, rule: str, kind: str, severity: Column, code: Column, excess: Column) -> DataFrame:
    return d.select("bill_id", F.lit(rule).alias("rule"), F.lit(kind).alias("type"), severity.alias("severity"), code.alias("code"), excess.alias("excess"))


def _with_finding(lines: DataFrame, eob_lines: DataFrame) -> DataFrame:
    """Insurer lines with a code, and the billed amount of the bill's first finding of that code."""
    first = lines.groupBy("bill_id", "code").agg(F.min_by("billed_amount", "line_number").alias("billed"))
    return eob_lines.where("code IS NOT NULL").select("bill_id", "code", "allowed_amount", F.col("patient_responsibility").alias("owed")).join(first, ["bill_id", "code"])


def line_alerts(lines: DataFrame, eob_lines: DataFrame) -> DataFrame:
    """Line level (A18): billed above what the patient owes, and owed above the allowed amount, by more than 1.

    Every bill line has one finding with its amount, so bill lines serve as well as findings: no rate is asked for.
    """
    d = _with_finding(lines, eob_lines)
    excess, over = round_to(F.col("billed") - F.col("owed"), 2), round_to(F.col("owed") - F.col("allowed_amount"), 2)
    owes_less = (F.col("owed") >= 0) & (F.col("billed") > F.col("owed")) & (F.col("owed") < F.coalesce("allowed_amount", "billed")) & (excess > MATERIAL)
    owes_more = (F.col("allowed_amount") > 0) & (round_to(F.col("billed") - F.col("allowed_amount"), 2) > 0) & (over > MATERIAL)
    alert = lambda cond, rule, x: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit("balance_billing").alias("type"), F.lit("alert").alias("severity"), F.col("code").alias("code"), x.alias("excess")))
    return d.select("bill_id", F.inline(F.array_compact(F.array(alert(owes_less, "billed_over_owed", excess), alert(owes_more, "owed_over_allowed", over)))))


def _statement_rules() -> dict[str, Column]:
    """Alerts of a statement's head, null where a rule doesn't apply."""
    alert = lambda cond, rule, kind, severity, x: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit("ALL").alias("code"), x.alias("excess")))
    owed, billed = F.col("patient_responsibility"), F.col("amount_billed")
    most = (F.coalesce("network_discount", F.lit(0.0)) == 0) & (billed > 0) & (owed / F.nullif("amount_billed", F.lit(0.0)) > 0.5)
    expected = round_to(billed - F.col("plan_paid") - F.coalesce("network_discount", F.lit(0.0)), 2)
    more = round_to(owed - expected, 2)
    return {
        "no_discount": alert(most, "no_discount", "surprise_bill", "warning", round_to(owed - billed * COINSURANCE, 2)),
        "arithmetic": alert((more > MATERIAL) & (expected >= 0), "arithmetic", "balance_billing", "alert", more),
    }


def _statement_alerts(eobs: DataFrame, *rules: str) -> DataFrame:
    return eobs.select("bill_id", F.inline(F.array_compact(F.array(*[c for rule, c in _statement_rules().items() if rule in rules]))))


def surprise_bills(eobs: DataFrame) -> DataFrame:
    """No discount and more than half of the bill for the patient; excess over 20 %."""
    return _statement_alerts(eobs, "no_discount")


def wrong_arithmetic(eobs: DataFrame) -> DataFrame:
    """Patient share above billed less paid less discount, by more than 1, that difference not being negative."""
    return _statement_alerts(eobs, "arithmetic")


def excessive_markups(found: DataFrame) -> DataFrame:
    """Billed at least four times the rate, by the unrounded ratio; ten times is an alert."""
    ratio = F.col("billed_amount") / F.nullif("rate_used", F.lit(0.0))
    d = found.where((F.col("rate_used") > 0) & (ratio >= MARKUP))
    return _alert(d, "markup", "excessive_markup", F.when(ratio >= MARKUP_ALERT, "alert").otherwise("warning"), F.col("code"), round_to(F.col("billed_amount") - F.col("rate_used"), 2))


def alerts(found: DataFrame, lines: DataFrame, eob_lines: DataFrame, eobs: DataFrame) -> DataFrame:
    """All alerts; ``lines`` are the bill lines of the findings."""
    return billing_alerts(lines, eob_lines, eobs).unionByName(excessive_markups(found))


def billing_alerts(lines: DataFrame, eob_lines: DataFrame, eobs: DataFrame) -> DataFrame:
    """Alerts of lines and statements: all but markups."""
    return line_alerts(lines, eob_lines).unionByName(_statement_alerts(eobs, *_statement_rules()))


def site_of_service(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """Cheaper sites (P30): lines (bill_id, line_number, code, description, locality) with site rates per (code, locality).

    Saving is facility less office rate where both are positive and the first is larger; advice is a class, not prose.
    """
    from .matching import join_nullsafe, site_saving

    d = join_nullsafe(lines, rates, ["code", "locality"])
    fac, off = F.col("facility_rate"), F.col("non_facility_rate")
    saving = site_saving("facility_rate", "non_facility_rate")
    advice = (
        F.when(~is_shoppable("code"), shopping_reason("code")).when((fac > off) & (off > 0), "cheaper_in_office").when(fac == off, "same_rate")
        .when(off.isNotNull() & fac.isNull(), "only_office").when(fac.isNotNull() & off.isNull(), "only_facility").otherwise("compare")
    )
    return d.withColumns({"saving": saving, "saving_percent": round_to(saving / F.nullif("facility_rate", F.lit(0.0)) * 100, 1), "shoppable": is_shoppable("code"), "advice": advice, "description": F.coalesce("rate_description", "description")})


def savings_summary(found: DataFrame, bills: DataFrame, errors: DataFrame, alerts_: DataFrame) -> DataFrame:
    """Savings per bill (A22): what findings with site rates give is summed in one grouping, then errors and alerts (without markups) are joined.

    ``found`` are ``audit.findings`` with ``sites``. Bills without a finding have no row.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    markup = (F.col("rate_used") > 0) & (F.col("billed_amount") / F.nullif("rate_used", F.lit(0.0)) >= MARKUP)
    d = found.select(
        "bill_id", "rate_used", F.col("site_saving").alias("site"), F.when(markup, round_to(F.col("billed_amount") - F.col("rate_used"), 2)).alias("excess"), F.coalesce(markup, F.lit(False)).alias("markup"),
    ).groupBy("bill_id").agg(
        F.coalesce(round_to(F.sum("rate_used"), 2), F.lit(0.0)).alias("baseline"), round_to(F.sum("site"), 2).alias("site_savings"), F.count("site").alias("shoppable_count"),
        F.count_if("markup").alias("markup_count"), round_to(F.sum("excess"), 2).alias("markup_excess"),
    )
    e = errors.groupBy("bill_id").agg(round_to(F.sum("saving"), 2).alias("error_savings"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("saving") > 0, F.col("type")))), ",").alias("error_types"))
    b = alerts_.groupBy("bill_id").agg(round_to(F.sum("excess"), 2).alias("balance_savings"))
    d = d.join(bills.select("bill_id", "total_billed"), "bill_id").join(e, "bill_id", "left").join(b, "bill_id", "left")
    known = F.col("baseline") > 0
    target = F.when(known, round_to(F.col("baseline") * TARGET, 2)).otherwise(0.0)
    d = d.select(
        "bill_id", "total_billed", "baseline", target.alias("target"), zero("error_savings"), zero("site_savings"), zero("balance_savings"), F.coalesce("error_types", F.lit("")).alias("error_types"),
        F.coalesce("shoppable_count", F.lit(0)).alias("shoppable_count"), F.coalesce("markup_count", F.lit(0)).alias("markup_count"), zero("markup_excess"),
        F.when(known, F.col("total_billed") / F.nullif("baseline", F.lit(0.0)) > 3).otherwise(False).alias("over_three_times"),
    )
    uninsured = F.when(known, F.greatest(F.lit(0.0), round_to(F.col("total_billed") - F.col("target"), 2))).otherwise(0.0)
    return d.withColumns({"uninsured_savings": uninsured, "total_savings": round_to(F.col("error_savings") + F.col("site_savings") + F.col("balance_savings"), 2)})
