"""Insurer statements against public rates: comparisons, per-bill audit, insights, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import NATIONAL_AVERAGE, PLAN_MULTIPLES, grams, plan_midpoint, plan_type, round_to


def best_eob_lines(eob_lines: DataFrame) -> DataFrame:
    """Per bill and code the line with the highest allowed amount, ties by line."""
    pick = F.max(F.struct(F.coalesce("allowed_amount", F.lit(-1.0)).alias("o"), (-F.col("line_number")).alias("l"), "allowed_amount", "insurance_paid", "patient_responsibility"))
    return eob_lines.where("code IS NOT NULL").groupBy("bill_id", "code").agg(pick.alias("e")).select("bill_id", "code", "e.allowed_amount", "e.insurance_paid", "e.patient_responsibility")


def compare(found: DataFrame, eob_lines: DataFrame) -> DataFrame:
    """Estimates by plan and differences per finding."""
    d = found.join(best_eob_lines(eob_lines), ["bill_id", "code"], "left")
    est = {f"{p}_{end}": round_to(F.col("rate_used") * m, 2) for p, ends in PLAN_MULTIPLES.items() for end, m in zip(("low", "high"), ends, strict=True)}
    d = d.withColumns(est | {"national_avg": round_to(F.col("rate_used") * NATIONAL_AVERAGE, 2)})
    return d.withColumns(
        {
            "over_cms": round_to(F.col("billed_amount") - F.col("rate_used"), 2),
            "over_estimated": round_to(F.col("billed_amount") - F.col("national_avg"), 2),
            "over_actual": round_to(F.col("billed_amount") - F.col("allowed_amount"), 2),
            "allowed_over_cms": round_to(F.col("allowed_amount") - F.col("rate_used"), 2),
        }
    )


def eob_audit(found: DataFrame, eob_lines: DataFrame, eobs: DataFrame, plan: str | None = None) -> DataFrame:
    """Per bill: allowed, plan midpoint, paid and patient share; the plan is an option or the statement's (A06), write-off."""
    plans = eobs.select("bill_id", F.lit(plan).alias("plan") if plan else plan_type("plan_type").alias("plan"))
    d = compare(found, eob_lines).join(plans, "bill_id").withColumn("midpoint", plan_midpoint("rate_used", "plan"))
    by = d.groupBy("bill_id", "plan").agg(*[round_to(F.sum(c), 2).alias(n) for c, n in (("billed_amount", "billed"), ("allowed_amount", "allowed"), ("midpoint", "midpoint"), ("insurance_paid", "paid"), ("patient_responsibility", "patient"))])
    off = round_to(F.col("billed") - F.col("allowed"), 2)
    return by.withColumns({"write_off": off, "write_off_percent": F.when(F.col("billed") > 0, round_to(off / F.nullif("billed", F.lit(0.0)) * 100, 1))})


def insights(found: DataFrame, eob_lines: DataFrame, eobs: DataFrame, inline: bool = False) -> DataFrame:
    """Insights per finding (A07); ``inline`` has the thresholds of a statement that comes with the bill."""
    d = compare(found, eob_lines).join(eobs.select("bill_id", plan_type("plan_type").alias("plan")), "bill_id").where("rate_used IS NOT NULL")
    mid, billed, allowed = plan_midpoint("rate_used", "plan"), F.col("billed_amount"), F.col("allowed_amount")
    row = lambda kind, level: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"))
    if inline:
        rules = [F.when(allowed > 1.5 * F.col("rate_used"), row("allowed_over_cms", "info")), F.when(billed > 2 * allowed, row("billed_over_allowed", "warning")), F.when((F.col("patient_responsibility") > 0) & (billed > 3 * F.col("patient_responsibility")), row("billed_over_share", "info"))]
    else:
        rules = [
            F.when(allowed > 1.5 * F.col("rate_used"), row("allowed_over_cms", "info")), F.when(billed > 5 * allowed, row("billed_over_allowed", "warning")),
            F.when(billed > 3 * mid, row("billed_over_plan", "alert")), F.when(F.startswith("code", F.lit("J")) & (billed > 3 * allowed), row("drug_markup", "alert")),
        ]
    return d.withColumn("i", F.explode(F.array_compact(F.array(*rules)))).select("bill_id", "line_number", "code", "i.*")


PREFIX = 10


def line_for_finding(found: DataFrame, eob_lines: DataFrame, descriptions: str = "description") -> DataFrame:
    """Per finding the first statement line of its code, or whose description holds the finding's first ten letters.

    Either condition is an equi-join: on (bill, code), and on (bill, piece), where a statement line gives all pieces of
    its description that are as long as a finding's beginning (ten letters; of short descriptions fewer). Keys keep their
    first line only, so a bill of any size costs its lines, not its pairs.
    """
    begins = F.lower(F.substring("description", 1, PREFIX))
    own = F.array(F.struct(F.lit("code").alias("kind"), F.col("code").alias("key")), F.struct(F.lit("piece").alias("kind"), begins.alias("key")))
    asked = found.select("bill_id", "line_number", F.explode(own).alias("k")).select("bill_id", "line_number", "k.*").where("key IS NOT NULL")
    keys = eob_lines.where("code IS NOT NULL").select("bill_id", F.lit("code").alias("kind"), F.col("code").alias("key"), "line_number", "allowed_amount")
    if descriptions in eob_lines.columns:
        # lengths of beginnings: at most eleven numbers a bill
        sizes = found.where("description IS NOT NULL").groupBy("bill_id").agg(F.collect_set(F.least(F.length("description"), F.lit(PREFIX))).alias("sizes"))
        text = F.lower(F.col(descriptions))
        pieces = F.array_distinct(F.flatten(F.transform("sizes", lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(grams(text, n)))))
        said = eob_lines.where(F.col(descriptions).isNotNull()).join(sizes, "bill_id").select("bill_id", F.lit("piece").alias("kind"), F.explode(pieces).alias("key"), "line_number", "allowed_amount")
        keys = keys.unionByName(said)
    first = keys.groupBy("bill_id", "kind", "key").agg(F.min_by("allowed_amount", "line_number").alias("allowed_amount"), F.min("line_number").alias("eob_line"))
    d = asked.join(first, ["bill_id", "kind", "key"]).groupBy("bill_id", "line_number").agg(F.min_by(F.struct("eob_line", "allowed_amount"), "eob_line").alias("e"))
    return d.select("bill_id", "line_number", "e.*")


def allowed_fallback(found: DataFrame, matched: DataFrame, eobs: DataFrame) -> DataFrame:
    """Where a bill has one finding and a statement summary, the allowed amount is billed less discount."""
    n = found.groupBy("bill_id").agg(F.count("*").alias("n"))
    d = found.select("bill_id", "line_number", "billed_amount").join(matched.select("bill_id", "line_number", "allowed_amount"), ["bill_id", "line_number"], "left").join(n, "bill_id").join(eobs.select("bill_id", "network_discount"), "bill_id", "left")
    fallback = F.when((F.col("n") == 1) & F.col("network_discount").isNotNull(), round_to(F.col("billed_amount") - F.col("network_discount"), 2))
    return d.select("bill_id", "line_number", F.coalesce("allowed_amount", fallback).alias("allowed_amount"))


def eob_totals(eob_lines: DataFrame, eobs: DataFrame) -> DataFrame:
    """Given or summed totals, and whether they differ by more than 1."""
    sums = eob_lines.groupBy("bill_id").agg(round_to(F.sum("allowed_amount"), 2).alias("summed"))
    d = eobs.select("bill_id", "total_allowed").join(sums, "bill_id", "left")
    return d.select("bill_id", F.coalesce("total_allowed", "summed").alias("total_allowed"), F.coalesce(F.abs(F.col("total_allowed") - F.col("summed")) > 1, F.lit(False)).alias("differs"))


def validate_lines(eob_lines: DataFrame) -> DataFrame:
    """Required amounts and reject reasons (P23), coherence of allowed with paid and patient share."""
    reasons = F.array_compact(F.array(F.when(F.col("code").isNull(), F.lit("code")), F.when(F.col("billed_amount").isNull(), F.lit("billed_amount")), F.when(F.col("allowed_amount").isNull(), F.lit("allowed_amount"))))
    share = F.coalesce("insurance_paid", F.lit(0.0)) + F.coalesce("patient_responsibility", F.lit(0.0))
    return eob_lines.withColumns({"reasons": F.array_join(reasons, ","), "valid": F.size(reasons) == 0, "incoherent": F.coalesce(F.abs(F.col("allowed_amount") - share) > 0.10, F.lit(False))})


def validate_bills(bills: DataFrame, lines: DataFrame) -> DataFrame:
    """Bills with reject reasons (P22): enumerations, confidence in 0..1, at least one line."""
    n = lines.groupBy("bill_id").agg(F.count("*").alias("n_lines"))
    d = bills.join(n, "bill_id", "left")
    checks = {
        "facility_type": ~F.coalesce(F.col("facility_type").isin("hospital", "er", "outpatient", "clinic", "office", "unknown"), F.lit(False)),
        "source_type": ~F.coalesce(F.col("source_type").isin("pdf", "image", "json", "manual"), F.lit(False)),
        "confidence": ~F.coalesce(F.col("parse_confidence").between(0, 1), F.lit(False)),
        "total": F.col("total_billed").isNull(),
        "lines": F.coalesce("n_lines", F.lit(0)) == 0,
    }
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return d.select("bill_id", F.size(reasons).alias("n_reasons"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("valid"))


def appeal_types(bills: DataFrame, eobs: DataFrame) -> DataFrame:
    """Kind of appeal per bill."""
    d = bills.select("bill_id", "uninsured").join(eobs, "bill_id", "left")
    known = F.col("amount_billed").isNotNull() & F.col("plan_paid").isNotNull() & F.col("patient_responsibility").isNotNull()
    over = known & (F.col("patient_responsibility") > 0.5 * F.col("plan_paid"))
    return d.select("bill_id", F.when(F.col("uninsured"), "billing_dispute").when(over, "balance_billing_complaint").otherwise("denial_appeal").alias("appeal"))


def effective_rates(found: DataFrame) -> DataFrame:
    """Matched findings with a positive effective rate."""
    return found.withColumn("effective_rate", F.coalesce("rate_used", "non_facility_rate", "facility_rate")).where("mode != 'unmatched' AND effective_rate > 0")


def appeal_facts(found: DataFrame) -> DataFrame:
    """Figures of an appeal per bill."""
    usable = (F.col("mode") != "unmatched") & (F.coalesce("rate_used", "non_facility_rate", "facility_rate") > 0)
    rate = F.coalesce("rate_used", "non_facility_rate", "facility_rate")
    d = found.groupBy("bill_id").agg(round_to(F.sum("billed_amount"), 2).alias("billed"), round_to(F.sum(F.when(usable, rate)), 2).alias("cms"), F.count_if(usable).alias("matched"), F.count("*").alias("lines"))
    return d.withColumns({"markup": F.when(F.col("cms") > 0, round_to(F.col("billed") / F.nullif("cms", F.lit(0.0)), 1)), "fair_price": round_to(F.col("cms") * 1.2, 2)})


def rank_lines(d: DataFrame) -> DataFrame:
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("bill_id").orderBy("line_number")))
