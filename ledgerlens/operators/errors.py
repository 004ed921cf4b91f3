"""Billing-error rules. Each gives rows (bill_id, rule, type, severity, codes, saving); codes are ordered as billed.

Rules that list lines come from one grouping: a line gives a row for each part that it plays in a rule, and rows are aggregated by
bill, rule and key. A finding lists its codes, so the lines of one bill and rule are collected; plain repeats are only counted, apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BUNDLES, DISTINCT_MODIFIERS, IMAGING, SURGICAL, TOP_VISITS, WOUND, body_area, is_visit, number_prefix, round_to
from .matching import best_by_place

COLUMNS = ("bill_id", "rule", "type", "severity", "codes", "saving")


#: A finding as it leaves a grouping.
FINDING = "struct<rule: string, type: string, severity: string, codes: string, saving: double>"


def _finding(rule: str, kind: str, severity: str, codes: Column, saving: Column | None = None) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), codes.alias("codes"), (F.lit(None) if saving is None else saving).cast("double").alias("saving")]


def upcoding(lines: DataFrame, packs: DataFrame) -> DataFrame:
    """Top-level visit codes against the next lower level (J11), for ``audit.placed_lines`` and ``matching.rate_packs``."""
    lower = F.create_map(*[F.lit(x) for kv in TOP_VISITS.items() for x in kv])
    d = lines.where(F.col("code").isin(*TOP_VISITS)).select("bill_id", "code", "locality", "context").withColumn("lower", lower[F.col("code")])
    asked = d.select(F.col("code").alias("top"), "lower", "locality").distinct().withColumn("code", F.explode(F.array("top", "lower")))
    rated = asked.join(packs.where(F.col("code").isin(*TOP_VISITS, *TOP_VISITS.values())).select("code", "pfs"), "code").withColumn("rate", best_by_place())
    place = F.coalesce("locality", F.lit("")).alias("place")
    rates = rated.groupBy(F.col("top").alias("code"), place).agg(F.min(F.when(F.col("code") == F.col("top"), F.col("rate"))).alias("r1"), F.min(F.when(F.col("code") == F.col("lower"), F.col("rate"))).alias("r2"))
    d = d.withColumn("place", place).join(rates, ["code", "place"], "left")
    used = lambda p: F.when(F.col("context") == "facility", F.coalesce(f"{p}.facility_rate", f"{p}.non_facility_rate")).otherwise(F.coalesce(f"{p}.non_facility_rate", f"{p}.facility_rate"))
    saving = round_to(used("r1") - used("r2"), 2)
    return d.select("bill_id", *_finding("upcoding", "upcoding", "warning", F.col("code"), F.when(saving > 0, saving)))


def _part(group: str, cond: Column, second: bool = False, key: Column | None = None) -> Column:
    key = F.lit("") if key is None else key.cast("string")
    return F.when(cond, F.struct(F.lit(group).alias("group"), key.alias("key"), F.lit(second).alias("second")))


def _parts() -> dict[str, list[Column]]:
    """The parts of a line with ``_marks`` by group of rules; in most groups lines of the first part need lines of the second."""
    surgical, wound, visit, area = F.col("surgical"), F.col("wound"), is_visit("code"), F.col("area")
    marked = F.coalesce("modifier", F.lit("")) == "25"
    return {
        "bundle": [_part("bundle", F.col("code").isin(*codes), second, F.lit(n)) for n, primary, extra in BUNDLES for second, codes in ((False, primary), (True, extra))],
        "wound_repair": [_part("wound_repair", surgical & ~wound), _part("wound_repair", wound, True)],
        "visit_with_procedure": [_part("visit_with_procedure", visit & ~marked), _part("visit_with_procedure", surgical, True)],
        "repeated_imaging": [_part("repeated_imaging", area.isNotNull(), key=area)],
        "modifier_25": [_part("modifier_25", visit & marked), _part("modifier_25", surgical, True)],
    }


def _marks(lines: DataFrame) -> DataFrame:
    """Lines with what their code's number says, read once, and the body area of imaging."""
    d = lines.withColumn("number", number_prefix("code"))
    within = lambda low, high: F.coalesce(F.col("number").between(low, high), F.lit(False))
    imaging = within(*IMAGING)
    return d.withColumns({"surgical": within(*SURGICAL), "wound": within(*WOUND), "area": F.when(imaging, body_area("description")) if "description" in lines.columns else F.lit(None).cast("string")})


def _found(lines: DataFrame, *groups: str) -> DataFrame:
    """Findings of the groups of rules that list lines, in one pass over the lines."""
    parts, lines = _parts(), _marks(lines)
    bare = ~F.coalesce(F.col("modifier").isin(*DISTINCT_MODIFIERS), F.lit(False))
    d = lines.select("bill_id", F.struct("line_number", "code", "billed_amount", bare.alias("bare")).alias("line"), F.explode(F.array_compact(F.array(*[p for g in groups for p in parts[g]]))).alias("part"))
    d = d.select("bill_id", "line", "part.*")
    listed = lambda second: F.sort_array(F.collect_list(F.when(F.col("second") == second, F.col("line"))))
    amount = F.col("line.billed_amount")
    d = d.groupBy("bill_id", "group", "key").agg(
        F.count("*").alias("n"), listed(False).alias("a"), listed(True).alias("b"), F.sum(F.when(F.col("second"), amount)).alias("extra")
    )
    codes = lambda a: F.transform(a, lambda x: x["code"])
    joined = lambda *a: F.array_join(F.concat(*[codes(x) for x in a]), ",")
    a, b = F.col("a"), F.col("b")
    first = F.transform(F.array_distinct(codes(b)), lambda c: F.get(F.filter(b, lambda x: x["code"] == c), F.lit(0))["billed_amount"])
    first = F.filter(first, lambda x: x.isNotNull())
    first = F.when(F.size(first) > 0, round_to(F.aggregate(first, F.lit(0.0), lambda s, x: s + x), 2))
    distinct = F.array_join(F.concat(F.array_sort(F.array_distinct(codes(a))), F.array_sort(F.array_distinct(codes(b)))), ",")
    one = lambda *x: F.array(F.struct(*_finding(*x)))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    found = {
        "bundle": (both, F.concat(one("bundle", "unbundling", "alert", distinct, first), F.transform(F.filter(b, lambda x: x["bare"]), lambda x: F.struct(*_finding("missing_59", "modifier", "info", x["code"]))))),
        "wound_repair": (both, one("wound_repair", "unbundling", "warning", joined(a, b), F.when(F.col("extra") > 0, round_to("extra", 2)))),
        "visit_with_procedure": (both, one("visit_with_procedure", "unbundling", "warning", joined(a, b))),
        "repeated_imaging": (F.col("n") > 1, one("repeated_imaging", "unbundling", "info", joined(a))),
        "modifier_25": (both, F.transform(a, lambda x: F.struct(*_finding("modifier_25", "modifier", "info", F.concat_ws(",", x["code"], joined(b)))))),
    }
    rows = F.coalesce(*[F.when((F.col("group") == g) & found[g][0], found[g][1].cast(f"array<{FINDING}>")) for g in groups])
    return d.select("bill_id", F.inline(rows))


def bundled(lines: DataFrame) -> DataFrame:
    """Laboratory panels with a separate blood draw, per rule; saving is the first line of each bundled code (A10)."""
    return _found(lines, "bundle").where("rule = 'bundle'")


def wound_repair(lines: DataFrame) -> DataFrame:
    """Surgery with separate wound repair."""
    return _found(lines, "wound_repair")


def visit_with_procedure(lines: DataFrame) -> DataFrame:
    """A visit without modifier 25 together with a procedure."""
    return _found(lines, "visit_with_procedure")


def repeated_imaging(lines: DataFrame) -> DataFrame:
    """More than one imaging line of a body area."""
    return _found(lines, "repeated_imaging")


def duplicates(lines: DataFrame) -> DataFrame:
    """A code billed more than once; saving is what follows the first line, if positive."""
    d = lines.groupBy("bill_id", "code").agg(F.count("*").alias("n"), (F.sum("billed_amount") - F.min_by("billed_amount", "line_number")).alias("repeats")).where("n > 1")
    repeats = round_to("repeats", 2)
    return d.select("bill_id", *_finding("duplicate", "duplicate", "warning", F.col("code"), F.when(repeats > 0, repeats)))


def missing_distinct_modifier(lines: DataFrame) -> DataFrame:
    """Bundled lines without a distinct-service modifier, once per rule that fires."""
    return _found(lines, "bundle").where("rule = 'missing_59'")


def modifier_25(lines: DataFrame) -> DataFrame:
    """Visits with modifier 25 together with a procedure."""
    return _found(lines, "modifier_25")


def billing_errors(lines: DataFrame, packs: DataFrame) -> DataFrame:
    """All rules in one table."""
    return upcoding(lines, packs).unionByName(duplicates(lines)).unionByName(_found(lines, *_parts()))
