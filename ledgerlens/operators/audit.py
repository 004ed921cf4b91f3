"""Audit of bills: findings per line, totals and tops per bill, the nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dispute_strength, rate_context, round_to, severity, severity_rank
from .matching import join_nullsafe, match_rates, resolve_zip, site_savings


def placed_lines(bills: DataFrame, lines: DataFrame, zips: DataFrame) -> DataFrame:
    """Bill lines with the locality of their bill (its own, else its ZIP's) and the rate context."""
    head = resolve_zip(bills.select("bill_id", "zip", "locality", "setting", "facility_type"), zips).select("bill_id", "locality", rate_context("setting", "facility_type").alias("context"))
    return lines.join(head, "bill_id")


LOOKUP = ["code", "modifier", "locality", "context"]


def _look_up() -> Column:
    """The four values of a look-up as one text, null unlike any value; codes, modifiers and places have no control characters."""
    return F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x02")) for c in LOOKUP])


def findings(placed: DataFrame, packs: DataFrame, by: str | None = None, sites: bool = False) -> DataFrame:
    """One finding per bill line: the matched rate, overcharge, multiplier, severity and dispute strength.

    Bills repeat codes heavily, so DISTINCT look-ups are matched and joined back; that also removes the skew of common
    codes from the rate join. Lines take one short key to that join and get the look-up's values from the other side.
    ``placed`` (from ``placed_lines``) is read twice, so it should be a stored step; ``packs`` is ``matching.rate_packs``.
    Units are ignored: a line is compared with the rate of one unit. With ``by`` findings are dealt by that column before
    ratings are derived, so that a grouping by it moves no more; ``sites`` adds ``matching.site_savings``.
    """
    asked = placed.select(*LOOKUP).distinct()
    rated = match_rates(asked, packs)
    if sites:
        rated = join_nullsafe(rated, site_savings(asked, packs), ["code", "locality"])
    joined = placed.withColumn("__key", _look_up()).drop(*LOOKUP).join(rated.withColumn("__key", _look_up()), "__key")
    joined = joined.select(*placed.columns, *[c for c in rated.columns if c not in LOOKUP])
    return rate_lines(joined.repartition(by) if by else joined)


def rate_lines(joined: DataFrame) -> DataFrame:
    over = F.when(F.col("rate_used").isNotNull(), round_to(F.col("billed_amount") - F.col("rate_used"), 2))
    multiplier = F.when(F.col("rate_used") > 0, round_to(F.col("billed_amount") / F.nullif("rate_used", F.lit(0.0)), 1))
    d = joined.withColumns({"overcharge": over, "multiplier": multiplier})
    return d.withColumns({"severity": severity("multiplier"), "dispute": dispute_strength("mode", "source", "multiplier")})


def _totals() -> list[Column]:
    return [
        F.coalesce(round_to(F.sum("rate_used"), 2), F.lit(0.0)).alias("baseline"), F.count_if(F.col("mode") != "unmatched").alias("matched"), F.count_if(F.col("mode") == "unmatched").alias("unmatched"),
        round_to(F.avg("multiplier"), 1).alias("avg_multiplier"),
    ]


def _with_savings(by_bill: DataFrame, bills: DataFrame) -> DataFrame:
    return by_bill.join(bills.select("bill_id", "total_billed"), "bill_id").withColumn("savings", round_to(F.col("total_billed") - F.col("baseline"), 2))


def bill_totals(found: DataFrame, bills: DataFrame) -> DataFrame:
    """Totals per bill (A01): savings are the header's total less the baseline; multipliers are averaged as rounded."""
    return _with_savings(found.groupBy("bill_id").agg(*_totals()), bills)


def overcharge_by_severity(found: DataFrame) -> DataFrame:
    """(bill_id, severity, overcharge): sums of positive and negative differences of matched lines."""
    return found.where("severity IS NOT NULL").groupBy("bill_id", "severity").agg(round_to(F.sum("overcharge"), 2).alias("overcharge"))


def top_overcharges(found: DataFrame, k: int = 5) -> DataFrame:
    """The k largest positive overcharges per bill, ties by line."""
    w = Window.partitionBy("bill_id").orderBy(F.desc("overcharge"), "line_number")
    return found.where("overcharge > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_by_severity(found: DataFrame, k: int = 5) -> DataFrame:
    """The k findings per bill that rank highest by severity, then line."""
    w = Window.partitionBy("bill_id").orderBy(severity_rank("severity"), "line_number")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_by_multiplier(found: DataFrame, k: int = 10) -> DataFrame:
    """The k findings per bill with the largest multiplier, null as 0, ties by line."""
    w = Window.partitionBy("bill_id").orderBy(F.desc(F.coalesce("multiplier", F.lit(0.0))), "line_number")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_overcharged(found: DataFrame, k: int = 5) -> DataFrame:
    """The first k overcharged findings per bill in line order."""
    w = Window.partitionBy("bill_id").orderBy("line_number")
    return found.where("overcharge > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def worst_line(found: DataFrame) -> DataFrame:
    """The worst line per bill with its ratio rounded to whole numbers."""
    worst = found.where("overcharge > 0").groupBy("bill_id").agg(F.max(F.struct("overcharge", (-F.col("line_number")).alias("o"), "code", "billed_amount", "rate_used")).alias("w"))
    return worst.select("bill_id", "w.code", "w.overcharge", F.when(F.col("w.rate_used") > 0, round_to(F.col("w.billed_amount") / F.col("w.rate_used"), 0)).alias("ratio"))


def reports(found: DataFrame, bills: DataFrame) -> DataFrame:
    """One nested report per bill (A03): header figures, findings in line order, severity map, top five.

    All of it is one aggregation by bill; the map has a sum per severity, the top five come from the sorted array.
    """
    finding = F.struct("line_number", "code", "modifier", "billed_amount", "source", "mode", "rate_used", "overcharge", "multiplier", "severity", "dispute")
    sums = {s: round_to(F.sum(F.when(F.col("severity") == s, F.col("overcharge"))), 2) for s in ("extreme", "high", "low", "medium")}
    each = found.groupBy("bill_id").agg(*_totals(), F.sort_array(F.collect_list(finding)).alias("findings"), *[x.alias(f"__{s}") for s, x in sums.items()])
    over = F.map_filter(F.create_map(*[x for s in sums for x in (F.lit(s), F.col(f"__{s}"))]), lambda _, v: v.isNotNull())
    top = F.transform(
        F.slice(F.sort_array(F.transform(F.filter("findings", lambda f: f["overcharge"] > 0), lambda f: F.struct((-f["overcharge"]).alias("o"), f["line_number"].alias("line"), f["code"].alias("code")))), 1, 5),
        lambda f: F.struct(f["code"].alias("code"), (-f["o"]).alias("overcharge")),
    )
    d = _with_savings(each.withColumn("overcharge_by_severity", F.when(F.size(over) > 0, over)).drop(*[f"__{s}" for s in sums]), bills)
    return d.withColumn("top_overcharges", top)


def available_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """(source): the rate tables that hold any row."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.limit(1).select(F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out
