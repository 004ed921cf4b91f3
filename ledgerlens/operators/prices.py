"""Hospital prices, community prices, charity hospitals, price-file registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contains_ci, name_similarity, plain_name, round_to
from .matching import join_holding, join_nullsafe


QUESTION = ["code", "hospital", "payer"]
SHARES = 32  #: a question's prices are ranked in so many shares first


def _asked(requests: DataFrame) -> DataFrame:
    """Distinct questions (code, hospital, payer): requests for the same are answered once."""
    return requests.select(*QUESTION).distinct()


def look_up_prices(requests: DataFrame, prices: DataFrame, limit: int = 200) -> DataFrame:
    """Prices per request (request_id, code, hospital, payer), names being optional substrings, at most ``limit`` each.

    Distinct questions meet prices by code; the name tests are residual. Prices are ranked in two rounds, first within
    shares of a question that their own hash deals, so that no task sorts all prices of a common code; each round
    keeps ``limit`` rows a question and share. Ordered by hospital, payer, then file order.
    """
    q = _asked(requests).withColumnRenamed("code", "billing_code")
    ok = (F.col("hospital").isNull() | contains_ci("hospital_name", "hospital")) & (F.col("payer").isNull() | F.coalesce(contains_ci("payer_name", "payer"), F.lit(False)))
    order = ("hospital_name", F.asc_nulls_first("payer_name"), "price_seq", "gross_charge")
    by = ("billing_code", "hospital", "payer")
    d = q.join(prices, "billing_code").where(ok).withColumn("__share", F.pmod(F.xxhash64("price_seq", "hospital_name"), F.lit(SHARES)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "__share").orderBy(*order))).where(F.col("rank") <= limit).drop("__share")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)
    return join_nullsafe(requests.select("request_id", *QUESTION), d.withColumnRenamed("billing_code", "code"), QUESTION, "inner").withColumnRenamed("code", "billing_code")


def lowest_prices(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Lowest positive cash price, and lowest positive negotiated rate for the payer, per request."""
    d = _asked(requests).join(prices.withColumnRenamed("billing_code", "code"), "code").where(F.col("hospital").isNull() | contains_ci("hospital_name", "hospital"))
    ours = F.coalesce(contains_ci("payer_name", "payer"), F.lit(False)) & (F.col("negotiated_rate") > 0)
    cash = F.min(F.when(F.col("cash_discount_price") > 0, F.col("cash_discount_price")))
    found = d.groupBy(*QUESTION).agg(round_to(cash, 2).alias("cash_price"), round_to(F.min(F.when(ours, F.col("negotiated_rate"))), 2).alias("negotiated_rate"))
    return join_nullsafe(requests.select("request_id", *QUESTION), found, QUESTION, "inner").drop(*QUESTION)


def enrich(found: DataFrame, bills: DataFrame, prices: DataFrame) -> DataFrame:
    """Findings with cash price, number of negotiated rates and first gross charge at the bill's facility.

    Distinct (code, facility) pairs are joined to prices, then joined back to findings; a bill without a facility takes
    all hospitals.
    """
    d = found.join(bills.select("bill_id", F.col("facility_name").alias("facility")), "bill_id")
    asked = d.select("code", "facility").distinct()
    p = asked.join(prices, asked["code"] == prices["billing_code"]).where(F.col("facility").isNull() | contains_ci("hospital_name", "facility"))
    rate = F.when(F.col("negotiated_rate") > 0, F.struct("payer_name", "plan_name", "negotiated_rate"))
    e = p.groupBy("code", "facility").agg(
        F.min(F.when(F.col("cash_discount_price") > 0, F.col("cash_discount_price"))).alias("cash_price"),
        F.sort_array(F.collect_set(rate)).alias("negotiated"),
        F.min(F.struct("price_seq", "gross_charge"))["gross_charge"].alias("gross_charge"),
    )
    return join_nullsafe(d, e, ["code", "facility"])


def price_stats(prices: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct hospitals, payers and codes (A29); ``approximate`` needs no expansion by column."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return prices.agg(F.count("*").alias("n"), distinct("hospital_name").alias("hospitals"), distinct("payer_name").alias("payers"), distinct("billing_code").alias("codes"))


def price_summary(prices: DataFrame) -> DataFrame:
    """Per code the number of hospitals and the range of positive prices, in one aggregation."""
    ranges = []
    for c, n in (("cash_discount_price", "cash"), ("negotiated_rate", "negotiated"), ("gross_charge", "gross")):
        positive = F.when(F.col(c) > 0, F.col(c))
        ranges += [F.min(positive).alias(f"min_{n}"), F.max(positive).alias(f"max_{n}")]
    return prices.groupBy("billing_code").agg(F.countDistinct("hospital_name").alias("hospitals"), *ranges)


_RANGES = (("cash_discount_price", "cash"), ("negotiated_rate", "negotiated"), ("gross_charge", "gross"))
SKETCH = 12  #: log2 of a sketch's registers: a standard error of about 1.6 %, exact for small counts


def price_sketches(prices: DataFrame) -> DataFrame:
    """Per source and code what A29 and A30 need, in a form that sources can be put together from.

    Stored with ``sinks.replace_source``, so a replaced source (K05) costs a pass over that source only: ``merged_summary``
    and ``merged_stats`` read the sketches of all sources, never their prices.
    """
    ranges = [f(F.when(F.col(c) > 0, F.col(c))).alias(f"{name}_{n}") for c, n in _RANGES for name, f in (("min", F.min), ("max", F.max))]
    return prices.groupBy("source_id", "billing_code").agg(F.count("*").alias("n"), F.hll_sketch_agg("hospital_name", SKETCH).alias("hospitals"), F.hll_sketch_agg("payer_name", SKETCH).alias("payers"), *ranges)


def merged_summary(sketches: DataFrame) -> DataFrame:
    """``price_summary`` from sketches: ranges exact, hospitals within the sketch's error."""
    ranges = [f(f"{name}_{n}").alias(f"{name}_{n}") for _, n in _RANGES for name, f in (("min", F.min), ("max", F.max))]
    return sketches.groupBy("billing_code").agg(F.hll_sketch_estimate(F.hll_union_agg("hospitals")).alias("hospitals"), *ranges)


def merged_stats(sketches: DataFrame) -> DataFrame:
    """``price_stats`` from sketches: rows and codes exact, hospitals and payers within the sketch's error."""
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    return sketches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), estimate("hospitals"), estimate("payers"), F.countDistinct("billing_code").alias("codes"))


def cheapest_payers(prices: DataFrame, k: int = 20) -> DataFrame:
    """Mean negotiated rate per code and payer, the k cheapest of each code."""
    mean = prices.where("negotiated_rate > 0 AND payer_name IS NOT NULL").groupBy("billing_code", "payer_name").agg(round_to(F.avg("negotiated_rate"), 2).alias("mean_rate"))
    w = Window.partitionBy("billing_code").orderBy("mean_rate", "payer_name")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def newest(prices: DataFrame, k: int = 100) -> DataFrame:
    """The k newest community prices of each code."""
    w = Window.partitionBy("billing_code").orderBy(F.desc("submitted_at"), F.desc("price_id"), F.desc("amount_paid"))
    return prices.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def community_stats(prices: DataFrame, k: int = 100) -> DataFrame:
    """Count, mean, range and upper median of the k newest amounts per code."""
    amounts = F.sort_array(F.collect_list("amount_paid"))
    d = newest(prices, k).groupBy("billing_code").agg(F.count("*").alias("n"), round_to(F.avg("amount_paid"), 2).alias("mean"), F.min("amount_paid").alias("least"), F.max("amount_paid").alias("most"), amounts.alias("a"))
    return d.withColumn("median", F.get("a", F.floor(F.size("a") / 2).cast("int"))).drop("a")


def charity_check(bills: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Nonprofit hospital per bill: by facility name, else by ZIP, the first by EIN.

    The name test runs on distinct facilities and meets hospitals by a substring of the name; an empty name
    is part of all.
    """
    h = hospitals.select(F.col("ein"), F.col("name"), F.col("zip_code"))
    facilities = bills.select("facility_name").where("facility_name != ''").distinct()
    named = join_holding(facilities, F.array(F.lower("facility_name")), h, F.col("name"), least=1).groupBy("facility_name").agg(F.min("ein").alias("by_name"))
    named = named.unionByName(h.groupBy(F.lit("").alias("facility_name")).agg(F.min("ein").alias("by_name")))
    at = h.groupBy(F.col("zip_code").alias("zip")).agg(F.min("ein").alias("by_zip"))
    d = bills.select("bill_id", "facility_name", "zip").join(named, "facility_name", "left").join(at, "zip", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_zip").isNotNull(), "zip").otherwise("none")
    return d.select("bill_id", F.coalesce("by_name", "by_zip").alias("ein"), how.alias("matched_by"))


def merge_hospitals(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary list and what the secondary has besides, by upper-case name and state."""
    key = lambda d: d.select(F.upper("name").alias("__n"), F.upper("state").alias("__s")).distinct()
    s = secondary.withColumns({"__n": F.upper("name"), "__s": F.upper("state")})
    return primary.unionByName(s.join(key(primary), ["__n", "__s"], "left_anti").drop("__n", "__s"))


def hospital_counts(hospitals: DataFrame) -> DataFrame:
    """Hospitals by state and kind of EIN."""
    return hospitals.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.startswith("ein", F.lit("CMS-"))).alias("synthetic"), F.count_if(~F.startswith("ein", F.lit("CMS-"))).alias("own"))


def registry_matches(names: DataFrame, registry: DataFrame, threshold: float = 0.3, k: int = 5) -> DataFrame:
    """Registry entries whose name or alias is like each distinct hospital name, best first (J25); k=1 at 0.4 is J26.

    names: (name, state), state being optional: with one, only entries that list it count. registry: (ord, name, ...)
    with optional arrays ``aliases`` and ``states``. matched_on is the entry's first best name or alias.

    A pair scores only if the plain names share a word's first three letters (or a whole shorter word), or one holds the
    other: those are equi-joins, the state being part of the first one's key, and only what they find is scored.
    """
    none = lambda c: F.coalesce(F.col(c), F.array()).cast("array<string>") if c in registry.columns else F.array().cast("array<string>")
    r = registry.select("ord", F.transform(none("states"), F.upper).alias("states"), F.posexplode(F.concat(F.array("name"), none("aliases"))).alias("pos", "target"))
    t = r.withColumn("t", plain_name("target")).where("t != ''")
    state = F.upper("state") if "state" in names.columns else F.lit(None).cast("string")
    q = names.select(F.col("name").alias("query"), F.coalesce(F.nullif(state, F.lit("")), F.lit("")).alias("state")).distinct().withColumn("q", plain_name("query")).where("q != ''")
    begins = lambda c: F.array_distinct(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 3)))
    pair = ("query", "state", "q", "ord", "pos", "target", "t")
    places = F.array_distinct(F.concat(F.array(F.lit("")), "states"))
    keyed = t.select("*", F.explode(places).alias("state")).select("*", F.explode(begins(F.col("t"))).alias("key")).drop("states")
    pairs = q.select("*", F.explode(begins(F.col("q"))).alias("key")).join(keyed, ["state", "key"]).select(*pair)
    here = (F.col("state") == "") | F.array_contains("states", F.col("state"))
    for held in (join_holding(q, F.array("q"), t, F.col("t"), least=1), join_holding(t, F.array("t"), q, F.col("q"), least=1)):
        pairs = pairs.unionByName(held.where(here).select(*pair))
    scored = pairs.distinct().withColumn("score", name_similarity(F.col("q"), F.col("t")))
    best = scored.groupBy("query", "state", "ord").agg(F.min(F.struct((-F.col("score")).alias("o"), "pos", "target")).alias("b"))
    best = best.select("query", F.nullif("state", F.lit("")).alias("state"), "ord", (-F.col("b.o")).alias("score"), F.col("b.target").alias("matched_on")).where(F.col("score") >= threshold)
    w = Window.partitionBy("query", "state").orderBy(F.desc("score"), "ord")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
