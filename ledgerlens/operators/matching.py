"""Rates for look-ups (code, modifier, locality): per schedule, and the cascade over all schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_code, grams, is_drug, is_lab, is_shoppable, round_to

ANY = "*"  #: key of a look-up that doesn't ask for a modifier or locality
NONE = "-"  #: key of a rate without one


def latest_snapshot(snapshots: DataFrame, source_type: str | None = None) -> DataFrame:
    """One row (snapshot_id): the newest by year, then fetch time, then id."""
    s = snapshots if source_type is None else snapshots.where(F.col("source_type") == source_type)
    return s.agg(F.max_by("snapshot_id", F.struct("effective_year", "fetched_at", "snapshot_id")).alias("snapshot_id"))


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys are equal; the keys appear once."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, cond, how).drop(*[f"__{k}" for k in keys])


def _missing_last(rate: str) -> Column:
    return F.when(F.col(rate) > 0, 0).otherwise(1)


def best_rates(rates: DataFrame, match_carrier: bool = False) -> DataFrame:
    """Best row for each (code, modifier key, locality key): exact keys, '-' for none, '*' for any.

    A row with a facility rate wins, then one with a non-facility rate, then file order. Rates are reduced before any
    look-up is joined, so a look-up meets at most four rows and no condition has an OR. Rates are dealt by code before
    they take their four keys, so each moves once, and codes have no more rows than modifiers times localities.
    """
    place = F.concat_ws("/", F.col("carrier"), F.col("locality")) if match_carrier else F.col("locality")
    own = lambda c: F.explode(F.array(F.lit(ANY), F.coalesce(c, F.lit(NONE))))
    keyed = rates.repartition("code").withColumn("mod_key", own(F.col("modifier"))).withColumn("loc_key", own(F.when(F.col("locality").isNotNull(), place)))
    row = F.struct(
        _missing_last("facility_rate").alias("a"), _missing_last("non_facility_rate").alias("b"), F.col("rate_seq").alias("seq"),
        "facility_rate", "non_facility_rate", "description", "modifier", "locality", "status_indicator",
    )
    return keyed.groupBy("code", "mod_key", "loc_key").agg(F.min(row).alias("rate"))


def match_pfs(lookups: DataFrame, rates: DataFrame) -> DataFrame:
    """Physician schedule (J01): adds ``pfs`` (struct or null) to look-ups (code, modifier, locality, ...).

    A given modifier or locality must equal the rate's or the rate has none; rows without any rate are dropped after
    the best is chosen. ``lookups`` should be distinct.
    """
    keys = [c for c in lookups.columns if c != "pfs"]
    either = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.col(c), F.lit(NONE)))
    asked = lookups.select(*keys, F.explode(either("modifier")).alias("mod_key"), F.lit(0).alias("__x")).withColumn("loc_key", F.explode(either("locality"))).drop("__x")
    found = asked.join(best_rates(rates), ["code", "mod_key", "loc_key"]).groupBy(*keys).agg(F.min("rate").alias("pfs"))
    usable = (F.coalesce(F.col("pfs.facility_rate"), F.lit(0.0)) != 0) | (F.coalesce(F.col("pfs.non_facility_rate"), F.lit(0.0)) != 0)
    return join_nullsafe(lookups, found.where(usable), keys)


def match_clfs(lookups: DataFrame, rates: DataFrame) -> DataFrame:
    """Laboratory schedule (J02): the highest rate of the code; a given modifier must be equal, null or empty there."""
    best = rates.withColumn("m", F.explode(F.array(F.lit(ANY), F.coalesce(F.nullif("modifier", F.lit("")), F.lit(NONE))))).groupBy("code", "m").agg(F.max(F.struct("rate", (-F.col("rate_seq")).alias("o"), "modifier")).alias("r"))
    asked = F.when(F.col("modifier").isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.col("modifier"), F.lit(NONE)))
    found = lookups.select("code", "modifier").distinct().withColumn("m", F.explode(asked)).join(best, ["code", "m"]).groupBy("code", "modifier").agg(F.max("r").alias("clfs")).where("clfs.rate != 0")
    return join_nullsafe(lookups, found, ["code", "modifier"])


def match_asp(lookups: DataFrame, rates: DataFrame) -> DataFrame:
    """Drug limits (J03): the highest payment limit of the code."""
    best = rates.where("payment_limit IS NOT NULL").groupBy("code").agg(F.max(F.struct("payment_limit", (-F.col("rate_seq")).alias("o"), "short_desc")).alias("asp"))
    return lookups.join(best, "code", "left").select(*lookups.columns, "asp")


def match_opps(lookups: DataFrame, rates: DataFrame) -> DataFrame:
    """Outpatient rates (J04): the highest positive payment rate, a facility rate only."""
    best = rates.where("payment_rate > 0").groupBy("code").agg(F.max(F.struct("payment_rate", (-F.col("rate_seq")).alias("o"), "apc", "status_indicator", "short_desc")).alias("opps"))
    return lookups.join(best, "code", "left").select(*lookups.columns, "opps")


ALL = "#"  #: key of rates that depend on no modifier, or no locality


def rate_card(pfs: DataFrame, clfs: DataFrame, asp: DataFrame, opps: DataFrame) -> DataFrame:
    """All schedules in one table (code, mod_key, loc_key, pfs, clfs, asp, opps), each reduced to its best row per key.

    A row has the rate of one schedule: the physician schedule by modifier and locality, the laboratory schedule by
    modifier, drug limits and outpatient rates by code alone. Look-ups meet the whole card in a single equi-join.
    """
    any_or_own = F.explode(F.array(F.lit(ANY), F.coalesce(F.nullif("modifier", F.lit("")), F.lit(NONE))))
    lab = clfs.withColumn("mod_key", any_or_own).groupBy("code", "mod_key").agg(F.max(F.struct("rate", (-F.col("rate_seq")).alias("o"), "modifier")).alias("clfs"))
    drugs = asp.where("payment_limit IS NOT NULL").groupBy("code").agg(F.max(F.struct("payment_limit", (-F.col("rate_seq")).alias("o"), "short_desc")).alias("asp"))
    outpatient = opps.where("payment_rate > 0").groupBy("code").agg(F.max(F.struct("payment_rate", (-F.col("rate_seq")).alias("o"), "apc", "status_indicator", "short_desc")).alias("opps"))
    rows = best_rates(pfs).withColumnRenamed("rate", "pfs")
    for part in (lab.withColumn("loc_key", F.lit(ALL)), drugs.withColumns({"mod_key": F.lit(ALL), "loc_key": F.lit(ALL)}), outpatient.withColumns({"mod_key": F.lit(ALL), "loc_key": F.lit(ALL)})):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def rate_packs(pfs: DataFrame, clfs: DataFrame, asp: DataFrame, opps: DataFrame) -> DataFrame:
    """All schedules with one row per code (code, pfs, clfs, asp, opps), for look-ups that need rates and no texts.

    ``pfs`` holds the best row per modifier and locality, ``clfs`` per modifier, so a row is bounded by a schedule's
    modifiers times localities. Rates are reduced before they move: the order of rows (as in ``best_rates``) is one number,
    so buffers are plain numbers and the grouping hashes, without a sort. ``rate_seq`` is unique and below 2^60.
    """
    order = (_missing_last("facility_rate") * 2 + _missing_last("non_facility_rate")).cast("long") * (1 << 61) + F.col("rate_seq")
    best = pfs.withColumn("o", order).groupBy("code", "modifier", "locality").agg(F.min("o").alias("o"), F.min_by("facility_rate", "o").alias("facility_rate"), F.min_by("non_facility_rate", "o").alias("non_facility_rate"))
    lab = clfs.groupBy("code", F.nullif("modifier", F.lit("")).alias("modifier")).agg(F.max(F.struct("rate", (-F.col("rate_seq")).alias("o"))).alias("r"))
    rows = best.select("code", F.struct("o", "facility_rate", "non_facility_rate", "modifier", "locality").alias("pfs"))
    for part in (
        lab.select("code", F.struct("r.rate", "r.o", "modifier").alias("clfs")),
        asp.groupBy("code").agg(F.max("payment_limit").alias("asp")),
        opps.where("payment_rate > 0").groupBy("code").agg(F.max("payment_rate").alias("opps")),
    ):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy("code").agg(F.collect_list("pfs").alias("pfs"), F.collect_list("clfs").alias("clfs"), F.max("asp").alias("asp"), F.max("opps").alias("opps"))


def _fits(own: Column, asked: str) -> Column:
    """Whether a rate's modifier or locality answers a look-up's: either has none, or they are equal."""
    return F.col(asked).isNull() | own.isNull() | (own == F.col(asked))


def best_by_place() -> Column:
    """For (locality) with the ``pfs`` of a pack: the best row of any modifier there."""
    return F.array_min(F.filter("pfs", lambda x: _fits(x["locality"], "locality")))


def _wanted(c: str) -> Column:
    """Keys of a look-up's modifier or locality: any row if it has none, else its own or rows without one."""
    return F.when(F.col(c).isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.col(c), F.lit(NONE)))


def match_rates(lookups: DataFrame, packs: DataFrame) -> DataFrame:
    """The cascade (J05) for distinct look-ups (code, modifier, locality, context): adds source, mode, rate_used and rates.

    Drugs take their limit first and laboratory codes their schedule; then the physician schedule, outpatient rates in
    a facility, and the other schedules. A look-up meets the one row of its code (``rate_packs``) and chooses there, so
    look-ups move once and no rate is repeated per key.
    """
    found = lookups.join(packs, "code", "left").select(
        *lookups.columns, F.array_min(F.filter("pfs", lambda x: _fits(x["modifier"], "modifier") & _fits(x["locality"], "locality"))).alias("pfs"),
        F.array_max(F.filter("clfs", lambda x: _fits(x["modifier"], "modifier"))).alias("clfs"), "asp", "opps",
    )
    usable = (F.coalesce(F.col("pfs.facility_rate"), F.lit(0.0)) != 0) | (F.coalesce(F.col("pfs.non_facility_rate"), F.lit(0.0)) != 0)
    d = found.withColumns({"pfs": F.when(usable, F.col("pfs")), "clfs": F.when(F.col("clfs.rate") != 0, F.col("clfs"))})
    drug, lab, facility = is_drug("code"), is_lab("code"), F.col("context") == "facility"
    none = F.lit(None).cast("double")
    given, placed = F.col("modifier").isNotNull(), F.col("locality").isNotNull()

    def pick(source: str, mode: Column, fac: Column, non: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), mode.alias("mode"), fac.alias("facility_rate"), non.alias("non_facility_rate"))

    pfs_mode = F.when(given & placed, "exact_code_modifier_locality").when(given, "exact_code_modifier").otherwise("exact_code_only")
    clfs_mode = F.when(given & (F.coalesce(F.col("clfs.modifier"), F.lit("")) != ""), "exact_code_modifier").otherwise("exact_code_only")
    only = F.lit("exact_code_only")
    p = pick("pfs", pfs_mode, F.col("pfs.facility_rate"), F.col("pfs.non_facility_rate"))
    c = pick("clfs", clfs_mode, F.col("clfs.rate"), F.col("clfs.rate"))
    a = pick("asp", only, F.col("asp"), F.col("asp"))
    o = pick("opps", only, F.col("opps"), none)
    has = {k: F.col(k).isNotNull() for k in ("pfs", "clfs", "asp", "opps")}
    best = F.coalesce(
        F.when(drug & has["asp"], a), F.when(lab & has["clfs"], c), F.when(has["pfs"], p), F.when(facility & has["opps"], o),
        F.when(~lab & has["clfs"], c), F.when(~drug & has["asp"], a), F.when(~facility & has["opps"], o), pick("none", F.lit("unmatched"), none, none),
    )
    used = F.when(facility, F.coalesce("best.facility_rate", "best.non_facility_rate")).otherwise(F.coalesce("best.non_facility_rate", "best.facility_rate"))
    return d.withColumn("best", best).select(*lookups.columns, "best.*", used.alias("rate_used"))


def match_tiered(lookups: DataFrame, rates: DataFrame) -> DataFrame:
    """Single-source tiers (J06): code with modifier and locality, then code with modifier, then code alone.

    Here a given modifier or locality must be equal; each tier is tried only if asked for. Adds tier, mode, rates.
    """
    keys = list(lookups.columns)
    exact = F.filter(
        F.array(
            F.when(F.col("modifier").isNotNull() & F.col("locality").isNotNull(), F.struct(F.lit(1).alias("tier"), F.col("modifier").alias("mod_key"), F.col("locality").alias("loc_key"))),
            F.when(F.col("modifier").isNotNull(), F.struct(F.lit(2).alias("tier"), F.col("modifier").alias("mod_key"), F.lit(ANY).alias("loc_key"))),
            F.struct(F.lit(3).alias("tier"), F.lit(ANY).alias("mod_key"), F.lit(ANY).alias("loc_key")),
        ),
        lambda x: x.isNotNull(),
    )
    asked = lookups.withColumn("t", F.explode(exact)).select(*keys, "t.*")
    found = asked.join(best_rates(rates), ["code", "mod_key", "loc_key"]).groupBy(*keys).agg(F.min(F.struct("tier", "rate")).alias("hit"))
    tier = F.col("hit.tier")
    mode = F.when(tier == 1, "exact_code_modifier_locality").when(tier == 2, "exact_code_modifier").when(tier == 3, "exact_code_only").otherwise("unmatched")
    return join_nullsafe(lookups, found, keys).select(*keys, mode.alias("mode"), F.col("hit.rate.facility_rate").alias("facility_rate"), F.col("hit.rate.non_facility_rate").alias("non_facility_rate"))


def resolve_zip(bills: DataFrame, zips: DataFrame) -> DataFrame:
    """ZIP to locality (J07): an explicit locality wins; urban_rural is 'U' where the ZIP is known and blank there."""
    from ..functions import zip5

    z = zips.select(F.col("zip_code").alias("__zip"), F.col("locality").alias("zip_locality"), "carrier", "state", F.coalesce(F.nullif("urban_rural", F.lit("")), F.lit("U")).alias("urban_rural"))
    joined = bills.withColumn("__own", zip5("zip")).join(z, F.col("__own") == F.col("__zip"), "left")
    return joined.withColumn("locality", F.coalesce("locality", "zip_locality")).drop("__own", "__zip", "zip_locality")


def area_of(zips: DataFrame) -> DataFrame:
    """(carrier, locality) to its first ZIP's area."""
    return zips.groupBy("carrier", "locality").agg(F.min(F.struct("zip_code", "state", "county_name", F.coalesce("urban_rural", F.lit("U")).alias("urban_rural"))).alias("a")).select("carrier", "locality", "a.*")


def zips_of(zips: DataFrame) -> DataFrame:
    """(carrier, locality) to the ordered list of its ZIPs."""
    return zips.groupBy("carrier", "locality").agg(F.sort_array(F.collect_set("zip_code")).alias("zips"))


def site_rates(lookups: DataFrame, card: DataFrame) -> DataFrame:
    """Site-of-service rates (J10) for distinct (code, locality), from a ``rate_card``: the modifier is ignored; description falls back to opps."""
    key = lambda m, p: F.struct(m.alias("mod_key"), p.alias("loc_key"))
    keys = F.concat(F.transform(_wanted("locality"), lambda p: key(F.lit(ANY), p)), F.array(key(F.lit(ALL), F.lit(ALL))))
    asked = lookups.select("code", "locality").distinct().withColumn("__key", F.explode(keys)).select(F.col("code").alias("asked"), clean_code("code").alias("code"), "locality", "__key.*")
    d = asked.join(card.select("code", "mod_key", "loc_key", "pfs", "opps"), ["code", "mod_key", "loc_key"], "left").groupBy("asked", "locality").agg(F.min("pfs").alias("r"), F.max("opps").alias("o"))
    return d.select(F.col("asked").alias("code"), "locality", F.col("r.facility_rate").alias("facility_rate"), F.col("r.non_facility_rate").alias("non_facility_rate"), F.col("o.payment_rate").alias("opps_rate"), F.coalesce("r.description", "o.short_desc").alias("rate_description"))


def site_saving(facility: str, office: str) -> Column:
    """Facility less office rate where both are positive and the first is larger."""
    fac, off = F.col(facility), F.col(office)
    return F.when((fac > 0) & (off > 0) & (fac > off), round_to(fac - off, 2))


def site_savings(lookups: DataFrame, packs: DataFrame) -> DataFrame:
    """Positive savings at another site (P30) of shoppable codes by (code, locality), from ``rate_packs``, for look-ups that need no texts."""
    asked = lookups.select("code", "locality").distinct().select(F.col("code").alias("asked"), clean_code("code").alias("code"), "locality")
    d = asked.join(packs.select("code", "pfs"), "code", "left").select("asked", "locality", best_by_place().alias("r"))
    saving = site_saving("r.facility_rate", "r.non_facility_rate")
    return d.select(F.col("asked").alias("code"), "locality", F.when((saving > 0) & is_shoppable("asked"), saving).alias("site_saving"))


GRAM = 3


def join_holding(asked: DataFrame, need: Column, texts: DataFrame, said: Column, least: int = GRAM) -> DataFrame:
    """Rows of ``asked`` and ``texts`` where the lower-case ``said`` holds every string of the array ``need``, as an equi-join.

    Each distinct ``need`` looks texts up by its rarest substring of GRAM letters, or by a whole string that is shorter
    (strings have ``least`` letters or more), so pairs meet only where that substring occurs; the test follows.
    """
    sizes = range(min(least, GRAM), GRAM + 1)
    t = texts.withColumn("__low", F.lower(said))
    t = t.withColumn("__gram", F.explode(F.array_distinct(F.concat(*[grams("__low", k) for k in sizes]))))
    a = asked.withColumn("__need", need)
    own = F.flatten(F.transform("__need", lambda x: F.when(F.length(x) >= GRAM, grams(x, GRAM)).otherwise(F.array(x))))
    often = t.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = a.select("__need").distinct().withColumn("__gram", F.explode(own)).join(often, "__gram").groupBy("__need").agg(F.min(F.struct("__n", "__gram"))["__gram"].alias("__gram"))
    found = a.join(rarest, "__need").join(t, "__gram")
    return found.where(F.forall("__need", lambda x: F.contains(F.col("__low"), x))).drop("__need", "__gram", "__low")
