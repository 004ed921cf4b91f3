"""Column functions: money, codes, texts, dates. All are built-in expressions; nothing here runs Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: Column | str, places: int) -> Column:
    """Round half up through decimal(18,4), then back to double; engines agree on this form."""
    return F.round(col(c).cast("decimal(18,4)"), places).cast("double")


def money(c: Column | str) -> Column:
    """Money text to number: strips '$', ',', blanks; '', '.', NA, N/A are null; a numeric prefix counts."""
    return F.regexp_extract(F.regexp_replace(col(c), r"[$,\s]", ""), r"^-?\d*\.?\d+", 0).try_cast("double")  # no number, no cast


def money_text(c: Column | str) -> Column:
    """A number as '$1,234.50', rounded half up, a minus sign after the '$' (F14)."""
    return F.concat(F.lit("$"), F.format_number(col(c).cast("decimal(18,2)"), 2))


def price(c: Column | str) -> Column:
    """As ``money`` without quotes; '-' and negative values are null."""
    t = F.regexp_replace(col(c), r"[$,\s\"']", "")
    return F.regexp_extract(t, r"^(?:\d*\.?\d+|-0*\.?0+(?!\.?\d))", 0).try_cast("double")  # of negative numbers only -0 matches


def number_prefix(code: Column | str) -> Column:
    """Leading digits of a code as a number, null without any."""
    return F.regexp_extract(col(code), r"^\s*(\d+)", 1).try_cast("int")


def clean_code(code: Column | str) -> Column:
    return F.upper(F.trim(col(code)))


def normal_text(c: Column | str) -> Column:
    """Lower-case words of letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", " "))


def tokens(c: Column | str) -> Column:
    """Distinct words of ``normal_text``."""
    return F.array_distinct(F.filter(F.split(normal_text(c), " "), lambda t: t != ""))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if a set is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def contains_ci(whole: Column | str, part: Column | str) -> Column:
    """Case-insensitive substring test, wildcards being literal."""
    return F.contains(F.lower(col(whole)), F.lower(col(part)))


def grams(c: Column | str, size: int | Column) -> Column:
    """Distinct substrings of one size."""
    c = col(c)
    cut = lambda i: F.substring(c, i, size if isinstance(size, Column) else F.lit(size))
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), cut))).otherwise(F.array().cast("array<string>"))


def iso_date(c: Column | str) -> Column:
    """M/D/Y or M-D-Y (two-digit years are 20xx) or ISO text to yyyy-MM-dd text."""
    p = F.split(col(c), "[/-]")
    year = F.when(F.length(F.get(p, F.lit(2))) == 2, F.concat(F.lit("20"), F.get(p, F.lit(2)))).otherwise(F.get(p, F.lit(2)))
    made = F.concat_ws("-", year, F.lpad(F.get(p, F.lit(0)), 2, "0"), F.lpad(F.get(p, F.lit(1)), 2, "0"))
    return F.when((F.size(p) == 3) & (F.length(F.get(p, F.lit(0))) != 4), made).otherwise(col(c))


def zip5(c: Column | str) -> Column:
    """Digits only, the first five, padded with zeros; null without digits (P25)."""
    digits = F.substring(F.regexp_replace(col(c), r"\D", ""), 1, 5)
    return F.when(digits != "", F.lpad(digits, 5, "0"))


def ein(c: Column | str) -> Column:
    """NN-NNNNNNN where nine digits are given."""
    d = F.regexp_replace(col(c), r"\D", "")
    return F.when(F.length(d) == 9, F.concat(F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 7))).otherwise(F.trim(col(c)))


def first_of(*pairs: tuple[Column, object]) -> Column:
    """The value of the first condition that holds, else null."""
    return reduce(lambda acc, p: acc.when(p[0], p[1]), pairs[1:], F.when(pairs[0][0], pairs[0][1]))


def first_match(c: Column | str, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that matches, else null."""
    return F.coalesce(*[F.when(col(c).rlike(p), F.regexp_extract(col(c), p, group)) for p in patterns])


# ---- codes ----------------------------------------------------------------------------------------------------------

#: Procedure codes and ranges that public coding rules name.
TOP_VISITS = {"99215": "99214", "99223": "99222", "99233": "99232", "99285": "99284"}
BUNDLES = ((0, ("80053", "85025"), ("36415",)), (1, ("80048", "80050", "80051", "80076"), ("36415",)))
VISITS = ("99211", "99212", "99213", "99214", "99215", "99201", "99202", "99203", "99204", "99205")
DISTINCT_MODIFIERS = ("59", "XE", "XS", "XP", "XU")
SURGICAL, WOUND, IMAGING = (10000, 69999), (12001, 13160), (70000, 79999)
BODY_AREAS = (
    "chest", "abdomen", "pelvis", "spine", "head", "brain", "knee", "shoulder", "hip", "ankle", "wrist", "elbow", "neck", "cervical", "thoracic",
    "lumbar", "sacral", "hand", "foot", "forearm", "thigh", "leg", "arm", "skull", "facial", "orbit", "sinus",
)


def is_drug(code: Column | str) -> Column:
    return clean_code(code).startswith("J")


def is_lab(code: Column | str) -> Column:
    c = clean_code(code)
    return F.coalesce(number_prefix(c).between(80000, 89999), F.lit(False)) | (c == "36415") | c.rlike(r"^\d{4}U$")


def in_range(code: Column | str, low: int, high: int) -> Column:
    return F.coalesce(number_prefix(code).between(low, high), F.lit(False))


def is_surgical(code: Column | str) -> Column:
    return in_range(code, *SURGICAL)


def is_wound_repair(code: Column | str) -> Column:
    return in_range(code, *WOUND)


def is_imaging(code: Column | str) -> Column:
    return in_range(code, *IMAGING)


def is_visit(code: Column | str) -> Column:
    return col(code).isin(*VISITS)


def body_area(description: Column | str) -> Column:
    low = F.lower(col(description))
    return first_of(*[(F.contains(low, F.lit(a)), F.lit(a)) for a in BODY_AREAS])


#: (low, high, shoppable, reason) in the order in which they are tried; 36415 and J codes stand between by their place.
SHOPPING = (
    (99281, 99285, False, "emergency_visit"), (99291, 99292, False, "critical_care"), (99221, 99223, False, "inpatient_care"), (99231, 99233, False, "inpatient_care"),
    (99201, 99215, True, "office_visit"), (70000, 79999, True, "imaging"), (80000, 89999, True, "laboratory"), (36415, 36415, True, "blood_draw"),
    (10000, 29999, True, "minor_procedure"), (30000, 69999, False, "surgery"), (97000, 97999, True, "therapy"),
)


def shopping_reason(code: Column | str) -> Column:
    """Why a service can or can't be shopped for."""
    c = clean_code(code)
    rules = [((c == "36415") if low == high else in_range(c, low, high), F.lit(why)) for low, high, _, why in SHOPPING]
    return F.coalesce(first_of(*rules, (is_drug(c), F.lit("drug"))), F.lit("depends"))


def is_shoppable(code: Column | str) -> Column:
    return shopping_reason(code).isin(*sorted({why for *_, ok, why in SHOPPING if ok}))


# ---- ratings --------------------------------------------------------------------------------------------------------


def severity(multiplier: Column | str) -> Column:
    m = col(multiplier)
    return F.when(m.isNull(), None).when(m > 10, "extreme").when(m > 5, "high").when(m > 2, "medium").otherwise("low")


def severity_rank(s: Column | str) -> Column:
    return first_of((col(s) == "extreme", 0), (col(s) == "high", 1), (col(s) == "medium", 2), (col(s) == "low", 3), (F.lit(True), 4))


def dispute_strength(mode: Column | str, source: Column | str, multiplier: Column | str) -> Column:
    """Strength over all sources (P17): exact modes, thresholds half a point lower for physician and lab schedules."""
    m, exact = col(multiplier), F.startswith(col(mode), F.lit("exact"))
    lower = F.when(col(source).isin("pfs", "clfs"), 0.5).otherwise(0.0)
    known = (col(mode) != "unmatched") & m.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), None).when(exact & (m > 3 - lower), "strong").when(exact & (m > 2 - lower), "moderate").otherwise("weak")


def single_source_strength(mode: Column | str, multiplier: Column | str) -> Column:
    """Strength for the tiered single-source match (P18): only modifier-level modes can be strong or moderate."""
    m, level = col(multiplier), col(mode).isin("exact_code_modifier_locality", "exact_code_modifier")
    known = (col(mode) != "unmatched") & m.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), None).when(level & (m > 3), "strong").when(level & (m > 2), "moderate").otherwise("weak")


def rate_context(setting: Column | str, facility_type: Column | str) -> Column:
    """An explicit setting wins; hospitals, emergency and outpatient sites take facility rates (P10)."""
    by_type = F.when(col(facility_type).isin("hospital", "er", "outpatient"), "facility").otherwise("non_facility")
    return F.when(col(setting) == "facility", "facility").when(col(setting) == "office", "non_facility").otherwise(by_type)


def care_setting(c: Column | str) -> Column:
    """both, inpatient, outpatient or the lower-case text."""
    low = F.lower(F.trim(col(c)))
    has = lambda t: F.contains(low, F.lit(t))
    return F.when(low == "", None).when(has("both") | (has("inpatient") & has("outpatient")), "both").when(has("inpatient"), "inpatient").when(has("outpatient"), "outpatient").otherwise(low)


def code_type(given: Column | str, code: Column | str) -> Column:
    """A given type, or one inferred from the code's shape."""
    c = clean_code(code)
    return F.coalesce(F.nullif(F.upper(F.trim(col(given))), F.lit("")), F.when(c.rlike(r"^\d{5}$"), "CPT").when(c.rlike(r"^[A-Z]\d{4}$"), "HCPCS"))


#: Multiples of the public rate that insurers typically allow, low and high by plan, and the national average.
PLAN_MULTIPLES = {"hmo": (1.0, 1.5), "ppo": (1.2, 2.0), "oon": (2.0, 4.0)}
NATIONAL_AVERAGE = 1.43


def plan_type(c: Column | str) -> Column:
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.when(F.contains(low, F.lit("hmo")), "hmo").when(F.contains(low, F.lit("oon")) | F.contains(low, F.lit("out")), "oon").otherwise("ppo")


def plan_midpoint(rate: Column | str, plan: Column | str) -> Column:
    """Middle of the plan's range, each end rounded first (P20)."""
    mid = {p: round_to((round_to(col(rate) * lo, 2) + round_to(col(rate) * hi, 2)) / 2, 2) for p, (lo, hi) in PLAN_MULTIPLES.items()}
    return first_of(*[(col(plan) == p, m) for p, m in mid.items()])


# ---- hospital names -------------------------------------------------------------------------------------------------

#: Words that tell no hospital from another.
GENERIC_NAMES = ("medical center", "health system", "health care")
GENERIC_WORDS = ("hospital", "healthcare", "health", "regional", "community", "memorial", "university", "the")


def plain_name(c: Column | str) -> Column:
    """A hospital's name as lower-case words, without generic words and signs."""
    joined = F.regexp_replace(F.translate(F.lower(col(c)), "'`", ""), rf"\b(?:{'|'.join(GENERIC_NAMES)})\b", " ")
    words = F.split(F.regexp_replace(joined, "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*GENERIC_WORDS)), " ")


def name_similarity(query: Column, target: Column) -> Column:
    """Similarity of two plain names (F13): 1 if equal, 0.9 if one holds the other, else weighted token coverage.

    Each query token takes the first target token, in the target's order, that equals it (1) or that it shares a
    prefix with (0.8, the shorter having 3 letters or more).
    """
    q, t = F.split(query, " "), F.split(target, " ")

    def gain(w: Column) -> Column:
        hits = F.filter(t, lambda x: (x == w) | ((F.length(w) >= 3) & F.startswith(x, w)) | ((F.length(x) >= 3) & F.startswith(w, x)))
        return F.when(F.size(hits) == 0, 0.0).when(F.get(hits, F.lit(0)) == w, 1.0).otherwise(0.8)

    matches = F.aggregate(F.transform(q, gain), F.lit(0.0), lambda a, x: a + x)
    score = matches / F.size(q) * 0.7 + matches / F.size(t) * 0.3
    empty = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "")
    return F.when(empty, 0.0).when(query == target, 1.0).when(F.contains(query, target) | F.contains(target, query), 0.9).otherwise(round_to(score, 3))
