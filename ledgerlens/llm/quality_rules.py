"""Quality rules (operator 10): every rule evaluated once into a ledger of failure bits, policies applied to the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_BLANK = r"[\x20\x09-\x0D]+"

#: Bit k of fail_bits is set where rule k fails. Shares are compared as integers, so that no rounding decides.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "100 * n_symbols > 30 * n_words"),
    ("shouting", "100 * n_exclaims > 30 * n_words"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES = {"v1": BIT["few_words"] | BIT["repeated_words"], "v2": (1 << len(RULES)) - 1}
BASE, CURRENT = "v1", "v2"


def ledger(docs: DataFrame, name: str = "ledger") -> DataFrame:
    """``docs`` plus one struct column ``name`` (replacing one of that name): the measurements and ``fail_bits``.

    Words are maximal runs of non-blank characters. n_repeat_words counts the words that stand in a 3-word window found
    twice or more in the text; windows are compared by 64-bit hashes, sorted with their positions within the text's
    array, so the work is n log n in the words of one text and nothing is shuffled. Null and empty texts have no words
    and no lines, and fail few_words. All columns of ``docs`` stay, repeated rows are measured alike.
    """
    own = [c for c in docs.columns if c != name]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumns({"__w": F.filter(F.split(text, _BLANK, -1), lambda w: w != ""), "__l": lines})
    d = d.withColumn("__h", F.slice(F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2))), F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    d = d.withColumn("__s", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, x: F.coalesce(F.get("__s", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("__p", F.array_sort(F.transform(F.filter("__s", lambda x, k: F.when(k > 0, same(k - 1, x)).otherwise(False) | same(k + 1, x)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn(
        "__m",
        F.struct(
            F.size("__w").cast("long").alias("n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("__l").cast("long").alias("n_lines"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            (F.length(text) - F.length(F.replace(text, F.lit("!")))).cast("long").alias("n_exclaims"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ),
    )
    bits: Column = F.lit(0)
    for rule_name, rule in RULES:
        fails = F.expr(_of_struct(rule))
        bits = bits.bitwiseOR(F.when(fails, BIT[rule_name]).otherwise(0))
    # the generator keeps a later filter on the ledger from being pushed down, where each nested array would be built anew
    return d.select(*own, F.col("__m").withField("fail_bits", bits).alias("__r")).select(*own, F.explode(F.array("__r")).alias(name))


def _of_struct(rule: str) -> str:
    return " ".join(f"__m.{w}" if w.isidentifier() else w for w in rule.split())


def passes(fail_bits: Column, policy: str) -> Column:
    return fail_bits.bitwiseAND(POLICIES[policy]) == 0


def apply_policy(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that ``policy`` keeps, with their own columns only."""
    return ledger(docs, "__ledger").where(passes(F.col("__ledger.fail_bits"), policy)).select(*docs.columns)


def ablations(rated: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that stay kept without it.

    One count per distinct bitmask (at most 2^rules rows, combined map-side), from which every figure follows.
    """
    mask = POLICIES[policy]
    by_bits = rated.groupBy(F.col("ledger.fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & mask]))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(total(hit)("failed"), total(alone)("failed_alone"), total(alone | (F.col("bits") == 0))("kept_without"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("ledger")
    return rated.select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        (~passes(m["fail_bits"], BASE)).alias("base_failed"), passes(m["fail_bits"], CURRENT).alias("kept"), m["fail_bits"].alias("fail_bits"),
    )


#: CTEs giving ``rated(doc_id, ..., fail_bits)`` from ``{docs}``.
RATED_CTE = (
    """
worded AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w != '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM {docs}),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
measured AS (SELECT worded.* EXCLUDE (w, l), CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS BIGINT) AS n_exclaims,
  CAST(length(regexp_replace(coalesce(text, ''), '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper
  FROM worded LEFT JOIN covered USING (doc_id)),
rated AS (SELECT *, """
    + " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)
    + " AS fail_bits FROM measured)"
)

OP10_SQL = f"""WITH {RATED_CTE.format(docs='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {POLICIES[BASE]} != 0 AS base_failed, fail_bits & {POLICIES[CURRENT]} = 0 AS kept,
  CAST(fail_bits AS INTEGER) AS fail_bits FROM rated"""
