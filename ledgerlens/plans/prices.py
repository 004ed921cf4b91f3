"""Queries for prices, hospitals, descriptions and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import descriptions, prices, stats
from .bindings import Tables, with_views
from .rates import FOUND, found, prefix, r


def requests(t: Tables) -> DataFrame:
    """Look-ups derived from suppliers: a common code or one of many each, with a hospital or payer part for some."""
    own = F.lpad((10000 + (F.col("s_suppkey") * 37) % 89999).cast("string"), 5, "0")
    p = t.supplier.select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 4 == 0, "99213").when(F.col("s_suppkey") % 4 == 1, "80053").otherwise(own).alias("code"))
    return p.withColumns({"hospital": F.when(F.col("request_id") % 3 == 0, F.lit("supplier#00000000")), "payer": F.when(F.col("request_id") % 5 > 0, F.concat(F.lit("nation_"), (F.col("request_id") % 7).cast("string")))})


REQ = "req AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 0 THEN '99213' WHEN 1 THEN '80053' ELSE lpad(CAST(10000 + (s_suppkey * 37) % 89999 AS STRING), 5, '0') END AS code, CASE WHEN s_suppkey % 3 = 0 THEN 'supplier#00000000' END AS hospital, CASE WHEN s_suppkey % 5 > 0 THEN 'nation_' || CAST(s_suppkey % 7 AS STRING) END AS payer FROM {supplier})"
def as_of():
    return F.lit("2024-01-31").cast("timestamp")


def rollup(t: Tables) -> DataFrame:
    """The daily rollup that the dashboards read, as the stream keeps it."""
    return t.step("rollup", lambda: stats.daily_rollup(t.analytics_events))


def next_page(t: Tables) -> DataFrame:
    """The page after the hundredth audit."""
    last = t.audits.orderBy(F.desc("created_at"), F.desc("report_id")).select("created_at", "report_id").offset(99).limit(1).first()
    return stats.audit_page_after(t.audits, last["created_at"], last["report_id"]).select("report_id", F.col("created_at").cast("string").alias("day"))


def sketched(t: Tables) -> DataFrame:
    """The summary from sketches by source; ``close`` tells whether the estimate is within 5 % of the exact count."""
    d = prices.merged_summary(t.step("sketches", lambda: prices.price_sketches(t.hospital_prices)))
    exact = t.hospital_prices.groupBy("billing_code").agg(F.countDistinct("hospital_name").alias("exact"))
    return d.join(exact, "billing_code").withColumn("close", F.abs(F.col("hospitals") - F.col("exact")) <= 0.05 * F.col("exact")).drop("hospitals", "exact")


STATE_OF = "CASE WHEN CAST(substr(facility_name, 10) AS INT) % 3 > 0 THEN CAST(CAST(substr(facility_name, 10) AS INT) % 25 AS STRING) END"
NAMES = f"SELECT DISTINCT replace(facility_name, '#', ' ') AS name, {STATE_OF} AS state FROM {{bills}}"


def names(t: Tables) -> DataFrame:
    """Facilities to look up, two thirds of them in a state."""
    return t.bills.select(F.replace("facility_name", F.lit("#"), F.lit(" ")).alias("name"), F.expr(STATE_OF).alias("state")).distinct()


def entries(t: Tables) -> DataFrame:
    aliases = F.when(F.col("alias").isNotNull(), F.array("alias"))
    return t.mrf_registry.select("ord", F.replace("name", F.lit("#"), F.lit(" ")).alias("name"), aliases.alias("aliases"), F.array("state", "also").alias("states"))


def texts(t: Tables) -> DataFrame:
    return t.descriptions.select(F.concat_ws(" ", "description", F.when(F.col("seq") % 3 == 0, F.col("brand"))).alias("description"))


def said(t: Tables) -> DataFrame:
    return descriptions.searchable(t.clfs_rates, t.asp_rates, t.opps_rates)


def dictionary(t: Tables) -> DataFrame:
    return t.step("dictionary", lambda: descriptions.dictionary(t.code_synonyms, said(t)))


def matched(t: Tables, step: str) -> DataFrame:
    texts = t.step("entries", lambda: descriptions.entries(t.code_synonyms)) if step in ("exact", "fuzzy") else dictionary(t)
    return descriptions.match(text_names(t), texts, (step,)).drop("step")


def text_names(t: Tables) -> DataFrame:
    return texts(t).select(fn.normal_text("description").alias("name")).where(F.length("name") >= 2).distinct()


N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
TOK = "list_filter(string_split({0}, ' '), lambda x, i: x != '' AND list_position(string_split({0}, ' '), x) = i)"
TEXTS = f"texts AS (SELECT concat_ws(' ', description, CASE WHEN seq % 3 = 0 THEN brand END) AS description FROM {{descriptions}}), nm AS (SELECT DISTINCT {N.format('description')} AS name FROM texts WHERE length({N.format('description')}) >= 2)"
STEP1 = f"s1 AS (SELECT nm.name, arg_min(code, ord) AS code, CAST(1 AS DOUBLE) AS confidence FROM nm JOIN (SELECT *, {N.format('description')} AS sname FROM {{code_synonyms}}) x ON nm.name = x.sname GROUP BY nm.name), l1 AS (SELECT name FROM nm WHERE name NOT IN (SELECT name FROM s1))"


def step2(src: str, out: str) -> str:
    return f"""{out} AS (SELECT name, code, confidence FROM (SELECT name, code, score AS confidence, row_number() OVER (PARTITION BY name ORDER BY score DESC, ord) AS rn FROM (
  SELECT name, ord, code, len(list_intersect(t, st)) / least(len(t), len(st)) AS score FROM (SELECT name, {TOK.format('name')} AS t FROM {src}) JOIN (SELECT ord, code, {TOK.format(N.format('description'))} AS st FROM {{code_synonyms}}) ON len(list_intersect(t, st)) > 0) WHERE score >= 0.7) WHERE rn = 1)"""


SAID = "said AS (SELECT 0 AS ord, rate_seq AS seq, code, short_desc AS said FROM {clfs_rates} UNION ALL SELECT 1, rate_seq, code, long_desc FROM {clfs_rates} UNION ALL SELECT 2, rate_seq, code, short_desc FROM {asp_rates} UNION ALL SELECT 3, rate_seq, code, short_desc FROM {opps_rates})"


def step3(src: str, out: str) -> str:
    return f"{out} AS (SELECT name, code, CAST(0.85 AS DOUBLE) AS confidence FROM (SELECT name, code, row_number() OVER (PARTITION BY name ORDER BY ord, seq) AS rn FROM {src} JOIN said ON contains(lower(said), name)) WHERE rn = 1)"


def step4(src: str, out: str) -> str:
    return f"""{out} AS (SELECT name, code, {r('least(score * 0.9, 0.8)', 2)} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord, score DESC, seq) AS pick FROM (
  SELECT name, ord, seq, code, len(list_intersect(t, st)) / least(len(t), len(st)) AS score FROM (SELECT q.name, q.t, ord, seq, code, {TOK.format(N.format('said'))} AS st, row_number() OVER (PARTITION BY q.name, ord ORDER BY seq) AS rn
    FROM (SELECT name, {TOK.format('name')} AS t, list_filter({TOK.format('name')}, lambda x: length(x) > 2) AS w FROM {src}) q JOIN said ON len(w) >= 2 AND contains(lower(said), w[1]) AND contains(lower(said), w[2])) WHERE rn <= 5) WHERE score >= 0.5) WHERE pick = 1)"""


STEPS = f"{STEP1}, {step2('l1', 's2')}, l2 AS (SELECT name FROM l1 WHERE name NOT IN (SELECT name FROM s2)), {SAID}, {step3('l2', 's3')}, l3 AS (SELECT name FROM l2 WHERE name NOT IN (SELECT name FROM s3)), {step4('l3', 's4')}"
CASCADE = f"{TEXTS}, {STEPS}"


def resolved_sql(table: str) -> str:
    """CTEs giving resolved(description, code) for the distinct descriptions of ``table``."""
    asked = f"nm AS (SELECT DISTINCT {N.format('description')} AS name FROM {table} WHERE length({N.format('description')}) >= 2)"
    steps = "steps AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)"
    return f"{asked}, {STEPS}, {steps}, resolved AS (SELECT description, code FROM (SELECT DISTINCT description, {N.format('description')} AS name FROM {table}) JOIN steps USING (name) WHERE confidence >= 0.6)"


_JOINED = "regexp_replace(translate(lower({0}), '''`', ''), '\\b(?:" + "|".join(fn.GENERIC_NAMES) + ")\\b', ' ', 'g')"
PLAIN = f"array_to_string(list_filter(string_split(regexp_replace({_JOINED}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w != '' AND w NOT IN ({', '.join(repr(w) for w in fn.GENERIC_WORDS)})), ' ')"
GAIN = "list_sum(list_transform(qt, lambda w: CASE WHEN len(list_filter(tt, lambda x: x = w OR (length(w) >= 3 AND starts_with(x, w)) OR (length(x) >= 3 AND starts_with(w, x)))) = 0 THEN 0.0e0 WHEN list_filter(tt, lambda x: x = w OR (length(w) >= 3 AND starts_with(x, w)) OR (length(x) >= 3 AND starts_with(w, x)))[1] = w THEN 1.0e0 ELSE 0.8e0 END))"


def registry_sql(threshold: float, k: int) -> str:
    return f"""WITH q AS ({NAMES}), en AS (SELECT ord, 0 AS pos, replace(name, '#', ' ') AS target, state, also FROM {{mrf_registry}} UNION ALL SELECT ord, 1, alias, state, also FROM {{mrf_registry}} WHERE alias IS NOT NULL),
sc AS (SELECT query, qs AS state, ord, pos, target, CASE WHEN a = '' OR b = '' THEN 0.0e0 WHEN a = b THEN 1.0e0 WHEN contains(a, b) OR contains(b, a) THEN 0.9e0 ELSE {r('g / len(qt) * 0.7e0 + g / len(tt) * 0.3e0', 3)} END AS score FROM (
  SELECT *, {GAIN} AS g FROM (SELECT *, string_split(a, ' ') AS qt, string_split(b, ' ') AS tt FROM (SELECT q.name AS query, q.state AS qs, ord, pos, target, {PLAIN.format('q.name')} AS a, {PLAIN.format('target')} AS b FROM q JOIN en ON q.state IS NULL OR q.state IN (en.state, also))))),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, state, ord ORDER BY score DESC, pos) AS rn FROM sc) WHERE rn = 1 AND score >= {threshold})
SELECT query, state, ord, score, target AS matched_on, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, state ORDER BY score DESC, ord) AS rank FROM one) WHERE rank <= {k}"""


BRANDED = TOK.format(N.format("brand || ' ' || description"))
EV = "{analytics_events}"
QUERIES = {
    "j15_price_lookup": (
        lambda t: prices.look_up_prices(requests(t), t.hospital_prices).select("request_id", "hospital_name", "payer_name", "gross_charge", "rank"),
        f"WITH {REQ} SELECT request_id, hospital_name, payer_name, gross_charge, rank FROM (SELECT q.request_id, p.*, row_number() OVER (PARTITION BY request_id ORDER BY hospital_name, payer_name NULLS FIRST, price_seq, gross_charge) AS rank FROM req q JOIN {{hospital_prices}} p ON q.code = p.billing_code AND (hospital IS NULL OR contains(lower(hospital_name), lower(hospital))) AND (payer IS NULL OR contains(lower(payer_name), lower(payer)))) WHERE rank <= 200",
    ),
    "j16_lowest_prices": (
        lambda t: prices.lowest_prices(requests(t), t.hospital_prices),
        f"WITH {REQ} SELECT request_id, {r('min(cash_discount_price) FILTER (cash_discount_price > 0)', 2)} AS cash_price, {r('min(negotiated_rate) FILTER (negotiated_rate > 0 AND contains(lower(payer_name), lower(payer)))', 2)} AS negotiated_rate FROM req q JOIN {{hospital_prices}} p ON q.code = p.billing_code AND (hospital IS NULL OR contains(lower(hospital_name), lower(hospital))) GROUP BY request_id",
    ),
    "j17_enriched_findings": (
        lambda t: prices.enrich(t.bill_lines.select("bill_id", "line_number", "code"), t.bills, t.hospital_prices).select("bill_id", "line_number", fn.round_to("cash_price", 2).alias("cash_price"), F.coalesce(F.size("negotiated"), F.lit(0)).alias("n_rates"), "gross_charge"),
        f"WITH d AS (SELECT l.bill_id, line_number, code, facility_name FROM {{bill_lines}} l JOIN {{bills}} b ON l.bill_id = b.bill_id), a AS (SELECT DISTINCT code, facility_name FROM d), e AS (SELECT code, facility_name, {r('min(cash_discount_price) FILTER (cash_discount_price > 0)', 2)} AS cash_price, count(DISTINCT struct_pack(a := payer_name, b := plan_name, c := negotiated_rate)) FILTER (negotiated_rate > 0) AS n_rates, arg_min(gross_charge, struct_pack(a := price_seq, b := gross_charge)) AS gross_charge FROM a JOIN {{hospital_prices}} p ON code = billing_code AND contains(lower(hospital_name), lower(facility_name)) GROUP BY code, facility_name) SELECT bill_id, line_number, cash_price, CAST(coalesce(n_rates, CASE WHEN e.code IS NULL THEN 0 ELSE 0 END) AS INT) AS n_rates, gross_charge FROM d LEFT JOIN e ON d.code = e.code AND d.facility_name = e.facility_name",
    ),
    "a29_price_stats": (lambda t: prices.price_stats(t.hospital_prices), "SELECT count(*) AS n, count(DISTINCT hospital_name) AS hospitals, count(DISTINCT payer_name) AS payers, count(DISTINCT billing_code) AS codes FROM {hospital_prices}"),
    "a30_price_summary": (
        lambda t: prices.price_summary(t.hospital_prices),
        "SELECT billing_code, count(DISTINCT hospital_name) AS hospitals, " + ", ".join(f"{f}({c}) FILTER ({c} > 0) AS {f}_{n}" for c, n in (("cash_discount_price", "cash"), ("negotiated_rate", "negotiated"), ("gross_charge", "gross")) for f in ("min", "max")) + " FROM {hospital_prices} GROUP BY billing_code",
    ),
    "a30_sketched_summary": (
        sketched,
        "SELECT billing_code, " + ", ".join(f"{f}({c}) FILTER ({c} > 0) AS {f}_{n}" for c, n in (("cash_discount_price", "cash"), ("negotiated_rate", "negotiated"), ("gross_charge", "gross")) for f in ("min", "max")) + ", true AS close FROM {hospital_prices} GROUP BY billing_code",
    ),
    "a31_cheapest_payers": (
        lambda t: prices.cheapest_payers(t.hospital_prices),
        f"WITH m AS (SELECT billing_code, payer_name, {r('avg(negotiated_rate)', 2)} AS mean_rate FROM {{hospital_prices}} WHERE negotiated_rate > 0 AND payer_name IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY billing_code ORDER BY mean_rate, payer_name) AS rank FROM m) WHERE rank <= 20",
    ),
    "w10_cheapest_five": (
        lambda t: prices.cheapest_payers(t.hospital_prices, 5).select("billing_code", "payer_name", "rank"),
        f"WITH m AS (SELECT billing_code, payer_name, {r('avg(negotiated_rate)', 2)} AS mean_rate FROM {{hospital_prices}} WHERE negotiated_rate > 0 AND payer_name IS NOT NULL GROUP BY ALL) SELECT billing_code, payer_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY billing_code ORDER BY mean_rate, payer_name) AS rank FROM m) WHERE rank <= 5",
    ),
    "w06_newest_prices": (
        lambda t: prices.newest(t.community_prices).select("billing_code", "price_id", "amount_paid", "rank"),
        "SELECT billing_code, price_id, amount_paid, rank FROM (SELECT *, row_number() OVER (PARTITION BY billing_code ORDER BY submitted_at DESC, price_id DESC, amount_paid DESC) AS rank FROM {community_prices}) WHERE rank <= 100",
    ),
    "a32_community_stats": (
        lambda t: prices.community_stats(t.community_prices),
        f"WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY billing_code ORDER BY submitted_at DESC, price_id DESC, amount_paid DESC) AS rank FROM {{community_prices}}) WHERE rank <= 100) SELECT billing_code, count(*) AS n, {r('avg(amount_paid)', 2)} AS mean, min(amount_paid) AS least, max(amount_paid) AS most, list_sort(list(amount_paid))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM n GROUP BY billing_code",
    ),
    "j18_charity_check": (
        lambda t: prices.charity_check(t.bills, t.charity_hospitals),
        "WITH n AS (SELECT facility_name, min(ein) AS e FROM (SELECT DISTINCT facility_name FROM {bills}) JOIN {charity_hospitals} ON contains(lower(name), lower(facility_name)) GROUP BY 1), z AS (SELECT zip_code, min(ein) AS e FROM {charity_hospitals} GROUP BY 1) SELECT bill_id, coalesce(n.e, z.e) AS ein, CASE WHEN n.e IS NOT NULL THEN 'name' WHEN z.e IS NOT NULL THEN 'zip' ELSE 'none' END AS matched_by FROM {bills} b LEFT JOIN n ON b.facility_name = n.facility_name LEFT JOIN z ON b.zip = z.zip_code",
    ),
    "j19_merged_hospitals": (
        lambda t: prices.merge_hospitals(t.charity_hospitals.where("ein < '000000050'").select("ein", "name", "state"), t.charity_hospitals.select(F.concat(F.lit("CMS-"), "ein").alias("ein"), F.lower("name").alias("name"), "state")),
        "SELECT ein, name, state FROM {charity_hospitals} WHERE ein < '000000050' UNION ALL SELECT 'CMS-' || ein, lower(name), state FROM {charity_hospitals} WHERE (upper(name), upper(state)) NOT IN (SELECT (upper(name), upper(state)) FROM {charity_hospitals} WHERE ein < '000000050')",
    ),
    "a35_hospital_counts": (
        lambda t: prices.hospital_counts(t.charity_hospitals.withColumn("ein", F.when(F.col("fap_url").isNull(), F.concat(F.lit("CMS-"), "ein")).otherwise(F.col("ein")))),
        "SELECT state, count(*) AS n, count(*) FILTER (fap_url IS NULL) AS synthetic, count(*) FILTER (fap_url IS NOT NULL) AS own FROM {charity_hospitals} GROUP BY state",
    ),
    "j25_registry_matches": (lambda t: prices.registry_matches(names(t), entries(t)), registry_sql(0.3, 5)),
    "j26_best_registry_match": (lambda t: prices.registry_matches(names(t), entries(t), 0.4, 1), registry_sql(0.4, 1)),
    "p25_zip": (lambda t: t.bills.select("bill_id", fn.zip5(F.concat(F.lit(" "), "zip", F.lit("-1234"))).alias("zip")), "SELECT bill_id, lpad(substr(regexp_replace(' ' || zip || '-1234', '\\D', '', 'g'), 1, 5), 5, '0') AS zip FROM {bills}"),
    "p26_ein": (lambda t: t.charity_hospitals.select("name", fn.ein("ein").alias("ein")), "SELECT name, substr(ein, 1, 2) || '-' || substr(ein, 3, 7) AS ein FROM {charity_hospitals}"),
    "f02_code_numbers": (
        lambda t: t.bill_lines.select("code").distinct().select(fn.clean_code(F.concat(F.lit(" "), F.lower("code"))).alias("code"), fn.number_prefix("code").alias("number")),
        f"SELECT DISTINCT code, {prefix('code')} AS number FROM {{bill_lines}}",
    ),
    "f05_word_sets": (
        lambda t: t.descriptions.select("seq", F.array_join(F.array_sort(fn.tokens(F.concat_ws(" - ", "description", "brand", "description"))), " ").alias("words")),
        f"SELECT seq, array_to_string(list_sort(list_distinct(string_split({N.format('description || chr(32) || brand')}, ' '))), ' ') AS words FROM {{descriptions}}",
    ),
    "f14_money_texts": (
        lambda t: t.bills.select("bill_id", fn.money_text(F.when(F.col("bill_id") % 2 == 0, -F.col("total_billed")).otherwise(F.col("total_billed"))).alias("total")),
        "SELECT bill_id, '$' || format('{:,}', CAST(trunc(x) AS BIGINT)) || '.' || right(CAST(x AS VARCHAR), 2) AS total FROM (SELECT bill_id, CAST(CASE WHEN bill_id % 2 = 0 THEN -total_billed ELSE total_billed END AS DECIMAL(18,2)) AS x FROM {bills}) b",
    ),
    "f04_normal_text": (lambda t: t.descriptions.select("seq", fn.normal_text("brand").alias("brand"), F.size(fn.tokens("description")).alias("n")), f"SELECT seq, {N.format('brand')} AS brand, len({TOK.format(N.format('description'))}) AS n FROM {{descriptions}}"),
    "f06_token_overlap": (
        lambda t: t.descriptions.select("seq", fn.overlap(fn.tokens("description"), fn.tokens(F.concat_ws(" ", "brand", "description"))).alias("score")),
        f"SELECT seq, len(list_intersect({TOK.format(N.format('description'))}, {BRANDED})) / least(len({TOK.format(N.format('description'))}), len({BRANDED})) AS score FROM {{descriptions}}",
    ),
    "u02_searchable": (lambda t: said(t).groupBy("ord").agg(F.count("*").alias("n"), F.countDistinct("said").alias("texts")), f"WITH {SAID} SELECT ord, count(*) AS n, count(DISTINCT said) AS texts FROM said GROUP BY ord"),
    "u03_code_descriptions": (lambda t: t.pfs_rates.select("code", "description").distinct(), "SELECT DISTINCT code, description FROM {pfs_rates}"),
    "j20_exact_description": (lambda t: matched(t, "exact"), f"WITH {TEXTS}, {STEP1} SELECT * FROM s1"),
    "j21_fuzzy_description": (lambda t: matched(t, "fuzzy"), f"WITH {TEXTS}, {step2('nm', 's2')} SELECT * FROM s2"),
    "j22_inside_description": (lambda t: matched(t, "inside"), f"WITH {TEXTS}, {SAID}, {step3('nm', 's3')} SELECT * FROM s3"),
    "j23_word_description": (lambda t: matched(t, "words"), f"WITH {TEXTS}, {SAID}, {step4('nm', 's4')} SELECT * FROM s4"),
    "j24_description_cascade": (
        lambda t: descriptions.resolve(texts(t), dictionary(t), t.keep),
        f"WITH {CASCADE}, al AS (SELECT *, 'exact' AS step FROM s1 UNION ALL SELECT *, 'fuzzy' FROM s2 UNION ALL SELECT *, 'inside' FROM s3 UNION ALL SELECT *, 'words' FROM s4) SELECT description, code, confidence, step FROM (SELECT DISTINCT description, {N.format('description')} AS name FROM texts) JOIN al USING (name) WHERE confidence >= 0.6",
    ),
    "a23_audit_totals": (
        lambda t: stats.audit_totals(t.audits),
        f"SELECT count(*) AS audits, {r('sum(total_billed)', 0)} AS billed, {r('sum(total_cms)', 0)} AS cms, {r('sum(total_savings)', 0)} AS savings, {r('avg(total_savings)', 0)} AS mean_savings, max(total_savings) AS max_savings FROM {{audits}}",
    ),
    "a24_user_totals": (
        lambda t: t.audits.groupBy("user_id").agg(F.count("*").alias("audits"), fn.round_to(F.avg("total_savings"), 2).alias("mean"), F.max("total_savings").alias("most")),
        f"SELECT user_id, count(*) AS audits, {r('avg(total_savings)', 2)} AS mean, max(total_savings) AS most FROM {{audits}} GROUP BY user_id",
    ),
    "a25_top_codes": (
        lambda t: stats.top_codes(found(t)),
        f"WITH {FOUND} SELECT code, count(*) AS n, {r('sum(overcharge)', 0)} AS overcharge, {r('avg(multiplier)', 1)} AS mean_multiplier FROM found WHERE overcharge > 0 GROUP BY code ORDER BY overcharge DESC, code LIMIT 10",
    ),
    "w05_audit_page": (lambda t: stats.audit_page(t.audits, 50, 100).select("report_id", F.col("created_at").cast("string").alias("day")), "SELECT report_id, CAST(created_at AS STRING) AS day FROM {audits} ORDER BY created_at DESC, report_id DESC LIMIT 50 OFFSET 100"),
    "w05_seek_page": (next_page, "SELECT report_id, CAST(created_at AS STRING) AS day FROM {audits} ORDER BY created_at DESC, report_id DESC LIMIT 50 OFFSET 100"),
    "w07_top_audits": (
        lambda t: stats.top_audits(t.audits).select("report_id", F.lit("savings").alias("kind")).unionByName(stats.latest_audits(t.audits).select("report_id", F.lit("latest").alias("kind"))),
        "SELECT * FROM (SELECT report_id, 'savings' AS kind FROM {audits} ORDER BY total_savings DESC, report_id LIMIT 5) UNION ALL SELECT * FROM (SELECT report_id, 'latest' AS kind FROM {audits} ORDER BY created_at DESC, report_id LIMIT 10)",
    ),
    "s14_allowed_events": (lambda t: t.analytics_events.where(F.col("event_type").isin(*stats.EVENT_TYPES)).select("event_id", "event_type"), f"SELECT event_id, event_type FROM {EV} WHERE event_type IN {stats.EVENT_TYPES}"),
    "a26_page_views": (
        lambda t: stats.page_views_of(rollup(t), as_of()),
        f"SELECT json_extract_string(event_data, '$.k') AS page, count(*) FILTER (created_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS last_7, count(*) FILTER (created_at > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS last_30 FROM {EV} WHERE event_type = 'page_view' GROUP BY 1",
    ),
    "a27_audit_events": (
        lambda t: stats.audit_events_of(rollup(t), as_of()),
        f"SELECT count(*) AS audits, count(*) FILTER (created_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS last_7, {r('avg(TRY_CAST(json_extract_string(event_data, ' + chr(39) + '$.k' + chr(39) + ') AS DOUBLE))', 2)} AS mean_size FROM {EV} WHERE event_type = 'audit'",
    ),
    "a28_event_trend": (
        lambda t: stats.event_trend_of(rollup(t), as_of()).withColumn("day", F.col("day").cast("string")),
        f"SELECT CAST(CAST(created_at AS DATE) AS STRING) AS day, count(*) FILTER (event_type = 'audit') AS audits, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'upgrade') AS upgrades, count(*) FILTER (event_type = 'feature_use') AS feature_uses FROM {EV} WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1",
    ),
    "a33_table_counts": (
        lambda t: stats.table_counts({n: getattr(t, n) for n in ("pfs_rates", "clfs_rates", "asp_rates", "opps_rates", "zip_locality", "hospital_prices")}),
        " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {{{n}}}" for n in ("asp_rates", "clfs_rates", "hospital_prices", "opps_rates", "pfs_rates", "zip_locality")),
    ),
    "a34_zip_states": (
        lambda t: stats.zip_states(t.zip_locality),
        "SELECT state, count(*) AS n, count(*) FILTER (urban_rural = 'R') AS rural, count(*) FILTER (coalesce(urban_rural, 'U') = 'U') AS urban FROM {zip_locality} GROUP BY state ORDER BY n DESC, state LIMIT 10",
    ),
    "a36_rate_spread": (lambda t: stats.rate_spread(t.pfs_rates), f"SELECT code, count(*) AS n, {r('avg(facility_rate)', 2)} AS mean, min(facility_rate) AS least, max(facility_rate) AS most FROM {{pfs_rates}} WHERE facility_rate > 0 GROUP BY code"),
    "a37_load_check": (
        lambda t: stats.load_check(t.pfs_rates.withColumn("description", F.when(F.col("rate_seq") % 3 > 0, F.col("description")))),
        "SELECT snapshot_id, count(*) FILTER (rate_seq % 3 > 0) AS described, count(*) FILTER (rate_seq % 3 = 0) AS bare, count(DISTINCT code) AS codes FROM {pfs_rates} GROUP BY snapshot_id",
    ),
    "a39_monthly_usage": (lambda t: stats.monthly_usage(t.audits), "SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS used, count(*) < 3 AS allowed FROM {audits} GROUP BY ALL"),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
