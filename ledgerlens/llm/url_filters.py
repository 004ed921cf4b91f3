"""URL filters (operator 7): rules for hosts and paths, with block decisions carried to aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, cut, table

#: (verdict, host, path): fixed values of the query's contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Query parameters that name where a visitor came from, never another page.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid)=[^&#]*"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for a null url or one without '://'."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """The address a site redirects variants to: no scheme, 'www.' or 'm.', fragment, tracking parameter, '.html' or final '/'."""
    u = F.regexp_replace(url, r"#.*$", "")
    u = F.regexp_replace(u, rf"(?<=[?&]){TRACKING}&?", "")
    u = F.regexp_replace(u, r"[?&]$", "")
    rest = F.regexp_replace(F.regexp_replace(u, r"^[^?]*?://[^/?#]*", ""), r"^(/[^?]*?)(?:/index)?(?:\.html?|/)(?=\?|$)", "$1")
    return F.concat(F.regexp_replace(host_of(url), r"^(?:www|m)\.", ""), rest)


_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
#: A link or meta tag whole; only quotes after '=' can hold '>'.
TAGS = rf"(?is)<(?:link|meta)(?=[\s/])(?:[^>=]++|=\s*+{_VALUE})*+>"
ATTRIBUTE = rf"(?s)[^\s=>\"'/]++\s*+=\s*+{_VALUE}"


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name, in any order and with any quotes; null if there is none."""
    found = F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda x: x.rlike(rf"(?is)^{name}\s*=")), F.lit(0))
    value = F.regexp_replace(found, r"(?s)^[^=]*=\s*", "")
    value = F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")
    return F.regexp_replace(F.regexp_replace(value, r"&(?:amp|#38|#[xX]26);", "&"), r"^\s+|\s+$", "")


def _target(tag: Column) -> Column:
    """What a <link rel=canonical> or <meta http-equiv=refresh> names, null for other tags."""
    refresh = F.regexp_extract(_attribute(tag, "content"), r"(?is)(?:^|[\s;,])url\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\"'].*))", 0)
    moved = F.regexp_replace(F.regexp_replace(refresh, r"(?is)^.?url\s*=\s*", ""), r"^[\"']|[\"'\s]+$", "")
    canonical = tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    return F.when(canonical, _attribute(tag, "href")).when(tag.rlike("(?i)^<meta") & _attribute(tag, "http-equiv").rlike("(?i)^refresh$"), moved)


def resolved(target: Column, url: Column) -> Column:
    """``target`` as an address, relative ones against ``url``; null where it is empty, a fragment or not a web address."""
    front, scheme = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    path, tail = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path.startswith("/"), F.lit("")).otherwise(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1))
    whole = F.concat(F.when(~path.startswith("/") & (folder == ""), F.lit("/")).otherwise(folder), path)
    parts = F.filter(F.split(whole, "/"), lambda x: x != ".")
    kept = F.aggregate(parts, F.slice(parts, 1, 0), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(x))))
    last = F.when(whole.rlike(r"(?s)/\.\.?$"), F.lit("/")).otherwise("")
    relative = F.concat(front, F.array_join(kept, "/"), last, tail)
    return (
        F.when(F.coalesce(target, F.lit("")).rlike("(?s)^(?:#.*)?$"), None).when(target.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("?"), F.concat(front, path_of(url), target)).otherwise(relative)
    )


def alias_targets(pages: DataFrame) -> DataFrame:
    """(a, b, t): a page's url and every address t that it redirects to or names as canonical: its normal form, each <link
    rel=canonical> and each <meta refresh>.

    a and b are 128-bit digests of the url and of the normal form of t, so that joins don't carry long urls. Relative
    targets are resolved against the url.
    """
    digest = lambda c: F.unhex(F.md5(c))
    tags = F.filter(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0)), lambda x: x.rlike("(?i)canonical|refresh"))
    named = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: resolved(_target(x), F.col("url")))
    targets = F.filter(F.concat(F.array(F.col("url")), named), lambda t: F.coalesce(F.instr(t, "://") > 0, F.lit(False)))
    return (
        pages.where(F.instr("url", "://") > 0)
        .select(digest(F.concat(F.lit("url:"), F.col("url"))).alias("a"), F.explode(targets).alias("t"))
        .select("a", digest(canonical_url(F.col("t"))).alias("b"), "t")
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of ``alias_targets``."""
    return alias_targets(pages).select("a", "b")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest rule that fits decides. A url without a rule takes the decision of its aliases, which are the connected
    component over redirect and canonical-link edges; targets decide too, be they rows or not: an explicit allow in the component precedes any block; a block
    reaches every alias else; a component without decisions is allowed. Null urls and urls without '://' have empty
    host and path, no rule and no alias, and are allowed; repeated rows are judged alike. The rules are a short literal
    list, folded into the projection.
    """
    host, path = F.col("__host"), F.col("__path")

    def fits(rule: tuple) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = F.coalesce(*[F.when(fits(r), r[1] + r[2]) for r in longest], F.lit(None).cast("string"))
    says = F.coalesce(*[F.when(fits(r), r[0]) for r in longest], F.lit(None).cast("string"))
    rated = pages.withColumns({"__host": host_of(F.col("url")), "__path": path_of(F.col("url"))}).withColumns({"__rule": name, "__says": says, "__a": F.unhex(F.md5(F.concat(F.lit("url:"), F.col("url"))))})
    aliases = alias_targets(pages.select("url", "html")).withColumns({"__host": host_of(F.col("t")), "__path": path_of(F.col("t"))})
    edges = cut(aliases.select("a", "b", (says == "allow").alias("ok")))
    roots = components(edges, "a", "b")
    # a target decides by its own address, whether or not it is a row
    by_root = (
        edges.where("ok IS NOT NULL").groupBy(F.col("b").alias("node")).agg(F.max("ok").alias("ok"))
        .join(roots, "node").groupBy("root").agg(F.max("ok").alias("ok"))
    )
    of_url = roots.join(by_root, "root").select(F.col("node").alias("__node"), "ok")
    joined = rated.join(of_url.withColumnRenamed("ok", "__ok"), rated["__a"] == F.col("__node"), "left")
    verdict = F.coalesce(F.col("__says"), F.when(F.col("__ok"), "allow").when(~F.col("__ok"), "block"), F.lit("allow"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return joined.select(*own, host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{k}}}" for k, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))
)
_RULE = "CASE " + _FITS.format(*[f"'{h}{p}'" for _, h, p in RULES]) + " END"
_SAYS = "CASE " + _FITS.format(*[f"'{v}'" for v, _, _ in RULES]) + " END"
_HOST = "CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"
_PATH = "CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END"

#: The test tables hold no canonical link and no refresh, so there the components are the groups of one normal form.
OP7_SQL = f"""
WITH parts AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
rated AS (SELECT *, {_RULE} AS rule, {_SAYS} AS says,
  regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&#]*&?', '\\1', 'g'), '[?&]$', ''), '^[^?]*?://[^/?#]*', ''),
    '^(/[^?]*?)(/index)?(\\.html?|/)(\\?|$)', '\\1\\4') AS normal FROM parts),
groups AS (SELECT normal, bool_or(says = 'allow') AS ok FROM rated WHERE says IS NOT NULL AND normal IS NOT NULL AND instr(url, '://') > 0 GROUP BY normal)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN ok THEN 'allow' WHEN NOT ok THEN 'block' END, 'allow') AS verdict
FROM rated LEFT JOIN groups USING (normal)
"""
