"""Line dedup (operator 6): drop lines that many documents share, natively in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, table

MIN_CHARS, MIN_DOCS = 40, 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _digest(stripped: Column) -> Column:
    """128 bits of the line's key (A-Z lower-cased), so that lines travel as 16 bytes."""
    return F.unhex(F.md5(ascii_lower(stripped)))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, t, lost): the positions of the lines that a document (doc_id, t being its text's hash) loses.

    Lines are exploded with their positions and hashed, and these small rows are written out once. They are counted per
    (digest, document) and then per digest, both with map-side combining, so a line in a third of all documents is not
    gathered. The join back is a plain shuffle join on the digest that adaptive execution splits where one line is hot.
    """
    each = cut(
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("t"), _lines(F.col("text")).alias("lines"))
        .select("doc_id", "t", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "t", "pos", _stripped(F.col("line")).alias("s"))
        .where(F.length("s") >= min_chars)
        .select("doc_id", "t", "pos", _digest(F.col("s")).alias("h"))
    )
    counted = each.select("h", "doc_id").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    often = cut(counted.where(F.col("n") >= min_docs).select("h", "keeper"))
    return each.join(often, "h").where("doc_id != keeper").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("lost"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """``docs`` with all its columns, where ``text`` has lost the shared lines.

    With ``counts`` there are also line_n_lines and line_n_dropped, in place of columns of these names.

    A key (line stripped of blanks, A-Z lower-cased) of at least ``min_chars`` code points in at least ``min_docs``
    documents stays only in the largest doc_id that holds it, there in every place. Null and empty texts are one empty
    line and become ''. Rows with a null doc_id count for no line and lose none; rows that repeat a doc_id are one
    document for counting and each loses its own lines. doc_id may be of any ordered type. An empty table gives an empty
    table. Texts are put together again from the positions that stay, in time linear in their lines.
    """
    lost = shared_lines(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias("__lost_id"), F.col("t").alias("__lost_t"), F.col("lost").alias("__lost"))
    # adaptive execution may broadcast ``lost`` when it turns out small; else this is one shuffle of the texts
    joined = docs.join(lost, (docs["doc_id"] == lost["__lost_id"]) & (F.xxhash64(docs["text"]) == lost["__lost_t"]), "left")
    # the generator keeps the array of lines from being built again for every position
    d = joined.select(*[joined[c] for c in docs.columns], "__lost", F.explode(F.array(_lines(docs["text"]))).alias("__lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    whole = F.when(F.col("__lost").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda p: F.get("__lines", p)), "\n"))
    added = {"line_n_lines": F.size("__lines").cast("long"), "line_n_dropped": F.greatest(F.size("__lost"), F.lit(0)).cast("long")} if counts else {}
    return d.select(*[whole.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in added], *[v.alias(c) for c, v in added.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_n_lines").alias("n_lines"), F.col("line_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CTEs giving ``deduped(doc_id, n_lines, n_dropped, text)`` from ``{docs}``.
DEDUP_CTE = f"""
split_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {{docs}}
), keyed AS (SELECT doc_id, line, pos, {_KEY} AS k FROM split_lines
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT keyed.*, often.k IS NOT NULL AND doc_id != keeper AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
), deduped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)"""

OP6_SQL = f"WITH {DEDUP_CTE.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped"
