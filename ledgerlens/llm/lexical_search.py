"""Ranked lexical search (operator 11): a length-stratified index, searched stratum by stratum.

1. A pass over the texts counts each document's terms; corpus statistics come from all documents.
2. The index is dealt by documents: a shard is a run of documents of one task. Within it the documents of one normaliser
   m form a stratum, one row: its doc_ids, and per term the postings by falling tf. All documents of a stratum and tf get the same
   impact of a term, so impacts are computed once per tf, and the first tf of a term gives its bound in the stratum.
3. A search hands blocks of items of bounded size to the tasks. A task orders the strata by the items' bounds, scores a
   stratum only for the items whose bound reaches their k-th best score so far, and returns k documents per item; these
   meet in two rounds of ranking, first by item and a share of the tasks.

Terms travel as 64-bit hashes. Everything but a term's weight is integer arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, id_type, small_batches, table
from .words import Words, chunks

TOP = 50
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20  #: a shard ends at either
VOCABULARY = 1 << 20  #: terms to which an index can be restricted; with more it holds all terms
BLOCK_TERMS = 1 << 20  #: (item, term) pairs of one block of items, about
CELLS = 1 << 20  #: numbers in one matrix of bounds or scores
MERGE = 64  #: shares of the first round of ranking

_TERM = np.arange(256, dtype=np.uint8)
_TERM[65:91] += 32
_TERM[[c for c in range(128) if not chr(c).isalnum()]] = 0


def _terms(batches: Iterator[pa.RecordBatch], only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(id, n, terms, tfs) of every text with a term; ``only``: the sorted hashes to which terms are restricted."""
    for batch in batches:
        ids, texts = batch.columns
        for lo, hi, data, off in chunks(texts):
            w = Words(data, off, _TERM)
            n = np.bincount(w.doc, minlength=hi - lo)
            doc, h = w.doc, w.hash
            if only is not None:
                place = np.minimum(np.searchsorted(only, h), max(0, len(only) - 1))
                known = only[place] == h if len(only) else np.zeros(len(h), bool)
                doc, h = doc[known], h[known]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.ones(len(h), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(first)
            tf = np.diff(np.append(at, len(h))).astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=hi - lo))]).astype(np.int32))
            columns = [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(h[at].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(tf))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))


def _counted(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
    """``rows`` is (id, text)."""
    small_batches(rows.sparkSession)
    known = rows.sparkSession.sparkContext.broadcast(only)
    return rows.mapInArrow(lambda batches: _terms(batches, known.value), f"id {id_type(rows, 'id')}, n long, terms array<long>, tfs array<int>")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(first)


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def _stratify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, m, terms, tfs) to strata, shard by shard."""
    held: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            held.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield _shard(held)
                held, docs, postings = [], 0, 0
    if docs:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).sort_by([("m", "ascending"), ("id", "ascending")]).combine_chunks()
    column = lambda name: t.column(name).combine_chunks()
    m, terms, tfs = column("m").to_numpy(), column("terms"), column("tfs")
    begin = _runs(m)  # of strata, in documents
    stratum_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(m))))
    doc = np.repeat(np.arange(len(m)), pc.list_value_length(terms).to_numpy())
    term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
    order = np.lexsort((doc, -tf, term, stratum_of[doc]))
    doc, term, tf = doc[order], term[order], tf[order]
    s = stratum_of[doc]
    level = _runs(s, term, tf) if len(s) else np.zeros(0, np.int64)  # a term's documents of one tf
    own = level[np.isin(level, _runs(s, term))] if len(s) else level  # a term's first level
    count = lambda at: np.cumsum(np.bincount(s[at], minlength=len(begin)))
    rank = np.searchsorted(level, own)
    sizes = np.diff(np.append(level, len(s))).astype(np.int32)
    levels = np.diff(np.append(rank, len(level))).astype(np.int32)
    everyone = np.arange(len(s))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(m[begin]), _lists(column("id"), np.append(begin[1:], len(m))), _lists(pa.array(term[own]), count(own)), _lists(pa.array(levels), count(own)),
            _lists(pa.array(tf[level]), count(level)), _lists(pa.array(sizes), count(level)), _lists(pa.array((doc - begin[s]).astype(np.int32)), count(everyone)),
        ],
        ["m", "ids", "terms", "levels", "tfs", "sizes", "members"],
    )


@dataclass
class Index:
    """``strata``: (m, ids, terms, levels, tfs, sizes, members), see the module; ``df``: (term, df); N and L of the corpus."""

    strata: DataFrame
    df: DataFrame
    n_docs: int
    n_terms: int

    def drop(self) -> None:
        for part in (self.strata, self.df):
            drop_cut(part)


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """Index of ``docs`` (doc_id, text). With ``vocabulary`` (term long, hashes from ``item_terms``) it holds only those terms.

    Statistics count every row of ``docs`` with a term; null, empty and termless texts count nowhere. Rows that repeat a
    doc_id, or have none, are documents of their own. doc_id may be of any ordered type. The restricted index is the same
    but for the absent terms; over ``VOCABULARY`` terms it isn't restricted.
    """
    only = None
    if vocabulary is not None and vocabulary.count() <= VOCABULARY:
        only = np.sort(np.array(vocabulary.select("term").toArrow().column(0).to_numpy(), np.int64).view(np.uint64))
    counted = cut(_counted(docs.select(F.col("doc_id").alias("id"), "text"), only))
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = cut(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    # a decimal product: 50 * n * N can pass 64 bits in a very large corpus
    m = F.expr(f"50 + (CAST(n AS DECIMAL(17, 0)) * CAST({50 * n_docs} AS DECIMAL(20, 0))) div CAST({max(1, n_terms)} AS DECIMAL(20, 0))")
    kind = id_type(counted, "id")
    schema = f"m long, ids array<{kind}>, terms array<long>, levels array<int>, tfs array<int>, sizes array<int>, members array<int>"
    strata = cut(counted.select("id", m.cast("long").alias("m"), "terms", "tfs").mapInArrow(_stratify, schema))
    drop_cut(counted)
    return Index(strata, df, n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text); rows that share an item_id are one item."""
    return _counted(items.select(F.col("item_id").alias("id"), "text"), None).select(F.col("id").alias("item_id"), F.explode("terms").alias("term")).distinct()


@dataclass
class _Items:
    """A block of items: item numbers and their terms' numbers, sorted by item; the sorted terms and their weights; numbers in a matrix."""

    ids: pa.Array
    item: np.ndarray
    term: np.ndarray
    terms: np.ndarray
    weight: np.ndarray
    cells: int


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each item: highest score, then least doc_id (nulls last)."""
    found = found.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
    item = found.column("item").to_numpy()
    begin = _runs(item)
    rank = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
    return found.filter(pa.array(rank < k))


class _Search:
    """One task's search: the best documents so far, and each item's k-th score."""

    def __init__(self, items: _Items, k: int):
        self.items, self.k = items, k
        self.begin = _runs(items.item)
        self.count = np.diff(np.append(self.begin, len(items.item)))
        self.least = np.ones(len(self.begin), np.int64)  # a score must reach this
        self.number = np.full(len(items.terms), -1)
        self.highest = np.zeros(len(items.terms), np.int64)
        self.found: list[pa.Table] = []
        self.held = 0

    def visit(self, batch: pa.RecordBatch) -> None:
        flat = [c.flatten() for c in batch.columns[1:]]
        ends = [np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy())]) for c in batch.columns[1:]]
        m = batch.column(0).to_numpy()
        ids = flat[0]
        term, levels, tf, size, member = (c.to_numpy() for c in flat[1:])
        of_level = np.repeat(np.arange(len(term)), levels)
        stratum = np.repeat(np.arange(len(m)), np.diff(ends[1]))
        place = np.minimum(np.searchsorted(self.items.terms, term), len(self.items.terms) - 1)
        weight = np.where(self.items.terms[place] == term, self.items.weight[place], 0)
        tf = tf.astype(np.int64)
        impact = weight[of_level] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[stratum[of_level]]))  # once per tf
        first = np.cumsum(levels) - levels
        posting = np.concatenate([[0], np.cumsum(size)])
        step = max(1, self.items.cells // max(1, len(self.begin)))
        for lo in range(0, len(m), step):
            hi = min(len(m), lo + step)
            bounds = np.zeros((hi - lo, len(self.begin)), np.int64)
            for s in range(lo, hi):
                t = np.arange(ends[1][s], ends[1][s + 1])
                t = t[weight[t] > 0]
                self.highest[place[t]] = impact[first[t]]
                bounds[s - lo] = np.add.reduceat(self.highest[self.items.term], self.begin)
                self.highest[place[t]] = 0
            share = (bounds / np.maximum(1, bounds.max(0))).max(1)
            for s in lo + np.argsort(-share, kind="stable"):
                who = np.flatnonzero(bounds[s - lo] >= self.least)
                if not len(who):
                    continue
                t = np.arange(ends[1][s], ends[1][s + 1])
                row = np.cumsum(weight[t] > 0) - 1  # of each term that an item holds
                t = t[weight[t] > 0]
                lev = np.arange(ends[3][s], ends[3][s + 1])
                lev = lev[weight[of_level[lev]] > 0]
                a, b = posting[lev], posting[lev + 1]
                at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
                held = np.repeat(row[of_level[lev] - ends[1][s]], b - a)
                gain = np.repeat(impact[lev], b - a)
                self.number[place[t]] = np.arange(len(t))
                self._score(who, held, member[at], gain, len(t), ids.slice(ends[0][s], ends[0][s + 1] - ends[0][s]))
                self.number[place[t]] = -1

    def _score(self, who: np.ndarray, held: np.ndarray, member: np.ndarray, gain: np.ndarray, rows: int, ids: pa.Array) -> None:
        """Scores of a stratum's documents for the items ``who``, a matrix of bounded size at a time."""
        order = np.argsort(member, kind="stable")
        held, member, gain = held[order], member[order], gain[order]
        wide = max(1, min(256, self.items.cells // rows))
        for lo in range(0, len(ids), wide):
            a, b = np.searchsorted(member, [lo, lo + wide])
            if a == b:
                continue
            width = min(wide, len(ids) - lo)
            each = np.zeros((rows, width), np.int64)
            each[held[a:b], member[a:b] - lo] = gain[a:b]
            done = 0
            while done < len(who):
                upto = done + max(1, int(np.searchsorted(np.cumsum(self.count[who[done:]]), self.items.cells // width, "right")))
                some, done = who[done:upto], upto
                c = self.count[some]
                at = np.repeat(self.begin[some] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
                number = self.number[self.items.term[at]]
                of = np.repeat(np.arange(len(some)), c)[number >= 0]  # every item of ``who`` has such a term
                score = np.add.reduceat(each[number[number >= 0]], _runs(of), axis=0)
                i, d = np.nonzero(score >= self.least[some][:, None])
                if len(i):
                    self.found.append(pa.table({"item": some[i], "score": score[i, d], "doc_id": ids.take(pa.array(lo + d))}))
                    self.held += len(i)
                if self.held > max(1 << 16, 4 * self.k * len(self.begin)):
                    self.settle()

    def settle(self) -> pa.Table | None:
        if not self.found:
            return None
        best = _best(pa.concat_tables(self.found), self.k)
        item, score = best.column("item").to_numpy(), best.column("score").to_numpy()
        begin = _runs(item)
        full = np.diff(np.append(begin, len(item))) == self.k
        self.least[item[begin[full]]] = score[begin[full] + self.k - 1]
        self.found, self.held = [best], len(best)
        return best


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``index`` for each item of ``items`` (item_id, text).

    Exact. Rows that share an item_id are one item, also the rows without an id; terms count once per item. Scores are
    above 0; equal scores go by ascending doc_id, nulls last. Items that match nothing, and an empty index, give no rows. Items are searched in blocks of about
    ``BLOCK_TERMS`` terms, a pass over the strata each; a block, never more, is held by the driver and by each task.
    """
    spark = items.sparkSession
    ratio = F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weights = index.df.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")).where("w > 0")
    wanted = cut(item_terms(items).join(weights, "term"))
    blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    kind, item_kind = id_type(index.strata.select(F.explode("ids").alias("id")), "id"), id_type(items, "item_id")
    found = None
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else wanted
        block = mine.toArrow().sort_by("item_id").combine_chunks()
        ids = block.column("item_id").combine_chunks() if len(block) else pa.array([], pa.null())
        item = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False) if len(block) else np.zeros(0, int)
        hashes, where = np.unique(block.column("term").to_numpy(), return_index=True)
        known = spark.sparkContext.broadcast(
            _Items(ids.take(pa.array(_runs(item))), item.astype(np.int64), np.searchsorted(hashes, block.column("term").to_numpy()), hashes, block.column("w").to_numpy()[where], CELLS)
        )

        def visit(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            items = known.value
            if not len(items.terms):
                return
            task = _Search(items, k)
            for batch in batches:
                if batch.num_rows:
                    task.visit(batch)
            best = task.settle()
            if best is not None:
                t = pa.table({"item_id": items.ids.take(best.column("item").combine_chunks()), "doc_id": best.column("doc_id"), "score": best.column("score")})
                yield from t.to_batches(max_chunksize=10_000)

        part = index.strata.mapInArrow(visit, f"item_id {item_kind}, doc_id {kind}, score long")
        found = part if found is None else found.unionAll(part)
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    shared = found.withColumn("share", F.spark_partition_id() % MERGE)
    once = shared.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "share").orderBy(*best_first))).where(F.col("rank") <= k)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    vocabulary = item_terms(items).select("term").distinct()
    return search(build_index(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), items)


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
held AS (SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, unnest({_SPLIT}) AS term FROM numbered) GROUP BY ALL),
sizes AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
lengths AS (SELECT r, 100 - 50 + (50 * n * docs) // terms AS m FROM sizes, corpus),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, corpus GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
scored AS (
  SELECT item_id, held.r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths ON lengths.r = held.r GROUP BY item_id, held.r
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""
