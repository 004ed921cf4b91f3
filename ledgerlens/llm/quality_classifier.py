"""Quality classifier (operator 5): a factorisation machine over hashed words, structure statistics and length metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_type, table
from .words import Words, chunks

WORDS, STRUCTURE, LENGTHS = 2048, 12, 16
FIELDS = WORDS + STRUCTURE + LENGTHS
RANK = 8
SAMPLE = 8000  #: labelled texts that the machine is fitted on, at most twice as many; a hash of the id chooses them
EPOCHS, BATCH, RATE, SHRINK = 12, 64, 0.05, 1e-5
KEEP = 0.7


def _share(data: np.ndarray, doc: np.ndarray, n: int, mask: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.bincount(doc[mask], minlength=n) / np.maximum(of, 1)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a chunk: (text, field, value), sorted by text.

    Fields: word buckets (L2-normalised square-root counts), shares and ratios of the text's structure in 0..1, and one
    field for the logarithm of the length, the metadata that a text itself has.
    """
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    w = Words(data, off)
    words = np.bincount(w.doc, minlength=n)
    lines = np.bincount(doc[data == 10], minlength=n) + 1
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    length = w.end - w.start
    # words in a 3-word window that the text repeats, and distinct words, both per word
    at, h = w.windows(3)
    order = np.lexsort((h, w.doc[at]))
    same = np.zeros(len(at), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (w.doc[at][order][1:] == w.doc[at][order][:-1])
    order1 = np.lexsort((w.hash, w.doc))
    new = np.ones(len(w.hash), bool)
    new[1:] = (w.hash[order1][1:] != w.hash[order1][:-1]) | (w.doc[order1][1:] != w.doc[order1][:-1])
    stats = np.stack(
        [
            _share(data, doc, n, np.isin(data, np.frombuffer(b"#*$%&<>", np.uint8)), words) / 3,
            _share(data, doc, n, data == 124, words),
            _share(data, doc, n, data == 33, words) / 2,
            _share(data, doc, n, upper, np.bincount(doc[upper | lower], minlength=n)),
            _share(data, doc, n, (data >= 48) & (data <= 57), size),
            _share(data, doc, n, np.isin(data, np.frombuffer(b".,;:?-'\"()", np.uint8)), words),
            np.bincount(w.doc, weights=length, minlength=n) / np.maximum(words, 1) / 16,
            np.bincount(w.doc[at][order][same], minlength=n) / np.maximum(words, 1),
            np.bincount(w.doc[order1][new], minlength=n) / np.maximum(words, 1),
            lines / np.maximum(words, 1),
            np.bincount(w.doc[length == 1], minlength=n) / np.maximum(words, 1),
            np.bincount(w.doc[length > 20], minlength=n) / np.maximum(words, 1),
        ],
        1,
    )
    stats = np.minimum(stats, 1.0)
    slot = (w.hash >> np.uint64(53)).astype(np.int64)
    key, count = np.unique(w.doc * WORDS + slot, return_counts=True)
    row, value = key // WORDS, np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
    r = np.concatenate([row, np.repeat(np.arange(n), STRUCTURE), np.arange(n)])
    f = np.concatenate([key % WORDS, np.tile(np.arange(WORDS, WORDS + STRUCTURE), n), WORDS + STRUCTURE + np.minimum(np.log2(size + 1.0), LENGTHS - 1).astype(np.int64)])
    v = np.concatenate([value / norm[row], stats.ravel(), np.ones(n)])
    order = np.argsort(r, kind="stable")
    return r[order], f[order], v[order]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, r: np.ndarray, f: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        """Linear in the entries: the pairwise term is half of (sum of factors) squared less the sum of squares."""
        begin = np.searchsorted(r, np.arange(n))
        xv = self.factors[f] * v[:, None]
        s = np.add.reduceat(xv, begin, 0)
        q = np.add.reduceat((xv * xv).sum(1), begin)
        return self.bias + np.add.reduceat(self.linear[f] * v, begin) + 0.5 * ((s * s).sum(1) - q)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of the sampled texts, of bounded size whatever the texts' length."""
    for batch in batches:
        for lo, hi, data, off in chunks(batch.column(2), rows=512):
            r, f, v = features(data, off)
            ends = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (f.astype(np.int32), v)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], ["mark", "y", "f", "v"])


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mini-batch AdaGrad on the bounded sample, in an order fixed by the texts."""
    pdf = pdf.sort_values(["mark", "y"], kind="stable")
    y = pdf["y"].to_numpy(float)
    f, v = np.concatenate(pdf["f"].to_list()).astype(np.int64), np.concatenate(pdf["v"].to_list())
    ends = np.concatenate([[0], np.cumsum(pdf["f"].map(len).to_numpy())])
    rng = np.random.default_rng(11)
    m = Machine(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(FIELDS), rng.normal(0, 0.02, (FIELDS, RANK)))
    g_bias, g_lin, g_fac = 1e-6, np.full(FIELDS, 1e-6), np.full((FIELDS, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for b in range(0, len(y), BATCH):
            pick = np.sort(order[b : b + BATCH])
            size = ends[pick + 1] - ends[pick]
            idx = np.repeat(ends[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            rr, ff, vv = np.repeat(np.arange(len(pick)), size), f[idx], v[idx]
            xv = m.factors[ff] * vv[:, None]
            s = np.add.reduceat(xv, np.concatenate([[0], np.cumsum(size)[:-1]]), 0)
            err = (_sigmoid(m.logits(rr, ff, vv, len(pick))) - y[pick]) / len(pick)
            e = err[rr]
            lin = np.bincount(ff, weights=e * vv, minlength=FIELDS) + SHRINK * m.linear
            d = (e * vv)[:, None] * (s[rr] - xv)
            fac = np.stack([np.bincount(ff, weights=d[:, k], minlength=FIELDS) for k in range(RANK)], 1) + SHRINK * m.factors
            g_bias += err.sum() ** 2
            m.bias -= RATE * err.sum() / np.sqrt(g_bias)
            g_lin += lin * lin
            m.linear -= RATE * lin / np.sqrt(g_lin)
            g_fac += fac * fac
            m.factors -= RATE * fac / np.sqrt(g_fac)
    out = np.concatenate([[[m.bias] + [0.0] * RANK], np.concatenate([m.linear[:, None], m.factors], 1)])
    return pd.DataFrame({"field": np.arange(len(out)) - 1, "w": out.tolist()})


def fit(labelled: DataFrame) -> Machine:
    """Fit on (text, y) rows, a bounded sample whose features (at most about 25 KB a text) one task can hold.

    FIELDS rows of weights come to the driver.
    """
    rows = labelled.select(F.xxhash64("text").alias("mark"), "y", "text").mapInArrow(_sampled, "mark long, y int, f array<int>, v array<double>")
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_train, "field long, w array<double>").collect()
    m = Machine(0.0, np.zeros(FIELDS), np.zeros((FIELDS, RANK)))
    for r in found:
        if r["field"] < 0:
            m.bias = r["w"][0]
        else:
            m.linear[r["field"]], m.factors[r["field"]] = r["w"][0], r["w"][1:]
    return m


def _score(m: Machine) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(2), rows=4096):
                score = _sigmoid(m.logits(*features(data, off), hi - lo))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(score), pa.array((score >= KEEP).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, m: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text): the probability of label 1.

    Null and empty texts are scored by their length field and zero shares. Without labelled rows all scores are 0.5. Ids may be of any type.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(m), f"doc_id {id_type(docs)}, held_out boolean, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, y) of about ``sample`` labelled training documents, taken by a hash of the id; never over twice as many.

    Null labels and ids are left out; an id with several labels gives a row for each.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < share).select("doc_id", F.col("quality").cast("int").alias("y")).limit(2 * sample)
    # the limit bounds what is broadcast
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y").limit(2 * sample)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return score(docs, fit(training_rows(docs, labels)))
