"""Language ID (operator 4): nearest of several clustered centroids per language, over normalised TF-IDF of letter n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, held_out, id_type, table
from .words import chunks, code_points

DIMS = 4096  #: hashed n-grams
ORDERS = (1, 2, 3)
CLUSTERS = 4  #: centroids per language
SAMPLE = 1500  #: labelled texts per language that centroids are fitted on, about; a hash of id and text chooses them
SLACK = 1.25  #: a text is rejected beyond this many times the distance that covers a centroid's own sample
ROWS = 512  #: texts in one dense block
BROADCAST_ROWS = 10_000  #: languages whose sampling shares are broadcast


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter; 0 for what isn't a letter."""
    return np.array([ord(low) if (c := chr(i)).isalpha() and len(low := c.lower()) == 1 else i if c.isalpha() else 0 for i in range(0x33480)], np.int64)


def counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIMS) counts of letter n-grams within and at the edges of words; number of letters of each text."""
    n = len(off) - 1
    codes, at = code_points(data, off)
    table_ = _letters()
    c = table_[np.minimum(codes, len(table_) - 1)] * (codes < len(table_))
    doc = np.repeat(np.arange(n), np.diff(at))
    found = np.zeros(n * DIMS)
    h = np.zeros(len(c), np.uint64)
    for k in range(max(ORDERS)):
        m = len(c) - k
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B1) + c[k:].astype(np.uint64) + np.uint64(1)
        if k + 1 not in ORDERS:
            continue
        ok = (doc[:m] == doc[k:]) & ((c[:m] > 0) | (c[k:] > 0))
        slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        found += np.bincount(doc[:m][ok] * DIMS + slot[ok], minlength=n * DIMS)
    return found.reshape(n, DIMS), np.bincount(doc, weights=c > 0, minlength=n)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(found) * idf).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    radius: np.ndarray  # the distance that covers 99.5 % of the centroid's sample


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for lo, hi, data, off in chunks(batch.column(0), rows=ROWS):
            total += (counts(data, off)[0] > 0).sum(0)
            n += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, n))], ["slot", "n"])


def _sampled(idf: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of the sampled texts, of one size whatever the texts' length."""
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(2), rows=ROWS):
                x = vectors(counts(data, off)[0], idf)
                rows = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * DIMS, x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), rows], ["lang", "mark", "x"])

    return run


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means of one language's sample, started from spread-out texts."""
    pdf = pdf.sort_values("mark")
    x = np.stack(pdf["x"].to_list())
    seeds = [x.sum(0)]
    for _ in range(CLUSTERS - 1):
        best = np.max([x @ (s / max(np.linalg.norm(s), 1e-9)) for s in seeds], 0)
        seeds.append(x[int(np.argmin(best))])
    cent = np.stack(seeds)
    for _ in range(12):
        cent = cent / np.maximum(np.linalg.norm(cent, axis=1, keepdims=True), 1e-9)
        own = (x @ cent.T).argmax(1)
        cent = np.stack([x[own == k].sum(0) if (own == k).any() else cent[k] for k in range(len(cent))])
    cent = cent / np.maximum(np.linalg.norm(cent, axis=1, keepdims=True), 1e-9)
    near = x @ cent.T
    own = near.argmax(1)
    rows = [(pdf["lang"].iloc[0], cent[k].tolist(), float(np.quantile(1 - near[own == k, k], 0.995))) for k in range(len(cent)) if (own == k).any()]
    return pd.DataFrame(rows, columns=["lang", "centroid", "radius"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text, lang). Document frequencies count every row; centroids are fitted per language on a sample.

    The sample takes rows by a hash threshold, about ``sample`` of each language, each (id, text) once, and turns them into
    vectors of DIMS numbers before they are gathered: a fitting task holds about ``sample`` * 16 KB, however long the
    texts are. What comes to the driver: DIMS counts, and CLUSTERS centroids of 16 KB for each language there is.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    df = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    total = df.get(DIMS, 0)
    idf = np.log((1 + total) / (1 + np.array([df.get(k, 0) for k in range(DIMS)]))) + 0.1
    share = cut(rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")))
    few = share.count() <= BROADCAST_ROWS  # else a shuffle join, though so many languages hardly exist
    marked = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    at = F.pmod(F.col("mark"), F.lit(1 << 20)) / float(1 << 20)
    taken = marked.join(F.broadcast(share) if few else share, "lang").where(at < F.col("share")).select("lang", "mark", "text")
    seen = taken.mapInArrow(_sampled(idf), "lang string, mark long, x array<float>").dropDuplicates(["lang", "mark"])
    found = sorted(seen.groupBy("lang").applyInPandas(_cluster, "lang string, centroid array<float>, radius double").collect(), key=lambda r: (r["lang"], r["centroid"]))
    drop_cut(share)
    return Model(idf, [r["lang"] for r in found], np.array([r["centroid"] for r in found], np.float32).reshape(-1, DIMS), np.array([r["radius"] for r in found]))


def _predict(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(2), rows=ROWS):
                found, letters = counts(data, off)
                if len(model.langs):
                    near = vectors(found, model.idf) @ model.centroids.T
                    k = near.argmax(1)
                    score = np.clip(near[np.arange(len(k)), k].astype(float), 0, 1)
                    lang = np.array(model.langs, object)[k]
                    far = 1 - score > SLACK * model.radius[k]
                else:
                    score, lang, far = np.zeros(hi - lo), np.full(hi - lo, "und", object), np.ones(hi - lo, bool)
                none = letters == 0
                lang[none], score[none], far[none] = "und", 0.0, True
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text).

    lang_pred is the language of the centroid with the largest cosine, which is the score; ties go to the first language
    by name. ``rejected`` says that the text is farther from that centroid than its training texts (SLACK). Null texts
    and texts without a letter, and every text if nothing was learned, are 'und' with score 0. Ids may be of any type.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_predict(model), f"doc_id {id_type(docs)}, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), fit(docs.where(~held_out(F.col("doc_id")))))
