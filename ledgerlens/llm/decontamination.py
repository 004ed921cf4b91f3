"""Benchmark decontamination (operator 1): windows of word templates and of words, joined by hash, with a slot consistency check."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_type, table
from .words import PLAIN, Words, chunks, mix

WINDOW = 8  #: template words in a window; items of 4 to 7 words are one window each
SHORTEST = 4  #: shorter items are looked for as whole documents
LITERALS, LITERALS_SHORT = 3, 2  #: literal words that a template window needs, and one of a short item
COVERED, LONG_RUN = 0.5, 13  #: a document holds an item if it covers this share of its windows, or so many windows (20 words)
LEAST_BITS, MOST_BITS = 24, 27  #: the filter of benchmark windows has 2^24 (2 MB) to 2^27 (16 MB) bits, about 16 a window

#: Units that follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l gal s sec min h hr hrs ms day days week weeks month months year years "
    "hour hours minute minutes second seconds meter meters metre metres kilometer kilometers mile miles inch inches foot feet "
    "gram grams kilogram kilograms liter liters litre litres pound pounds ounce ounces dollar dollars euro euros cent cents percent "
    "degree degrees hz khz mhz ghz v kv w kw mw j kj n pa kpa mol k c f b kb mb gb tb"
).split()


def _hash_of(words: list[str]) -> np.ndarray:
    texts = pa.array(words)
    return np.concatenate([Words(data, off, PLAIN).hash for _, _, data, off in chunks(texts)])


_UNIT = np.sort(_hash_of(UNITS))
_LITERAL = 0x11E4A1 << 8
_NUMBER_SLOT, _UNIT_SLOT, _NAME_SLOT = (np.uint64(x) for x in (0xA11CE5, 0xB0B5, 0xCAFE77))


def _templates(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words without punctuation, A-Z lower-cased; their template hashes; which of them are slots.

    Slots: words that begin with a digit (number), unit words right after a number (unit), and words of an upper-case
    letter and a lower-case rest that don't begin a sentence (name).
    """
    w = Words(data, off, PLAIN)
    n = len(w.hash)
    if not n:
        return w, w.hash, np.zeros(0, bool)
    first = w.data[w.start]
    number = (first >= 48) & (first <= 57)
    after = np.zeros(n, bool)
    after[1:] = number[:-1] & (w.doc[1:] == w.doc[:-1])
    unit = after & (_UNIT[np.minimum(np.searchsorted(_UNIT, w.hash), len(_UNIT) - 1)] == w.hash)
    begin, last = w.source[w.start], w.source[w.end - 1]
    stops = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:\n", np.uint8)))])
    sentence = np.ones(n, bool)
    sentence[1:] = (w.doc[1:] != w.doc[:-1]) | (stops[begin[1:]] > stops[last[:-1]])
    second = data[np.minimum(w.source[np.minimum(w.start + 1, len(w.source) - 1)], len(data) - 1)]
    capital = (data[begin] >= 65) & (data[begin] <= 90) & (w.end - w.start > 1) & ((second >= 97) & (second <= 122) | (second >= 128))
    name = capital & ~sentence
    t = w.hash.copy()
    t[number], t[unit], t[name] = _NUMBER_SLOT, _UNIT_SLOT, _NAME_SLOT
    return w, t, number | unit | name


def _windows(w: Words, t: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows that have enough literal words."""
    literal, w.hash = w.hash, t
    at, h = w.windows(size)
    w.hash = literal
    slots = np.concatenate([[0], np.cumsum(slot)])
    ok = slots[at + size] - slots[at] <= size - (LITERALS if size == WINDOW else LITERALS_SHORT)
    return at[ok], mix(h[ok] + np.uint64(size))


def _literal_windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all windows as they stand, in lower case; other hashes than those of templates."""
    at, h = w.windows(size)
    return at, mix(h + np.uint64(_LITERAL + size))


def _rows(ids: pa.Array, w: Words, slot: tuple[np.ndarray, int] | None, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """(id, pos, h, slots): slots are the hashes of the words that fill the window's slots, in order; null in literal windows."""
    size = len(at)
    if slot is None:
        slots = pa.nulls(size, pa.list_(pa.int64()))
    else:
        where, words = slot
        lo, hi = np.searchsorted(where, at), np.searchsorted(where, at + words)
        ends = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)
        slots = pa.ListArray.from_arrays(ends, w.hash[where[np.repeat(lo - ends[:-1], hi - lo) + np.arange(ends[-1])]].view(np.int64))
    pos = at - np.searchsorted(w.doc, w.doc[at])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(w.doc[at])), pa.array(pos), pa.array(h.view(np.int64)), slots], ["id", "pos", "h", "slots"])


def _both(w: Words, t: np.ndarray, slot: np.ndarray, size: int) -> Iterator[tuple[tuple | None, np.ndarray, np.ndarray]]:
    """Template windows with (places of slots, size), then literal windows with None: (slots, first word, hash).

    Windows below ``SHORTEST`` are literal only, and only whole texts.
    """
    if size >= SHORTEST:
        yield (np.flatnonzero(slot), size), *_windows(w, t, slot, size)
    at, h = _literal_windows(w, size)
    if size < SHORTEST:
        whole = np.bincount(w.doc, minlength=1)[w.doc[at]] == size
        at, h = at[whole], h[whole]
    yield None, at, h


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in chunks(batch.column(1)):
            w, t, slot = _templates(data, off)
            words = np.bincount(w.doc, minlength=hi - lo)
            ids = batch.column(0).slice(lo, hi - lo)
            for size in range(1, WINDOW + 1):
                total = np.zeros(hi - lo, np.int64)
                for places, at, h in _both(w, t, slot, size):
                    fits = words[w.doc[at]] == size if size < WINDOW else np.ones(len(at), bool)
                    at, h = at[fits], h[fits]
                    total = np.bincount(w.doc[at], minlength=hi - lo) if places else total
                    rows = _rows(ids, w, places, at, h)
                    for name, value in (("total", total[w.doc[at]]), ("every", words[w.doc[at]] - size + 1), ("size", np.full(len(at), size, np.int64))):
                        rows = rows.append_column(name, pa.array(value))
                    yield rows


def _doc_windows(bits: np.ndarray | None, log_bits: int, sizes: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                w, t, slot = _templates(data, off)
                for size in sizes:
                    for places, at, h in _both(w, t, slot, size):
                        if bits is not None:
                            k = (h >> np.uint64(64 - log_bits)).astype(np.int64)
                            maybe = (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
                            at, h = at[maybe], h[maybe]
                        if len(at):
                            yield _rows(batch.column(0).slice(lo, hi - lo), w, places, at, h)

    return run


def _filter(items: DataFrame) -> tuple[np.ndarray | None, int]:
    """Bit filter of the windows' hashes and the logarithm of its size; None if so many windows would fill the largest one."""
    n = items.count()
    log_bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(n, 1)))))
    if n > 1 << (MOST_BITS - 2):
        return None, log_bits
    # at most 2^21 words of 64 bits come to the driver
    cell = F.shiftrightunsigned("h", 64 - log_bits)
    words = items.groupBy(F.shiftright(cell, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - log_bits}) & 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(1 << (log_bits - 6), np.int64)
    bits[words.column("k").to_numpy()] = words.column("v").to_numpy()
    return bits.view(np.uint8), log_bits


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per occurrence the item positions of its windows that count: sure, literal and likely ones (see ``contaminated``)."""
    for batch in batches:
        sure, literal, likely, own = [], [], [], []
        for windows in batch.column(2).to_pylist():
            equal = {w["pos"] for w in windows if w["slots"] == w["filled"]}
            windows = [w for w in windows if w["slots"] is not None]
            said: dict[int, Counter] = defaultdict(Counter)
            for w in windows:
                for a, b in zip(w["slots"], w["filled"], strict=True):
                    said[a][b] += 1
            whole = all(len(c) == 1 for c in said.values())
            best = {a: max(c, key=lambda b: (c[b], b == a, b)) for a, c in said.items()}
            follow = {w["pos"] for w in windows if all(best[a] == b for a, b in zip(w["slots"], w["filled"], strict=True))}
            sure.append(sorted(follow) if whole else [])
            literal.append(sorted(equal))
            likely.append(sorted(max(follow, equal, key=len)))
            own.append(whole and all(a in c for a, c in said.items()))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (sure, literal, likely)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], *lists, pa.array(own, pa.bool_())], ["doc_id", "item_id", "total", "every", "sure", "literal", "likely", "own"])


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, t, item_id, n_windows, coverage, kind) for each text that holds a benchmark item, t being the text's hash.

    docs: (doc_id, text), benchmark: (item_id, text). Windows of 8 template words of every document are tested against a
    bit filter of bounded size made from all benchmark windows, and the few that pass are joined to the benchmark windows
    by hash, whatever their number. Matches that lie on one diagonal (document position less item position) are one
    occurrence. If its slots are consistent (equal fillings in the item stay equal in the document) all its windows are
    sure, and an item counts as held if half its windows, or 13 windows, are. In an inconsistent occurrence the windows
    whose fillings are the item's own are literal, and those that follow the most frequent filling of each slot value, or
    the literal ones if they are more, are likely: the item is held if sure and literal windows are more than half, or if
    sure and likely ones are 13. kind is 'exact' if every filling is the item's own, else 'reparameterised'.

    Every window is also hashed as it stands with A-Z lower-cased, whatever its slots, and is literal where that matches:
    so copies of items full of numbers or names, and copies in another case, are found. Items of 4 to 7 words are one
    window. Items of 1 to 3 words, which ordinary texts hold by chance, are held by documents of just those words.
    Not found: copies that change the case of letters beyond A-Z; re-parameterised copies in another case, and those of
    windows with fewer than 3 literal words (2 in items below 8 words).

    Null and empty texts hold nothing; an empty benchmark gives no row. Every row is judged by itself, whether its doc_id is
    its own, another row's too, or null; rows alike in id and text are one. Ids may be of any type that groups.
    """
    docs = docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text")
    doc_kind, item_kind = id_type(docs), id_type(benchmark, "item_id")
    items = cut(benchmark.select("item_id", "text").mapInArrow(_item_windows, f"id {item_kind}, pos long, h long, slots array<long>, total long, every long, size long"))
    bits, log_bits = _filter(items)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    found = docs.select("doc_id", "text").mapInArrow(_doc_windows(bits, log_bits, sizes), f"id {doc_kind}, pos long, h long, slots array<long>")
    pairs = found.select(F.col("id").alias("doc_id"), F.col("pos").alias("at"), "h", F.col("slots").alias("filled")).join(items, "h")
    occurrence = pairs.groupBy("doc_id", F.col("id").alias("item_id"), (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.collect_set(F.struct("pos", "slots", "filled")).alias("windows"), F.max("total").alias("total"), F.max("every").alias("every")
    )
    judged = occurrence.select("doc_id", "item_id", "windows", "total", "every").mapInArrow(_judge, f"doc_id {doc_kind}, item_id {item_kind}, total long, every long, sure array<long>, literal array<long>, likely array<long>, own boolean")
    union = lambda *cs: F.size(F.array_distinct(F.flatten(F.concat(*[F.collect_set(c) for c in cs])))).cast("long")
    counts = judged.groupBy("doc_id", "item_id").agg(
        union("sure").alias("n_sure"), union("sure", "literal").alias("n_known"), union("sure", "likely").alias("n_likely"),
        F.max("total").alias("total"), F.max("every").alias("every"), F.bool_and(F.when(F.size("sure") > 0, F.col("own"))).alias("sure_own"), F.bool_and("own").alias("own"),
    )
    surely = (F.col("n_sure") > 0) & ((F.col("n_sure") >= COVERED * F.col("total")) | (F.col("n_sure") >= LONG_RUN))
    held = counts.where(surely | (F.col("n_known") > COVERED * F.col("every")) | (F.greatest("n_known", "n_likely") >= LONG_RUN))
    n = F.when(surely, F.col("n_sure")).otherwise(F.greatest("n_known", "n_likely"))
    own = F.when(surely, F.col("sure_own")).otherwise(F.col("own"))
    return held.select("doc_id.doc_id", "doc_id.t", "item_id", n.alias("n_windows"), (n / F.when(surely, F.col("total")).otherwise(F.col("every"))).alias("coverage"), F.when(own, "exact").otherwise("reparameterised").alias("kind"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, kind): ``contaminated_rows`` by id; of several rows of an id the one that holds most of the item."""
    most = F.max(F.struct("n_windows", "coverage", "kind")).alias("m")
    return contaminated_rows(docs, benchmark).groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, rows without a doc_id among them."""
    bad = contaminated_rows(docs, benchmark).select(F.col("doc_id").alias("__bad"), F.col("t").alias("__t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs["text"]) == bad["__t"]), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
