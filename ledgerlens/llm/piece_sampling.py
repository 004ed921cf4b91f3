"""SentencePiece encoding and decoding (operator 8): segmentations sampled from the piece lattice, decoded without loss.

A text is a space followed by its characters, spaces standing for the piece marker. No piece reaches from a word into
the next space, and within a word the lattice falls apart wherever no piece crosses a gap, so it is a row of independent
parts. Each distinct word of a chunk is filtered forward once, all parts at once, and every occurrence is sampled backward
with random numbers that are hashes of (seed, row key, part number, gap). Results don't depend on partitions or batches.
Parts of over ``LONG`` characters are walked one by one, in time linear in their length. A character without a piece, and
the marker character itself, become byte pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, table
from .words import chunks, code_points, mix

MODEL = "piece_bpe_32k.model"
TEMPERATURE, SEED = 1.0, 20240501
CHUNK = 1 << 18  #: bytes of text whose lattices are in memory at once, unless one text is longer
LONG = 2048
_MARK, _LITERAL_MARK = 0x2581, 0x110001
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_FILTER = 20


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def _rolling(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over characters, and the inverse powers that align its differences."""
    power = np.full(len(codes) + 1, _P, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(len(codes) + 1, _P_INV, np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(77)) * power[:-1], out=sums[1:])
    return sums, inverse


class Pieces:
    """A piece vocabulary: lookup by hash, log weights, byte pieces, and the bytes of each piece."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = np.zeros(256, np.int32)
        raw = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte[value] = i
                raw[i] = bytes([value])
        for i in plain:
            raw[i] = sp.id_to_piece(i).replace("▁", " ").encode()
        # A rank among the pieces gives a Zipf weight; BPE scores are ranks, not probabilities.
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        total = np.log(np.sum(1 / (np.arange(len(plain)) + 2.7)))
        self.weight = np.zeros(size)
        for i, r in rank.items():
            self.weight[i] = -temperature * (np.log(r + 2.7) + total)
        self.byte_weight = -temperature * (np.log(2.0 * len(plain)) + total)
        self.longest = max(len(sp.id_to_piece(i)) for i in plain)
        keys, longer = np.zeros(len(plain), np.uint64), []
        for k, i in enumerate(plain):
            sums = _rolling(np.array([ord(c) for c in sp.id_to_piece(i)], np.int64))[0]
            keys[k] = sums[-1]
            longer.append(sums[1:-1])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int32)[order]
        # by the upper bits of a hash: 1 for a piece, 2 for the beginning of a longer piece
        self.maybe = np.zeros(1 << _FILTER, np.uint8)
        self.maybe[(self.keys >> np.uint64(64 - _FILTER)).view(np.int64)] |= 1
        self.maybe[(np.concatenate(longer) >> np.uint64(64 - _FILTER)).view(np.int64)] |= 2
        self.raw_at = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes of the hashes that are pieces, those pieces' ids, and which hashes may begin longer pieces."""
        maybe = self.maybe[(h >> np.uint64(64 - _FILTER)).view(np.int64)]
        at = np.flatnonzero(maybe & 1)
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[place] == h[at]
        return at[hit], self.ids[place[hit]], maybe > 1


@lru_cache(maxsize=4)
def pieces(path: str, temperature: float) -> Pieces:
    return Pieces(path, temperature)


def _characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text that isn't empty led by a space; offsets of the texts."""
    codes, before = code_points(data, off)
    codes = codes.astype(np.int64)
    full = np.diff(before) > 0
    codes = np.insert(codes, before[:-1][full], 32)
    return codes, before + np.concatenate([[0], np.cumsum(full)])


def _edge_order(level: np.ndarray, dst: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order by level, then gap, longer pieces first. One packed integer where its bits hold all, which is faster."""
    if not len(dst) or (int(level.max()) < 1 << 21 and int(dst.max()) < 1 << 37 and int(length.max()) < 1 << 5):
        return np.argsort((level << 42) + (dst << 5) - length)
    return np.lexsort((-length, dst, level))


def _filter_long(alpha: np.ndarray, total_of: np.ndarray, parts: np.ndarray, src: np.ndarray, dst: np.ndarray, val: np.ndarray, new: np.ndarray, begin: int) -> None:
    """Forward filtering of the edges from ``begin`` on, which lie in few long parts: plain floats, gap after gap."""
    heads = np.flatnonzero(new[begin:]) + begin
    known = alpha.tolist()
    s, v, to = src[begin:].tolist(), val[begin:].tolist(), dst[heads].tolist()
    inner = (~parts[dst[heads]]).tolist()
    ends = [*(heads[1:] - begin).tolist(), len(s)]
    totals, lo = [], 0
    for g, hi, goes_on in zip(to, ends, inner, strict=True):
        if hi - lo == 1:
            t = known[s[lo]] + v[lo]
        else:
            each = [known[s[j]] + v[j] for j in range(lo, hi)]
            most = max(each)
            t = most + log(sum([exp(x - most) for x in each]))
        totals.append(t)
        if goes_on:
            known[g] = t
        lo = hi
    total_of[dst[heads]] = totals
    alpha[dst[heads]] = np.where(parts[dst[heads]], 0.0, totals)


def sample_ids(p: Pieces, data: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, and offsets of the texts. keys: 64 bits for each text."""
    n_docs = len(off) - 1
    codes, at = _characters(data, off)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
    codes = np.where(codes == _MARK, _LITERAL_MARK, codes)
    codes[codes == 32] = _MARK
    space = codes == _MARK
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    sums, inverse = _rolling(codes)
    doc = np.searchsorted(at, start, "right") - 1
    coded = pc.dictionary_encode(pa.array(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))))
    word = coded.indices.to_numpy().astype(np.int64)
    which = np.zeros(len(coded.dictionary), np.int64)
    which[word[::-1]] = np.arange(len(word))[::-1]  # first occurrences

    # distinct words, one after the other
    size = (end - start)[which]
    base = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(np.arange(len(which)), size)
    place = np.arange(base[-1]) - base[own]
    c = codes[start[which][own] + place]
    sums, inverse = _rolling(c)

    # edges of the lattice: (from, to, piece); to and from number gaps, a word having one more gap than characters
    src, dst, ids, val = [], [], [], []
    room = size[own] - place
    live = np.arange(len(c))
    for k in range(1, min(p.longest, int(size.max())) + 1):
        found, piece, more = p.find((sums[live + k] - sums[live]) * inverse[live])
        where = live[found]
        live = live[more & (room[live] > k)]
        src.append(where + own[where])
        dst.append(where + own[where] + k)
        ids.append(piece)
        val.append(p.weight[piece])
        if k == 1:
            bare = np.ones(len(c), bool)
            bare[where] = False
            bare = np.flatnonzero(bare)
            ch = np.where(c[bare] == _LITERAL_MARK, _MARK, c[bare])
            src.append(bare + own[bare])
            dst.append(bare + own[bare] + 1)
            ids.append((-1 - ch).astype(np.int32))
            val.append(p.byte_weight * (1 + (ch >= 0x80) + (ch >= 0x800) + (ch >= 0x10000)))
    src, dst, ids, val = (np.concatenate(x) for x in (src, dst, ids, val))
    gaps = base[-1] + len(which)
    # gaps that no edge crosses part the lattice; the first gap of a word and the last are among them
    edge = np.flatnonzero(np.cumsum(np.bincount(src + 1, minlength=gaps + 1) - np.bincount(dst, minlength=gaps + 1))[:gaps] == 0)
    parts = np.zeros(gaps, bool)
    parts[edge] = True
    at_edge = np.cumsum(parts) - 1  # the last edge at or before each gap
    level = np.arange(gaps) - edge[at_edge]
    level[edge] = np.diff(edge, prepend=edge[0])  # a part ends at its last gap
    order = _edge_order(level[dst], dst, dst - src)
    src, dst, ids, val = src[order], dst[order], ids[order], val[order]
    at_level = level[dst]
    new = np.ones(len(dst), bool)
    new[1:] = dst[1:] != dst[:-1]
    group = np.cumsum(new) - 1

    # forward filtering, all parts at once, gap by gap; beyond LONG one gap after the other
    alpha = np.zeros(gaps)
    total_of = np.zeros(gaps)
    last = min(int(level[dst].max()), LONG)
    cuts = np.searchsorted(at_level, np.arange(1, last + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        v = alpha[src[lo:hi]] + val[lo:hi]
        heads = np.flatnonzero(new[lo:hi])
        to = dst[lo:hi][heads]
        total_of[to] = np.logaddexp.reduceat(v, heads)
        alpha[to] = np.where(parts[to], 0.0, total_of[to])
    if cuts[-1] < len(dst):
        _filter_long(alpha, total_of, parts, src, dst, val, new, int(cuts[-1]))
    prob = np.exp(alpha[src] + val - total_of[dst])
    total = np.cumsum(prob)
    heads = np.flatnonzero(new)
    floor = np.where(heads > 0, total[heads - 1], 0.0)
    top = total[np.append(heads[1:] - 1, len(total) - 1)] - floor
    cdf = (total - floor[group]) / top[group]
    cdf[np.append(heads[1:], len(dst)) - 1] = 2.0
    head_of = np.zeros(gaps, np.int64)
    head_of[dst[heads]] = heads

    # backward sampling of every part of every occurrence
    n_parts = at_edge[base[1:] + np.arange(len(which))] - at_edge[base[:-1] + np.arange(len(which))]
    times = n_parts[word]
    begin_edge = at_edge[base[:-1] + np.arange(len(which))][word]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    ends_at = np.repeat(begin_edge, times) + nth + 1
    bottom, gap = edge[ends_at - 1], edge[ends_at]
    doc = np.repeat(doc, times)
    number = (np.arange(len(gap)) - np.searchsorted(doc, doc)).astype(np.uint64)
    seed = mix(keys[doc] + mix(number))

    def pick(unit: np.ndarray, gap: np.ndarray) -> np.ndarray:
        u = (mix(seed[unit] + _P * (gap - bottom[unit]).astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        e = head_of[gap]
        past = np.flatnonzero(cdf[e] <= u)
        while len(past):
            e[past] += 1
            past = past[cdf[e[past]] <= u[past]]
        return e

    far = gap - bottom > LONG
    live = np.flatnonzero(~far)
    gap_of = gap[live]
    picked, of, nth_step, step = [], [], [], 0
    while len(live):
        e = pick(live, gap_of)
        picked.append(ids[e])
        of.append(live)
        nth_step.append(np.full(len(live), step))
        gap_of = src[e]
        on = gap_of != bottom[live]
        live, gap_of = live[on], gap_of[on]
        step += 1
    for unit in np.flatnonzero(far):
        inner = np.arange(bottom[unit] + 1, gap[unit] + 1)
        e = np.zeros(gap[unit] - bottom[unit] + 1, np.int64)
        e[inner - bottom[unit]] = pick(np.full(len(inner), unit), inner)
        back, chain, g = (src[e] - bottom[unit]).tolist(), [], int(gap[unit] - bottom[unit])
        while g:
            chain.append(g)
            g = back[g]
        picked.append(ids[e[chain]])
        of.append(np.full(len(chain), unit))
        nth_step.append(np.arange(len(chain)))
    picked, of, steps = (np.concatenate(x) for x in (picked, of, nth_step))
    count = np.bincount(of, minlength=len(bottom))
    out = np.zeros(len(picked), np.int64)
    out[np.cumsum(count)[of] - 1 - steps] = picked  # sampled from the end of a part
    doc_of = np.repeat(doc, count)
    width = np.ones(len(out), np.int64)
    bare = np.flatnonzero(out < 0)
    if len(bare):
        width[bare] = 1 + (-1 - out[bare] >= 0x80) + (-1 - out[bare] >= 0x800) + (-1 - out[bare] >= 0x10000)
        spread = np.repeat(out, width)
        raw = np.frombuffer((-1 - out[bare]).astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        spread[np.repeat(out < 0, width)] = p.byte[raw]
        out = spread
    return out.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(doc_of, weights=width, minlength=n_docs).astype(np.int64))])


def _encode(path: str, temperature: float, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path, temperature)
        for batch in batches:
            keys = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, data, off in chunks(batch.column(2), CHUNK):
                ids, ends = sample_ids(p, data, off, mix(keys[lo:hi] + np.uint64(seed)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(ends.astype(np.int32), ids)], ["doc_id", "text", "piece_ids"])

    return run


def _decode(path: str, temperature: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path, temperature)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(part.num_columns - 1)
                flat = lists.flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                width = (p.raw_at[1:] - p.raw_at[:-1])[flat]
                stop = np.concatenate([[0], np.cumsum(width)])
                out = p.raw[np.repeat(p.raw_at[flat] - stop[:-1], width) + np.arange(stop[-1])]
                off = stop[ends]
                keep = np.ones(len(out), bool)
                keep[off[:-1][np.diff(off) > 0]] = False  # the leading space that encoding added
                off = off - np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
                text = pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(out[keep].tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "decoded"])

    return run


def _row_key(docs: DataFrame) -> Column:
    """64 bits of the id: whole numbers as they are, other types hashed."""
    whole = id_type(docs) in ("tinyint", "smallint", "int", "bigint")
    return F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))


def encode(docs: DataFrame, model: str | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(doc_id, text, piece_ids): one sampled segmentation of each row's text, fixed by (seed, doc_id).

    Null and empty texts have no pieces; a null doc_id samples as id 0; repeated rows sample alike. Ids may be of any type.
    ``model`` is a path that every executor can read.
    """
    rows = docs.select("doc_id", _row_key(docs).alias("key"), "text")
    return rows.mapInArrow(_encode(model or default_model(), temperature, seed), f"doc_id {id_type(docs)}, text string, piece_ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` (any columns, the last being piece_ids) plus ``decoded``, equal to the text that was encoded ('' for null)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(model or default_model(), TEMPERATURE), f"{fields}, decoded string")


def encoded_rows(docs: DataFrame, model: str | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, lossless), lossless being the comparison of the decoded text with the whole text.

    Encoding and decoding run one after the other in one Python worker per task; two steps would need two.
    """
    path = model or default_model()
    forth, back = _encode(path, temperature, seed), _decode(path, temperature)
    rows = docs.select("doc_id", _row_key(docs).alias("key"), "text").mapInArrow(lambda batches: back(forth(batches)), f"doc_id {id_type(docs)}, text string, piece_ids array<int>, decoded string")
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("lossless"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
