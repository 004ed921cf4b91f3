"""SimHash near-dedup (operator 12): fingerprints that differ in few bits, found at the anchors of a covering code.

1. The fingerprint of a text: a bit is set if it is set in over half of the XXH64 hashes of its three-word shingles.
2. Anchors are the words of a covering code, the direct sum of short linear codes: every fingerprint has a home anchor within
   the covering radius (the sum of the short codes' radii), found by the short codes' syndromes.
3. If y differs from x in at most ``DIFFER`` bits, x's home is within the radius plus ``DIFFER`` of y; more closely, it is
   the home of a word that differs from y in at most ``DIFFER`` bits. Each distinct fingerprint is replicated to those
   anchors, so every pair meets at the home of each of its two.
4. Per anchor, the fingerprints at home there are compared with all. Only spanning edges leave a task. The code has more
   anchors the more fingerprints there are, so that anchors stay small.
5. An anchor of too many fingerprints (a large group of near copies) isn't compared pair by pair: its fingerprints meet at
   every word one bit off, as two that share such a word differ in at most two bits, and any two that do share one.
   That is linear in the group.
6. Classes are the connected components of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop_cut, id_type, small_batches, table
from .near_dup import _forest, _groups
from .words import Words, chunks

SHINGLE, DIFFER, SEED = 3, 2, 42
HOT = 1 << 15  #: fingerprints at an anchor that are still compared pair by pair
HASHED = 1 << 18  #: shingles hashed at once
AT_ONCE = 1 << 15  #: fingerprints that a task replicates, about
LONG = 256  #: bytes of a shingle that is hashed together with others

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _round(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(h + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte ranges (start, size) of ``data``, all at once; the few ranges of over ``LONG`` bytes go one by one."""
    out = np.empty(len(start), np.uint64)
    whole = data.tobytes() if len(size) and size.max() > LONG else b""
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(memoryview(whole)[start[i] : start[i] + size[i]], seed)
    order = np.flatnonzero(size <= LONG)
    order = order[np.argsort(-size[order], kind="stable")]  # rows that take the same step stand together
    at, size = start[order].copy(), size[order]
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # the eight bytes from each place on
    at_least = lambda n: int(np.searchsorted(-size, -n, "right"))
    h = np.full(len(order), (seed + int(_P5)) % (1 << 64), np.uint64)
    if many := at_least(32):
        lanes = [np.full(many, (seed + x) % (1 << 64), np.uint64) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        done = 0
        while part := at_least(done + 32):
            for k in range(4):
                lanes[k][:part] = _round(lanes[k][:part], word[at[:part] + 8 * k])
            at[:part] += 32
            done += 32
        mixed = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for lane in lanes:
            mixed = (mixed ^ _round(np.uint64(0), lane)) * _P1 + _P4
        h[:many] = mixed
    h += size.astype(np.uint64)
    rest = size % 32
    for _ in range(3):
        i = np.flatnonzero(rest >= 8)
        h[i] = _turn(h[i] ^ _round(np.uint64(0), word[at[i]]), 27) * _P1 + _P4
        at[i] += 8
        rest[i] -= 8
    i = np.flatnonzero(rest >= 4)
    h[i] = _turn(h[i] ^ ((word[at[i]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[i] += 4
    rest[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(rest >= 1)
        h[i] = _turn(h[i] ^ (raw[at[i]].astype(np.uint64) * _P5), 11) * _P1
        at[i] += 1
        rest[i] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[order] = h ^ (h >> np.uint64(32))
    return out


def _set_bits(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per run of hashes: how often each of the 64 bits is set. Eight counters ride in a word, over at most 255 hashes."""
    end = np.append(begin[1:], len(h))
    pieces = np.concatenate([np.arange(a, b, 255) for a, b in zip(begin, end, strict=True)]) if len(begin) else begin
    run = np.searchsorted(begin, pieces, "right") - 1
    counts = np.zeros((len(begin), 64), np.int64)
    for bit in range(8):
        part = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), pieces)
        np.add.at(counts[:, bit::8], run, part.view(np.uint8).reshape(len(pieces), 8))
    return counts


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts of a chunk, as uint64; 0 for a text without a word."""
    w, texts = Words(data, off), len(off) - 1
    n, size = np.bincount(w.doc, minlength=texts), w.end - w.start
    # the words once more, one space between them
    start = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOWER[data[w.data != 0]]
    windows = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    last, begin = np.cumsum(n), np.cumsum(windows) - windows
    counts = np.zeros((texts, 64), np.int64)
    doc = np.repeat(np.arange(texts), windows)
    for lo in range(0, len(doc), HASHED):
        d = doc[lo : lo + HASHED]
        a = (last - n)[d] + np.arange(lo, lo + len(d)) - begin[d]
        b = np.minimum(a + SHINGLE, last[d]) - 1
        h = xxh64(joined, start[a], start[b] + size[b] - start[a])
        runs = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        counts[d[runs]] += _set_bits(h, runs)
    return np.packbits(2 * counts > windows[:, None], axis=1, bitorder="little").view("<u8").ravel()


class Code:
    """The direct sum of short linear codes over the 64 bits of a word, each given by the syndromes of its single bits.

    ``home`` of a word: each part corrected by the lightest pattern of its syndrome. ``radius`` is the sum of the heaviest
    such patterns, so no word is farther from its home. ``anchors`` are 2 ** ``bits``.
    """

    def __init__(self, *parts: list[int]):
        assert sum(map(len, parts)) == 64
        self.parts, self.radius, self.bits = [], 0, 0
        self.columns = np.zeros(64, np.uint64)  # a bit's syndrome, those of all parts side by side
        low = shift = 0
        for columns in parts:
            checks = max(columns).bit_length()
            leader, heaviest = {0: 0}, 0
            while len(leader) < 1 << checks:
                heaviest += 1
                for some in combinations(range(len(columns)), heaviest):
                    syndrome = 0
                    for j in some:
                        syndrome ^= columns[j]
                    leader.setdefault(syndrome, sum(1 << (low + j) for j in some))
            self.columns[low : low + len(columns)] = np.array(columns, np.uint64) << np.uint64(shift if checks else 0)
            self.parts.append((np.uint64(shift), np.uint64((1 << checks) - 1), np.array([leader[k] for k in range(1 << checks)], np.uint64), range(low, low + len(columns))))
            self.radius, self.bits = self.radius + heaviest, self.bits + len(columns) - checks
            low, shift = low + len(columns), shift + checks
        byte = np.arange(256)
        self.table = np.zeros((8, 256), np.uint64)
        for j in range(64):
            self.table[j // 8] ^= np.where(byte >> (j % 8) & 1, self.columns[j], np.uint64(0))

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for k, column in enumerate(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8).T):
            out ^= self.table[k][column]
        return out

    def home(self, words: np.ndarray) -> np.ndarray:
        s, out = self.syndrome(words), words.copy()
        for shift, mask, leader, _ in self.parts:
            out ^= leader[(s >> shift) & mask]
        return out

    def around(self, words: np.ndarray) -> np.ndarray:
        """Per word a row of anchors, with repeats: first its home, then the homes of all words one and two bits off."""
        s, home = self.syndrome(words), self.home(words)
        off = np.zeros((64, len(words)), np.uint64)  # how the home moves when a bit flips; a flip moves it in one part only
        out = [home]
        twice = []
        for shift, mask, leader, bits in self.parts:
            own = leader[(s >> shift) & mask]
            moved = lambda flip, syndrome, own=own, shift=shift, mask=mask, leader=leader: np.uint64(flip) ^ own ^ leader[((s ^ syndrome) >> shift) & mask]
            for j in bits:
                off[j] = moved(1 << j, self.columns[j])
            twice += [moved(1 << i | 1 << j, self.columns[i] ^ self.columns[j]) for i, j in combinations(bits, 2)]
            for j in bits:
                out += [home ^ off[j]]
                twice += [off[i] ^ off[j] for i in range(bits.start)]
        return np.stack(out + [home ^ x for x in twice], axis=1)


def repetition(n: int) -> list[int]:
    """Bits all equal: the majority is at most (n - 1) / 2 away."""
    return [(1 << (n - 1)) - 1, *(1 << k for k in range(n - 1))] if n > 1 else [0]


def hamming(checks: int) -> list[int]:
    return list(range(1, 1 << checks))


def golay() -> list[int]:
    """The perfect code of 23 bits and radius 3: syndromes are the powers of x modulo x^11+x^10+x^6+x^5+x^4+x^2+1."""
    powers = [1]
    while len(powers) < 23:
        x = powers[-1] << 1
        powers.append(x ^ 0b110001110101 if x >> 11 else x)
    return powers


#: Codes of ever more anchors (2 to the power of 6, 10, 17, 26 and 36).
CODES = (
    lambda: Code(*map(repetition, (13, 11, 11, 11, 9, 9))),
    lambda: Code(*map(repetition, (7, 7, 7, 7, 7, 7, 7, 5, 5, 5))),
    lambda: Code(golay(), *map(repetition, (9, 9, 9, 7, 7))),
    lambda: Code(golay(), golay(), repetition(9), repetition(9)),
    lambda: Code(golay(), golay(), hamming(4), repetition(3)),
)
AT_ANCHOR = 1 << 9  #: fingerprints at home at an anchor on average, at most (with the last code: more)


def choose_code(count: int) -> int:
    """The first code with so many anchors for ``count`` fingerprints."""
    bits = (6, 10, 17, 26, 36)
    return next((k for k, b in enumerate(bits) if count <= AT_ANCHOR << b), len(bits) - 1)


def _replicate(batches: Iterator[pa.RecordBatch], code: int) -> Iterator[pa.RecordBatch]:
    """(anchor, fp, home) for the anchors at which each fingerprint is compared."""
    chosen = CODES[code]()
    for batch in batches:
        words = batch.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(words), 2048):
            some = words[lo : lo + 2048]
            near = chosen.around(some)
            home = near[:, 0].copy()
            near.sort(axis=1)
            new = np.ones(near.shape, bool)
            new[:, 1:] = near[:, 1:] != near[:, :-1]
            row, _ = np.nonzero(new)
            anchor = near[new]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(some[row].view(np.int64)), pa.array(anchor == home[row])], ["anchor", "fp", "home"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges per anchor: those at home there against all."""
    for batch in _groups(batches, 1):
        anchor, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            here, words = np.flatnonzero(home[lo:hi]), fp[lo:hi].view(np.uint64)
            if hi - lo < 2 or not len(here):
                continue
            pairs_i, pairs_j = [], []
            step = max(1, (1 << 20) // (hi - lo))
            for k in range(0, len(here), step):
                some = here[k : k + step]
                i, j = np.nonzero(np.bitwise_count(words[some][:, None] ^ words[None, :]) <= DIFFER)
                i = some[i]
                pairs_i.append(i[i != j])
                pairs_j.append(j[i != j])
                if sum(map(len, pairs_i)) > 1 << 22:  # many near copies: keep what spans them
                    label = _forest(np.concatenate(pairs_i), np.concatenate(pairs_j), hi - lo)
                    pairs_i, pairs_j = [np.flatnonzero(label != np.arange(hi - lo))], [label[label != np.arange(hi - lo)]]
            label = _forest(np.concatenate(pairs_i), np.concatenate(pairs_j), hi - lo)
            node = np.flatnonzero(label != np.arange(hi - lo))
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(fp[lo:hi][node]), pa.array(fp[lo:hi][label[node]])], ["a", "b"])


def _meeting(words: DataFrame) -> DataFrame:
    """Edges (a, b) of ``words`` (fp), distinct, by the words at most one bit off: linear, without comparing pairs."""
    keys = cut(words.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(64)])).alias("key")))
    least = cut(keys.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b"))
    edges = cut(keys.join(least, "key").where("fp != b").select(F.col("fp").alias("a"), "b").distinct())
    for old in (keys, least):
        drop_cut(old)
    return edges


def linked_fingerprints(words: DataFrame, code: int | None = None, hot: int = HOT) -> DataFrame:
    """(node, root): components of the distinct ``words`` (fp long) at ``DIFFER`` or fewer bits; lone words are absent.

    ``drop_cut`` deletes what the result reads.
    """
    words = cut(words.select("fp"))
    count = words.count()
    code = choose_code(count) if code is None else code
    spread = words.repartition(max(1, count // AT_ONCE))  # a fingerprint is small in a file, but makes many rows
    dealt = cut(spread.mapInArrow(lambda batches: _replicate(batches, code), "anchor long, fp long, home boolean"))
    sizes = cut(dealt.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"))
    cold, more = dealt, None
    if not sizes.isEmpty():
        cold = dealt.join(sizes, "anchor", "left_anti")
        more = _meeting(dealt.join(sizes, "anchor", "left_semi").select("fp").distinct())
    edges = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long").distinct()
    found = components(edges.unionByName(more) if more else edges, "a", "b")
    for old in filter(None, (words, dealt, sizes, more)):
        drop_cut(old)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Words are split at blanks, A-Z lower-cased; a text of fewer words than a shingle is one shingle; null, empty and blank
    texts have fingerprint zero, linked like any other. component_id is the least doc_id of the rows whose fingerprints
    are reachable; rows without a doc_id link like others but name no component (a component of such rows has a null
    one). Rows that repeat a doc_id each have their own fingerprint. doc_id may be of any ordered type.
    """
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for lo, hi, data, off in chunks(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(fingerprints(data, off).view(np.int64))], ["doc_id", "fp"])

    signed = cut(docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {id_type(docs)}, fp long"))
    words = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = linked_fingerprints(words)
    rooted = words.join(linked, words["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written out, so that the join back is between plain shuffles and a hot fingerprint's rows can be split
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"))
    for old in (linked, words):
        drop_cut(old)
    out = signed.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
