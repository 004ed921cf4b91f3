"""N-gram Jaccard join (operator 9): chosen-path search for texts whose five-word shingles are alike.

1. Every text becomes a class (equal word sequences, A-Z lower-cased) with a signature of minimum hashes: coordinate c is
   a token of the set sampled by the c-th hash function, so two sets share it with probability equal to their similarity.
2. Chosen path: each run starts from the root and splits the sets on one shared sampled token; a large bucket is split
   again on two further tokens, chosen by a hash of its path, as long as that pays. To see that, one bit of each of
   ``MEASURED`` coordinates is summed over the bucket: the sums lean to one side by the share p of sets that agree.
   Comparing a bucket of B sets costs each of them B; after a split a share p is in each of two buckets of p * B, and
   splitting costs about as much as ``SMALL`` comparisons, so it pays if B * (1 - 2 * p^2) > SMALL. Small buckets, near
   copies, and what is left after ``DEPTH`` splits (its sets share as many sampled tokens) are compared pair by pair, large
   ones block by block. The number of runs follows from the target recall at the deepest split, as if runs drew apart. They
   draw from the same COORDS coordinates, so the recall of a pair at the threshold is 0.999996 where no bucket is split and
   0.99956 after eight splits; pairs more alike are found more surely.
3. Pairs whose signatures agree on ``agreeing()`` coordinates connect candidate clusters; only spanning edges leave a task.
4. Within clusters all pairs are verified exactly on whole shingle sets, block by block; a task returns per text its
   number of links and a spanning edge, never the pairs.
5. Classes of the result are the connected components of the exact links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop_cut, id_type, small_batches, table
from .words import Words, chunks, mix

SHINGLE, SIMILAR = 5, 0.8
COORDS = 64  #: sampled tokens per set
SMALL, BLOCK, DEPTH, BRANCH = 2048, 1024, 8, 2
MEASURED = 16  #: coordinates on which the agreement within a bucket is measured
TARGET_RECALL = 0.99999
BLOCK_SHINGLES = 1 << 19  #: shingles in one block of verification, about

_A = np.random.default_rng(7).integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(8).integers(1, 1 << 63, COORDS, dtype=np.uint64)


def runs_needed(similar: float = SIMILAR, target: float = TARGET_RECALL) -> int:
    """Runs until a pair at the threshold is found with the target probability, each run reaching the deepest split."""
    once = similar * (1 - (1 - similar) ** BRANCH) ** DEPTH
    return math.ceil(math.log(1 - target) / math.log(1 - once))


def agreeing(similar: float = SIMILAR, target: float = TARGET_RECALL) -> int:
    """Coordinates on which the signatures of a pair at the threshold agree with the target probability."""
    below = 0.0
    for k in range(COORDS + 1):
        below += math.comb(COORDS, k) * similar**k * (1 - similar) ** (COORDS - k)
        if below > 1 - target:
            return k
    return COORDS


def _shingles(w: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle; a text of fewer words than a shingle is one shingle."""
    at, h = w.windows(SHINGLE)
    doc = w.doc[at]
    counts = np.bincount(w.doc, minlength=n_docs)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        begin = np.searchsorted(w.doc, short)
        key = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            key[has] = mix(key[has] * np.uint64(31) + w.hash[begin[has] + k])
        place = np.searchsorted(doc, short)
        doc, h = np.insert(doc, place, short), np.insert(h, place, key)
    return doc, h


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle, sorted."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _keys(w: Words, n_docs: int) -> np.ndarray:
    """128 bits of each text's word sequence."""
    rank = np.arange(len(w.hash), dtype=np.uint64) - np.searchsorted(w.doc, w.doc).astype(np.uint64)
    out = np.zeros((n_docs, 2), np.uint64)
    full, begin = np.unique(w.doc, return_index=True)
    if len(full):
        for k, salt in enumerate((0x51ED270B, 0xC2B2AE3D)):
            term = mix(w.hash + mix(rank + np.uint64(salt << 20)))
            out[full, k] = mix(np.add.reduceat(term, begin))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks, texts = batch.columns
        for lo, hi, data, off in chunks(texts):
            w = Words(data, off)
            doc, h = _distinct(*_shingles(w, hi - lo))
            sig = np.zeros((hi - lo, COORDS), np.int32)
            full, begin = np.unique(doc, return_index=True)
            if len(full):
                for c in range(COORDS):
                    sig[full, c] = (np.minimum.reduceat(h * _A[c] + _B[c], begin) >> np.uint64(20)).astype(np.uint32).view(np.int32)
            key = pa.Array.from_buffers(pa.binary(16), hi - lo, [None, pa.py_buffer(_keys(w, hi - lo).tobytes())]).cast(pa.binary())
            n = np.bincount(doc, minlength=hi - lo)
            sigs = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * COORDS, sig.ravel())
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), marks.slice(lo, hi - lo), key, pa.array(n.astype(np.int64)), sigs], ["doc_id", "t", "key", "n", "sig"])


def _forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Least member of each node's component under the links i-j."""
    label = np.arange(size)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        # down to the roots before a link is dropped: else a node could leave the root that it shares with its partner
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches that end where a group of the first ``n_keys`` columns ends; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in range(n_keys)]
        same = np.ones(batch.num_rows, bool)
        for k in range(n_keys):
            same &= np.asarray(pc.equal(batch.column(k), last[k]))
        begin = int(np.argmax(same))  # the last group starts here
        if begin == 0 and held and all(held[-1].column(k)[held[-1].num_rows - 1] == last[k] for k in range(n_keys)):
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, begin)]).combine_chunks()
        yield from whole.to_batches()
        held = [batch.slice(begin)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs in each bucket whose sizes and signatures allow the similarity."""
    least = agreeing()
    for batch in _groups(batches, 3):
        path, b1, b2, side, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        sig = batch.column(5).flatten().to_numpy().reshape(len(path), COORDS)
        keys = batch.column(6)
        within = b1 == b2
        pairs_i, pairs_j = [], []
        i = np.arange(len(path))
        d = 0
        while True:
            d += 1
            i = i[i + d < len(path)]
            i = i[(path[i] == path[i + d]) & (b1[i] == b1[i + d]) & (b2[i] == b2[i + d])]
            if not len(i):
                break
            c = i[within[i] | (side[i] != side[i + d])]
            c = c[np.minimum(n[c], n[c + d]) >= SIMILAR * np.maximum(n[c], n[c + d]) - 1e-9]
            c = c[(sig[c] == sig[c + d]).sum(1) >= least]
            pairs_i.append(c)
            pairs_j.append(c + d)
        if pairs_i:
            label = _forest(np.concatenate(pairs_i), np.concatenate(pairs_j), len(path))
            node = np.flatnonzero(label != np.arange(len(path)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(node)), keys.take(pa.array(label[node]))], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted distinct shingles of each text, for rows whose text has the expected key; copies in a task only once."""
    seen: set[bytes] = set()
    for batch in batches:
        texts, wanted, rest = batch.column(0), batch.column(1), batch.select(batch.schema.names[1:])
        for lo, hi, data, off in chunks(texts):
            w = Words(data, off)
            doc, h = _distinct(*_shingles(w, hi - lo))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]).astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(h.tobytes())])
            found = _keys(w, hi - lo).tobytes()
            ok = []
            for k in range(hi - lo):
                key = found[16 * k : 16 * k + 16]
                ok.append(key == wanted[lo + k].as_py() and key not in seen)
                if ok[-1]:
                    seen.add(key)
            part = rest.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, packed], [*part.schema.names, "set"]).filter(pa.array(ok))


def _links(sets: list[np.ndarray], side: np.ndarray, within: bool) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity of at least SIMILAR, exact; only pairs across sides unless within."""
    count = len(sets)
    size = np.array([len(s) for s in sets])
    tokens, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(count), size)
    often = np.bincount(of)[of] > 1  # a token of one text adds to no intersection
    tokens, of = np.unique(of[often], return_inverse=True)
    row = row[often]
    left = np.arange(count) if within else np.flatnonzero(side == side.min())
    right = np.arange(count) if within else np.flatnonzero(side != side.min())
    shared = np.zeros((len(left), len(right)), np.float32)
    step = max(256, (1 << 22) // max(1, count))
    order = np.argsort(of, kind="stable")
    of, row = of[order], row[order]
    for lo in range(0, len(tokens), step):
        a, b = np.searchsorted(of, [lo, lo + step])
        has = np.zeros((count, min(step, len(tokens) - lo)), np.float32)
        has[row[a:b], of[a:b] - lo] = 1
        shared += has[left] @ has[right].T
    linked = np.zeros((count, count), bool)
    union = size[left][:, None] + size[right][None, :] - shared
    linked[np.ix_(left, right)] = shared >= SIMILAR * union - 1e-6
    linked |= linked.T
    np.fill_diagonal(linked, False)
    return linked


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group (cluster, two blocks): each text's linked weight and the root of its component within the group."""
    for batch in _groups(batches, 3):
        cluster, keys, blobs = batch.column(0), batch.column(5).to_pylist(), batch.column(6)
        b1, b2, side, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
        code = pc.dictionary_encode(cluster).indices.to_numpy()
        change = np.flatnonzero((code[1:] != code[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])) + 1
        out: tuple[list, list, list] = ([], [], [])
        for lo, hi in zip([0, *change], [*change, len(code)], strict=True):
            at = [k for j, k in enumerate(range(lo, hi)) if keys[k] not in keys[lo:k]] if hi - lo < 64 else list({keys[k]: k for k in range(lo, hi)}.values())
            if len(at) < 2 or (b1[lo] != b2[lo] and len({int(x) for x in side[at]}) < 2):
                continue
            linked = _links([np.frombuffer(blobs[k].as_py(), np.uint64) for k in at], side[at], b1[lo] == b2[lo])
            label = _forest(*np.nonzero(np.triu(linked)), len(at))
            for k in np.flatnonzero(linked.any(1)):
                out[0].append(keys[at[k]])
                out[1].append(int(weight[at][linked[k]].sum()))
                out[2].append(keys[at[label[k]]])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["key", "links", "root"])


def _blocks(rows: DataFrame, blocks: str, salt: str) -> DataFrame:
    """Deal a group's rows to every pair of its blocks: b1 <= b2, side being the row's own block."""
    own = F.pmod(F.xxhash64("key", salt), F.col(blocks)).cast("int")
    d = rows.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return d.withColumns({"b1": F.least("side", "other"), "b2": F.greatest("side", "other")})


def candidates(sets: DataFrame) -> list[DataFrame]:
    """Cuts of (a, b): spanning edges between the keys of ``sets`` (key, n, sig) that chosen-path search finds alike."""
    some = [k * COORDS // MEASURED for k in range(MEASURED)]
    bits = reduce(Column.bitwiseOR, [F.shiftleft(F.col("sig")[c].bitwiseAND(1), k) for k, c in enumerate(some)])
    leaning = [F.abs(2 * F.sum(F.shiftright("bits", k).bitwiseAND(1)) / F.count("*") - 1) for k in range(MEASURED)]
    roots = F.array(*[F.xxhash64(F.lit(r), F.col("sig")[r % COORDS]) for r in range(runs_needed())])
    level = sets.select("key", bits.alias("bits"), F.explode(roots).alias("path"))
    found, held = [], None
    for depth in range(DEPTH + 1):
        here = cut(level) if depth else level
        # sizes are written out, so that the join is between plain shuffles and a hot path's rows can be split
        alike = reduce(Column.__add__, leaning) / MEASURED
        sizes = cut(here.groupBy("path").agg(F.count("*").alias("size"), alike.alias("alike")).where("size > 1"))
        level = cut(here.join(sizes, "path"))
        for old in (here if depth else None, sizes, held):
            if old is not None:
                drop_cut(old)
        held, last = level, depth == DEPTH
        deeper = F.lit(False) if last else F.col("size") * (1 - BRANCH * F.col("alike") * F.col("alike")) > SMALL
        rows = _blocks(level.where(~deeper).withColumn("g", F.ceil(F.col("size") / BLOCK)).join(sets, "key"), "g", "path")
        found.append(cut(rows.select("path", "b1", "b2", "side", "n", "sig", "key").repartition("path", "b1", "b2").sortWithinPartitions("path", "b1", "b2").mapInArrow(_brute, "a binary, b binary").distinct()))
        if last or level.where(deeper).isEmpty():
            break
        pick = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(COORDS)).cast("int")
        split = F.array(*[F.xxhash64("path", F.lit(k), F.get("sig", pick(k))) for k in range(BRANCH)])
        level = level.where(deeper).join(sets.select("key", "sig"), "key").select("key", "bits", F.explode(split).alias("path"))
    drop_cut(held)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id, text).

    Words are split at blanks, A-Z lower-cased; texts are linked if the Jaccard similarity of their sets of 5-word
    shingles is 0.8 or more (a text of one to four words is one shingle; equal word sequences are linked as copies).
    class_id is the least doc_id of the connected component, n_links the number of other rows linked to this one.
    Null, empty and blank texts link to nothing and form their own class. Rows with a null doc_id link like others, each
    being a row; they never name a class, so a class of such rows only has a null class_id. Rows that repeat a doc_id count
    as rows. doc_id may be of any ordered type. The files that the result reads stay in the shared folder.
    """
    small_batches(docs.sparkSession)
    kind = id_type(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    signed = cut(rows.mapInArrow(_sign, f"doc_id {kind}, t long, key binary, n long, sig array<int>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t", "n", "sig"))
    classes = cut(signed.where("n > 0").groupBy("key").agg(first.alias("f"), F.count("*").alias("weight")).select("key", F.col("f.doc_id").alias("rep"), "f.t", "f.n", "f.sig", "weight"))
    edges = candidates(classes.select("key", "n", "sig"))
    near = components(reduce(DataFrame.unionByName, edges), "a", "b")
    clusters = cut(near)
    for old in (*edges, near):
        drop_cut(old)
    members = clusters.join(classes.select("key", "rep", "t", "n", "weight"), clusters["node"] == classes["key"]).select("key", "rep", F.col("t").alias("mark"), "n", "weight", F.col("root").alias("cluster"))
    load = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(F.col("c") / (BLOCK // 2), F.col("s") / BLOCK_SHINGLES, F.lit(1)))
    members = members.join(load.select("cluster", blocks.alias("g")), "cluster")
    # a row is found again by its text's hash and its id, null or not
    texts = rows.join(members, (F.col("t") == F.col("mark")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    whole = texts.select("text", "key", "cluster", "g", "weight").mapInArrow(_sets, "key binary, cluster binary, g long, weight long, set binary")
    dealt = _blocks(whole, "g", "cluster").select("cluster", "b1", "b2", "side", "weight", "key", "set")
    checked = cut(dealt.repartition("cluster", "b1", "b2").sortWithinPartitions("cluster", "b1", "b2").mapInArrow(_verify, "key binary, links long, root binary"))
    drop_cut(clusters)
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    linked = components(checked, "key", "root").withColumnRenamed("node", "key")
    c = classes.select("key", "rep", "weight").join(links, "key", "left").join(linked, "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = c.join(c.groupBy("root").agg(F.min("rep").alias("class_id")), "root").where("n_links > 0").select("key", "class_id", "n_links")
    out = signed.select("doc_id", "key").join(named, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the least doc_id. Rows that repeat id and text are one; null ids all stay."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("doc_id = class_id").select(F.col("doc_id").alias("__kept")).distinct()
    unique = docs.where("doc_id IS NOT NULL").join(kept, docs["doc_id"] == kept["__kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return unique.unionByName(docs.where("doc_id IS NULL"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
