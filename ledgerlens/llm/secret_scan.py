"""Secret scans (operator 3): credentials in whole texts, and in layers of encoding unwrapped until nothing new appears."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, table

#: Fixed patterns of the query's contract, in the order that breaks ties.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")

# one escape at a time, so that spans map to the very escape; bytes and surrogates that need each other stay together
_URL = re.compile(r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+")
_UNICODE = re.compile(r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}")
_ONE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")  # the shortest secret has 14 bytes
# readable bytes inside a decoded word, as long as the shortest secret, and heads of compressed data
_INSIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}")
_HEAD = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
# such bytes as text of two bytes a character, either byte first
_WIDE = re.compile(rb"(?:\x00[\t\r\n\x20-\x7e]){14,}|(?:[\t\r\n\x20-\x7e]\x00){14,}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(rb"[^A-Za-z0-9+/_=\s\x80-\xff-]")
_CONTINUED = bytes(range(0x80, 0xC0))

#: Bytes of a window of a decompressed text, of its overlap and of its end that is searched for a break; of a piece of decompression.
MAX_INFLATED, OVERLAP, TAIL, PIECE = 1 << 24, 1 << 16, 1 << 22, 1 << 20
DEEPEST = 100  #: compressions directly in each other, since one may hold itself; beyond, the row says incomplete

Span = tuple[int, int, int]  # start, kind's number, end


def secrets(text: str) -> list[Span]:
    """Leftmost matches that don't overlap, per kind; those that are too short are dropped after matching."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    return sorted(found)


class Layer:
    """A decoded text and where its characters come from: runs of (own start, original start, original end, per character).

    A run is copied text (each character maps to one of the original) or decoded text (it maps to the original whole).
    """

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]]):
        self.text, self.runs, self.starts = text, runs, [r[0] for r in runs]

    def key(self) -> tuple[bytes, tuple]:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), tuple(self.runs)

    def place(self, at: int) -> tuple[int, int]:
        own, lo, hi, copied = self.runs[bisect_right(self.starts, at) - 1]
        return (lo + at - own, lo + at - own + 1) if copied else (lo, hi)

    def origin(self, lo: int, hi: int) -> tuple[int, int]:
        return self.place(lo)[0], self.place(hi - 1)[1]

    def sub(self, lo: int, hi: int) -> list[tuple[int, int, int, bool]]:
        """Runs of self.text[lo:hi], own starts counted from lo."""
        first, last = bisect_right(self.starts, lo) - 1, bisect_right(self.starts, hi - 1)
        out = []
        for own, a, b, copied in self.runs[first:last]:
            begin = max(own, lo)
            out.append((begin - lo, a + begin - own if copied else a, b, copied))
        return out


def _url(m: re.Match) -> str | None:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _unicode(m: re.Match) -> str | None:
    codes = [int(next(filter(None, x)), 16) for x in _ONE.findall(m[0])]
    if any(c > 0x10FFFF for c in codes):
        return None
    try:
        return "".join(map(chr, codes)).encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every escape of one sort decoded; None if there is none."""
    parts, runs, at, last = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        said = decode(m)
        if said is None:
            continue
        if m.start() > last:
            runs += [(at + r[0], *r[1:]) for r in layer.sub(last, m.start())]
            parts.append(layer.text[last : m.start()])
            at += m.start() - last
        if said:
            runs.append((at, *layer.origin(m.start(), m.end()), False))
            parts.append(said)
            at += len(said)
        last = m.end()
    if not last:
        return None
    if last < len(layer.text):
        runs += [(at + r[0], *r[1:]) for r in layer.sub(last, len(layer.text))]
        parts.append(layer.text[last:])
    return Layer("".join(parts), runs)


def _packing(head: bytes) -> str:
    """The compression whose data begin so; zstd is known but not undone."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib"
    return "bz2" if re.match(rb"BZh[1-9]1AY&SY", head) else "xz" if head[:6] == b"\xfd7zXZ\x00" else "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else ""


#: How to undo each compression, and how a further member begins.
_UNDO = {"gzip": (lambda: zlib.decompressobj(31), b"\x1f"), "zlib": (lambda: zlib.decompressobj(15), None), "bz2": (bz2.BZ2Decompressor, b"BZh"), "xz": (lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), b"\xfd7zXZ")}


def _inflated(source: Iterator[bytes], packing: str, broken: list, more: list) -> Iterator[bytes]:
    """Decompressed pieces of all members; ``broken`` gets an entry if the data ends early, is wrong or of no known way to undo, ``more`` if other data follow."""
    if packing not in _UNDO:
        broken.append(True)
        return
    begin, again = _UNDO[packing]
    z = begin()
    for data in source:
        while data or not z.eof:
            if z.eof:
                if again is None or not data.startswith(again[: len(data)]):
                    more.append(True)  # what follows is no further member
                    return
                z = begin()
            try:
                out = z.decompress(data, PIECE)
            except (zlib.error, lzma.LZMAError, OSError):
                broken.append(True)
                return
            if out:
                yield out
            data = z.unused_data if z.eof else getattr(z, "unconsumed_tail", b"")
            if not data and len(out) < PIECE and getattr(z, "needs_input", True):
                break
    if not z.eof:
        broken.append(True)


def _unpacked(raw: bytes | memoryview) -> tuple[Iterator[bytes], list, int, list]:
    """Pieces of ``raw`` with every compression around it taken off, where that went wrong, the number of compressions, whether other data follow."""
    more: list = []
    source, broken, depth = (bytes(raw[k : k + PIECE]) for k in range(0, len(raw), PIECE)), [], 0
    while True:
        first = next(source, b"")
        packing = _packing(first)
        if not packing:
            return chain([first], source), broken, depth, more
        if depth == DEEPEST:
            broken.append(True)
            return iter(()), broken, depth, more
        taken, fails = [first], []

        def kept(source=source, taken=taken):
            yield taken[0]
            for piece in source:
                if taken:
                    taken.append(piece)
                yield piece

        inner = _inflated(kept(), packing, fails, [] if depth else more)
        out = next(inner, b"")
        if not out and fails and packing != "zstd":  # only looks like a compression
            return chain(taken, source), broken, depth, more
        taken.clear()
        broken, source, depth = _Both(broken, fails), chain([out], inner), depth + 1


class _Both:
    """The failures of all compressions around a text, as they become known."""

    def __init__(self, *lists):
        self.lists = lists

    def __bool__(self) -> bool:
        return any(self.lists)

    def append(self, x) -> None:
        self.lists[-1].append(x)


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """Readable texts of windows of about MAX_INFLATED bytes. Windows end outside encoded words and overlap."""
    held, limit = b"", MAX_INFLATED
    parts, size = [], 0
    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size <= limit:
            continue
        held, parts = b"".join(parts), []
        at = max(m.end() for m in _BREAK.finditer(held[-TAIL:])) + max(0, len(held) - TAIL) if _BREAK.search(held[-TAIL:]) else 0
        if not at:  # an encoded word without end is kept whole
            parts, limit = [held], 2 * size
            continue
        if said := _readable(held[:at]):
            yield said
        at = max(0, at - OVERLAP)
        while at < len(held) and held[at] & 0xC0 == 0x80:
            at += 1
        parts, size = [held[at:]], len(held) - at
        limit = size + MAX_INFLATED
    if said := _readable(b"".join(parts)):
        yield said


def _blocks(text: str) -> Iterator[tuple[int, int, list[tuple[int, str]]]]:
    """(start, end, lines (place, word)) of base64 that line breaks may divide: lines of one length and a shorter last one."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x[0]) for x in _LINE.finditer(text, m.start(), m.end())]
        ranges, k = {(0, len(lines)), (0, len(lines) - 1)}, 0
        while k < len(lines):
            end = k + 1
            while end < len(lines) and len(lines[end][1]) == len(lines[k][1]):
                end += 1
            ranges.add((k, end))
            if end < len(lines) and len(lines[end][1]) < len(lines[k][1]):
                ranges.add((k, end + 1))
            k = end
        for lo, hi in sorted(ranges):
            if hi - lo > 1:
                last = lines[hi - 1]
                yield lines[lo][0], m.end() if hi == len(lines) else last[0] + len(last[1]), lines[lo:hi]


def _bytes(word: str) -> bytes | None:
    word = word.rstrip("=").replace("-", "+").replace("_", "/")
    if len(word) % 4 == 1:
        return None
    try:
        return base64.b64decode(word + "=" * (-len(word) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


_MARKS = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}


def _wide(raw: bytes) -> str | None:
    """Text of two bytes a character: marked as such, or with a zero in every other byte of most."""
    if len(raw) < 4:
        return None
    zeros = [raw[k::2].count(0) for k in (0, 1)]
    marked = _MARKS.get(bytes(raw[:2]))
    kind = marked or ("utf-16-be" if zeros[0] > zeros[1] else "utf-16-le") if marked or max(zeros) >= 0.4 * (len(raw) // 2) else None
    return raw[: len(raw) // 2 * 2].decode(kind, "replace").removeprefix("\ufeff") if kind else None


def _readable(raw: bytes) -> str | None:
    clear = lambda text: text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = None
    if clear(text):
        return text
    text = _wide(raw)
    return text if clear(text) else None


def _runs(layer: Layer, raw: bytes, lo: int, hi: int, lines: list[tuple[int, str]]) -> list[tuple[int, int, int, bool]]:
    """Runs of the text of wrapped base64: by line where lines hold whole bytes, else the whole block."""
    if any(len(word) % 4 for _, word in lines[:-1]):
        return [(0, *layer.origin(lo, hi), False)]
    runs, at, own = [], 0, 0
    for k, (place, word) in enumerate(lines):
        piece = raw[at : at + len(word) // 4 * 3] if k + 1 < len(lines) else raw[at:]
        runs.append((own, *layer.origin(place, place + len(word) if k + 1 < len(lines) else hi), False))
        at += len(piece)
        own += len(piece.translate(None, _CONTINUED))
    return runs


def _embedded(layer: Layer, lo: int, hi: int, word: str, whole: bool) -> Iterator[Layer]:
    """Texts inside the base64 characters at lo..hi that begin anywhere, as behind a path or a word joined to them.

    The characters are decoded from each of the four offsets, on which the bytes depend, and readable runs and compressed
    data inside become layers. ``whole``: what begins with the word was taken already.
    """
    for skip in range(4):
        body = word[skip:].rstrip("=")
        raw = _bytes(body[: len(body) - (len(body) % 4 == 1)])
        if not raw:
            continue

        def origin(begin: int, end: int, skip=skip, raw=raw) -> tuple[int, int]:
            return layer.origin(lo + skip + begin * 8 // 6, hi if end == len(raw) else lo + skip - (-end * 8 // 6))

        view = memoryview(raw)
        for m in _HEAD.finditer(raw):
            if skip or m.start() or not whole:
                pieces, _, depth, _ = _unpacked(view[m.start() :])
                for said in _texts(pieces) if depth else ():
                    if len(said) >= 14:
                        yield Layer(said, [(0, *origin(m.start(), len(raw)), False)])
        for m in _WIDE.finditer(raw):
            yield Layer(m[0].replace(b"\x00", b"").decode(), [(0, *origin(*m.span()), False)])
        for m in _INSIDE.finditer(raw):
            if (skip or m.span() != (0, len(raw)) or not whole) and (said := _readable(m[0])):
                yield Layer(said, [(0, *origin(*m.span()), False)])


def _layers(layer: Layer, failed: list) -> Iterator[Layer]:
    """The layers of one way of decoding ``layer``, one at a time; ``failed`` gets an entry if some of it can't be decompressed."""
    if "%" in layer.text and (x := _rewritten(layer, _URL, _url)):
        yield x
    if "\\" in layer.text and (x := _rewritten(layer, _UNICODE, _unicode)):
        yield x
    whole = []  # places of wrapped words that were decompressed to their end
    wrapped = ((*x, True) for x in _blocks(layer.text)) if "\n" in layer.text else ()
    for lo, hi, lines, joined in chain(wrapped, ((m.start(), m.end(), [(m.start(), m[0])], False) for m in _BASE64.finditer(layer.text))):
        word = "".join(word for _, word in lines)
        raw = _bytes(word)
        if raw is None:
            if not joined:
                yield from _embedded(layer, lo, hi, word, False)
            continue
        said, wide = None, False
        pieces, broken, depth, more = _unpacked(raw)
        origin = layer.origin(lo, hi)
        if depth:
            for text in _texts(pieces):
                yield Layer(text, [(0, *origin, False)])
        if (not depth or broken) and (said := _readable(raw)):
            wide = len(said.encode("utf-8", "surrogatepass")) != len(raw)
            yield Layer(said, [(0, *origin, False)] if wide else _runs(layer, raw, lo, hi, lines))
        elif depth and not broken and joined:
            whole.append((lo, hi))
        elif depth and broken and not joined and not any(a <= lo and hi <= b for a, b in whole):
            failed.append(True)
        if not joined and (broken or more if depth else not said or wide and raw[:2] not in _MARKS):  # unmarked text of two bytes may begin at an odd one
            yield from _embedded(layer, lo, hi, lines[0][1], bool(depth))


def scan(text: str) -> tuple[list[Span], list[Span], int, bool]:
    """(base spans, all spans, decoded layers, complete) of one text.

    Stack of layers: each is scanned, and each way of decoding it gives further layers: %XX and \\u escapes rewrite
    the layer, base64 words (plain, of two bytes a character, or compressed inside, in one line or wrapped, or joined to other letters or signs of the
    alphabet) become layers of their own that map to the word's place. A layer text is taken once for each way it maps to the original, which ends cycles and finds every
    copy. Layers are counted by their distinct texts. Long decompressed texts are layers in windows, made one at a time.
    """
    base = secrets(text)
    found, texts, seen, failed = set(base), set(), set(), []
    stack = [iter([Layer(text, [(0, 0, len(text), True)])] if text else [])]
    while stack:
        layer = next(stack[-1], None)
        if layer is None:
            stack.pop()
            continue
        if not layer.text or layer.key() in seen:
            continue
        seen.add(layer.key())
        texts.add(layer.key()[0])
        if layer.text is not text:
            for lo, kind, hi in secrets(layer.text):
                a, b = layer.origin(lo, hi)
                found.add((a, kind, b))
        stack.append(_layers(layer, failed))
    return base, sorted(found), max(len(texts) - 1, 0), not failed


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "complete"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    for batch in batches:
        rows = []
        for value in batch.column(1):
            base, spans, layers, complete = scan(value.as_py() or "")
            rows.append((*[sum(k == x for _, k, _ in base) for x in range(3)], hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), layers, complete))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], ["doc_id", *names])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, complete), one row for each row of ``docs``.

    Offsets are code points, ends exclusive; a secret found in a decoded layer has the offsets of the encoded text that it
    came from. Null and empty texts have no spans. ``complete`` is false where compressed data (gzip, zlib, bz2, xz) end
    early or are damaged (they are scanned up to there), are packed over DEEPEST times, or are zstd, which isn't undone. Null ids and repeated rows are scanned like others.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scanned, f"doc_id {id_type(docs)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, complete boolean"
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
