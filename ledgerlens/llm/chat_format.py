"""Chat formatting (operator 2): schema fingerprints select declarative mappings to canonical turns; a reversible template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, table


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either ``each`` names an array whose elements hold ``role`` and ``text``, or the record itself is one turn
    (``each`` is ''), or ``fixed`` lists (role, paths whose values are joined by a blank line).
    ``paths`` are the layout's field paths; those in ``optional`` may be missing.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Layouts in public use. A new layout is one more entry.
MAPPINGS = (
    Mapping("turn_row", ("role", "text"), each="", role="role", text="text"),
    Mapping("turn_row_content", ("role", "content"), each="", role="role", text="content"),
    Mapping("messages", ("messages[].role", "messages[].content"), ("id", "system", "tools", "messages[].name"), "messages", "role", "content", (("system", ("system",)),)),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("id", "system"), "conversations", "from", "value", (("system", ("system",)),)),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_completion", ("prompt", "completion"), ("id", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("id", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("question", "answer"), ("context", "id"), fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
)

#: Role names of other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a record: 'a.b' for objects, 'a[]' for arrays; a leaf ends a path."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()]) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*[field_paths(v, at + "[]") for v in value]) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


@lru_cache(maxsize=1)
def known() -> dict[str, Mapping]:
    """Mappings by fingerprint, one for each choice of the optional paths."""
    out = {}
    for m in MAPPINGS:
        for n in range(len(m.optional) + 1):
            for some in combinations(m.optional, n):
                out[fingerprint({*m.paths, *some})] = m
    return out


def _value(record: dict, name: str) -> str | None:
    v = record.get(name)
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def turns_of(m: Mapping, record: dict) -> list[tuple[str, str]]:
    out = []
    for role, names in m.fixed:
        parts = [v for v in (_value(record, n) for n in names) if v]
        if parts or (role != "system" and m.each is None):
            out.append((role, "\n\n".join(parts)))
    if m.each is not None:
        for x in [record] if m.each == "" else record[m.each]:
            role = _value(x, m.role) or ""
            out.append((ROLES.get(role, role), _value(x, m.text) or ""))
    return out


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for k, payload in enumerate(batch.column(2).to_pylist()):
            try:
                record = json.loads(payload or "null", strict=False)
            except ValueError:
                record = None
            mark = fingerprint(field_paths(record)) if isinstance(record, dict) else ""
            m = known().get(mark)
            for sub, (role, text) in enumerate(turns_of(m, record) if m else [(None, None)]):
                for col, v in zip(rows, (k, sub, role, text, mark, m.name if m else None), strict=True):
                    col.append(v)
        at = pa.array(rows[0], pa.int64())
        rest = [pa.array(v, t) for v, t in zip(rows[1:], (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *rest], ["conv_id", "turn", "sub", "role", "text", "fingerprint", "layout"])


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, sub, role, text, fingerprint, layout) from (conv_id, turn, payload), payload being a JSON object.

    A record gives one row per turn, ``sub`` numbering them. Null texts and roles become ''. A payload that is null, no
    object, or of an unknown layout gives one row with null role, text and layout, which ``formatted`` keeps count of. conv_id may
    be of any type that can be sorted.
    """
    return records.select("conv_id", F.col("turn").cast("long"), "payload").mapInArrow(
        _canonical, f"conv_id {id_type(records, 'conv_id')}, turn long, sub long, role string, text string, fingerprint string, layout string"
    )


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that steer chat templates in public use. A backslash after the first character disarms them in a text.
_CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>|<(?:pad|unk|bos|eos|mask)>|</?(?:start|end)_of_turn>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One formatted segment per turn, with the place of its trained text in the conversation's formatted text."""
    now, at = object(), 0
    for batch in batches:
        lo, hi, out, unknown = [], [], [], []
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            now, at = (now, at) if conv == now else (conv, 0)
            unknown.append(int(role is None))
            if role is None:
                lo, hi, out = [*lo, None], [*hi, None], [*out, ""]
                continue
            head, body = f"{OPEN}{quote(role or '', safe='')}\n", escape(text or "")
            trained = role == "assistant"
            lo.append(at + len(head) if trained else None)
            hi.append(at + len(head) + len(body) if trained else None)
            out.append(head + body + CLOSE)
            at += len(out[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(unknown, pa.int64())], ["conv_id", "segment", "loss_from", "loss_to", "unknown"])


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, loss_from, loss_to, unknown): the formatted text of each conversation, one segment a turn, in order.

    Rows come dealt by conversation and sorted by turn, then sub, role and text (so ties have one order); segments are
    streamed, so a conversation of any length needs the memory of one batch. Texts may hold any string: control strings
    are escaped and ``unescape`` restores them. loss_from and loss_to are the mask's code point offsets in the whole
    conversation; only assistant texts are trained on. A null conv_id is one conversation.
    A record of no known layout is an empty segment whose ``unknown`` is 1 (else 0), so that it can be counted.
    """
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "sub", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_segments, f"conv_id {id_type(turns, 'conv_id')}, segment string, loss_from long, loss_to long, unknown long")


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    now, state = none, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_unknown"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def row() -> tuple:
        n, turns, chars, loss, total, unknown = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), total, unknown

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for batch in batches:
        types[0] = batch.schema.field(0).type
        done = []
        for conv, segment, lo, hi, unknown in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            if now is none or conv != now:
                if state:
                    done.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            state[5] += unknown
            for m in _TURN.finditer(segment):
                role, text = unquote(m[1]), unescape(m[2])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if lo is not None:
                text = unescape(segment[lo - state[4] : hi - state[4]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(segment)
        if done:
            yield batch_of(done)
    if state:
        yield batch_of([row()])


def digests(segments: DataFrame) -> DataFrame:
    """Read the formatted text back: per conversation its turns' digest and the digest of the text under the loss mask, and its records of unknown layout."""
    return segments.mapInArrow(_digests, f"conv_id {id_type(segments, 'conv_id')}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unknown long")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast(id_type(own, "conv_id")).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    rows = own.unionByName(more)
    payload = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    return digests(formatted(canonical_turns(rows.select("conv_id", "turn", payload.alias("payload")))))


_ESCAPED = r"regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>|pad>|unk>|bos>|eos>|mask>|/?start_of_turn>|/?end_of_turn>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"

OP2_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + 1 + len(CLOSE)} + length(role) + length({_ESCAPED})) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_unknown
FROM said GROUP BY conv_id
"""
