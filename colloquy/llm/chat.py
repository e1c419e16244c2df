"""Chat formatting: typed content parts, flattened by a visitor into one control-safe string a turn.

A turn is conv_id, turn, role and ``content``, an array of typed parts: text, image (width, height), audio (seconds)
or document (pages), the last three with a reference. The visitor writes text escaped and other parts as placeholders
in their order, and records the attachment references and the tokens they expand to.

Template: ``<|turn|>`` role newline body ``<|end|>`` newline. Inside roles and texts a backslash is doubled, a newline
of a role is written backslash n, and every control string gets a backslash after its first character; reading takes
any backslash with the character behind it as that character. So no text can form a control string, and unescaping
gives the text back exactly.

Turns are formatted row by row. Reading back streams the turns of a conversation in order through digests, so a task
holds one Arrow batch however long a conversation is.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
TURN, END = "<|turn|>", "<|end|>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
CONTENT = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = "conv_id long, turn long, role string, formatted string, loss array<struct<start:int,length:int>>, attachments array<string>, expanded_tokens long"
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_PART = re.compile(r"<\|(image|audio|document)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Flattens the parts of one turn."""

    def __init__(self):
        self.out, self.at, self.spans, self.refs, self.tokens = [], 0, [], [], 0

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown part type {kind!r}")
        getattr(self, kind)(part)

    def text(self, part: dict) -> None:
        s = escape(part.get("text") or "")
        if s:
            self.spans.append((self.at, len(s)))
        self.write(s)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.write(f"<|{kind}|>")
        self.refs.append(part.get("ref") or "")
        self.tokens += tokens

    def image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)


def format_one(role: str | None, content: list[dict] | None) -> tuple[str, list[tuple[int, int]], list[str], int]:
    """(formatted turn, loss spans, attachment references, expanded tokens)."""
    v = Visitor()
    v.write(TURN + escape(role or "").replace("\n", "\\n") + "\n")
    for part in content or []:
        if part is not None:
            v.visit(part)
    v.write(END + "\n")
    return "".join(v.out), v.spans if role == "assistant" else [], v.refs, v.tokens


def parse_one(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders of other parts are left out of the text."""
    if not (formatted.startswith(TURN) and formatted.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    head, _, body = formatted[len(TURN) : -len(END) - 1].partition("\n")
    role = _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], head)
    return role, unescape(_PART.sub("", body))


def text_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and content of rows whose text is their only part (null: empty)."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.array(part).alias("content"))


def _parts(batches, rows: int = 256, nbytes: int = 4 << 20):
    """Slices of at most so many rows and about so many bytes (one row at least), so that what is formatted at once stays
    small beside its batch."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, rows)
            while some.num_rows > 1 and some.nbytes > nbytes:
                some = batch.slice(at, some.num_rows // 2)
            yield some
            at += some.num_rows


def _format(batches):
    for batch in _parts(batches):
        done = [format_one(r, c) for r, c in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist(), strict=True)]
        spans = pa.array([[{"start": a, "length": n} for a, n in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
        cols = [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([d[0] for d in done], pa.string()), spans, pa.array([d[2] for d in done], pa.list_(pa.string())), pa.array([d[3] for d in done], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "role", "formatted", "loss", "attachments", "expanded_tokens"])


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted row for each turn (conv_id, turn, role, content); a conversation is its rows' strings in turn order.

    A null role is empty; null content, parts and texts are empty; only an assistant's texts are under the loss mask.
    """
    ship(turns.sparkSession)
    return turns.select("conv_id", "turn", "role", F.col("content").cast(CONTENT).alias("content")).mapInArrow(_format, FORMATTED)


BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _back(batches):
    now, state = object(), None

    def row():
        n, all_, chars, loss, size = state
        return (now, n, all_.hexdigest(), chars, loss.hexdigest(), size)

    def emit(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in BACK.split(", ")])

    for batch in _parts(batches):
        out = []
        for conv, s, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            if state is None or conv != now:
                if state is not None:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_one(s)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in spans:
                heard = unescape(s[span["start"] : span["start"] + span["length"]])
                state[2] += len(heard)
                state[3].update(heard.encode("utf-8", "surrogatepass"))
            state[4] += len(s)
        if out:
            yield emit(out)
    if state is not None:
        yield emit([row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted turns alone.

    Turns stand by number, null first; turns of equal number by their formatted strings. Rows with a null conv_id form
    one conversation of that id. Equal rows count each.
    """
    ship(formatted.sparkSession)
    rows = formatted.select("conv_id", "turn", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return rows.mapInArrow(_back, BACK)


def oracle() -> str:
    """The contract's columns in DuckDB SQL."""
    esc = "replace({}, '\\', '\\\\')"
    for c in CONTROL:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id::bigint as conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
       sum({len(TURN) + len(END) + 2} + length(replace({esc.format("role")}, chr(10), '\\n')) + length({esc.format("text")}))::bigint as formatted_chars
from rows group by conv_id
"""
