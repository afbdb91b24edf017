"""Chat formatting of typed content parts.

A conversation is a series of turns, a turn a role and a list of parts: text,
image, audio or document. A visitor flattens the parts of a turn into one
string: texts are escaped, every attachment leaves a numbered placeholder, and
its reference, place and expanded token count are recorded. The template marks
turns; all control strings start with ``<|`` and end with ``|>``:

    <|turn|>ROLE<|body|>CONTENT<|end|>

Inside roles and texts a backslash becomes two and ``|`` becomes ``\\|``, so no
text, nor two texts side by side, make a control string, and each can be read
back exactly. The loss mask covers the texts of assistant turns only.

Turns are sorted within a conversation and stream through one task with a few
counters of state, so a conversation may be of any length; a result row is one
turn's segment of the formatted conversation, and the segments of a
conversation in order are its text.

Defined cases: a null role or text is an empty one; a null part, or a null list,
adds nothing; a part of another kind is an attachment of that kind that counts one token;
turns with equal numbers come by role, then content; a null turn comes first; rows repeated are
turns repeated; rows with a null conversation id are one conversation; a null
size, length or page count of an attachment counts as 1; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDER = re.compile(r"<\|([a-z]+):(\d+)\|>")
_ESCAPED = re.compile(r"\\([\\|])")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = ("conv long, position long, formatted string, char_start long, "
           "loss array<struct<start:long,end:long>>, "
           "attachments array<struct<number:long,kind:string,ref:string,char_start:long,n_tokens:long>>")
OUT = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Rates:
    """Tokens that a placeholder stands for: per image patch of so many pixels, per second of audio, per document page."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 576


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def content_parts(content: str) -> list[tuple[str, str]]:
    """Parts of a formatted turn's content, read back: ("text", text), or (kind, attachment number)."""
    out, at = [], 0
    for found in PLACEHOLDER.finditer(content):
        if found.start() > at:
            out.append(("text", unescape(content[at:found.start()])))
        out.append(found.groups())
        at = found.end()
    return out + [("text", unescape(content[at:]))] * (at < len(content))


@dataclass
class Flattener:
    """Visitor over the parts of one conversation: numbers attachments through all its turns."""

    rates: Rates
    chars: int = 0                      # formatted characters of the conversation so far
    number: int = 0                     # attachments so far
    out: list = field(default_factory=list)
    loss: list = field(default_factory=list)
    attachments: list = field(default_factory=list)

    def emit(self, piece: str) -> None:
        self.out.append(piece)
        self.chars += len(piece)

    def turn(self, role: str, parts: list) -> tuple[str, list, list]:
        """(formatted segment, loss spans, attachments) of one turn."""
        self.out, self.loss, self.attachments = [], [], []
        self.emit(TURN + escape(role) + BODY)
        for part in parts:
            if part is not None:
                getattr(self, f"visit_{part['kind']}", self.visit_other)(part, role == "assistant")
        self.emit(END)
        return "".join(self.out), self.loss, self.attachments

    def visit_text(self, part: dict, learn: bool) -> None:
        begin = self.chars
        self.emit(escape(part["text"] or ""))
        if learn and self.chars > begin:
            self.loss.append({"start": begin, "end": self.chars})

    def visit_image(self, part: dict, learn: bool) -> None:
        side = self.rates.patch
        self.attach(part, math.ceil(max(part["width"] or 1, 1) / side) * math.ceil(max(part["height"] or 1, 1) / side))

    def visit_audio(self, part: dict, learn: bool) -> None:
        seconds = 1.0 if part["seconds"] is None else part["seconds"]
        self.attach(part, max(1, math.ceil(seconds * self.rates.per_second)))

    def visit_document(self, part: dict, learn: bool) -> None:
        self.attach(part, max(part["pages"] or 1, 1) * self.rates.per_page)

    def visit_other(self, part: dict, learn: bool) -> None:
        self.attach(part, 1)

    def attach(self, part: dict, n_tokens: int) -> None:
        self.number += 1
        kind = re.sub("[^a-z]", "", (part["kind"] or "").lower()) or "other"
        self.attachments.append({"number": self.number, "kind": kind, "ref": part["ref"], "char_start": self.chars, "n_tokens": n_tokens})
        self.emit(f"<|{kind}:{self.number}|>")


def text_part(text: Column) -> Column:
    """A list with one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, parts: str) -> DataFrame:
    spark = turns.sparkSession
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "parts")


def _segments(batches: Iterator[pa.RecordBatch], rates: Rates) -> Iterator[tuple]:
    """(conv, position, formatted, char_start, loss, attachments) of rows (conv, turn, role, parts) in order."""
    now, position, own = object(), 0, Flattener(rates)
    for batch in batches:
        for conv, role, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if conv != now:
                now, position, own = conv, 0, Flattener(rates)
            begin = own.chars
            formatted, loss, attachments = own.turn(role, parts)
            yield conv, position, formatted, begin, loss, attachments
            position += 1


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", rates: Rates = Rates()) -> DataFrame:
    """One row per turn: its segment of the formatted conversation, with loss spans and attachments (places count from the conversation's start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(_segments(batches, rates)):
            yield pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, zip(*rows))), schema=_SCHEMA)

    return _ordered(turns, conv, turn, role, parts).mapInArrow(run, SEGMENT).withColumnRenamed("conv", conv)


def _grouped(rows: Iterator[tuple], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


_SCHEMA = pa.schema([("conv", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("char_start", pa.int64()),
                     ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     ("attachments", pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("char_start", pa.int64()), ("n_tokens", pa.int64())])))])


class Reader:
    """Reads one formatted conversation back, piece by piece, into digests of its turns and of the text under the loss mask."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def feed(self, piece: str, loss: list) -> None:
        """The next characters of the conversation, and the spans of them that the loss mask covers."""
        for span in loss:
            text = unescape(piece[span["start"] - self.chars:span["end"] - self.chars])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(piece)
        self.rest += piece
        *whole, self.rest = self.rest.split(END)
        for turn in whole:
            role, content = turn.removeprefix(TURN).split(BODY, 1)
            self.n_turns += 1
            self.turns.update(f"{unescape(role)}\n{unescape(content)}\n".encode())

    def row(self, conv) -> dict:
        return {"conv": [conv], "n_turns": [self.n_turns], "turns_sha256": [self.turns.hexdigest()], "loss_chars": [self.loss_chars],
                "loss_sha256": [self.loss.hexdigest()], "formatted_chars": [self.chars]}


_DIGEST = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", rates: Rates = Rates()) -> DataFrame:
    """Format conversations and read each back from its formatted text: turns, digests of turns and of the text under the loss mask, and lengths.

    The segments go to the reader as they are made, in the same task. A
    placeholder reads back as itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, done = None, None, []
        for found, _, formatted, _, loss, _ in _segments(batches, rates):
            if reader is None or found != now:
                if reader is not None:
                    done.append(reader.row(now))
                now, reader = found, Reader()
            reader.feed(formatted, loss)
            if len(done) == 4096:
                yield _rows(done)
                done = []
        if reader is not None:
            done.append(reader.row(now))
        if done:
            yield _rows(done)

    return _ordered(turns, conv, turn, role, parts).mapInArrow(run, OUT).withColumnRenamed("conv", conv)


def _rows(done: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: [x for r in done for x in r[c]] for c in _DIGEST.names}, schema=_DIGEST)
