"""Chat formatting over typed content parts.

A visitor flattens the text, image, audio and document parts of each turn, in order, into one
string with numbered placeholders, and records what each placeholder stands for and how many tokens
it expands to. The template marks turns; control strings inside texts and roles are escaped by a
backslash, and every backslash is doubled, so parsing gives back the exact texts.

Edge cases: null text is empty; a null role is empty; an unknown part type raises; rows of one turn
are ordered by role, then parts, and repeated rows are turns of their own; a null turn comes first; rows
without a conv_id are one conversation; very long texts are formatted whole (a conversation is one row of
the output and must fit a task); a conversation without rows has no output; columns other than conv_id,
turn, role and text (or parts) are not read, so names cannot clash; an empty table is empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that this or another common template gives a meaning.
CONTROL = (START, BODY, END, "<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(re.escape(x) for x in sorted(["\\", *CONTROL], key=len, reverse=True)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """A backslash goes after each backslash and after the first character of a control string."""

    def mark(m: re.Match) -> str:
        s = m[0]
        return s[0] + "\\" + s[1:]

    return _ESCAPE.sub(mark, text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flattened:
    """What a visit has written: the text, the spans under the loss mask, and the attachments."""

    pieces: list[str] = field(default_factory=list)
    chars: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attached: list[dict] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.chars += len(text)


class PartVisitor:
    """Flattens parts. tokens: the expanded count of one unit of an attachment of each type
    (an image tile, a second of audio, a document page)."""

    tokens = {"image": 256, "audio": 25, "document": 512}

    def __init__(self) -> None:
        self.out = Flattened()

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        visit = getattr(self, f"visit_{kind}", None)
        if visit is None:
            raise ValueError(f"unknown part type {kind!r}")
        visit(part)

    def visit_text(self, part: dict) -> None:
        self.out.write(escape(part.get("text") or ""))

    def attach(self, part: dict) -> None:
        kind, n = part["type"], len(self.out.attached)
        units = 1 if part.get("units") is None else part["units"]
        self.out.attached.append({"ord": n, "type": kind, "ref": part.get("ref"), "at": self.out.chars, "tokens": units * self.tokens[kind]})
        self.out.write(f"<|{kind}:{n}|>")

    visit_image = visit_audio = visit_document = attach

    def turn(self, role: str | None, parts: list[dict]) -> None:
        self.out.write(f"{START}{escape(role or '')}{BODY}")
        began = self.out.chars
        for part in parts:
            self.visit(part)
        if role == "assistant":
            self.out.loss.append((began, self.out.chars))
        self.out.write(END + "\n")


def read_back(formatted: str, loss: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of each turn and the text under the loss mask, from the output alone.

    Placeholders of attachments stay in the texts as they are."""
    turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
    return turns, "".join(unescape(formatted[i:j]) for i, j in loss)


FORMATTED = "formatted string, loss array<struct<start:long,stop:long>>, attachments array<struct<ord:long,type:string,ref:string,at:long,tokens:long>>"


def text_parts(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the text as their one part."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, attachments) from rows (conv_id, turn, role, parts).

    parts: array of struct (type, text, ref, units). One output row holds one whole conversation.
    """
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    kind = grouped.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for turns in batch.column("turns").to_pylist():
                v = PartVisitor()
                for t in turns:
                    v.turn(t["role"], t["parts"] or [])
                made.append({"formatted": "".join(v.out.pieces), "loss": [{"start": i, "stop": j} for i, j in v.out.loss], "attachments": v.out.attached})
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            held = pa.list_(pa.struct([("ord", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([m["formatted"] for m in made], pa.string()), pa.array([m["loss"] for m in made], span), pa.array([m["attachments"] for m in made], held)],
                names=["conv_id", "formatted", "loss", "attachments"],
            )

    return grouped.mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the formatted output alone tells: turns and loss text, digested."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns, learnt = read_back(text, [(x["start"], x["stop"]) for x in loss])
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
