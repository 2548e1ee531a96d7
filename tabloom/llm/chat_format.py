"""Chat formatting of turns made of typed content parts.

A turn is a role and a list of parts: texts, images, audio and documents, in the order they appear.
A visitor goes over the parts of a turn once and flattens them: texts are escaped, every other part
becomes its kind's placeholder, is recorded as an attachment with its place in the formatted piece and
its reference, and is charged the tokens its placeholder expands to. The piece of a turn reads

    <s>role[INST]content[/INST]</s>

Control strings (the markers and the placeholders) inside roles and texts are escaped by one more
``~`` after their first character, and one is taken off when a piece is read, so any text comes back
as it was. No control string holds a ``<`` or ``[`` but at its start, so none can arise where a text
meets a marker. The loss mask of a turn is the list of spans (code points of the piece) of its texts
if its role is trained on, the assistant by default.

A formatted conversation is its pieces in order: files are written by ranges of (conversation, turn,
piece), so a conversation of any size is spread over tasks and stays in order. Digests of whole
conversations cannot be split, as SHA-256 runs over their bytes in order: a task streams its
conversations from a sort that spills and holds one Arrow batch.

Defined results: a null text or part list is empty, a null role is empty, null parts are left out;
a part of another kind is a text if it has one, else a document; neighbouring texts come back as one
and empty ones not at all; null conversation ids form a conversation; null turns come first, equal
turns are ordered by their piece and repeated rows are all kept; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import as_long, scratch_folder, table, text_or_empty

START, BEGIN, STOP, END = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDER = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
_CONTROL = r"(/?s>|/?INST\]|image>|audio>|document>)"
_PLAIN, _ESCAPED = re.compile(r"([<\[])(~*)" + _CONTROL), re.compile(r"([<\[])~(~*)" + _CONTROL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(BEGIN) + "(.*)" + re.escape(STOP + END), re.DOTALL)
_PLACES = re.compile("<(image|audio|document)>")

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SIZES = ("width", "height", "seconds", "pages")
_ATTACHED = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("ref", pa.string()), ("start", pa.int32()), ("tokens", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("seconds", pa.float64()), ("pages", pa.int32())]
    )
)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
_FORMATTED = (
    "key {key}, turn {turn}, formatted binary, loss array<struct<start:int,length:int>>, "
    "attachments array<struct<kind:string,ref:string,start:int,tokens:bigint,width:int,height:int,seconds:double,pages:int>>, attachment_tokens bigint"
)


@dataclass(frozen=True)
class Costs:
    """Tokens that placeholders expand to; unknown sizes cost ``unknown``."""

    patch: int = 28
    tokens_a_second: float = 25.0
    tokens_a_page: int = 512
    unknown: int = 256


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1~\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _decoded(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "surrogateescape")


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


class Flattener:
    """Visits the parts of one turn in order and keeps what they become."""

    def __init__(self, role: str, costs: Costs, trained: bool):
        self.costs, self.trained = costs, trained
        self.pieces: list[str] = []
        self.length = 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []
        self._add(START + escape(role) + BEGIN)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        known = part["kind"] in ("text", *PLACEHOLDER)
        kind = part["kind"] if known else "text" if part["text"] is not None else "document"
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        piece = escape(_decoded(part["text"]))
        if piece and self.trained:
            self.loss.append({"start": self.length, "length": len(piece)})
        self._add(piece)

    def visit_image(self, part: dict) -> None:
        width, height = part["width"], part["height"]
        patches = lambda side: max(1, math.ceil(side / self.costs.patch))
        self._attach("image", part, patches(width) * patches(height) if width and height else None)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"]
        timed = seconds is not None and math.isfinite(seconds)
        self._attach("audio", part, math.ceil(max(seconds, 0) * self.costs.tokens_a_second) if timed else None)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, part["pages"] * self.costs.tokens_a_page if part["pages"] else None)

    def _attach(self, kind: str, part: dict, tokens: int | None) -> None:
        cost = self.costs.unknown if tokens is None else tokens
        self.attachments.append({"kind": kind, "ref": part["ref"], "start": self.length, "tokens": cost} | {s: part[s] for s in SIZES})
        self._add(PLACEHOLDER[kind])

    def piece(self) -> str:
        return "".join(self.pieces) + STOP + END


def flatten(role: str, parts: Iterable[dict | None], costs: Costs = Costs(), trained: bool = False) -> Flattener:
    visitor = Flattener(role, costs, trained)
    for part in parts:
        visitor.visit(part)
    return visitor


def parse(piece: str) -> tuple[str, list[str]]:
    """Role of a piece and its content split at placeholders: text, kind, text, kind, ..., text."""
    role, content = _TURN.fullmatch(piece).groups()
    found = _PLACES.split(content)
    found[::2] = [unescape(t) for t in found[::2]]
    return unescape(role), found


def _formatting(costs: Costs, trained: tuple[str, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [_decoded(r) for r in batch.column("role").to_pylist()]
            turns = [flatten(r, parts or (), costs, r in trained) for r, parts in zip(roles, batch.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("turn"), pa.array([_encoded(t.piece()) for t in turns], pa.binary()),
                    pa.array([t.loss for t in turns], _SPANS), pa.array([t.attachments for t in turns], _ATTACHED),
                    pa.array([sum(a["tokens"] for a in t.attachments) for t in turns], pa.int64()),
                ],
                ["key", "turn", "formatted", "loss", "attachments", "attachment_tokens"],
            )

    return run


def text_parts(text: str = "text") -> Column:
    """A list of one text part for tables whose turns are plain texts."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text_or_empty(text).alias("text"), *nothing))


def format_turns(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | str = "parts",
    costs: Costs = Costs(), trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """A row a turn: ``key``, ``turn``, ``formatted``, ``loss`` (spans of code points),
    ``attachments`` in order and the tokens they expand to. ``parts`` is a list of ``PART``."""
    listed = F.col(f"`{parts}`") if isinstance(parts, str) else parts
    # texts travel as bytes, so that texts that are no valid UTF-8 come back as they were
    inside = F.transform(
        listed.cast(f"array<{PART}>"),
        lambda p: F.when(p.isNotNull(), F.struct(p["kind"].alias("kind"), p["text"].cast("binary").alias("text"), *[p[n].alias(n) for n in ("ref", *SIZES)])),
    )
    rows = turns.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), text_or_empty(role).cast("binary").alias("role"), inside.alias("parts")
    )
    schema = _FORMATTED.format(key=turns.schema[key].dataType.simpleString(), turn=turns.schema[turn].dataType.simpleString())
    return rows.mapInArrow(_formatting(costs, trained), schema).withColumn("formatted", F.col("formatted").cast("string"))


def write_conversations(formatted: DataFrame, folder: str) -> None:
    """Parquet files whose rows, file by file, are the conversations' pieces in order."""
    head = F.substring("formatted", 1, 64)
    formatted.repartitionByRange("key", "turn", head).sortWithinPartitions("key", "turn", "formatted").write.option("compression", "zstd").mode("overwrite").parquet(folder)


def restored(formatted: DataFrame) -> DataFrame:
    """``(key, turn, role, parts)`` from formatted rows, as they were before formatting."""
    sizes = {"key": formatted.schema["key"].dataType.simpleString(), "turn": formatted.schema["turn"].dataType.simpleString()}
    binary = PART.replace("text:string", "text:binary")
    part = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.binary()), ("ref", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("seconds", pa.float64()), ("pages", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, parts = [], []
            for piece, attached in zip(batch.column("formatted").to_pylist(), batch.column("attachments").to_pylist()):
                role, found = parse(_decoded(piece))
                roles.append(_encoded(role))
                rest, turn = iter(attached), []
                for i, x in enumerate(found):
                    if i % 2:
                        a = next(rest)
                        turn.append({"kind": x, "text": None, "ref": a["ref"]} | {s: a[s] for s in SIZES})
                    elif x:
                        turn.append({"kind": "text", "text": _encoded(x), "ref": None} | dict.fromkeys(SIZES))
                parts.append(turn)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("turn"), pa.array(roles, pa.binary()), pa.array(parts, part)], ["key", "turn", "role", "parts"])

    rows = formatted.select("key", "turn", F.col("formatted").cast("binary").alias("formatted"), "attachments")
    out = rows.mapInArrow(run, f"key {sizes['key']}, turn {sizes['turn']}, role binary, parts array<{binary}>")
    return out.select("key", "turn", F.col("role").cast("string").alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))


class _Digest:
    """Sums of one conversation while its pieces stream by."""

    def __init__(self, key):
        self.key, self.turns, self.chars, self.loss_chars = key, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, spans: list[dict]) -> None:
        role, found = parse(piece)
        self.turns += 1
        self.chars += len(piece)
        self.text.update(_encoded(f"{role}\n{''.join(found[::2])}\n"))
        for span in spans:
            text = unescape(piece[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(text)
            self.loss.update(_encoded(text))

    def row(self) -> tuple:
        return self.key, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digesting() -> Callable:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        key_type = None

        def packed(done: list[_Digest]) -> pa.RecordBatch:
            columns = list(zip(*[d.row() for d in done]))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], _DIGESTS)

        for batch in batches:
            done, key_type = [], batch.schema.field("key").type
            for key, piece, spans in zip(*[batch.column(c).to_pylist() for c in ("key", "formatted", "loss")]):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now)
                    now = _Digest(key)
                now.add(_decoded(piece), spans)
            if done:
                yield packed(done)
        if now is not None:
            yield packed([now])

    return run


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """A row a conversation: turns, texts and texts under the loss mask, as the pieces hold them."""
    pieces = formatted.select("key", "turn", F.col("formatted").cast("binary").alias("formatted"), "loss")
    kind = formatted.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return pieces.repartition("key").sortWithinPartitions("key", "turn", "formatted").mapInArrow(_digesting(), schema)


#: The conversation whose texts are control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(as_long("conv_id").alias("conv_id"), as_long("turn").alias("turn"), "role", "text")
    turns = given.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    folder = scratch_folder(spark, "conversations") + "/rows"
    write_conversations(format_turns(turns, parts=text_parts()), folder)
    return conversation_digests(spark.read.parquet(folder)).withColumnRenamed("key", "conv_id")
