"""Chat formatting with typed content parts.

A conversation's rows become one text with marked turns:

    <|im_start|>role\\n parts <|im_end|>\\n

A visitor flattens each turn's parts (text, image, audio, document) into that text: text stands for itself, an attachment
becomes a placeholder in its place, and its reference and the number of tokens that it expands to are recorded. Control strings
begin with "<|". In texts, roles and references "<|" is written "<\\|", "<\\|" is written "<\\\\|" and so on, so that
control strings inside a text can't be taken for the template's, and every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"
#: A formatted conversation is cut after the turn with which it passes so many characters; the rest follows in further pieces.
PIECE_CHARS = 1 << 22

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


# parts -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """One part of a turn. ref names an attachment; its size is width and height, seconds or pages."""

    kind: str
    text: str = ""
    ref: str = ""
    width: int = 0
    height: int = 0
    seconds: float = 0.0
    pages: int = 0

    def accept(self, visitor: Flattener) -> None:
        getattr(visitor, f"visit_{self.kind}", visitor.visit_other)(self)

    @staticmethod
    def of(given: dict | None) -> list[Part]:
        """The part that a row has; none for null. Null fields have their defaults, and a part without a kind is text."""
        return [Part(**{"kind": "text"} | {k: v for k, v in given.items() if v is not None})] if given is not None else []


@dataclass
class Flattener:
    """Visits parts in order and gathers the text with placeholders and the attachments."""

    image_tile: int = 28
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 256
    first: int = 0
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit_text(self, part: Part) -> None:
        self.out.append(escape(part.text))

    def visit_image(self, part: Part) -> None:
        self._attach(part, max(1, ceil(part.width / self.image_tile)) * max(1, ceil(part.height / self.image_tile)))

    def visit_audio(self, part: Part) -> None:
        self._attach(part, max(1, ceil(max(0.0, part.seconds if part.seconds < 1e9 else 0.0) * self.audio_tokens_per_second)))

    def visit_document(self, part: Part) -> None:
        self._attach(part, max(1, part.pages) * self.document_tokens_per_page)

    def visit_other(self, part: Part) -> None:
        """A part of a kind that isn't known keeps its place and is recorded under its own kind."""
        self._attach(part, 1, "other")

    def _attach(self, part: Part, tokens: int, name: str = "") -> None:
        number = self.first + len(self.attachments)
        self.out.append(f"<|{name or part.kind}:{number}|>")
        self.attachments.append({"number": number, "kind": part.kind, "ref": part.ref, "tokens": tokens})


@dataclass
class Piece:
    """Formatted turns of one conversation; loss has the spans of text to learn from."""

    text: list[str] = field(default_factory=list)
    n: int = 0
    turns: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def add(self, role: str, parts: Iterable[Part], attached: int, learn: bool) -> int:
        visitor = Flattener(first=attached)
        for part in parts:
            part.accept(visitor)
        head, body = f"{START}{escape(role).replace(chr(10), LINE)}\n", "".join(visitor.out)
        if learn:
            self.loss.append((self.n + len(head), self.n + len(head) + len(body)))
        self.text += (head, body, END + "\n")
        self.n += len(head) + len(body) + len(END) + 1
        self.turns += 1
        self.attachments += visitor.attachments
        return attached + len(visitor.attachments)


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ATTACHED = re.compile(r"<\|(?:image|audio|document|other):\d+\|>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; placeholders give no text."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        turns.append((unescape(m[1].replace(LINE, "\n")), unescape(_ATTACHED.sub("", m[2]))))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


# tables ------------------------------------------------------------------------------------------

PIECES = "conv_id long, piece int, formatted string, n_turns int, loss array<struct<start:int,end:int>>, attachments array<struct<number:int,kind:string,ref:string,tokens:int>>"

#: Of a column of parts, for tables that have one.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

_PIECE_TYPES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("piece", pa.int32()),
        ("formatted", pa.string()),
        ("n_turns", pa.int32()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))),
    ]
)


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = LOSS_ROLE, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """Pieces of formatted conversations, in the columns of PIECES; most conversations are one piece, number 0.

    Turns go by turn, then role and text (nulls first), so that ties and repeated rows keep a fixed order. Null roles and texts
    count as empty; rows with a null conv_id form one conversation of their own. ``parts_col`` names a column of type PARTS that is used
    in place of the text where it isn't null; null parts are left out, a part without a kind is text, and one of an unknown kind keeps its place as <|other:n|>. Partitions are sorted and streamed: a conversation of any length is never held whole, and its
    pieces come out in order. An empty table gives no piece. Other columns are ignored.
    """
    parts = F.col(parts_col).cast(PARTS) if parts_col else F.lit(None).cast(PARTS)
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), parts.alias("parts"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, number, attached, now = Piece(), 0, 0, ()
        done: list[dict] = []
        held = 0

        def closed() -> None:
            done.append({"conv_id": now[0], "piece": number, "formatted": "".join(piece.text), "n_turns": piece.turns, "loss": [{"start": a, "end": b} for a, b in piece.loss], "attachments": piece.attachments})

        for batch in batches:
            for conv, role, text, given in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if now != (conv,):
                    if piece.turns:
                        closed()
                        held += piece.n
                    piece, number, attached, now = Piece(), 0, 0, (conv,)
                elif piece.n > piece_chars:
                    closed()
                    held += piece.n
                    piece, number = Piece(), number + 1
                role = role or ""
                content = [Part("text", text or "")] if given is None else [x for p in given for x in Part.of(p)]
                attached = piece.add(role, content, attached, role == loss_role)
                if held > piece_chars or len(done) >= 5000:
                    yield pa.RecordBatch.from_pylist(done, _PIECE_TYPES)
                    done, held = [], 0
        if piece.turns:
            closed()
        if done:
            yield pa.RecordBatch.from_pylist(done, _PIECE_TYPES)

    n = shuffle_partitions(df.sparkSession)
    return rows.repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(over, PIECES)


def digests(pieces: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Per conversation, read back from its pieces: turns, their digest, and the text under the loss mask with its digest.

    Relies on a conversation's pieces following one another in their partition, as format_conversations() leaves them.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, chars, learnt, sha, loss = (), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        rows: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4))):
                if now != (conv,):
                    if now:
                        rows.append((now[0], turns, sha.hexdigest(), learnt, loss.hexdigest(), chars))
                    now, turns, chars, learnt, sha, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in read_back(formatted):
                    sha.update(f"{role}\n{text}\n".encode())
                    turns += 1
                for span in spans:
                    text = unescape(_ATTACHED.sub("", formatted[span["start"] : span["end"]]))
                    loss.update(text.encode())
                    learnt += len(text)
                chars += len(formatted)
            if len(rows) >= 5000:
                yield batch_of()
                rows = []
        if now:
            rows.append((now[0], turns, sha.hexdigest(), learnt, loss.hexdigest(), chars))
        if rows:
            yield batch_of()

    return pieces.mapInArrow(over, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
