"""Lines of PostgreSQL's test_decoding output."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_TABLE = re.compile(r"""table ((?:"(?:[^"]|"")*"|[^."\s:]+)\.(?:"(?:[^"]|"")*"|[^":\s]+)): (INSERT|UPDATE|DELETE|TRUNCATE): ?(.*)""", re.S)
_EDGE = re.compile(r"(BEGIN|COMMIT) (\d+)")
_COLUMN = re.compile(r"""\s*("(?:[^"]|"")*"|[^\s\["]+)\[((?:[^\[\]"]|"(?:[^"]|"")*"|\[\])*)\]:""")
_VALUE = re.compile(r"""'((?:[^']|'')*)'|(\S*)""", re.S)
UNCHANGED = "unchanged-toast-datum"


@dataclass
class Line:
    kind: str  # BEGIN, COMMIT, INSERT, UPDATE, DELETE, TRUNCATE or OTHER
    xid: int | None = None
    table: str | None = None
    old: dict[str, str | None] = field(default_factory=dict)
    new: dict[str, str | None] = field(default_factory=dict)
    refused: str | None = None


def _plain(name: str) -> str:
    return name[1:-1].replace('""', '"') if name.startswith('"') else name


def columns(payload: str) -> list[tuple[str, str, str | None, bool]] | None:
    """(name, type, value, quoted) of each ``name[type]:value``; None where the text isn't of that form."""
    out, at = [], 0
    while payload[at:].strip():
        m = _COLUMN.match(payload, at)
        if m is None:
            return None
        v = _VALUE.match(payload, m.end())
        quoted = v[1] is not None
        text = v[1].replace("''", "'") if quoted else v[2]
        out.append((_plain(m[1]), m[2], None if not quoted and text.lower() == "null" else text, quoted))
        at = v.end()
    return out


def _image(payload: str, removal: bool) -> tuple[dict[str, str | None], str | None]:
    """A row image, and why it can't be used: an unchanged large value, or an array, that a write would need. Deletes just lack such columns."""
    found = columns(payload)
    if found is None:
        return {}, "malformed"
    image: dict[str, str | None] = {}
    for name, kind, value, quoted in found:
        missing = not quoted and value == UNCHANGED or value is not None and kind.endswith("[]")
        if missing and not removal:
            return {}, f"{'array' if kind.endswith('[]') else 'unchanged'} value of {name}"
        if not missing:
            image[name] = {"true": "1", "false": "0"}.get(value or "", value) if kind == "boolean" and not quoted else value
    return image, None


def _old_and_new(payload: str) -> tuple[str, str]:
    """Parts of an update: the marker of the new row counts only outside quotes."""
    if not payload.startswith("old-key: "):
        return "", payload
    at, quoted = len("old-key: "), False
    while at < len(payload):
        if payload[at] == "'":
            quoted = not quoted
        elif not quoted and payload.startswith("new-tuple: ", at):
            return payload[len("old-key: ") : at], payload[at + len("new-tuple: ") :]
        at += 1
    return payload[len("old-key: ") :], ""


def parse(line: str) -> Line:
    if m := _EDGE.match(line):
        return Line(m[1], xid=int(m[2]))
    m = _TABLE.match(line)
    if m is None:
        return Line("OTHER")
    table = ".".join(_plain(p) for p in re.findall(r'"(?:[^"]|"")*"|[^."]+', m[1]))
    kind, payload = m[2], m[3]
    if payload.strip() == "(no-tuple-data)":
        return Line(kind, table=table, refused="no tuple data")
    if kind == "TRUNCATE":
        return Line(kind, table=table)
    old, new = _old_and_new(payload) if kind == "UPDATE" else (payload, "") if kind == "DELETE" else ("", payload)
    before, why = _image(old, True) if old else ({}, None)
    after, why_not = _image(new, False) if new else ({}, None)
    return Line(kind, table=table, old=before, new=after, refused=why or why_not)


PARSED = "kind string, xid long, table_name string, old map<string,string>, new map<string,string>, refused string"


def parse_lines(df: DataFrame, line_col: str = "data", carried: str = "lsn") -> DataFrame:
    """``carried`` and the columns of PARSED for each line. Arrow batches in, Arrow batches out."""
    kinds = dict(df.dtypes)
    names = [carried, *(c.split()[0] for c in PARSED.split(", "))]
    text_map = pa.map_(pa.string(), pa.string())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f.kind for f in found], pa.string()),
                    pa.array([f.xid for f in found], pa.int64()),
                    pa.array([f.table for f in found], pa.string()),
                    pa.array([list(f.old.items()) for f in found], text_map),
                    pa.array([list(f.new.items()) for f in found], text_map),
                    pa.array([f.refused for f in found], pa.string()),
                ],
                names,
            )

    return df.select(carried, line_col).mapInArrow(over, f"{carried} {kinds[carried]}, {PARSED}")
