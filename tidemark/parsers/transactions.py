"""Transactions of a change stream: buffers with savepoints, and prepared branches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Event = tuple[str, str, Any]  # kind, transaction, content


@dataclass
class Assembler:
    """Events of one session in order: BEGIN, CHANGE, SAVEPOINT (content: name), ROLLBACK_TO, ROLLBACK, COMMIT.

    A rollback to a savepoint restores what was there when it was set; a BEGIN over leftovers discards them.
    """

    changes: list[Any] = field(default_factory=list)
    marks: dict[str, int] = field(default_factory=dict)
    current: str | None = None

    def push(self, event: Event) -> list[Any] | None:
        """The changes of a transaction when it commits."""
        kind, transaction, content = event
        if kind == "BEGIN":
            self.changes, self.marks, self.current = [], {}, transaction
        elif kind == "CHANGE":
            self.changes.append(content)
        elif kind == "SAVEPOINT":
            self.marks[content] = len(self.changes)
        elif kind == "ROLLBACK_TO":
            at = self.marks.get(content, len(self.changes))
            del self.changes[at:]
            self.marks = {n: m for n, m in self.marks.items() if m <= at}
        elif kind == "ROLLBACK":
            self.changes, self.marks, self.current = [], {}, None
        elif kind == "COMMIT":
            done, self.changes, self.marks, self.current = self.changes, [], {}, None
            return done
        return None


def committed(events: Iterable[Event]) -> Iterator[tuple[str, list[Any]]]:
    assembler = Assembler()
    for event in events:
        done = assembler.push(event)
        if done is not None:
            yield event[1], done


class BranchError(ValueError):
    pass


@dataclass
class PreparedBranch:
    """One prepared transaction at a time: rows wait for their commit; a second branch is an error, since its order can't be known."""

    branch: str | None = None
    rows: list[Any] = field(default_factory=list)

    def start(self, branch: str) -> None:
        if self.branch is not None and self.branch != branch:
            raise BranchError(f"branch {branch} while {self.branch} is prepared")
        self.branch = branch

    def add(self, branch: str, row: Any) -> None:
        self.start(branch)
        self.rows.append(row)

    def commit(self, branch: str) -> list[Any]:
        if branch != self.branch:
            raise BranchError(f"commit of {branch}, prepared is {self.branch}")
        done, self.rows, self.branch = self.rows, [], None
        return done

    def rollback(self, branch: str) -> None:
        if branch == self.branch:
            self.rows, self.branch = [], None


def committed_changes(events: DataFrame) -> DataFrame:
    """The CHANGE events (transaction, seq, kind, content) of transactions that commit, without those that a rollback to a savepoint took back.

    As Assembler, for a whole table of events at once: a rollback takes back the changes between the last savepoint of its name before it and itself. Rollbacks
    are few; changes are matched with those of their own transaction only.
    """
    ended = events.where("kind IN ('COMMIT', 'ROLLBACK')").groupBy("transaction").agg(F.max_by("kind", "seq").alias("last"), F.max("seq").alias("end"))
    done = ended.where("last = 'COMMIT'").select("transaction", "end")
    marks = events.where("kind = 'SAVEPOINT'").select("transaction", F.col("content").alias("mark"), F.col("seq").alias("set_at"))
    backs = events.where("kind = 'ROLLBACK_TO'").select("transaction", F.col("content").alias("mark"), F.col("seq").alias("back_at"))
    spans = backs.join(marks, ["transaction", "mark"]).where("set_at < back_at").groupBy("transaction", "back_at").agg(F.max("set_at").alias("set_at"))
    changes = events.where("kind = 'CHANGE'").join(done, "transaction").where("seq < end").drop("end")
    c, s = changes.alias("c"), spans.alias("s")
    undone = (F.col("c.transaction") == F.col("s.transaction")) & (F.col("c.seq") > F.col("s.set_at")) & (F.col("c.seq") < F.col("s.back_at"))
    return c.join(s, undone, "left_anti").select("transaction", "seq", "content")
