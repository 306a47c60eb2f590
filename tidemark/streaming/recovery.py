"""What a failure of a change stream means, and when to try again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.cursor import high_watermark
from .cdc import VersionedTable

FIRST_SECONDS, MOST_SECONDS = 1.0, 60.0
REPAIR_ATTEMPTS = 3

# Words of error texts, by class, in the order in which they are tried.
_CLASSES: tuple[tuple[str, str], ...] = (
    ("PURGED", r"purged|no longer available|missing logfile|requested wal segment|could not find first log|lsn.*(?:too old|out of range)"),
    ("AUTH", r"access denied|authentication|insufficient privilege|permission denied|login failed|password"),
    ("TRANSACTION_TOO_LARGE", r"transaction.*too large|over the budget|exceeds.*buffer"),
    ("TARGET_TABLE_MISSING", r"TABLE_OR_VIEW_NOT_FOUND|table.*(?:not found|does(?:n't| not) exist)|unknown table|PATH_NOT_FOUND"),
    ("SCHEMA_DRIFT", r"UNRESOLVED_COLUMN|unknown column|column.*(?:not found|does not exist)|schema.*(?:mismatch|incompatible)"),
)


def failure_class(error: BaseException | str) -> str:
    """The class of a failure; what isn't known is transient and tried again."""
    text = str(error)
    return next((name for name, words in _CLASSES if re.search(words, text, re.I)), "TRANSIENT")


def may_retry(kind: str) -> bool:
    """Whether trying again can help without a change from outside."""
    return kind in ("TRANSIENT", "TARGET_TABLE_MISSING", "SCHEMA_DRIFT")


def waits(first: float = FIRST_SECONDS, most: float = MOST_SECONDS) -> Iterator[float]:
    """Seconds to wait after each failure in a row, or each idle poll: doubling up to a limit."""
    now = first
    while True:
        yield now
        now = min(most, now * 2)


@dataclass
class RepairGate:
    """Reloads of missing target tables, a bounded number for each; success starts the count anew."""

    attempts: dict[str, int] = field(default_factory=dict)
    most: int = REPAIR_ATTEMPTS

    def try_repair(self, table: str, reload: Callable[[], None]) -> bool:
        if self.attempts.get(table, 0) >= self.most:
            return False
        self.attempts[table] = self.attempts.get(table, 0) + 1
        reload()
        self.attempts.pop(table)
        return True


def baseline(source: DataFrame, table: VersionedTable, position: Callable[[], object]) -> object:
    """Copy a table before its changes are followed. The position is taken first, so that replay begins no later than the copy; merges make the overlap harmless."""
    at = position()
    table.replace(source)
    return at


def last_position(log: DataFrame, column: str = "seq") -> Callable[[], object]:
    return lambda: high_watermark(log, column)
