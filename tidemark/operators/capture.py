"""How changes of a source are captured, where they go, and how large values are read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Strategy(Enum):
    """Rows are polled, all rows are compared, or a log is followed; the value is the source that a log strategy is for."""

    POLLING = "any"
    FULL_COMPARE = "every"
    BINLOG_CDC = "mysql"
    LOGMINER_CDC = "oracle"
    PG_LOGICAL_CDC = "postgres"
    SQLSERVER_CDC = "sqlserver"
    YSTREAM_CDC = "yashan"

    @property
    def follows_log(self) -> bool:
        return self.name.endswith("_CDC")

    @classmethod
    def of(cls, name: str | None) -> Strategy:
        """The strategy of a name in any case; polling where there is none."""
        if not name or not name.strip():
            return cls.POLLING
        try:
            return cls[name.strip().upper()]
        except KeyError:
            raise ValueError(f"unknown capture strategy {name}") from None


#: What a log strategy needs of its source: settings with the values that they must have.
REQUIRED: dict[Strategy, dict[str, tuple[str, ...]]] = {
    Strategy.BINLOG_CDC: {"log_bin": ("ON", "1"), "binlog_format": ("ROW",), "binlog_row_image": ("FULL",)},
    Strategy.LOGMINER_CDC: {"log_mode": ("ARCHIVELOG",), "supplemental_log_data_min": ("YES", "IMPLICIT")},
    Strategy.PG_LOGICAL_CDC: {"wal_level": ("logical",), "replication": ("true", "on")},
    Strategy.SQLSERVER_CDC: {"agent": ("running",), "is_cdc_enabled": ("1", "true")},
    Strategy.YSTREAM_CDC: {"ystream": ("available",)},
}


def probe(strategy: Strategy, source: str, settings: Mapping[str, str]) -> list[str]:
    """Why a strategy can't be used with a source; empty where it can. Settings and values match in any case."""
    if not strategy.follows_log:
        return []
    out = [] if source.lower() == strategy.value else [f"{strategy.name} is for {strategy.value}, the source is {source}"]
    known = {k.lower(): str(v).lower() for k, v in settings.items()}
    return out + [f"{name} is {known.get(name, 'not set')}, {' or '.join(wanted)} is needed" for name, wanted in REQUIRED[strategy].items() if known.get(name) not in {w.lower() for w in wanted}]


def offered(source: str, settings: Mapping[str, str]) -> list[Strategy]:
    """Strategies that a source can be captured with."""
    return [s for s in Strategy if not probe(s, source, settings)]


def sink_of(target: str | None) -> str:
    """Where changes go: a cache projection, or tables."""
    kind = (target or "JDBC").strip().upper()
    if kind not in ("JDBC", "REDIS"):
        raise ValueError(f"unknown target {target}")
    return kind


INLINE_BYTES, FORCED_BYTES = 8_192, 1 << 20


class ValueTooLarge(ValueError):
    """A key, cursor or cleansed column with a value that is over what is read whole."""


def read_modes(columns: Mapping[str, int | None], large: Iterable[str], whole: Iterable[str], inline: int = INLINE_BYTES, forced: int = FORCED_BYTES) -> dict[str, str]:
    """INLINE or STREAMED for each column by its declared size (None: unknown, which doesn't count as large). Columns in ``whole`` are read whole, or refused."""
    must, big = {w.lower() for w in whole}, {c.lower() for c in large}
    out = {}
    for name, size in columns.items():
        if name.lower() in must:
            if size is not None and size > forced:
                raise ValueTooLarge(f"{name} is declared with {size}, above {forced}")
            out[name] = "INLINE"
        else:
            out[name] = "STREAMED" if name.lower() in big or size is not None and size > inline else "INLINE"
    return out


def over_size(df: DataFrame, whole: Sequence[str], most: int = FORCED_BYTES) -> DataFrame:
    """(column_name, rows, largest) of the columns in ``whole`` with values over ``most`` bytes: rows in Spark hold their values, so this is what is left of the policy."""
    size = lambda c: F.octet_length(F.col(f"`{c}`").cast("string"))
    counts = df.agg(*(F.struct(F.lit(c).alias("column_name"), F.count_if(size(c) > most).alias("rows"), F.max(size(c)).alias("largest")).alias(f"c{i}") for i, c in enumerate(whole)))
    return counts.select(F.explode(F.array(*counts.columns)).alias("x")).select("x.*").where("rows > 0")
