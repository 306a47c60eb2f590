"""``${name}`` variables in SQL."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")
NAME_LENGTH, VALUE_LENGTH = 128, 4000
BUILT_IN = ("date", "datetime", "yesterday", "month", "year", "taskName", "targetTable", "runIndex")


class VariableError(ValueError):
    pass


def definitions(text: str | None) -> dict[str, str]:
    """``name = value`` lines. Names are checked, may not repeat, and may not be those of built-in values in any case."""
    out: dict[str, str] = {}
    reserved = {b.lower() for b in BUILT_IN}
    for number, line in enumerate((text or "").splitlines(), 1):
        if not line.strip():
            continue
        name, equals, value = (p.strip() for p in line.partition("="))
        if not equals or not name:
            raise VariableError(f"line {number} is not name = value")
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or len(name) > NAME_LENGTH:
            raise VariableError(f"{name} is not a name")
        if name.lower() in reserved:
            raise VariableError(f"{name} is built in")
        if len(value) > VALUE_LENGTH:
            raise VariableError(f"the value of {name} is too long")
        if name in out:
            raise VariableError(f"{name} is defined twice")
        out[name] = value
    return out


def built_in(now: datetime, task: str = "", target: str = "", runs: int = 0) -> dict[str, str]:
    """Values that every run has; ``runs`` counts successful runs so far."""
    return {
        "date": f"{now:%Y-%m-%d}",
        "datetime": f"{now:%Y-%m-%d %H:%M:%S}",
        "yesterday": f"{now - timedelta(days=1):%Y-%m-%d}",
        "month": f"{now:%Y-%m}",
        "year": f"{now:%Y}",
        "taskName": task.strip(),
        "targetTable": target.strip(),
        "runIndex": str(runs),
    }


def references(sql: str | None) -> list[str]:
    return REFERENCE.findall(sql or "")


def substitute(sql: str | None, values: dict[str, str]) -> str | None:
    """Every reference replaced, once: values aren't looked into. An unknown name is an error."""
    if sql is None:
        return None
    unknown = [n for n in references(sql) if n not in values]
    if unknown:
        raise VariableError(f"unknown variable {unknown[0]}")
    return REFERENCE.sub(lambda m: values[m[1]], sql)
