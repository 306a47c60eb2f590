"""Rewriting view bodies and queries from one SQL dialect to another, Spark's among them.

A rewrite that can't be sure of the same result is refused: the reasons are listed in ``blocked``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .text import LEXICONS, masked, rewrite_calls, split_top

# Names of functions in each target dialect.
FUNCTIONS: dict[str, dict[str, str]] = {
    "spark": {"SYSDATE": "current_timestamp()", "SYSTIMESTAMP": "current_timestamp()", "GETDATE": "current_timestamp()", "SYSDATETIME": "current_timestamp()", "NOW": "current_timestamp()", "CURDATE": "current_date()", "LEN": "char_length", "LENGTHB": "octet_length", "DATALENGTH": "octet_length", "REPLICATE": "repeat", "CHARINDEX": "locate", "STRPOS": "instr", "POSSTR": "instr", "RANDOM": "rand", "POW": "power", "CEILING": "ceil", "UCASE": "upper", "LCASE": "lower", "SUBSTR": "substring"},
    "mysql": {"NVL": "IFNULL", "SYSDATE": "NOW()", "SYSTIMESTAMP": "NOW(6)", "GETDATE": "NOW()", "SUBSTR": "SUBSTRING", "LEN": "CHAR_LENGTH", "ISNULL": "IFNULL", "REPLICATE": "REPEAT", "RANDOM": "RAND", "EOMONTH": "LAST_DAY", "CHARINDEX": "LOCATE", "STRPOS": "INSTR", "POW": "POWER", "UCASE": "UPPER", "LCASE": "LOWER", "DATALENGTH": "LENGTH"},
    "oracle": {"IFNULL": "NVL", "ISNULL": "NVL", "NOW": "SYSDATE", "GETDATE": "SYSDATE", "CURDATE": "TRUNC(SYSDATE)", "SUBSTRING": "SUBSTR", "LEN": "LENGTH", "CEILING": "CEIL", "EOMONTH": "LAST_DAY", "POW": "POWER", "UCASE": "UPPER", "LCASE": "LOWER", "DATALENGTH": "LENGTHB"},
    "postgres": {"NVL": "COALESCE", "IFNULL": "COALESCE", "ISNULL": "COALESCE", "SYSDATE": "CURRENT_TIMESTAMP", "SYSTIMESTAMP": "CURRENT_TIMESTAMP", "GETDATE": "NOW()", "LEN": "LENGTH", "REPLICATE": "REPEAT", "POW": "POWER", "UCASE": "UPPER", "LCASE": "LOWER", "DATALENGTH": "OCTET_LENGTH", "CURDATE": "CURRENT_DATE"},
    "sqlserver": {"NVL": "ISNULL", "IFNULL": "ISNULL", "SYSDATE": "GETDATE()", "SYSTIMESTAMP": "SYSDATETIME()", "NOW": "GETDATE()", "LENGTH": "LEN", "SUBSTR": "SUBSTRING", "CEIL": "CEILING", "REPEAT": "REPLICATE", "RANDOM": "RAND", "LAST_DAY": "EOMONTH", "LOCATE": "CHARINDEX", "POW": "POWER", "UCASE": "UPPER", "LCASE": "LOWER"},
    "db2": {"NVL": "COALESCE", "IFNULL": "COALESCE", "ISNULL": "COALESCE", "SYSDATE": "CURRENT TIMESTAMP", "GETDATE": "CURRENT TIMESTAMP", "NOW": "CURRENT TIMESTAMP", "LEN": "LENGTH", "CEILING": "CEIL", "REPLICATE": "REPEAT", "RANDOM": "RAND", "EOMONTH": "LAST_DAY", "CHARINDEX": "LOCATE", "STRPOS": "POSSTR", "POW": "POWER", "DATALENGTH": "LENGTH"},
    "hana": {"NVL": "COALESCE", "IFNULL": "COALESCE", "ISNULL": "COALESCE", "SYSDATE": "CURRENT_TIMESTAMP", "SYSTIMESTAMP": "CURRENT_TIMESTAMP", "GETDATE": "CURRENT_TIMESTAMP", "NOW": "CURRENT_TIMESTAMP", "LEN": "LENGTH", "CEILING": "CEIL", "EOMONTH": "LAST_DAY", "STRPOS": "INSTR", "POW": "POWER", "UCASE": "UPPER", "LCASE": "LOWER", "DATALENGTH": "LENGTHB"},
}
# Types that casts may name, in Spark.
CAST_TYPES = {
    "VARCHAR": "string", "VARCHAR2": "string", "NVARCHAR": "string", "NVARCHAR2": "string", "CHAR": "string", "NCHAR": "string", "TEXT": "string", "CLOB": "string", "CHARACTER VARYING": "string",
    "SIGNED": "bigint", "SIGNED INTEGER": "bigint", "UNSIGNED": "decimal(20,0)", "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint",
    "NUMBER": "decimal(38,10)", "NUMERIC": "decimal(38,10)", "DECIMAL": "decimal(38,10)", "FLOAT": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double", "REAL": "float", "BINARY_DOUBLE": "double", "BINARY_FLOAT": "float", "MONEY": "decimal(19,4)",
    "DATE": "date", "DATETIME": "timestamp", "DATETIME2": "timestamp", "TIMESTAMP": "timestamp", "TIMESTAMPTZ": "timestamp", "BOOLEAN": "boolean", "BOOL": "boolean", "BIT": "boolean", "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary", "BYTEA": "binary", "RAW": "binary", "STRING": "string",
}
_QUOTES = {"spark": ("`", "`"), "mysql": ("`", "`"), "sqlserver": ("[", "]")}
_FORMATTING = re.compile(r"\b(?:TO_CHAR|TO_DATE|TO_TIMESTAMP|DATE_FORMAT|STR_TO_DATE|FORMAT|CONVERT)\s*\(", re.I)


@dataclass
class Converted:
    sql: str
    warnings: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)

    @property
    def usable(self) -> bool:
        return not self.blocked


def view_body(definition: str) -> str:
    """The query of a CREATE VIEW statement; a bare query stays."""
    m = re.match(r"\s*create\b.*?\bview\b.*?\bas\b\s*(?=select\b|with\b|\()", definition, re.I | re.S)
    return definition[m.end() :].strip().rstrip(";").rstrip() if m else definition.strip().rstrip(";").rstrip()


def _requoted(name: str, target: str) -> str:
    inner = name[1:-1].replace(name[-1] * 2, name[-1])
    left, right = _QUOTES.get(target, ('"', '"'))
    return left + inner.replace(right, right * 2) + right


def _decode(args: list[str], out: Converted) -> str | None:
    if len(args) < 3:
        return None
    subject, rest = args[0], args[1:]
    if any(a.upper() == "NULL" for a in rest[0 : len(rest) - len(rest) % 2 : 2]):
        out.blocked.append("DECODE with a NULL search value")
        return None
    arms = " ".join(f"WHEN {subject} = {a} THEN {b}" for a, b in zip(rest[::2], rest[1::2]))
    return f"CASE {arms}{f' ELSE {rest[-1]}' if len(rest) % 2 else ''} END"


def _cast_type(text: str, out: Converted, source: str = "") -> str:
    """Spark's name of a type. A date of Oracle has a time of day."""
    m = re.fullmatch(r"\s*([A-Za-z_0-9 ]+?)\s*(\([^)]*\))?\s*", text)
    known = CAST_TYPES.get(m[1].upper()) if m else None
    if known == "date" and source == "oracle":
        return "timestamp"
    if known is None:
        out.blocked.append(f"cast to unknown type {text.strip()}")
        return text
    return f"decimal{m[2]}" if known.startswith("decimal") and m[2] and known != "decimal(20,0)" else known


def _blocks(code: str, source: str, target: str, out: Converted) -> None:
    found = lambda pattern: re.search(pattern, code, re.I)
    if found(r"\bROWNUM\b") and target != "oracle":
        out.blocked.append("ROWNUM")
    if found(r"\(\s*\+\s*\)"):
        out.blocked.append("outer join operator (+)")
    if found(r"\bTOP\s*\(?\s*\d+\s*\)?\s*(PERCENT|WITH\s+TIES)") or found(r"\bSELECT\s+(DISTINCT\s+)?TOP\b") and target != "sqlserver":
        out.blocked.append("TOP")
    if found(r"#>>?|->>?"):
        out.blocked.append("JSON operator")
    if found(r"\b(BEGIN|DECLARE|LOOP|ELSIF|CURSOR)\b"):
        out.blocked.append("procedural body")
    if "||" in code and target == "mysql":
        out.blocked.append("|| is a logical operator in MySQL")
    if target == "sqlserver" and found(r"\bLIMIT\b|\bFETCH\s+FIRST\b"):
        out.blocked.append("row limit without an order")
    if target == "mysql" and found(r"\bCUBE\s*\(|\bGROUPING\s+SETS\b"):
        out.blocked.append("CUBE or GROUPING SETS")
    if target == "oracle" and found(r"\bEXCEPT\s+ALL\b"):
        out.blocked.append("EXCEPT ALL")
    if "::" in code and target not in ("spark", "postgres"):
        out.blocked.append(":: cast")
    if found(r"\b(SYSDATE|CURRENT_DATE|GETDATE\s*\(\s*\))\s*[+-]\s*\d"):
        out.blocked.append("date plus or minus a number")


def convert(sql: str, source: str, target: str = "spark") -> Converted:
    """``sql`` of the ``source`` dialect for ``target``. Text of the same dialect comes back unchanged."""
    out = Converted(sql)
    if source == target:
        return out
    if source not in LEXICONS or target not in FUNCTIONS:
        raise ValueError(f"no rewrite from {source} to {target}")
    body = view_body(sql)
    if source == "mysql" and re.search(r"\\", body):
        out.blocked.append("backslash escape")

    def change(code: str) -> str:
        _blocks(code, source, target, out)
        if target != "spark":
            if target != "oracle":
                code = rewrite_calls(code, "DECODE", lambda a: _decode(a, out))
                code = rewrite_calls(code, "NVL2", lambda a: f"CASE WHEN {a[0]} IS NOT NULL THEN {a[1]} ELSE {a[2]} END" if len(a) == 3 else None)
        if source == "mysql" and target != "spark":
            code = rewrite_calls(code, "ISNULL", lambda a: f"({a[0]} IS NULL)" if len(a) == 1 else None)
        code = rewrite_calls(code, "ISNULL", lambda a: f"coalesce({a[0]}, {a[1]})" if len(a) == 2 and target == "spark" else None)
        code = rewrite_calls(code, "EOMONTH", lambda a: f"LAST_DAY(ADD_MONTHS({a[0]}, {a[1]}))" if len(a) == 2 and target != "sqlserver" else f"LAST_DAY({a[0]})" if len(a) == 1 and target == "spark" else None)
        if source == "mysql":
            code = rewrite_calls(code, "LENGTH", lambda a: f"{'OCTET_LENGTH' if target in ('spark', 'postgres') else 'LENGTHB' if target in ('oracle', 'hana') else 'DATALENGTH' if target == 'sqlserver' else 'LENGTH'}({a[0]})" if len(a) == 1 else None)
        code = rewrite_calls(code, "NOW", lambda a: {"oracle": "SYSTIMESTAMP", "sqlserver": "SYSDATETIME()", "spark": "current_timestamp()"}.get(target) if len(a) == 1 else None)
        for name, new in FUNCTIONS[target].items():
            if new.endswith(")") or " " in new or new.startswith("CURRENT_") or new == "SYSDATE":
                code = re.sub(rf"(?<![\w.$#]){name}\b(\s*\(\s*\))?(?!\s*\()", lambda m, new=new: new, code, flags=re.I)
            else:
                code = re.sub(rf"(?<![\w.$#]){name}(?=\s*\()", new, code, flags=re.I)
        if target == "spark":
            code = rewrite_calls(code, "CAST", lambda a: _cast(a, out, source))
            code = rewrite_calls(code, "CONVERT", lambda a: f"CAST({a[1]} AS {_cast_type(a[0], out)})" if len(a) == 2 and source == "sqlserver" else f"CAST({a[0]} AS {_cast_type(a[1], out)})" if len(a) == 2 else None)
            code = re.sub(r"::\s*([A-Za-z_0-9]+(?:\s*\([^)]*\))?)", lambda m: f"::{_cast_type(m[1], out, source)}", code)
        code = _limits(code, target)
        if target not in ("oracle", "hana", "db2"):
            code = re.sub(r"\s+FROM\s+(?:DUAL|DUMMY|SYSIBM\.SYSDUMMY1)\b", "", code, flags=re.I)
        elif target == "oracle" and source != "oracle":
            code = re.sub(r"\bFROM\s+(?:DUMMY|SYSIBM\.SYSDUMMY1)\b", "FROM DUAL", code, flags=re.I)
        if target == "oracle":
            code = re.sub(r"\bEXCEPT\b", "MINUS", code, flags=re.I)
        elif source == "oracle" and target != "spark":
            code = re.sub(r"\bMINUS\b", "EXCEPT", code, flags=re.I)
        if target != "mysql":
            code = re.sub(r"\bGROUP\s+BY\s+(.+?)\s+WITH\s+ROLLUP\b", lambda m: f"GROUP BY ROLLUP({m[1].strip()})", code, flags=re.I | re.S)
        else:
            code = re.sub(r"\bGROUP\s+BY\s+ROLLUP\s*\(([^()]*)\)", lambda m: f"GROUP BY {m[1]} WITH ROLLUP", code, flags=re.I)
        if target in ("oracle", "sqlserver"):
            code = re.sub(r"\bTRUE\b", "1", re.sub(r"\bFALSE\b", "0", code, flags=re.I), flags=re.I)
        if _FORMATTING.search(code):
            out.warnings.append("a function whose format patterns differ between dialects")
        return code

    out.sql = masked(body, source, change, lambda name: _requoted(name, target))
    return out


def _cast(args: list[str], out: Converted, source: str) -> str | None:
    m = re.fullmatch(r"(.*\S)\s+AS\s+(.+)", ", ".join(args), re.I | re.S)
    return f"CAST({m[1]} AS {_cast_type(m[2], out, source)})" if m else None


def _limits(code: str, target: str) -> str:
    """Row limits in the target's words."""
    n = r"(\d+|\?|:\w+)"
    both = re.compile(rf"\bOFFSET\s+{n}\s+ROWS?\s+FETCH\s+(?:FIRST|NEXT)\s+{n}\s+ROWS?\s+ONLY\b", re.I)
    first = re.compile(rf"\bFETCH\s+(?:FIRST|NEXT)\s+{n}\s+ROWS?\s+ONLY\b", re.I)
    limit = re.compile(rf"\bLIMIT\s+{n}(?:\s+OFFSET\s+{n})?", re.I)
    comma = re.compile(rf"\bLIMIT\s+{n}\s*,\s*{n}", re.I)
    code = comma.sub(r"LIMIT \2 OFFSET \1", code)
    if target in ("spark", "mysql", "postgres", "hana"):
        return first.sub(r"LIMIT \1", both.sub(r"LIMIT \2 OFFSET \1", code))
    if target in ("oracle", "db2"):
        return limit.sub(lambda m: f"{f'OFFSET {m[2]} ROWS ' if m[2] else ''}FETCH FIRST {m[1]} ROWS ONLY", code)
    return code


def page_sql(query: str, dialect: str, size: int, offset: int = 0) -> str:
    """A page of a query, in the words of its dialect."""
    if dialect in ("mysql", "postgres", "hana", "spark"):
        return f"{query} LIMIT {size} OFFSET {offset}"
    if dialect == "sqlserver" and not offset:
        return re.sub(r"(?i)^\s*select\b", f"SELECT TOP ({size})", query, count=1)
    if dialect == "oracle":
        return f"SELECT * FROM (SELECT q_.*, ROWNUM rn_ FROM ({query}) q_ WHERE ROWNUM <= {offset + size}) WHERE rn_ > {offset}"
    return f"{query} OFFSET {offset} ROWS FETCH NEXT {size} ROWS ONLY"


def may_page_by_offset(dialect: str, version: int | None = None) -> bool:
    """Whether a source can skip rows: old versions of two dialects can't, and an unknown version is taken for a new one."""
    least = {"sqlserver": 11, "oracle": 12}.get(dialect, 0)
    return version is None or version >= least


def functions_of(code: str) -> list[str]:
    """Names of called functions, for a report."""
    return sorted({m.upper() for m in re.findall(r"(?<![\w.])([A-Za-z_]\w*)\s*\(", code)})


__all__ = ["Converted", "convert", "page_sql", "view_body", "functions_of", "split_top"]
