"""Building blocks for the SQL checks: named CTEs that may refer to each other."""

from __future__ import annotations

import re

from pkgscreen import vocab as v
from pkgscreen.plans import fixtures

CTES: dict[str, str] = {name: fixtures.check_sql(name) for name in fixtures.SQL}
CHECKS: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def check(key: str, sql: str, recursive: bool = False) -> None:
    """Register the check of a query key; CTEs named as ``[[name]]`` are added."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\[\[(\w+)\]\]", text):
            if name not in order:
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(sql)
    plain = lambda text: re.sub(r"\[\[(\w+)\]\]", r"\1", text)
    head = ",\n".join(f"{n} AS ({plain(CTES[n])})" for n in order)
    word = "WITH RECURSIVE" if recursive or {"chunk_steps", "chain_steps"} & {*order} else "WITH"
    CHECKS[key] = (f"{word} {head}\n" if head else "") + plain(sql)


def m(pattern: str, col: str = "text", cs: bool = False) -> str:
    return f"regexp_matches({col}, '{pattern}'" + (")" if cs else ", 'i')")


def x(pattern: str, group: int = 1, col: str = "text", cs: bool = False) -> str:
    return f"nullif(regexp_extract({col}, '{pattern}', {group}" + ("), '')" if cs else ", 'i'), '')")


def words(items: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in items)


def strip(col: str = "text") -> str:
    return f"regexp_replace({col}, '^{v.WS}+|{v.WS}+$', '', 'g')"


def lst(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def values(rows: list[tuple], cols: str) -> str:
    def cell(c):
        if c is None:
            return "NULL"
        if isinstance(c, bool):
            return str(c).lower()
        if isinstance(c, (int, float)):
            return repr(c)
        return "'" + str(c).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(cell(c) for c in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({cols})"
