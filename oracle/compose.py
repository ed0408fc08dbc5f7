"""Statement composition: pulls in the CTEs a statement names and casts its output columns."""
import re

CTES: dict[str, str] = {}
ORACLE: dict[str, str] = {}
TYPES = {"i": "BIGINT", "f": "DOUBLE", "d": "DATE", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP"}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def _needed(text: str, seen: list[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", text):
            body = CTES[name]
            _needed(body, seen)
            if name not in seen:
                seen.append(name)


def compose(body: str, columns: str) -> str:
    used: list[str] = []
    _needed(body, used)
    casts = ", ".join(f"CAST({c.split(':')[0]} AS {TYPES[c.split(':')[1]]}) AS {c.split(':')[0]}" for c in columns.split())
    parts = [f"{n} AS ({CTES[n]})" for n in used]
    head = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
    return f"{head}SELECT {casts} FROM ({body}) AS result"


def oracle(key: str, columns: str, body: str) -> None:
    ORACLE[key] = compose(body, columns)
