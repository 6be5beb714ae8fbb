"""Helpers that spell DuckDB SQL for the oracles."""

from __future__ import annotations

from ..functions import lexicons as lx
from .views import MESSAGES_SQL

M = f"m AS ({MESSAGES_SQL})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str, screener: bool = False) -> str:
    gone = f"regexp_replace({x}, '[{lx.ZERO_WIDTH}{lx.TAGS if screener else ''}]', '', 'g')"
    return f"lower(translate({gone}, {q(lx.FULL_WIDTH + (lx.LOOKALIKES_FROM if screener else ''))}, {q(lx.HALF_WIDTH + (lx.LOOKALIKES_TO if screener else ''))}))"


def spaced(x: str, screener: bool = False) -> str:
    out = f"regexp_replace({x}, '[{lx.ZERO_WIDTH}{lx.TAGS if screener else ''}]', ' ', 'g')"
    out = f"translate({out}, {q(lx.FULL_WIDTH + (lx.LOOKALIKES_FROM if screener else ''))}, {q(lx.HALF_WIDTH + (lx.LOOKALIKES_TO if screener else ''))})"
    return f"lower(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


def has(forms: list[str] | str, term: str) -> str:
    forms = [forms] if isinstance(forms, str) else forms
    return "(" + " OR ".join(f"contains({f}, {q(term)})" for f in forms) + ")"


def any_of(forms: list[str] | str, terms: list[str]) -> str:
    return "(" + " OR ".join(has(forms, t) for t in terms) + ")"


def count_of(forms: list[str] | str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST({has(forms, t)} AS INT)" for t in terms) + ")"


def array(terms: list[str]) -> str:
    return "[" + ", ".join(map(q, terms)) + "]"


def normed(extra: str = "*") -> str:
    """Messages with the two normal forms of body (b1, b2) and subject (s1, s2)."""
    return f"{M}, n AS (SELECT {extra}, {norm('body')} AS b1, {spaced('body')} AS b2, {norm('subject')} AS s1, {spaced('subject')} AS s2 FROM m)"


def domain(x: str) -> str:
    return f"nullif(lower(trim(regexp_extract({x}, '@([^@>]*)>?\\s*$', 1))), '')"
