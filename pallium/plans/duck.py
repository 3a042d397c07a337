"""DuckDB mirrors of the Spark expressions, used to write the oracle SQL.

DuckDB's regex engine differs from Java's: its classes are ASCII-only and
``(?U)`` means "ungreedy" there. The mirrors below therefore spell out the
Python whitespace set, leave the Unicode flag out, and guard accented
letters for the PERSON pattern (see ``guard_letters``).
"""

from __future__ import annotations

from pallium.functions.patterns import CASCADE_PATTERNS, CASCADE_TYPES

# Python's str.isspace() set, written out for an ASCII regex engine.
PY_SPACE = (
    r"\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f"
# A letter outside ASCII: a word character for Python, not for DuckDB.
WIDE_LETTER = r"[^\P{L}\x00-\x7F]"

SENT = "chr(1)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), {q('[' + PY_SPACE + CONTROL + ']+')}, ' ', 'g'))"


def strip_control(expr: str) -> str:
    return f"regexp_replace({expr}, {q('[' + CONTROL + ']')}, ' ', 'g')"


def collapse_ws(expr: str) -> str:
    return f"regexp_replace({expr}, {q('[' + PY_SPACE + ']+')}, ' ', 'g')"


def strip_ends(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^[' + PY_SPACE + ']+|[' + PY_SPACE + ']+$')}, '', 'g')"


def guard_letters(expr: str) -> str:
    """Wrap each non-ASCII letter as ``_x_`` so that ASCII ``\\b`` sees a word
    character next to it, as Python does."""
    return f"regexp_replace({expr}, {q('(' + WIDE_LETTER + ')')}, '_\\1_', 'g')"


def unguard_letters(expr: str) -> str:
    return f"regexp_replace({expr}, {q('_(' + WIDE_LETTER + ')_')}, '\\1', 'g')"


def pattern(entity_type: str) -> str:
    return dict(CASCADE_PATTERNS)[entity_type]


def detect(expr: str, entity_type: str) -> str:
    """All matches of one pattern on ``expr`` (list of strings)."""
    if entity_type == "PERSON":
        return (
            f"list_transform(regexp_extract_all({guard_letters(expr)}, {q(pattern(entity_type))}), "
            f"lambda v: {unguard_letters('v')})"
        )
    return f"regexp_extract_all({expr}, {q(pattern(entity_type))})"


ENTRY_SQL_TYPE = "STRUCT(entity_type VARCHAR, n BIGINT, token VARCHAR, value VARCHAR)[]"


def cascade_ctes(source: str, key_cols: list[str], text_expr: str, prefix: str = "c",
                 types: list[str] | None = None) -> tuple[str, str]:
    """CTE chain tokenizing ``text_expr`` of ``source``.

    Returns ``(ctes, last_cte)``; the last CTE has ``key_cols``, ``t`` (the
    tokenized text) and ``entries`` (token-issue order)."""
    keys = ", ".join(key_cols)
    wanted = [t for t in CASCADE_TYPES if types is None or t in types]
    ctes = [f"{prefix}0 AS (SELECT {keys}, {text_expr} AS t, []::{ENTRY_SQL_TYPE} AS entries FROM {source})"]
    prev = f"{prefix}0"
    for k, et in enumerate(wanted, start=1):
        src = "t" if et != "PERSON" else guard_letters("t")
        marked = (
            f"string_split(regexp_replace({src}, {q(pattern(et))}, {SENT} || '\\0' || {SENT}, 'g'), {SENT})"
        )
        ctes.append(f"{prefix}{k}p AS (SELECT {keys}, t, entries, {marked} AS parts FROM {prev})")
        tok = lambda num: f"'[PII_{et}_' || CAST({num} AS VARCHAR) || ']'"
        n = "((len(parts) - 1) // 2)"
        rebuilt = (
            f"array_to_string(list_transform(parts, lambda s, i: CASE WHEN i % 2 = 1 THEN s "
            f"ELSE {tok(f'{n} - (i - 2) // 2')} END), '')"
        )
        if et == "PERSON":
            rebuilt = unguard_letters(rebuilt)
            value = unguard_letters("v")
        else:
            value = "v"
        new_entries = (
            f"list_transform(list_reverse(list_filter(parts, lambda s, i: i % 2 = 0)), "
            f"lambda v, j: {{'entity_type': '{et}', 'n': j, 'token': {tok('j')}, 'value': {value}}})"
        )
        ctes.append(
            f"{prefix}{k} AS (SELECT {keys}, "
            f"CASE WHEN len(parts) <= 1 THEN t ELSE {rebuilt} END AS t, "
            f"CASE WHEN len(parts) <= 1 THEN entries ELSE list_concat(entries, {new_entries}) END AS entries "
            f"FROM {prefix}{k}p)"
        )
        prev = f"{prefix}{k}"
    return ",\n".join(ctes), prev
