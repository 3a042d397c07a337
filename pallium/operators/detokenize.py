"""Detokenization (T1-T3): put original values back in place of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pallium.functions.jsonx import is_strict_json

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: A token anywhere in a text.
TOKEN = r"\[PII_[^\[\]\x01]+_[1-9][0-9]*\]"
#: Values, each followed by U+0002, that could make a token together with what
#: comes to stand beside them.
HAZARD = r"(?:^|\x02)(?:PII|II|I)?_|\[(?:P(?:I(?:I(?:_[^\[\]\x02]*)?)?)?)?\x02"
#: Tokens in the values of tokens are followed so deep in one pass after another.
LEVELS = 8


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


# The steps as SQL over x (t: text, e: entries), s (entries sorted by type and
# number) and f (where each type begins in s): parsed in one go, a plan of as
# many column objects would take longer to build than to run.
_ODD = "i % 2 = 1"
_WITHIN = "contains({0}, '[PII_')"


def _parsed(token: str, use: str) -> str:
    """Type and number of a token as q.k, q.n."""
    return _let("tl", f"substring_index({token}, '_', -1)", _let(
        "q", f"named_struct('k', substr({token}, 6, length({token}) - length(tl) - 6), "
             "'n', try_cast(substr(tl, 1, length(tl) - 1) AS INT))", use))


def _entry(token: str) -> str:
    """A token's entry in s, or null."""
    at = "get(filter(f, z -> z.k = q.k), 0).i + q.n - 1"
    return _parsed(token, _let("c", f"get(s, {at})", "CASE WHEN c.k = q.k AND c.n = q.n THEN c END"))


def _pieces(text: str) -> str:
    """Alternately what stands between tokens, and tokens."""
    return f"split(regexp_replace({text}, {_sql(TOKEN)}, concat(char(1), '$0', char(1))), char(1), -1)"


def _strays(pieces: str) -> str:
    """Whether something that begins like a token stands between tokens."""
    return f"exists(filter({pieces}, (p, i) -> i % 2 = 0), p -> {_WITHIN.format('p')})"


def _replaced(pieces: str) -> str:
    return f"array_join(transform({pieces}, (p, i) -> CASE WHEN {_ODD} THEN coalesce({_entry('p')}.v, p) ELSE p END), '')"


def _restored(reverse: bool) -> str:
    """The text of ``x`` with its tokens replaced."""
    order = "reverse(x.e)" if reverse else "x.e"
    one_by_one = f"aggregate({order}, x.t, (acc, y) -> replace(acc, y.token, y.value))"
    numbered = (f"transform(x.e, (y, i) -> " + _parsed("y.token", (
        "named_struct('k', q.k, 'n', q.n, 'at', i, 'v', y.value, 'ok', "
        f"coalesce(y.token RLIKE {_sql('^' + TOKEN + '$')} AND q.n IS NOT NULL AND y.value IS NOT NULL, false))")) + ")")
    follows = ("transform(s, (y, i) -> y.ok AND y.n = CASE WHEN i > 0 AND get(s, i - 1).k = y.k THEN get(s, i - 1).n + 1 ELSE 1 END)")
    safe = (f"forall({follows}, ok -> ok) AND NOT contains(x.t, char(1)) AND NOT "
            f"concat(array_join(transform(s, y -> y.v), char(2)), char(2)) RLIKE {_sql(HAZARD)}")
    first = "filter(transform(s, (y, i) -> named_struct('k', y.k, 'i', i, 'n', y.n)), y -> y.n = 1)"
    # Tokens in a value come before its own in the mapping.
    inner_ok = _let("vp", _pieces("y.v"), (
        f"NOT contains(y.v, char(1)) AND NOT {_strays('vp')} AND "
        f"forall(filter(vp, (p, i) -> {_ODD}), p -> coalesce({_entry('p')}.at < y.at, true))"))
    once = _replaced("ps")
    if reverse:
        deeper = (f"aggregate(sequence(1, {LEVELS}), {once}, (acc, l) -> CASE WHEN {_WITHIN.format('acc')} "
                  f"THEN {_replaced(_pieces('acc'))} ELSE acc END)")
        left = f"exists(filter({_pieces('o')}, (p, i) -> {_ODD}), p -> {_entry('p')} IS NOT NULL)"
        deep = _let("o", deeper, f"CASE WHEN {left} THEN {one_by_one} ELSE o END")
    else:
        deep = once
    passed = (f"CASE WHEN {_strays('ps')} THEN {one_by_one} WHEN size(nested) = 0 THEN {once} "
              f"WHEN forall(nested, y -> {inner_ok}) THEN {deep} ELSE {one_by_one} END")
    body = _let("f", first, _let("nested", f"filter(s, y -> {_WITHIN.format('y.v')})", _let("ps", _pieces("x.t"), passed)))
    none = f"NOT {_WITHIN.format('x.t')} AND forall(x.e, y -> startswith(y.token, '[PII_'))"
    return (f"CASE WHEN size(x.e) = 0 THEN x.t WHEN {none} THEN x.t ELSE "
            + _let("s", f"array_sort({numbered})", f"CASE WHEN {safe} THEN {body} ELSE {one_by_one} END") + " END")


def detokenize(text: ColumnOrName, entries: ColumnOrName, reverse: bool = False) -> Column:
    """Replace each token by its value, in mapping order.

    ``entries`` is the ordered ``array<struct<token, value, ...>>``. Insertion
    order reproduces the reference result, where a value that itself holds an
    earlier token (a link that swallowed an e-mail token) keeps that token;
    ``reverse=True`` expands such nested tokens too and restores the text
    exactly. Tokens without an entry stay as they are (drop entries first for
    a partial restore).

    One pass over the text for all types: it is split at its tokens, and the
    values are fetched by type and number from the entries sorted that way, so
    time is linear in text and tokens. Nested tokens are expanded by as many
    further passes as they are deep. That equals replacing token by token
    unless numbers have gaps, a value holds a token that comes after its own
    in the mapping, or values and text could make up a new token between them;
    such rows are replaced token by token.
    """
    given = F.array(F.struct(_col(text).alias("t"), _col(entries).alias("e")))
    return F.get(F.call_function("transform", given, F.expr(f"x -> {_restored(reverse)}")), 0)


def without_types(entries: ColumnOrName, types: list[str]) -> Column:
    """T2 helper: drop the entries of some entity types."""
    return F.filter(_col(entries), lambda x: ~x["entity_type"].isin(*types))


def detokenize_json(answer: ColumnOrName, entries: ColumnOrName, escape: bool = False) -> Column:
    """Detokenize a serialized JSON answer; if the result no longer parses
    as strict JSON, the answer is returned untouched.

    Keys are replaced too (the whole serialization is rewritten). With
    ``escape=True`` values are JSON-escaped before insertion, so a value with
    a quote or backslash keeps the answer valid.
    """
    e = _col(entries)
    if escape:
        e = F.transform(
            e,
            lambda x: x.withField(
                "value", F.regexp_replace(F.to_json(F.array(x["value"])), r'^\["|"\]$', "")
            ),
        )
    # Bound once: detokenized, then checked.
    return F.get(F.transform(F.array(detokenize(answer, e)), lambda x: F.when(is_strict_json(x), x).otherwise(_col(answer))), 0)


def token_collisions(text: ColumnOrName) -> Column:
    """L3: the source already holds something shaped like a token (it would
    be replaced on detokenizing). The regex runs only on texts holding the
    token prefix."""
    t = _col(text)
    return t.contains("[PII_") & t.rlike(r"\[PII_[A-Z_]+_[0-9]+\]")
