"""Strict JSON checks and answer parsing helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: No limits on string length, number length or depth, which the parser has by
#: default; and no syntax beyond JSON.
UNLIMITED = {"maxStringLen": "2147483647", "maxNumLen": "2147483647", "maxNestingDepth": "2147483647"}
STRICT = UNLIMITED | {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def is_strict_json(c: ColumnOrName) -> Column:
    """True when the whole string is exactly one JSON value, of any size and
    depth.

    The string is put in two places, as a member of an object, ``{"a":s,"b":1}``,
    and as an element of an array, ``{"a":[s],"b":1}``, and only ``b`` is asked
    for: the parser then checks all else and skips it, without building text
    (whose writer has a limit on depth) or recursion. Both must give 1. What
    may follow a value differs in the two places, ``:`` after a further string
    in the object alone, ``]`` or a further value in the array alone, ``}`` in
    the object alone; so a string that fits both is one value. Duplicate keys
    are valid, as in Python, whatever the session's settings. Null input gives
    false.
    """
    s = _col(c)
    member, element = (F.from_json(F.concat(F.lit(head), s, F.lit(tail)), "b int", STRICT)["b"]
                       for head, tail in (('{"a":', ',"b":1}'), ('{"a":[', '],"b":1}')))
    return F.coalesce((member == 1) & (element == 1), F.lit(False))
