"""Column functions for text cleaning, decoding and labels.

Every function takes and returns a Column and compiles to built-in Catalyst
expressions, so the work stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pallium.functions.patterns import CONTROL_CHARS, UNICODE_FLAG

ColumnOrName = Column | str

# Python's str.isspace() set is Java's (?U)\s plus the four information
# separators 1C-1F. Used where raw (not yet control-stripped) text is collapsed.
PY_WHITESPACE_CLASS = r"[\s\x1c-\x1f]"

# C1 and C2 fused: a run made of whitespace and control characters becomes one
# space. Replacing each control character by a space and then collapsing
# whitespace runs gives exactly this, in one regex pass instead of two.
_CLEAN_RUN = UNICODE_FLAG + r"[\s\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]+"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_to_empty(c: ColumnOrName) -> Column:
    """C4: null becomes the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def strip_control(c: ColumnOrName) -> Column:
    """Each control character (tab, LF and CR excepted) becomes a space."""
    return F.regexp_replace(_col(c), CONTROL_CHARS, " ")


def collapse_whitespace(c: ColumnOrName) -> Column:
    """Each run of (Unicode) whitespace becomes one space."""
    return F.regexp_replace(_col(c), UNICODE_FLAG + PY_WHITESPACE_CLASS + "+", " ")


def strip_ends(c: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(_col(c), UNICODE_FLAG + f"^{ws}+|{ws}+$", "")


def clean_text(c: ColumnOrName) -> Column:
    """Null to empty, control characters to spaces, whitespace runs to one
    space, ends trimmed. Output is one line; only U+0020 can be left at the
    ends, so the built-in trim suffices."""
    return F.trim(F.regexp_replace(null_to_empty(c), _CLEAN_RUN, " "))


def is_blank(c: ColumnOrName) -> Column:
    """C6 predicate: nothing but whitespace (or null)."""
    return clean_text(c) == F.lit("")


def char_count(c: ColumnOrName) -> Column:
    """Length in code points, as a bigint."""
    return F.char_length(_col(c)).cast("bigint")


def short_label(c: ColumnOrName, width: int = 50) -> Column:
    """First ``width`` characters and an ellipsis, always appended."""
    return F.concat(F.substring(_col(c), 1, width), F.lit("..."))


def decode_bytes(c: ColumnOrName) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else ISO-8859-1.

    Never a bare ``decode(..., 'UTF-8')``, which fails the whole job on a bad
    byte sequence."""
    raw = _col(c)
    as_utf8 = raw.cast("string")
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(
        F.is_valid_utf8(as_utf8), as_utf8
    ).otherwise(F.decode(raw, "ISO-8859-1"))


def file_suffix(c: ColumnOrName) -> Column:
    """S2 helper: lower-cased suffix of a path or file name (``''`` if none).

    As for a POSIX path suffix: only the last ``/``-separated component
    counts, a leading dot (hidden file) is not a suffix, and neither is a
    trailing dot."""
    name = F.regexp_extract(_col(c), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
