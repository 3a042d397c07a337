"""Detection patterns, entity names and token format.

Everything in the block marked FIXED VALUES must stay equal to the behaviour we
reproduce: the seven patterns, their cascade order, the span-path entity names
and the token layout. They are written out plainly, in their natural order.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced behaviour; do not reorder)
# ---------------------------------------------------------------------------

# Cascade order: (entity type, pattern). Each stage runs on the output of the
# previous one.
CASCADE_PATTERNS: list[tuple[str, str]] = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("URL", r"https?://[^\s]+"),
    ("PERSON", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
]

# Entity names accepted on the span path (detector output), English only.
SPAN_ENTITY_TYPES: list[str] = [
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD",
    "US_SSN", "US_DRIVER_LICENSE", "DATE_TIME", "LOCATION",
    "IP_ADDRESS", "URL", "US_BANK_NUMBER", "IBAN_CODE",
]

# Token layout: "[PII_" + entity type + "_" + number + "]".
TOKEN_PREFIX = "[PII_"
TOKEN_SUFFIX = "]"

# Cleaning: control characters replaced by a space (tab, LF, CR excluded).
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"

# Library default label for inline text.
DEFAULT_INLINE_LABEL = "direct_input"

# File suffixes accepted, and which reader handles them.
PAGED_SUFFIXES = [".pdf"]
TEXT_SUFFIXES = [".txt", ".text"]

# Messages.
MSG_UNSUPPORTED_SUFFIX = "Unsupported file type: "  # followed by the suffix
MSG_FILE_NOT_FOUND = "File not found: "  # followed by the path
MSG_BLANK_FILE = "No text content found in the document"
MSG_BLANK_TEXT = "No text content provided"
MSG_BAD_ANSWER = "Failed to parse JSON response"
MSG_CALL_FAILED = "API call failed: "  # followed by the last error

# Summary defaults: missing text fields show this word, parties are joined by
# comma and space.
SUMMARY_DEFAULT = "Unknown"
SUMMARY_PARTY_SEPARATOR = ", "

# Page assembly: non-empty pages joined by one blank line.
PAGE_SEPARATOR = "\n\n"

# Paging default of the library.
DEFAULT_PAGE_SIZE = 100

# Analyzer calls: attempts, and bounds of the exponential wait in seconds.
ANALYZE_ATTEMPTS = 3
ANALYZE_WAIT_MIN = 4.0
ANALYZE_WAIT_MAX = 10.0

# Sections of an answer, in order.
ANSWER_SECTIONS = [
    "key_dates_and_events", "date_dependencies", "simplified_clauses",
    "benefit_analysis", "contract_summary", "risk_assessment",
]

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

# Java regex needs the Unicode flag so that \b, \w, \d and \s classify
# characters like Python's str patterns do (an accented letter is a word
# character).
UNICODE_FLAG = "(?U)"

CASCADE_TYPES: list[str] = [t for t, _ in CASCADE_PATTERNS]


# Python's word characters: what str.isalnum() accepts (letters and every
# kind of number) plus the underscore. Java's (?U)\w differs: it adds
# combining marks and leaves out non-decimal numbers such as superscripts.
PY_WORD = r"[\p{L}\p{N}_]"
# Python's \b, spelled with that class for Java.
PY_BOUNDARY = f"(?:(?<={PY_WORD})(?!{PY_WORD})|(?<!{PY_WORD})(?={PY_WORD}))"
# Where one side of a \b is known to be a word character, one lookaround
# decides it; that is exact and several times cheaper than the full form.
NOT_AFTER_WORD = f"(?<!{PY_WORD})"
NOT_BEFORE_WORD = f"(?!{PY_WORD})"
# A \b before these (a mandatory first character that is a word character)
# or after these (a last character that is one).
_WORD_START = re.compile(r"^(?:\[A-Z\]|\\d|\(\?:\\d|\(\?:\[0-9\])")
_SINGLE_CLASS = re.compile(r"^(\[[^\]]+\])(?![*+?{])")
_WORD_END = re.compile(r"(?:\[a-z\]\+|\\d\{\d+(?:,\d+)?\}|\[0-9\]\{\d+(?:,\d+)?\})$")


def to_java(pattern: str) -> str:
    r"""A pattern in Python's regex dialect, for Java: the Unicode flag makes
    \d, \s and classes Unicode-aware as in Python, and each \b becomes
    Python's word boundary -- the one construct whose meaning differs (Java's
    (?U)\b counts combining marks as word characters and superscript digits
    as not). A leading or trailing \b next to a token of word characters
    needs only one lookaround; any other \b gets the full form."""
    lead = trail = ""
    body = pattern
    if body.startswith(r"\b"):
        body = body[2:]
        lead = NOT_AFTER_WORD if _WORD_START.match(body) else PY_BOUNDARY
    if body.endswith(r"\b"):
        body = body[:-2]
        trail = NOT_BEFORE_WORD if _WORD_END.search(body) else PY_BOUNDARY
    body = body.replace(r"\b", PY_BOUNDARY)
    first = _SINGLE_CLASS.match(body)
    if lead == NOT_AFTER_WORD and first:
        # Test the character class first and look behind it: the engine tries
        # the first node at every position, and a plain class fails there
        # far faster than a lookbehind over Unicode properties.
        cls = first.group(1)
        return UNICODE_FLAG + cls + f"(?<!{PY_WORD}{cls})" + body[len(cls):] + trail
    return UNICODE_FLAG + lead + body + trail


def java_pattern(entity_type: str) -> str:
    """Pattern of a cascade entity type, ready for Spark's Java regex."""
    return to_java(dict(CASCADE_PATTERNS)[entity_type])


# Same entity on the two paths has different names; this maps the cascade
# name to the span-path name (used when cascade hits are relabelled as spans).
CASCADE_TO_SPAN_TYPE: dict[str, str] = {
    "EMAIL": "EMAIL_ADDRESS",
    "PHONE": "PHONE_NUMBER",
    "SSN": "US_SSN",
    "CREDIT_CARD": "CREDIT_CARD",
    "IP_ADDRESS": "IP_ADDRESS",
    "URL": "URL",
    "PERSON": "PERSON",
}
