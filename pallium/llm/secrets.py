"""Secret scan of whole texts (operator 2).

An Aho-Corasick automaton finds the literal keywords of all rules in one pass
over the text; a rule's regular expression is tried only at the places of its
keywords, anchored there; tokens that carry a checksum are kept only if it
holds. Runs of hexadecimal digits have no keyword: a byte-class table marks
the digits, and a substring search for enough marks in a row finds the places.

A rule's expression can only begin at one of its keywords, so trying the
keyword places in order, each from where the last match ended, gives just the
leftmost non-overlapping matches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import column_of, id_and_text

#: 24 hexadecimal digits in a row or more.
HEX_RUN = 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``keywords`` in lower case; ``pattern`` begins with one of them;
    ``holds`` decides on a match."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]


def checksum_holds(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the secret before them, in base 62."""
    body, stated = m.group(1)[:-6], m.group(1)[-6:]
    value, digits = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == stated


RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII),
         lambda m: len(m.group(2)) >= 6),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
         checksum_holds),
    Rule("npm", ("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), checksum_holds),
)
_HEX = re.compile(r"[0-9a-f]+")
_MARKS = bytes(b in b"0123456789abcdef" for b in range(256))
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n, rule in enumerate(RULES):
        for word in rule.keywords:
            found.add_word(word, (n, len(word)))
    found.make_automaton()
    return found


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as in KINDS."""
    # One byte per code point: what Latin-1 lacks becomes '?', which no keyword holds.
    flat = text.encode("latin-1", "replace")
    found: list[tuple[int, int, str]] = []
    ended = [0] * len(RULES)
    # Keywords of a rule never hold each other, so their ends come in the order of their starts.
    for last, (n, size) in automaton().iter(flat.lower().decode("latin-1")):
        rule, at = RULES[n], last + 1 - size
        if at >= ended[n] and (m := rule.pattern.match(text, at)):
            ended[n] = m.end()
            if rule.holds(m):
                found.append((m.start(), m.end(), rule.kind))
    marks, run = flat.translate(_MARKS), b"\x01" * HEX_RUN
    at = marks.find(run)
    while at >= 0:
        end = _HEX.match(text, at).end()
        found.append((at, end, "hex"))
        at = marks.find(run, end)
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``secrets``, the spans of every row in order.

    Null and empty texts have none; null ids and repeated rows are kept;
    other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_batches, f"doc_id {kind}, secrets {SPAN_TYPE}")


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans(t)] for t in column_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["doc_id", "secrets"])


def _joined(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find_secrets`'s rows."""
    secrets = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(secrets, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(secrets).alias("spans"))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every found span, overlapping ones as one, replaced."""
    out, at = [], 0
    for start, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted(texts: Column) -> Column:
    """Texts with their secrets replaced; null stays null."""
    return F.pandas_udf(_redact_series, "string")(texts)


def _redact_series(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")
