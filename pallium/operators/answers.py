"""Prompts, answer parsing, answer schema, flattening, summaries and outcome
envelopes (A1, A3-A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pallium.functions.jsonx import UNLIMITED, is_strict_json
from pallium.functions.patterns import (
    ANSWER_SECTIONS,
    MSG_BAD_ANSWER,
    SUMMARY_DEFAULT,
    SUMMARY_PARTY_SEPARATOR,
)

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A1 -------------------------------------------------------------------------
# Our own wording; only the six section names and their fields are shared.
PROMPT_HEAD = (
    "Review the document below and answer with a single JSON object.\n\n"
    "Document:\n"
)
PROMPT_TAIL = """

Use exactly these top-level keys:
- "key_dates_and_events": list of {"date", "event", "importance" (high, medium or low), "dependencies": list}
- "date_dependencies": list of {"dependent_event", "dependency", "relationship"}
- "simplified_clauses": list of {"original_clause", "simplified", "key_points": list}
- "benefit_analysis": list of {"clause", "benefits_party" (buyer, seller, both or neutral), "explanation", "risk_level" (high, medium or low)}
- "contract_summary": {"contract_type", "main_parties": list, "primary_purpose", "key_obligations": list, "termination_conditions": list, "governing_law"}
- "risk_assessment": {"high_risk_items": list, "medium_risk_items": list, "recommendations": list}

Placeholders such as [PII_PERSON_1] stand for withheld values: copy them unchanged.
Answer with JSON only.
"""


def build_prompt(tokenized: ColumnOrName) -> Column:
    """A1: the prompt around the tokenized text; tokens pass unchanged."""
    return F.concat(F.lit(PROMPT_HEAD), _col(tokenized), F.lit(PROMPT_TAIL))


# A4 -------------------------------------------------------------------------
_S = T.StringType()
_LS = T.ArrayType(_S)


def _struct(*names: str, lists: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, _LS if n in lists else _S, True) for n in names])


ANSWER_SCHEMA = T.StructType(
    [
        T.StructField(
            "key_dates_and_events",
            T.ArrayType(_struct("date", "event", "importance", "dependencies", lists=("dependencies",))),
        ),
        T.StructField("date_dependencies", T.ArrayType(_struct("dependent_event", "dependency", "relationship"))),
        T.StructField(
            "simplified_clauses",
            T.ArrayType(_struct("original_clause", "simplified", "key_points", lists=("key_points",))),
        ),
        T.StructField(
            "benefit_analysis", T.ArrayType(_struct("clause", "benefits_party", "explanation", "risk_level"))
        ),
        T.StructField(
            "contract_summary",
            _struct(
                "contract_type", "main_parties", "primary_purpose", "key_obligations",
                "termination_conditions", "governing_law",
                lists=("main_parties", "key_obligations", "termination_conditions"),
            ),
        ),
        T.StructField(
            "risk_assessment",
            _struct(
                "high_risk_items", "medium_risk_items", "recommendations",
                lists=("high_risk_items", "medium_risk_items", "recommendations"),
            ),
        ),
    ]
)
assert [f.name for f in ANSWER_SCHEMA.fields] == ANSWER_SECTIONS


# A3 -------------------------------------------------------------------------
def error_record(raw: ColumnOrName) -> Column:
    """The record kept for an answer that is not JSON: ``{error, raw_content}``."""
    return F.to_json(F.struct(F.lit(MSG_BAD_ANSWER).alias("error"), _col(raw).alias("raw_content")))


def parse_answer(df: DataFrame, raw_col: str = "raw", prefix: str = "") -> DataFrame:
    """A3: strict parse of the analyzer's raw answer.

    Adds ``parse_ok``; ``answer_json`` (the raw text when it is one JSON
    value, else the ``{error, raw_content}`` record -- still a success, as in
    the reference); and ``answer`` parsed with the section schema (A4; extra
    keys ignored, missing ones null). A null raw answer is a failed call, not
    a parse failure, and is left to the caller.
    """
    ok = is_strict_json(raw_col)
    raw = F.col(raw_col)
    answer_json = F.when(ok, raw).otherwise(error_record(raw))
    return (
        df.withColumn(prefix + "parse_ok", ok)
        .withColumn(prefix + "answer_json", answer_json)
        .withColumn(prefix + "answer", F.when(ok, F.from_json(raw, ANSWER_SCHEMA, UNLIMITED)))
    )


# A5 -------------------------------------------------------------------------
def flatten_section(df: DataFrame, keys: list[str], section: Column, pos: str = "pos") -> DataFrame:
    """A5: one row per element of an answer section, order kept in ``pos``;
    documents with an empty or missing section keep one row with nulls."""
    return df.select(*keys, F.posexplode_outer(section).alias(pos, "item")).select(
        *keys, F.col(pos).cast("bigint").alias(pos), "item.*"
    )


def _section_rows(answer: Column) -> Column:
    """The rows that an answer has in all six tables, as one array."""
    kinds = {f.name: f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType for f in ANSWER_SCHEMA.fields}

    def row(name: str, pos: Column, item: Column) -> Column:
        items = [(item if other == name else F.lit(None)).cast(kind).alias(other) for other, kind in kinds.items()]
        return F.struct(F.lit(name).alias("section"), pos.cast("bigint").alias("pos"), *items)

    none, rows = F.lit(None), []
    for field in ANSWER_SCHEMA.fields:
        name, section = field.name, answer[field.name]
        if isinstance(field.dataType, T.ArrayType):
            made = F.transform(section, lambda item, pos: row(name, pos, item))
            rows.append(F.when(F.size(section) > 0, made).otherwise(F.array(row(name, none, none))))
        else:
            rows.append(F.array(row(name, none, section)))
    return F.concat(*rows)


def answer_tables(parsed: DataFrame, keys: list[str], answer_col: str = "answer",
                  together: bool = False) -> dict[str, DataFrame] | DataFrame:
    """A5 for every section: one child table per section, keyed by ``keys``.

    The four list sections give one row per element (``pos`` keeps the
    order; documents without the section keep one all-null row). The two
    object sections give one row per document with their fields as columns
    (lists stay arrays). Each table is a projection of ``parsed``: no
    shuffle. ``together`` gives the rows of all tables as one DataFrame, made
    in one pass over ``parsed``: ``keys``, ``section``, ``pos`` and a struct
    per section, null but for the row's own.
    """
    a = F.col(answer_col)
    if together:
        return parsed.select(*keys, F.explode(_section_rows(a)).alias("row")).select(*keys, "row.*")
    out: dict[str, DataFrame] = {}
    for field in ANSWER_SCHEMA.fields:
        section = a[field.name]
        if isinstance(field.dataType, T.ArrayType):
            out[field.name] = flatten_section(parsed, keys, section)
        else:
            out[field.name] = parsed.select(*keys, *[section[f.name].alias(f.name) for f in field.dataType.fields])
    return out


# A6 -------------------------------------------------------------------------
def summary_view(summary: ColumnOrName) -> list[Column]:
    """Type and purpose default to ``Unknown``; parties joined by ``, ``.
    A null field counts as missing."""
    s = _col(summary)
    return [
        F.coalesce(s["contract_type"], F.lit(SUMMARY_DEFAULT)).alias("contract_type"),
        F.array_join(F.coalesce(s["main_parties"], F.array().cast("array<string>")), SUMMARY_PARTY_SEPARATOR).alias(
            "parties"
        ),
        F.coalesce(s["primary_purpose"], F.lit(SUMMARY_DEFAULT)).alias("purpose"),
    ]


# A7 -------------------------------------------------------------------------
def outcome_envelope(error: ColumnOrName, entity_count: ColumnOrName, contract_id: Column | None = None,
                     analysis: Column | None = None) -> list[Column]:
    """``success`` and either the result fields or the error message."""
    err = _col(error)
    ok = err.isNull()
    cols = [
        ok.alias("success"),
        F.when(ok, _col(entity_count).cast("bigint")).alias("pii_entities_found"),
        err.alias("error"),
    ]
    if contract_id is not None:
        cols.append(F.when(ok, contract_id).alias("contract_id"))
    if analysis is not None:
        cols.append(F.when(ok, analysis).alias("analysis"))
    return cols


# A8 -------------------------------------------------------------------------
def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Rows and entities per (success, error); partial aggregation
    map-side, one small shuffle."""
    return outcomes.groupBy("success", "error").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("pii_entities_found"), F.lit(0)).cast("bigint").alias("n_entities"),
    )
