"""Registered queries for prompts, answers, outcomes and the text flow
(A1, A3, A5-A8, P1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pallium.functions.patterns import MSG_BAD_ANSWER, MSG_BLANK_TEXT
from pallium.operators import answers as an
from pallium.operators import cascade as cz
from pallium.plans import duck
from pallium.plans.duck import q
from pallium.plans.flows import ECHO, TOKEN_SHAPE, analyze_texts
from pallium.plans.pii_queries import _DOC_CTES, _DOC_LAST, tokenized_documents
from pallium.plans.registry import query
from pallium.session import spread, table


# A1 -------------------------------------------------------------------------
@query(
    "build_prompt",
    f"""WITH {_DOC_CTES}
SELECT doc_id, {q(an.PROMPT_HEAD)} || t || {q(an.PROMPT_TAIL)} AS prompt FROM {_DOC_LAST}""",
)
def q_build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized_documents(spark, sf_dir).select("doc_id", an.build_prompt("tokenized_text").alias("prompt"))


# A3: answers damaged by event_id rules ----------------------------------------
_RAW_SQL = (
    "CASE event_id % 5 WHEN 0 THEN substr(props, 1, length(props) - 2) WHEN 1 THEN '' "
    "WHEN 2 THEN props || ' trailing' ELSE props END"
)


@query(
    "parse_answer",
    f"""SELECT event_id, json_valid(raw) AS parse_ok,
       CASE WHEN json_valid(raw) THEN raw ELSE CAST(to_json({{'error': {q(MSG_BAD_ANSWER)}, 'raw_content': raw}}) AS VARCHAR) END AS answer_json,
       CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.k') END AS k
FROM (SELECT event_id, {_RAW_SQL} AS raw FROM events)""",
)
def q_parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    k = F.col("event_id") % 5
    p = F.col("props")
    raw = (
        F.when(k == 0, F.substring(p, F.lit(1), F.char_length(p) - 2))
        .when(k == 1, F.lit(""))
        .when(k == 2, F.concat(p, F.lit(" trailing")))
        .otherwise(p)
    )
    parsed = an.parse_answer(e.select("event_id", raw.alias("raw")), "raw")
    value = F.when(F.col("parse_ok"), F.try_variant_get(F.try_parse_json("raw"), "$.k", "string"))
    return parsed.select("event_id", "parse_ok", "answer_json", value.alias("k"))


# A5: answers built from lineitem + orders, one per line ------------------------
def _answers_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"),
        "l_orderkey",
    )
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    importance = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise(
        "low"
    )
    events = F.array(
        F.struct(
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
            F.concat(F.lit("ship line "), F.col("l_linenumber").cast("string")).alias("event"),
            importance.alias("importance"),
            F.array(F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))).alias("dependencies"),
        ),
        F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.lit("order placed").alias("event"),
            F.lit("low").alias("importance"),
            F.array().cast("array<string>").alias("dependencies"),
        ),
    )
    answer = F.to_json(F.struct(events.alias("key_dates_and_events")))
    return j.select("l_orderkey", "l_linenumber", answer.alias("raw"))


_LINES_SQL = """SELECT l_orderkey, l_linenumber,
  CAST(to_json({'key_dates_and_events': [
     {'date': strftime(l_shipdate, '%Y-%m-%d'), 'event': 'ship line ' || CAST(l_linenumber AS VARCHAR),
      'importance': CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END,
      'dependencies': ['order ' || CAST(l_orderkey AS VARCHAR)]},
     {'date': strftime(o_orderdate, '%Y-%m-%d'), 'event': 'order placed', 'importance': 'low', 'dependencies': []::VARCHAR[]}]}) AS VARCHAR) AS raw
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(
    "flatten_sections",
    f"""WITH a AS ({_LINES_SQL}),
p AS (SELECT l_orderkey, l_linenumber,
        from_json(raw, '{{"key_dates_and_events": [{{"date": "VARCHAR", "event": "VARCHAR", "importance": "VARCHAR", "dependencies": ["VARCHAR"]}}]}}').key_dates_and_events AS evs FROM a)
SELECT l_orderkey, l_linenumber, CAST(pos - 1 AS BIGINT) AS pos, e.date AS date, e.event AS event, e.importance AS importance,
       array_to_string(e.dependencies, ',') AS dependencies
FROM (SELECT l_orderkey, l_linenumber, unnest(evs) AS e, generate_subscripts(evs, 1) AS pos FROM p)""",
)
def q_flatten_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = an.parse_answer(_answers_from_lines(spark, sf_dir), "raw")
    flat = an.flatten_section(parsed, ["l_orderkey", "l_linenumber"], F.col("answer.key_dates_and_events"))
    return flat.select(
        "l_orderkey", "l_linenumber", "pos", "date", "event", "importance",
        F.array_join("dependencies", ",").alias("dependencies"),
    )


# A5 for all six sections: an answer per order line, flattened to child tables;
# a row of a table is shown as its fields, lists joined, nulls marked.
_SECTION_FIELDS = {f.name: (f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType).fields for f in an.ANSWER_SCHEMA.fields}


def _full_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"),
                "l_orderkey")
    key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    texts = F.array().cast("array<string>")
    event = F.struct(day.alias("date"), F.concat(F.lit("line "), line).alias("event"), flag.alias("importance"),
                     F.when(number % 2 == 0, F.array(key, line)).otherwise(texts).alias("dependencies"))
    placed = F.struct(F.lit("first").alias("date"), F.lit("placed").alias("event"), F.lit("low").alias("importance"), texts.alias("dependencies"))
    depends = F.struct(F.concat(F.lit("ship "), line).alias("dependent_event"), F.lit("placed").alias("dependency"), F.lit("after").alias("relationship"))
    clause = F.struct(key.alias("original_clause"), F.concat(flag, F.lit(" \"quoted\"")).alias("simplified"), F.array(line, flag).alias("key_points"))
    benefit = F.struct(key.alias("clause"), F.lit("both").alias("benefits_party"), F.lit(None).cast("string").alias("explanation"), flag.alias("risk_level"))
    summary = F.struct(F.lit("sale").alias("contract_type"), F.array(key, line).alias("main_parties"), day.alias("primary_purpose"),
                       texts.alias("key_obligations"), F.array(flag).alias("termination_conditions"), F.lit("x").alias("governing_law"))
    risks = F.struct(F.array(flag, line).alias("high_risk_items"), texts.alias("medium_risk_items"), F.array(day).alias("recommendations"))
    answer = F.to_json(F.struct(
        F.array(event, placed).alias("key_dates_and_events"),
        F.when(number % 2 == 0, F.array(depends)).otherwise(F.array().cast("array<struct<dependent_event:string,dependency:string,relationship:string>>")).alias("date_dependencies"),
        F.array(clause, clause).alias("simplified_clauses"),
        F.when(F.col("l_orderkey") % 3 != 0, F.array(benefit)).alias("benefit_analysis"),
        summary.alias("contract_summary"),
        F.when(number != 1, risks).alias("risk_assessment"),
    ))
    return li.select("l_orderkey", "l_linenumber", answer.alias("raw"))


def _shown_sql(*cells: str) -> str:
    return " || '~' || ".join(f"coalesce({c}, '-')" for c in cells)


_DAY = "strftime(l_shipdate, '%Y-%m-%d')"
_KEY, _LINE = "CAST(l_orderkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)"
_SECTIONS_SQL = [
    ("key_dates_and_events", "0", "true", _shown_sql(_DAY, f"'line ' || {_LINE}", "l_returnflag",
                                                     f"CASE WHEN l_linenumber % 2 = 0 THEN {_KEY} || ',' || {_LINE} ELSE '' END")),
    ("key_dates_and_events", "1", "true", "'first~placed~low~'"),
    ("date_dependencies", "0", "l_linenumber % 2 = 0", _shown_sql(f"'ship ' || {_LINE}", "'placed'", "'after'")),
    ("date_dependencies", "-1", "l_linenumber % 2 <> 0", "'-~-~-'"),
    ("simplified_clauses", "0", "true", _shown_sql(_KEY, "l_returnflag || ' \"quoted\"'", f"{_LINE} || ',' || l_returnflag")),
    ("simplified_clauses", "1", "true", _shown_sql(_KEY, "l_returnflag || ' \"quoted\"'", f"{_LINE} || ',' || l_returnflag")),
    ("benefit_analysis", "0", "l_orderkey % 3 <> 0", _shown_sql(_KEY, "'both'", "NULL", "l_returnflag")),
    ("benefit_analysis", "-1", "l_orderkey % 3 = 0", "'-~-~-~-'"),
    ("contract_summary", "-1", "true", _shown_sql("'sale'", f"{_KEY} || ',' || {_LINE}", _DAY, "''", "l_returnflag", "'x'")),
    ("risk_assessment", "-1", "true", "CASE WHEN l_linenumber = 1 THEN '-~-~-' ELSE " + _shown_sql(f"l_returnflag || ',' || {_LINE}", "''", _DAY) + " END"),
]


@query("answer_tables", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{section}' AS section, CAST({pos} AS BIGINT) AS pos, {shown} AS fields FROM lineitem WHERE {when}"
    for section, pos, when, shown in _SECTIONS_SQL))
def q_answer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    made = an.answer_tables(an.parse_answer(_full_answers(spark, sf_dir), "raw"), keys, together=True)
    shown = {}
    for section, fields in _SECTION_FIELDS.items():
        cells = [(f, F.col(section)[f.name]) for f in fields]
        shown[section] = F.concat_ws("~", *[F.coalesce(F.array_join(c, ",") if isinstance(f.dataType, T.ArrayType) else c, F.lit("-"))
                                            for f, c in cells])
    fields = F.coalesce(*[F.when(F.col("section") == section, text) for section, text in shown.items()])
    pos = F.coalesce("pos", F.lit(-1).cast("bigint"))  # -1: no place
    return made.select(*keys, "section", pos.alias("pos"), fields.alias("fields"))


# Summaries from orders with fields nulled by key ----------------------------
@query(
    "summary_view",
    """SELECT o_orderkey,
       coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown') AS contract_type,
       array_to_string(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ['customer ' || CAST(o_custkey AS VARCHAR), 'status ' || o_orderstatus] END, []::VARCHAR[]), ', ') AS parties,
       coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'order ' || CAST(o_orderkey AS VARCHAR) END, 'Unknown') AS purpose
FROM orders""",
)
def q_summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        "o_orderkey",
    )
    k = F.col("o_orderkey")
    summary = F.struct(
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("contract_type"),
        F.when(
            k % 4 != 0,
            F.array(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")),
                    F.concat(F.lit("status "), F.col("o_orderstatus"))),
        ).alias("main_parties"),
        F.when(k % 5 != 0, F.concat(F.lit("order "), k.cast("string"))).alias("primary_purpose"),
    )
    raw = o.select("o_orderkey", F.to_json(F.struct(summary.alias("contract_summary"))).alias("raw"))
    parsed = an.parse_answer(raw, "raw")
    return parsed.select("o_orderkey", *an.summary_view(F.col("answer.contract_summary")))


# Envelopes over documents with blanks ------------------------------------
_BLANKED = "CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) || ' ' ELSE text END"
_ENV_CTES, _ENV_LAST = duck.cascade_ctes(
    "documents", ["doc_id"], duck.clean(_BLANKED), prefix="e"
)
_ENVELOPE_SQL = f"""WITH {_ENV_CTES}
SELECT doc_id, e0_t <> '' AS success,
       CAST(CASE WHEN e0_t <> '' THEN len(entries) ELSE 0 END AS BIGINT) AS pii_entities_found,
       CASE WHEN e0_t = '' THEN {q(MSG_BLANK_TEXT)} END AS error
FROM (SELECT l.doc_id, z.t AS e0_t, l.entries FROM {_ENV_LAST} l JOIN e0 z ON l.doc_id = z.doc_id)"""


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    t = F.when(F.col("doc_id") % 11 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    out = analyze_texts(d.select("doc_id", t.alias("text")), ECHO)
    # Failed rows carry no count; 0 here keeps the column non-null for the
    # value hash (a nullable bigint turns into floats on the way to pandas).
    return out.select(
        "doc_id", "success", F.coalesce("pii_entities_found", F.lit(0).cast("bigint")).alias("pii_entities_found"), "error"
    )


@query("outcome_envelope", _ENVELOPE_SQL)
def q_outcome_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelopes(spark, sf_dir)


@query(
    "outcome_summary",
    f"""SELECT success, error, CAST(count(*) AS BIGINT) AS n_docs, CAST(coalesce(sum(pii_entities_found), 0) AS BIGINT) AS n_entities
FROM ({_ENVELOPE_SQL}) GROUP BY success, error""",
)
def q_outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.outcome_summary(_envelopes(spark, sf_dir))


# The inline-text flow with the stand-in analyzer -----------------------------
_P_CTES, _P_LAST = duck.cascade_ctes("documents", ["doc_id", "label"], duck.clean(_BLANKED), prefix="p")
_P_CTES = _P_CTES.replace(
    "FROM documents)",
    "FROM (SELECT *, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, 'direct_input') AS label FROM documents))",
    1,
)
_TEXT_FLOW_SQL = f"""WITH {_P_CTES},
pr AS (SELECT doc_id, label, t, entries, {q(an.PROMPT_HEAD)} || t || {q(an.PROMPT_TAIL)} AS prompt FROM {_P_LAST}),
tk AS (SELECT *, regexp_extract_all(prompt, {q(TOKEN_SHAPE)}) AS toks FROM pr),
an AS (SELECT *, CAST(to_json({{'contract_summary': {{'contract_type': 'document',
          'main_parties': list_filter(toks, lambda x: starts_with(x, '[PII_PERSON_')),
          'primary_purpose': coalesce(toks[1], '')}}, 'n_tokens': CAST(len(toks) AS INTEGER), 'n_chars': CAST(length(prompt) AS INTEGER)}}) AS VARCHAR) AS raw FROM tk),
rs AS (SELECT *, list_reduce(entries, lambda acc, e: replace(acc, e.token, e.value), raw) AS replaced FROM an)
SELECT r.doc_id, r.label AS original_file, z.t <> '' AS success,
       CASE WHEN z.t = '' THEN {q(MSG_BLANK_TEXT)} END AS error,
       CAST(CASE WHEN z.t <> '' THEN len(r.entries) ELSE 0 END AS BIGINT) AS pii_entities_found,
       CASE WHEN z.t <> '' THEN r.raw END AS ai_response,
       CASE WHEN z.t <> '' THEN CASE WHEN json_valid(r.replaced) THEN r.replaced ELSE r.raw END END AS analysis
FROM rs r JOIN p0 z ON r.doc_id = z.doc_id"""


def text_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    k = F.col("doc_id")
    inp = d.select(
        "doc_id",
        F.when(k % 11 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("text"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("source_identifier"),
    )
    out = analyze_texts(inp, ECHO)
    return out.select(
        "doc_id", "original_file", "success", "error",
        F.coalesce("pii_entities_found", F.lit(0).cast("bigint")).alias("pii_entities_found"),
        "ai_response", F.col("detokenized_response").alias("analysis"),
    )


query("text_analysis", _TEXT_FLOW_SQL)(text_analysis)
