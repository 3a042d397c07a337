"""Registered queries for the span path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pallium.functions.patterns import CASCADE_TO_SPAN_TYPE, SPAN_ENTITY_TYPES
from pallium.operators import cascade as cz
from pallium.operators import spans as sp
from pallium.plans import duck
from pallium.plans.duck import q
from pallium.plans.pii_queries import _DOC_CTES, _DOC_LAST, cleaned_documents, tokenized_documents
from pallium.plans.registry import query
from pallium.session import spread, table

SPAN_SOURCES = [("EMAIL", "EMAIL_ADDRESS"), ("IP_ADDRESS", "IP_ADDRESS")]


def regex_spans(df: DataFrame, doc: str, text: str, entity_type: str, label: str) -> DataFrame:
    """Spans of one pattern: match offsets from cumulative piece lengths."""
    marked = cz.split_matches(F.col(text), entity_type)
    guard = cz.stage_guards(F.col(text)).get(entity_type)
    if guard is not None:  # no candidate characters: one piece, no match
        marked = F.when(guard, marked).otherwise(F.array(F.col(text)))
    rows = cz.explode_rows(df, [doc], marked, "piece", pos="idx")
    w = Window.partitionBy(doc).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    st = F.coalesce(F.sum(F.char_length("piece")).over(w), F.lit(0)).cast("int")
    return (
        rows.withColumn("start", st)
        .filter(F.col("idx") % 2 == 1)
        .select(doc, "start", (F.col("start") + F.char_length("piece")).cast("int").alias("end"),
                F.lit(label).alias("entity_type"))
    )


def document_spans(docs: DataFrame) -> DataFrame:
    out = None
    for et, label in SPAN_SOURCES:
        s = regex_spans(docs, "doc_id", "text", et, label)
        out = s if out is None else out.unionByName(s)
    return out


def _spans_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS entity_type, string_split(regexp_replace(t, {q(duck.pattern(et))}, "
        f"chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM d"
        for et, label in SPAN_SOURCES
    )
    return f"""d AS (SELECT doc_id, {duck.clean('text')} AS t FROM documents),
m AS ({arms}),
u AS (SELECT doc_id, entity_type, unnest(parts) AS piece, generate_subscripts(parts, 1) AS idx FROM m),
o AS (SELECT doc_id, entity_type, idx, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, entity_type ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u),
spans AS (SELECT doc_id, entity_type, CAST(st AS BIGINT) AS s, CAST(st + length(piece) AS BIGINT) AS e FROM o WHERE idx % 2 = 0),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY s DESC) AS n FROM spans),
agg AS (SELECT doc_id, list({{'s': s, 'e': e, 't': entity_type, 'n': n}} ORDER BY s) AS sp FROM num GROUP BY doc_id),
st AS (SELECT d.doc_id, CASE WHEN agg.sp IS NULL THEN d.t ELSE
    array_to_string(list_transform(agg.sp, lambda x, i: substr(d.t, (CASE WHEN i = 1 THEN 0 ELSE agg.sp[i - 1].e END) + 1,
        x.s - (CASE WHEN i = 1 THEN 0 ELSE agg.sp[i - 1].e END)) || '[PII_' || x.t || '_' || CAST(x.n AS VARCHAR) || ']'), '')
    || substr(d.t, agg.sp[len(agg.sp)].e + 1) END AS tokenized_text,
    CAST(coalesce(len(agg.sp), 0) AS BIGINT) AS n_entities
  FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id)"""


# D15 ------------------------------------------------------------------------
@query("tokenize_spans", f"WITH {_spans_sql()}\nSELECT doc_id, tokenized_text, n_entities FROM st")
def q_tokenize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cleaned_documents(spark, sf_dir)
    out = sp.tokenize_spans(docs, document_spans(docs), "doc_id")
    return out.select("doc_id", "tokenized_text", F.size("entries").cast("bigint").alias("n_entities"))


# Cascade hits relabelled on even documents, then the allowlist -------------------
_RELABEL_SQL = "CASE " + " ".join(f"WHEN e.entity_type = '{a}' THEN '{b}'" for a, b in CASCADE_TO_SPAN_TYPE.items()) + " END"


@query(
    "entity_allowlist",
    f"""WITH {_DOC_CTES}, v AS (SELECT doc_id, unnest(entries) AS e FROM {_DOC_LAST}),
r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_RELABEL_SQL} ELSE e.entity_type END AS entity_type, e.value AS value FROM v)
SELECT doc_id, entity_type, value FROM r WHERE entity_type IN ({', '.join(q(t) for t in SPAN_ENTITY_TYPES)})""",
)
def q_entity_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = cz.token_vault(tokenized_documents(spark, sf_dir), ["doc_id"])
    relabel = F.create_map(*[F.lit(x) for kv in CASCADE_TO_SPAN_TYPE.items() for x in kv])
    et = F.when(F.col("doc_id") % 2 == 0, relabel[F.col("entity_type")]).otherwise(F.col("entity_type"))
    spans = vault.select("doc_id", et.alias("entity_type"), "value")
    return sp.allowlisted(spans)


# Spans given on odd documents, detector missing on even ones ----------------------
_CAS_CTES, _CAS_LAST = duck.cascade_ctes("documents", ["doc_id"], duck.clean("text"), prefix="f")


@query(
    "detector_fallback",
    f"""WITH {_spans_sql()}, {_CAS_CTES}
SELECT doc_id, tokenized_text, n_entities, 'spans' AS path FROM st WHERE doc_id % 2 = 1
UNION ALL
SELECT doc_id, t AS tokenized_text, CAST(len(entries) AS BIGINT) AS n_entities, 'cascade' AS path FROM {_CAS_LAST} WHERE doc_id % 2 = 0""",
)
def q_detector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cleaned_documents(spark, sf_dir)
    arrays = sp.spans_as_array(document_spans(docs), "doc_id")
    empty = F.array().cast("array<struct<start:int,end:int,entity_type:string>>")
    with_spans = docs.join(arrays, "doc_id", "left_outer").withColumn(
        "spans", F.when(F.col("doc_id") % 2 == 1, F.coalesce(F.col("spans"), empty))
    )
    out = sp.tokenize_with_fallback(with_spans, "doc_id")
    return out.select(
        "doc_id", "tokenized_text", F.size("entries").cast("bigint").alias("n_entities"), "path"
    )


# Intervals from deduplicated lineitem ----------------------------------------------
_LINE_SPANS_SQL = """SELECT DISTINCT l_orderkey AS doc, l_linenumber * 10 AS start,
       l_linenumber * 10 + CAST(floor(l_quantity) AS INTEGER) AS "end", l_returnflag AS entity_type
FROM lineitem"""


@query(
    "resolve_overlaps",
    # An end inside no span closes the group that the last start inside no span opened.
    f"""WITH s AS (SELECT * FROM ({_LINE_SPANS_SQL}) WHERE "end" > start),
opens AS (SELECT DISTINCT doc, start AS a FROM s x WHERE NOT EXISTS (
  SELECT 1 FROM s y WHERE y.doc = x.doc AND y.start < x.start AND y."end" > x.start)),
closes AS (SELECT DISTINCT doc, "end" AS z FROM s x WHERE NOT EXISTS (
  SELECT 1 FROM s y WHERE y.doc = x.doc AND y.start < x."end" AND y."end" > x."end")),
g AS (SELECT o.doc, o.a, min(c.z) AS z FROM opens o JOIN closes c ON c.doc = o.doc AND c.z > o.a GROUP BY o.doc, o.a)
SELECT g.doc, g.a AS start, g.z AS "end", first(s.entity_type ORDER BY s."end" - s.start DESC, s.start, s.entity_type) AS entity_type
FROM g JOIN s ON s.doc = g.doc AND s.start >= g.a AND s."end" <= g.z GROUP BY g.doc, g.a, g.z""",
)
def q_resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"),
        "l_orderkey",
    )
    spans = li.select(
        F.col("l_orderkey").alias("doc"),
        (F.col("l_linenumber") * 10).alias("start"),
        (F.col("l_linenumber") * 10 + F.floor("l_quantity").cast("int")).alias("end"),
        F.col("l_returnflag").alias("entity_type"),
    )
    return sp.resolve_overlaps(spans, "doc").select("doc", "start", "end", "entity_type")


# D15-D18 with all seven types -----------------------------------------------------------
# Documents lack social security numbers and links: every fifth text gets one of
# each, the link with an e-mail address inside, so that spans overlap.
_ALL_TEXT_SQL = (f"{duck.clean('text')} || CASE WHEN doc_id % 5 = 0 THEN ' id 219-09-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') "
                 "|| ' see https://example.org/?m=u' || CAST(doc_id AS VARCHAR) || '@corp.example, Ann Lee' ELSE '' END")


def _all_text() -> F.Column:
    number = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    extra = F.concat(F.lit(" id 219-09-"), number, F.lit(" see https://example.org/?m=u"), F.col("doc_id").cast("string"),
                     F.lit("@corp.example, Ann Lee"))
    return F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, extra).otherwise(""))


def all_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every pattern, as a detector would report them: each type by
    itself, so spans of different types overlap. One shuffle for all types."""
    guards = cz.stage_guards(F.col(text))
    found = [F.struct(F.lit(label).alias("label"), F.when(guards.get(et, F.lit(True)), cz.split_matches(F.col(text), et)).alias("parts"))
             for et, label in CASCADE_TO_SPAN_TYPE.items()]
    per_type = cz.explode_rows(docs, [doc], F.filter(F.array(*found), lambda x: F.size(x["parts"]) > 1), "f")
    rows = cz.explode_rows(per_type.select(doc, "f.label", "f.parts"), [doc, "label"], F.col("parts"), "piece", pos="idx")
    w = Window.partitionBy(doc, "label").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(w), F.lit(0)).cast("int"))
    return rows.filter(F.col("idx") % 2 == 1).select(
        doc, "start", (F.col("start") + F.char_length("piece")).cast("int").alias("end"), F.col("label").alias("entity_type"))


def _all_spans_sql() -> str:
    def parts(et: str) -> str:
        source = duck.guard_letters("t") if et == "PERSON" else "t"
        split = f"string_split(regexp_replace({source}, {q(duck.pattern(et))}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
        return f"list_transform({split}, lambda p: {duck.unguard_letters('p')})" if et == "PERSON" else split

    arms = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS entity_type, {parts(et)} AS parts FROM d"
                              for et, label in CASCADE_TO_SPAN_TYPE.items())
    before = "PARTITION BY doc_id ORDER BY s, e, entity_type ROWS BETWEEN UNBOUNDED PRECEDING"
    return f"""d AS (SELECT doc_id, {_ALL_TEXT_SQL} AS t FROM documents),
m AS ({arms}),
u AS (SELECT doc_id, entity_type, unnest(parts) AS piece, generate_subscripts(parts, 1) AS idx FROM m),
o AS (SELECT doc_id, entity_type, idx, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, entity_type ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u),
spans AS (SELECT doc_id, entity_type, CAST(st AS BIGINT) AS s, CAST(st + length(piece) AS BIGINT) AS e FROM o WHERE idx % 2 = 0),
opened AS (SELECT *, CASE WHEN max(e) OVER ({before} AND 1 PRECEDING) > s THEN 0 ELSE 1 END AS opens FROM spans),
grouped AS (SELECT *, sum(opens) OVER ({before} AND CURRENT ROW) AS g FROM opened),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e, first(entity_type ORDER BY e - s DESC, s, entity_type) AS entity_type
  FROM grouped GROUP BY doc_id, g),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY s DESC) AS n FROM merged),
agg AS (SELECT doc_id, list({{'s': s, 'e': e, 't': entity_type, 'n': n}} ORDER BY s) AS sp FROM num GROUP BY doc_id),
st AS (SELECT d.doc_id, CASE WHEN agg.sp IS NULL THEN d.t ELSE
    array_to_string(list_transform(agg.sp, lambda x, i: substr(d.t, (CASE WHEN i = 1 THEN 0 ELSE agg.sp[i - 1].e END) + 1,
        x.s - (CASE WHEN i = 1 THEN 0 ELSE agg.sp[i - 1].e END)) || '[PII_' || x.t || '_' || CAST(x.n AS VARCHAR) || ']'), '')
    || substr(d.t, agg.sp[len(agg.sp)].e + 1) END AS tokenized_text,
    CAST(coalesce(len(agg.sp), 0) AS BIGINT) AS n_entities,
    coalesce(array_to_string(list_transform(list_reverse(agg.sp), lambda x: '[PII_' || x.t || '_' || CAST(x.n AS VARCHAR) || ']='
      || substr(d.t, x.s + 1, x.e - x.s)), '|'), '') AS entries
  FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id)"""


def _written(entries: str) -> F.Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["token"], F.lit("="), e["value"])), "|")


@query("tokenize_all_spans", f"WITH {_all_spans_sql()}\nSELECT doc_id, tokenized_text, n_entities, entries FROM st")
def q_tokenize_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cleaned_documents(spark, sf_dir).withColumn("text", _all_text())
    out = sp.tokenize_spans(docs, all_spans(docs), "doc_id")
    return out.select("doc_id", "tokenized_text", F.size("entries").cast("bigint").alias("n_entities"), _written("entries").alias("entries"))


_ALL_CAS_CTES, _ALL_CAS_LAST = duck.cascade_ctes("documents", ["doc_id"], _ALL_TEXT_SQL, prefix="g")


@query(
    "fallback_overlapping",
    # The detector gave nothing on every third document, overlapping spans of all types on the others.
    f"""WITH {_all_spans_sql()}, {_ALL_CAS_CTES}
SELECT doc_id, tokenized_text, n_entities, 'spans' AS path FROM st WHERE doc_id % 3 <> 0
UNION ALL
SELECT doc_id, t AS tokenized_text, CAST(len(entries) AS BIGINT) AS n_entities, 'cascade' AS path FROM {_ALL_CAS_LAST} WHERE doc_id % 3 = 0""",
)
def q_fallback_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cleaned_documents(spark, sf_dir).withColumn("text", _all_text())
    arrays = sp.spans_as_array(all_spans(docs), "doc_id")
    empty = F.array().cast("array<struct<start:int,end:int,entity_type:string>>")
    given = F.when(F.col("doc_id") % 3 != 0, F.coalesce(F.col("spans"), empty))
    out = sp.tokenize_with_fallback(docs.join(arrays, "doc_id", "left_outer").withColumn("spans", given), "doc_id")
    return out.select("doc_id", "tokenized_text", F.size("entries").cast("bigint").alias("n_entities"), "path")
