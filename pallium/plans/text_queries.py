"""Registered queries for cleaning, sources and detokenization
(C1-C8, S2-S6, T1-T3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.functions import text as tx
from pallium.functions.patterns import MSG_BLANK_TEXT
from pallium.operators import cascade as cz
from pallium.operators import detokenize as dt
from pallium.plans import duck
from pallium.plans.pii_queries import _DOC_CTES, _DOC_LAST, tokenized_documents
from pallium.plans.registry import query
from pallium.session import spread, table
from pallium.sources import files as fs
from pallium.sources.inline import assemble_pages, inline_source


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *cols), "doc_id")


# Control characters injected by doc_id rules -----------------------------
def _inject_control_spark(df: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    t = F.col("text")
    return df.withColumn(
        "text",
        F.concat(
            F.substring(t, 1, 20), F.char(k % 31 + 1), F.substring(t, 21, 20),
            F.char(k % 33 + 127), F.substr(t, F.lit(41)), F.char(k % 7 + 9),
        ),
    )


_INJECT_CONTROL_SQL = (
    "substr(text, 1, 20) || chr(CAST(doc_id % 31 + 1 AS INTEGER)) || substr(text, 21, 20) || "
    "chr(CAST(doc_id % 33 + 127 AS INTEGER)) || substr(text, 41) || chr(CAST(doc_id % 7 + 9 AS INTEGER))"
)


@query(
    "strip_control",
    f"SELECT doc_id, {duck.strip_control('t')} AS text_out FROM (SELECT doc_id, {_INJECT_CONTROL_SQL} AS t FROM documents)",
)
def q_strip_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _inject_control_spark(_docs(spark, sf_dir))
    return d.select("doc_id", tx.strip_control("text").alias("text_out"))


# C2 -------------------------------------------------------------------------
@query("collapse_ws", f"SELECT page_id, {duck.collapse_ws('html')} AS html_out FROM pages")
def q_collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return p.select("page_id", tx.collapse_whitespace("html").alias("html_out"))


# Padded ends --------------------------------------------------------------
_PAD_SQL = "repeat(' ', CAST(doc_id % 3 AS INTEGER)) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(9) ELSE '' END || text || repeat(' ', CAST(doc_id % 4 AS INTEGER)) || CASE WHEN doc_id % 5 = 0 THEN chr(13) || chr(10) ELSE '' END"


@query("trim_text", f"SELECT doc_id, {duck.strip_ends('t')} AS text_out FROM (SELECT doc_id, {_PAD_SQL} AS t FROM documents)")
def q_trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    padded = F.concat(
        F.repeat(F.lit(" "), (k % 3).cast("int")),
        F.when(k % 2 == 0, F.lit("\n\t")).otherwise(F.lit("")),
        F.col("text"),
        F.repeat(F.lit(" "), (k % 4).cast("int")),
        F.when(k % 5 == 0, F.lit("\r\n")).otherwise(F.lit("")),
    )
    return _docs(spark, sf_dir).select("doc_id", tx.strip_ends(padded).alias("text_out"))


# C4 -------------------------------------------------------------------------
@query(
    "null_to_empty",
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END, '') AS text_out FROM documents",
)
def q_null_to_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", tx.null_to_empty(t).alias("text_out"))


# C5 -------------------------------------------------------------------------
@query("clean_text", f"SELECT doc_id, {duck.clean('text')} AS text_out FROM documents")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("text_out"))


@query("clean_pages", f"SELECT page_id, {duck.clean('html')} AS html_out FROM pages")
def q_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return p.select("page_id", tx.clean_text("html").alias("html_out"))


# Blank documents rejected, every row kept with its status -----------------
_BLANKED_SQL = "CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) || ' ' ELSE text END"


@query(
    "blank_filter",
    f"""SELECT doc_id, {duck.clean(_BLANKED_SQL)} = '' AS is_blank,
       CASE WHEN {duck.clean(_BLANKED_SQL)} = '' THEN '{MSG_BLANK_TEXT}' END AS error FROM documents""",
)
def q_blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 11 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    d = _docs(spark, sf_dir).select("doc_id", tx.is_blank(t).alias("is_blank"))
    blank = F.col("is_blank")
    return d.select("doc_id", "is_blank", F.when(blank, F.lit(MSG_BLANK_TEXT)).alias("error"))


# C7 -------------------------------------------------------------------------
@query("char_count", f"SELECT doc_id, CAST(length({duck.clean('text')}) AS BIGINT) AS n_chars FROM documents")
def q_char_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.char_count(tx.clean_text("text")).alias("n_chars"))


# C8 -------------------------------------------------------------------------
@query("short_label", "SELECT page_id, left(url, 50) || '...' AS label FROM pages")
def q_short_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.short_label("url").alias("label"))


# File names derived from documents ---------------------------------------
_EXT_SQL = "CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.text' WHEN 3 THEN '.docx' ELSE '' END"


@query(
    "ext_dispatch",
    f"""WITH f AS (SELECT doc_id, source || '/doc_' || CAST(doc_id AS VARCHAR) || {_EXT_SQL} AS file_name FROM documents),
s AS (SELECT doc_id, file_name, lower(coalesce(regexp_extract(regexp_extract(file_name, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1), '')) AS suffix FROM f)
SELECT doc_id, file_name, suffix,
       CASE WHEN suffix IN ('.pdf') THEN 'paged' WHEN suffix IN ('.txt', '.text') THEN 'text' END AS kind,
       CASE WHEN suffix NOT IN ('.pdf', '.txt', '.text') THEN 'Unsupported file type: ' || suffix END AS error
FROM s""",
)
def q_ext_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    ext = (
        F.when(k % 5 == 0, ".pdf").when(k % 5 == 1, ".TXT").when(k % 5 == 2, ".text")
        .when(k % 5 == 3, ".docx").otherwise("")
    )
    names = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("source"), F.lit("/doc_"), k.cast("string"), ext).alias("file_name")
    )
    return fs.dispatch(names, "file_name").select("doc_id", "file_name", "suffix", "kind", "error")


# S3: requested inputs (documents) against found inputs (labels) ---------------
@query(
    "missing_inputs",
    """SELECT d.doc_id, d.source || '/doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path,
       'File not found: ' || d.source || '/doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS error
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def q_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    )
    found = table(spark, sf_dir, "labels").select("doc_id")
    return fs.missing_inputs(req, found, "doc_id", "path").select("doc_id", "path", "error")


# Latin-1 and UTF-8 bytes decoded back ------------------------------------
@query("decode_fallback", "SELECT doc_id, text AS from_latin1, text AS from_utf8 FROM documents")
def q_decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select(
        "doc_id",
        fs.decode_content(F.encode("text", "ISO-8859-1")).alias("from_latin1"),
        fs.decode_content(F.encode("text", "UTF-8")).alias("from_utf8"),
    )


# S5 -------------------------------------------------------------------------
@query(
    "inline_source",
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, 'direct_input') AS source_identifier FROM documents",
)
def q_inline_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias(
            "source_identifier"
        ),
    )
    return inline_source(d).select("doc_id", "source_identifier")


# Conversations as pages; some pages emptied by (conv_id + turn) rule -------
_PAGE_TEXT_SQL = "CASE WHEN (conv_id + turn) % 4 = 0 THEN '' ELSE text END"


@query(
    "page_assembly",
    f"""SELECT conv_id, {duck.clean(f"coalesce(string_agg({_PAGE_TEXT_SQL}, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE coalesce({_PAGE_TEXT_SQL}, '') <> ''), '')")} AS text,
       CAST(count(*) AS BIGINT) AS n_pages,
       CAST(count(*) FILTER (WHERE coalesce({_PAGE_TEXT_SQL}, '') <> '') AS BIGINT) AS n_text_pages
FROM conversations GROUP BY conv_id""",
)
def q_page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pages = c.select(
        "conv_id", "turn",
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
    )
    return assemble_pages(pages, "conv_id", "turn")


# Tokenize then detokenize ---------------------------------------------------
_RESTORE_SQL = "list_reduce(ee, lambda acc, e: replace(acc, e.token, e.value), tt)"
_RESTORE_REV_SQL = "list_reduce(list_reverse(ee), lambda acc, e: replace(acc, e.token, e.value), tt)"


@query(
    "roundtrip",
    f"""WITH {_DOC_CTES}, r AS (SELECT c0.doc_id, c0.t AS cleaned, {_RESTORE_SQL} AS restored, {_RESTORE_REV_SQL} AS restored_rev
    FROM c0 JOIN (SELECT doc_id AS k, t AS tt, entries AS ee FROM {_DOC_LAST}) l ON c0.doc_id = l.k)
SELECT doc_id, restored, restored = cleaned AS lossless, restored_rev = cleaned AS lossless_reverse FROM r""",
)
def q_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenized_documents(spark, sf_dir)
    restored = dt.detokenize("tokenized_text", "entries")
    restored_rev = dt.detokenize("tokenized_text", "entries", reverse=True)
    return tok.select(
        "doc_id",
        restored.alias("restored"),
        (restored == F.col("text")).alias("lossless"),
        (restored_rev == F.col("text")).alias("lossless_reverse"),
    )


# T1 on long documents with many tokens: the orders of a thousand keys, a name,
# an address and a number each, make one text.
_DENSE = 1000


@query(
    "roundtrip_dense",
    f"""SELECT CAST(o_orderkey // {_DENSE} AS BIGINT) AS part, CAST(3 * count(*) AS BIGINT) AS n_entities,
       CAST(sum(length('Ann Lee, u' || CAST(o_custkey AS VARCHAR) || '@corp.example, 10.0.0.' || CAST(o_orderkey % 250 AS VARCHAR) || '.')) + count(*) - 1 AS BIGINT) AS n_chars,
       true AS lossless
FROM orders GROUP BY 1""",
)
def q_roundtrip_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = F.concat(F.lit("Ann Lee, u"), F.col("o_custkey").cast("string"), F.lit("@corp.example, 10.0.0."),
                    (F.col("o_orderkey") % 250).cast("string"), F.lit("."))
    part = F.floor(F.col("o_orderkey") / _DENSE).cast("bigint").alias("part")
    texts = o.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("lines"))
    docs = texts.select("part", F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("text"))
    tok = cz.tokenize_cascade(spread(docs, "part"))
    return tok.select("part", F.size("entries").cast("bigint").alias("n_entities"), F.char_length("text").cast("bigint").alias("n_chars"),
                      (dt.detokenize("tokenized_text", "entries", reverse=True) == F.col("text")).alias("lossless"))


# E-mail entries dropped from the mapping ----------------------------------
@query(
    "partial_detokenize",
    f"""WITH {_DOC_CTES}
SELECT doc_id, list_reduce(list_filter(entries, lambda e: e.entity_type <> 'EMAIL'), lambda acc, e: replace(acc, e.token, e.value), t) AS restored
FROM {_DOC_LAST}""",
)
def q_partial_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenized_documents(spark, sf_dir)
    return tok.select(
        "doc_id", dt.detokenize("tokenized_text", dt.without_types("entries", ["EMAIL"])).alias("restored")
    )


# JSON answers detokenized; a value with a quote breaks the JSON -------------
_ANSWER_SQL = "CAST(to_json({'doc': doc_id, 'text': t, 'tokens': list_transform(entries, lambda e: e.token)}) AS VARCHAR)"
_QUOTED_ENTRIES_SQL = (
    "CASE WHEN doc_id % 4 = 0 THEN list_transform(entries, lambda e: {'entity_type': e.entity_type, 'n': e.n, "
    "'token': e.token, 'value': CASE WHEN e.n = 1 THEN e.value || '\"q' ELSE e.value END}) ELSE entries END"
)


@query(
    "detokenize_json",
    f"""WITH {_DOC_CTES}, a AS (SELECT doc_id, {_ANSWER_SQL} AS answer, {_QUOTED_ENTRIES_SQL} AS qentries FROM {_DOC_LAST}),
r AS (SELECT doc_id, answer, list_reduce(qentries, lambda acc, e: replace(acc, e.token, e.value), answer) AS replaced FROM a)
SELECT doc_id, CASE WHEN json_valid(replaced) THEN replaced ELSE answer END AS detokenized,
       json_valid(replaced) AS restored FROM r""",
)
def q_detokenize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenized_documents(spark, sf_dir)
    answer = F.to_json(
        F.struct(
            F.col("doc_id").alias("doc"),
            F.col("tokenized_text").alias("text"),
            F.transform("entries", lambda e: e["token"]).alias("tokens"),
        )
    )
    entries = F.transform(
        "entries",
        lambda e: e.withField(
            "value",
            F.when((F.col("doc_id") % 4 == 0) & (e["n"] == 1), F.concat(e["value"], F.lit('"q'))).otherwise(
                e["value"]
            ),
        ),
    )
    a = tok.select("doc_id", answer.alias("answer"), entries.alias("entries"))
    from pallium.functions.jsonx import is_strict_json

    return a.select(
        "doc_id",
        dt.detokenize_json("answer", "entries").alias("detokenized"),
        is_strict_json(dt.detokenize("answer", "entries")).alias("restored"),
    )
