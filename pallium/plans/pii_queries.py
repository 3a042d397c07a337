"""Registered queries for detection and tokenization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.functions.text import clean_text
from pallium.operators import cascade as cz
from pallium.plans import duck
from pallium.plans.registry import query
from pallium.session import spread, table


def cleaned_documents(spark: SparkSession, sf_dir: str, cols: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` with cleaned text, spread over tasks by ``doc_id``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", *cols)
    return spread(d, "doc_id").withColumn("text", clean_text("text"))


def tokenized_documents(spark: SparkSession, sf_dir: str, cols: tuple[str, ...] = ()) -> DataFrame:
    return cz.tokenize_cascade(cleaned_documents(spark, sf_dir, cols))


_DOC_CTES, _DOC_LAST = duck.cascade_ctes("documents", ["doc_id"], duck.clean("text"))
_DOC_CTES_LANG, _DOC_LAST_LANG = duck.cascade_ctes("documents", ["doc_id", "lang"], duck.clean("text"))


# D8 -------------------------------------------------------------------------
@query(
    "tokenize_cascade",
    f"""WITH {_DOC_CTES}
SELECT doc_id, t AS tokenized_text, CAST(len(entries) AS BIGINT) AS n_entities FROM {_DOC_LAST}""",
)
def q_tokenize_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized_documents(spark, sf_dir).select(
        "doc_id", "tokenized_text", F.size("entries").cast("bigint").alias("n_entities")
    )


# D12 ------------------------------------------------------------------------
@query(
    "entity_count",
    f"""WITH {_DOC_CTES}
SELECT doc_id, CAST(coalesce(cardinality(map_from_entries(list_transform(entries, lambda e: {{'k': e.token, 'v': e.value}}))), 0) AS BIGINT)
       AS pii_entities_found FROM {_DOC_LAST}""",
)
def q_entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized_documents(spark, sf_dir).select(
        "doc_id", cz.entity_count(cz.mapping("entries")).alias("pii_entities_found")
    )


# D1-D7 as standalone detectors ----------------------------------------------
def _detector_sql(source: str, key: str, text_expr: str, entity_type: str) -> str:
    hits = duck.detect(text_expr, entity_type)
    return (
        f"SELECT {key}, CAST(len(h) AS BIGINT) AS n_hits, array_to_string(h, chr(10)) AS hits "
        f"FROM (SELECT {key}, {hits} AS h FROM {source})"
    )


def _detector(df: DataFrame, key: str, text: str, entity_type: str) -> DataFrame:
    h = cz.detect(text, entity_type)
    return df.select(
        key, F.size(h).cast("bigint").alias("n_hits"), F.array_join(h, "\n").alias("hits")
    )


def _doc_detector(entity_type: str):
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _detector(cleaned_documents(spark, sf_dir), "doc_id", "text", entity_type)

    return fn


_CLEAN_DOCS = f"(SELECT doc_id, {duck.clean('text')} AS text FROM documents)"
for _name, _et in [
    ("detect_email", "EMAIL"),
    ("detect_phone", "PHONE"),
    ("detect_card", "CREDIT_CARD"),
    ("detect_ip", "IP_ADDRESS"),
    ("detect_person", "PERSON"),
]:
    query(_name, _detector_sql(_CLEAN_DOCS, "doc_id", "text", _et))(_doc_detector(_et))


# D3: SSN text built from customer keys (documents hold none) ---------------
def _ssn_text_spark(df: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    a = F.lpad((k % 1000).cast("string"), 3, "0")
    b = F.lpad((k % 100).cast("string"), 2, "0")
    c = F.lpad((k % 10000).cast("string"), 4, "0")
    text = F.concat(
        F.col("c_name"), F.lit(" ssn "), a, F.lit("-"), b, F.lit("-"), c,
        F.lit(", ref "), a, b, F.lit("-"), c, F.lit(", alt "), c, F.lit("-"), a, F.lit("."),
    )
    return df.select("c_custkey", clean_text(text).alias("text"))


_SSN_SRC = (
    "(SELECT c_custkey, "
    + duck.clean(
        "c_name || ' ssn ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || "
        "lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || "
        "', ref ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || "
        "'-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ', alt ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || "
        "'-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '.'"
    )
    + " AS text FROM customer)"
)


@query("detect_ssn", _detector_sql(_SSN_SRC, "c_custkey", "text", "SSN"))
def q_detect_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detector(_ssn_text_spark(table(spark, sf_dir, "customer")), "c_custkey", "text", "SSN")


# Links wrapped in a sentence (documents hold none) ---------------------
_URL_SRC = (
    "(SELECT page_id, "
    + duck.clean("'See ' || url || ', then (' || url || '). Done'")
    + " AS text FROM pages)"
)


@query("detect_url", _detector_sql(_URL_SRC, "page_id", "text", "URL"))
def q_detect_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(
        "page_id",
        clean_text(F.concat(F.lit("See "), F.col("url"), F.lit(", then ("), F.col("url"), F.lit("). Done"))).alias(
            "text"
        ),
    )
    return _detector(p, "page_id", "text", "URL")


# Numbering right to left, checked against a window ------------------
def _numbering_sql() -> str:
    ctes, _ = duck.cascade_ctes("documents", ["doc_id"], duck.clean("text"), prefix="n")
    arms = []
    from pallium.functions.patterns import CASCADE_TYPES

    for k, et in enumerate(CASCADE_TYPES, start=1):
        val = "m" if et != "PERSON" else duck.unguard_letters("m")
        arms.append(
            f"SELECT doc_id, '{et}' AS entity_type, {val} AS value, pos FROM "
            f"(SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM "
            f"(SELECT doc_id, list_filter(parts, lambda s, i: i % 2 = 0) AS ms FROM n{k}p))"
        )
    return (
        f"WITH {ctes}, hits AS ({' UNION ALL '.join(arms)})\n"
        "SELECT doc_id, entity_type, CAST(row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY pos DESC) AS BIGINT) AS n, "
        "'[PII_' || entity_type || '_' || CAST(row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY pos DESC) AS VARCHAR) || ']' AS token, "
        "value FROM hits"
    )


@query("token_numbering", _numbering_sql())
def q_token_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cz.token_vault(tokenized_documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "entity_type", "n", "token", "value"
    )


# The mapping as sorted rows --------------------------------------------
@query(
    "token_mapping",
    f"""WITH {_DOC_CTES}
SELECT doc_id, e.token AS token, e.value AS value FROM (SELECT doc_id, unnest(entries) AS e FROM {_DOC_LAST})""",
)
def q_token_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = cz.token_vault(tokenized_documents(spark, sf_dir), ["doc_id"])
    return vault.select("doc_id", "token", "value")


# D13 ------------------------------------------------------------------------
@query(
    "entity_counts_by_type",
    f"""WITH {_DOC_CTES}
SELECT doc_id, e.entity_type AS entity_type, CAST(count(*) AS BIGINT) AS n_entities
FROM (SELECT doc_id, unnest(entries) AS e FROM {_DOC_LAST}) GROUP BY doc_id, e.entity_type""",
)
def q_entity_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cz.counts_by_type(tokenized_documents(spark, sf_dir), ["doc_id"])


# D19 ------------------------------------------------------------------------
@query(
    "token_vault",
    f"""WITH {_DOC_CTES}
SELECT doc_id, CAST(seq AS BIGINT) AS seq, e.entity_type AS entity_type, CAST(e.n AS BIGINT) AS n, e.token AS token, e.value AS value
FROM (SELECT doc_id, unnest(entries) AS e, generate_subscripts(entries, 1) - 1 AS seq FROM {_DOC_LAST})""",
)
def q_token_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cz.token_vault(tokenized_documents(spark, sf_dir), ["doc_id"])


# D20 ------------------------------------------------------------------------
@query(
    "pii_census",
    f"""WITH {_DOC_CTES_LANG}, v AS (SELECT doc_id, lang, unnest(entries).entity_type AS entity_type FROM {_DOC_LAST_LANG})
SELECT lang, entity_type, CAST(count(*) AS BIGINT) AS n_entities, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs
FROM v GROUP BY ROLLUP (lang, entity_type)""",
)
def q_pii_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = cz.token_vault(tokenized_documents(spark, sf_dir, ("lang",)), ["doc_id", "lang"])
    return cz.pii_census(vault, "doc_id", "lang")
