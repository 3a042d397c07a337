"""Registered queries over stored results (Q1-Q8, S9, S11), with the
driver's ``orders`` and ``events`` tables standing in for the result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.plans.registry import query
from pallium.session import table
from pallium.sources import store as st
from pallium.sources.paging import deep_page

_ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_ORDER_COLS)


def _newest():
    return [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]


_PAGE_LIMIT, _PAGE_OFFSET = 100, 20
_ISO_ORDERDATE = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(o_orderdate, '%f') = '000000' THEN '' ELSE '.' || strftime(o_orderdate, '%f') END"


# Q1 -------------------------------------------------------------------------
@query("get_by_id", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey = 7")
def q_get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.get_by_id(_orders(spark, sf_dir), 7, "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )


# Q2 -------------------------------------------------------------------------
@query(
    "list_page",
    f"""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {_PAGE_LIMIT} OFFSET {_PAGE_OFFSET}""",
)
def q_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.page(_orders(spark, sf_dir), _PAGE_LIMIT, _PAGE_OFFSET, _newest()).select(
        "o_orderkey", "o_orderdate", "o_totalprice"
    )


# Q2, from the middle of the listing on: found by counting, not by sorting what comes before.
@query(
    "deep_page",
    f"""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {_PAGE_LIMIT} OFFSET (SELECT count(*) // 2 FROM orders)""",
)
def q_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return deep_page(orders, _PAGE_LIMIT, orders.count() // 2, "o_orderdate", "o_orderkey").select(
        "o_orderkey", "o_orderdate", "o_totalprice"
    )


# Q3 -------------------------------------------------------------------------
@query("total_count", "SELECT CAST(count(*) AS BIGINT) AS total FROM orders")
def q_total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.total_count(_orders(spark, sf_dir))


# Q4 -------------------------------------------------------------------------
@query(
    "page_with_total",
    f"""SELECT o_orderkey, o_orderdate, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS total FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {_PAGE_LIMIT} OFFSET {_PAGE_OFFSET}""",
)
def q_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.page_with_total(_orders(spark, sf_dir), _PAGE_LIMIT, _PAGE_OFFSET, _newest()).select(
        "o_orderkey", "o_orderdate", "total"
    )


# Q5: events as stored rows; props keys stand in for the mapping -------------------
@query(
    "list_view",
    """SELECT event_id AS id, event_type AS original_file,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS created_at,
       CAST(coalesce(len(json_keys(props)), 0) AS BIGINT) AS pii_entities_found
FROM events""",
)
def q_list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    count = F.coalesce(F.size(F.from_json("props", "map<string,string>")), F.lit(0))
    return st.list_view(e, "event_id", "event_type", "ts", count)


# Q6: requested ids (customer keys scaled) against orders -------------------------
@query(
    "detail_view",
    f"""SELECT r.req_id, o.o_orderkey IS NOT NULL AS found, coalesce(o.o_orderkey, -1) AS id, o.o_orderpriority AS original_file,
       CASE WHEN o.o_orderkey IS NOT NULL THEN {_ISO_ORDERDATE} END AS created_at, o.o_orderstatus AS analysis,
       CAST(CASE WHEN o.o_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pii_entities_found
FROM (SELECT c_custkey * 11 AS req_id FROM customer) r LEFT JOIN orders o ON r.req_id = o.o_orderkey""",
)
def q_detail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 11).alias("req_id"))
    held = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("[PII_PERSON_1]"), F.lit("x")))
    orders = _orders(spark, sf_dir).withColumn("mapping", held)
    # A miss gets id -1, so that the column has no nulls to compare.
    d = st.detail_view(req, orders, "req_id", "o_orderkey").withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1)))
    return d.select("req_id", "found", *st.detail_item("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus", "mapping"))


# Q7: delete the orders whose key is a customer key times 7 ------------------------
@query(
    "delete_rows",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey * 7 = o.o_orderkey)""",
)
def q_delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("req_id"))
    return st.without_ids(_orders(spark, sf_dir), req, "req_id", "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "delete_found",
    """SELECT c_custkey * 7 AS req_id, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = c.c_custkey * 7) AS existed
FROM customer c""",
)
def q_delete_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("req_id"))
    return st.delete_found(req, _orders(spark, sf_dir), "req_id", "o_orderkey")


# Q8 -------------------------------------------------------------------------
@query(
    "iso_time",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS ts_iso
FROM events""",
)
def q_iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", st.iso_time("ts").alias("ts_iso"))


@query("iso_time_orders", f"SELECT o_orderkey, {_ISO_ORDERDATE} AS date_iso FROM orders")
def q_iso_time_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", st.iso_time("o_orderdate").alias("date_iso"))


# S9 -------------------------------------------------------------------------
@query(
    "assign_ids",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS id FROM orders",
)
def q_assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return st.assign_ids(o, ["o_orderdate", "o_orderkey"], start=1).select("o_orderkey", "id")


# Documents to JSON text and back ----------------------------------------------
@query(
    "json_export",
    """SELECT doc_id, text, lang, source, n_chars, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') AS made
FROM documents""",
)
def q_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.timestamp_seconds(F.col("doc_id") + 1_704_067_200).alias("made")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars", made)
    js = d.select(st.to_json_lines(d).alias("value"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, made string"
    return js.select(F.from_json("value", schema).alias("r")).select("r.*")
