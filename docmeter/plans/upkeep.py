"""Upkeep and summaries of tables: flags of siblings, retention, order, pages, key checks, field maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.operators import upkeep as U
from docmeter.sources.tables import read_table as table


def sibling_flag(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest order becomes the main one, all others of the customer lose the flag."""
    return U.only_one(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "main").select("o_orderkey", "o_custkey", "main")


def retention(spark: SparkSession, d: str) -> DataFrame:
    """Errors are kept a day, other events a week, before the newest event."""
    return U.retained(table(spark, d, "events"), "ts", "event_type", {"error": 1}, 7).select("event_id", "event_type")


def fifo_drain(spark: SparkSession, d: str) -> DataFrame:
    """Open orders in the order of their keys, numbered."""
    return U.drain(table(spark, d, "orders").where("o_orderstatus = 'O'"), "o_orderkey").select("o_orderkey", "place")


def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 20 suppliers by balance, each row with the number of all."""
    return U.page(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")], 3, 20)


def rounded_averages(spark: SparkSession, d: str) -> DataFrame:
    """Averages rounded to the whole; half goes away from zero."""
    cents = F.avg((F.col("l_quantity") * 100).cast("long")) / 100
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(cents).cast("int").alias("whole"), F.count(F.lit(1)).alias("n"))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour of each user, null where no time passed."""
    return U.throughput(table(spark, d, "events"), ["user_id"], "ts")


def top_error(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent kind of event of each user; ties by the kind's name."""
    return U.most_frequent(table(spark, d, "events"), ["user_id"], "event_type")


def ordered_fields(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the order of their brands in a list; brands that are not listed come last, as 999."""
    return U.ordinal(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#3", "Brand#1", "Brand#4"]).select("p_partkey", "p_brand", "ordinal")


def map_rows(spark: SparkSession, d: str) -> DataFrame:
    """A customer's fields as rows, without empty ones and those that are not allowed."""
    c = table(spark, d, "customer")
    fields = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("note"), F.lit(""))
    return U.map_rows(c.select("c_custkey", fields.alias("fields")), "c_custkey", "fields", ["name", "segment", "note"])


def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Balances of suppliers: even keys change (to null where the balance is negative), odd ones were not sent and stay."""
    s = table(spark, d, "supplier")
    sent, value = F.col("s_suppkey") % 2 == 0, F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))
    return U.patched(s, {"s_acctbal": (sent, value)}).select("s_suppkey", "s_acctbal")


def key_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer is unknown, and lines whose order is: the ids that break the relation."""
    a = U.orphans(table(spark, d, "orders").select("o_custkey"), "o_custkey", table(spark, d, "customer"), "c_custkey", "orders.customer")
    b = U.orphans(table(spark, d, "labels").select("doc_id"), "doc_id", table(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", "labels.document")
    return a.unionByName(b)


def extra_keys(spark: SparkSession, d: str) -> DataFrame:
    """Fields of 1996 and 1997 (priorities a customer used) side by side: both, missing in the second, or extra in it."""
    o = table(spark, d, "orders")
    side = lambda y: o.where(f"year(o_orderdate) = {y}").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return U.expected_actual(side(1996), side(1997), ["o_custkey", "o_orderpriority"], "n")


def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of event of each user in the order in which they first came."""
    return U.distinct_in_order(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language and split."""
    from docmeter.plans.datasets import hash_split

    return hash_split(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


def _split_sql() -> str:
    from docmeter.plans.datasets import QUERIES as Q
    from docmeter.plans.datasets import hash_split

    return Q[hash_split]


QUERIES = {
    sibling_flag: "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS main FROM orders",
    retention: """SELECT event_id, event_type FROM events WHERE ts::TIMESTAMP >= (SELECT max(ts::TIMESTAMP) FROM events) - (CASE WHEN event_type = 'error' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END)""",
    fifo_drain: "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'",
    page_with_total: "SELECT s_suppkey, s_acctbal, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 40",
    rounded_averages: "SELECT l_returnflag, round(avg((l_quantity * 100)::BIGINT) / 100)::INT AS whole, count(*) AS n FROM lineitem GROUP BY 1",
    throughput: """SELECT user_id, n, CASE WHEN us > 0 THEN n * 3600000000.0::DOUBLE / us END AS per_hour FROM
      (SELECT user_id, count(*) AS n, epoch_us(max(ts::TIMESTAMP)) - epoch_us(min(ts::TIMESTAMP)) AS us FROM events GROUP BY 1)""",
    top_error: "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    ordered_fields: """SELECT p_partkey, p_brand, coalesce(list_position(['Brand#3', 'Brand#1', 'Brand#4'], p_brand), 999)::INT AS ordinal FROM part""",
    map_rows: """SELECT c_custkey, 'name' AS field, c_name AS value FROM customer WHERE c_name <> '' UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_mktsegment <> ''""",
    partial_update: "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_acctbal < 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier",
    key_integrity: """SELECT 'orders.customer' AS relation, o_custkey::BIGINT AS id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
      UNION ALL SELECT 'labels.document', doc_id, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2""",
    extra_keys: """WITH r AS (SELECT year(o_orderdate) AS y, o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
      SELECT o_custkey, o_orderpriority, a.n AS expected, b.n AS actual, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'both' END AS side
      FROM (FROM r WHERE y = 1996) a FULL JOIN (FROM r WHERE y = 1997) b USING (o_custkey, o_orderpriority)""",
    distinct_in_order: """SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM
      (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)""",
    split_counts: f"SELECT lang, split, count(*) AS n FROM ({_split_sql()}) JOIN documents USING (doc_id) GROUP BY 1, 2",
}
