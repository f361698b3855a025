"""Reports over the operational tables, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmeter.functions import text as T
from docmeter.functions.dates import day_spine
from docmeter.operators import relational as R
from docmeter.sources.tables import read_table as table

AS_OF = "1998-12-01"


def traffic_daily(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    measures = {"errors": F.col("event_type") == "error", "purchases": F.col("event_type") == "purchase", "all_events": F.lit(True)}
    cents = F.round(F.col("value") * 100).cast("long")
    return R.daily_series(day_spine(spark, "2024-01-01", "2024-02-15"), events, "ts", "user_id", measures, cents)


def kpi_row(spark: SparkSession, d: str) -> DataFrame:
    o, c, e = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "events")
    n = F.count(F.lit(1))
    return R.one_row(
        c.agg(n.alias("customers")),
        o.agg(n.alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders")),
        e.agg(F.count_if(F.col("event_type") == "error").alias("errors")),
    ).withColumn("items", F.col("orders") + F.col("errors"))


def owner_summary(spark: SparkSession, d: str) -> DataFrame:
    state = {"open": "O", "finished": "F", "partial": "P"}
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(f"n_{n}") for n, s in state.items()]
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_total"), *counts)


def latest_per_owner(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return R.newest(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], order).select("o_custkey", "o_orderstatus", "o_orderkey")


def lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return R.top_one(c, o, "c_custkey", F.col("o_orderpriority"), F.struct("o_orderdate", "o_orderkey"), "last_priority")


def sequence_folio(spark: SparkSession, d: str) -> DataFrame:
    o = R.next_number(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], None, "folio")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    name = F.concat(F.lpad(F.col("folio").cast("string"), 4, "0"), F.lit("_"), F.coalesce(F.left("c_mktsegment", F.lit(3)), F.lit("XXX")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "folio", name.alias("visible_id"))


def continued_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cut = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    old = R.next_number(o.where(cut), ["o_custkey"], order, None, "version").select("o_custkey", "version")
    return R.next_number(o.where(~cut), ["o_custkey"], order, old, "version").select("o_orderkey", F.col("version").cast("long").alias("version"))


def alerts_anti_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    items = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("expires"))
    sent = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(30).alias("threshold"))
    return R.expiry_alerts(items, sent, "1998-06-01").select("id", "threshold")


def unified_log(spark: SparkSession, d: str) -> DataFrame:
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    agent = F.element_at(F.array(*[F.lit(x) for x in ("Edg/1 Chrome Safari", "Firefox", "Chrome Safari", "Safari", "curl")]), (F.col("user_id") % 5 + 1).cast("int"))
    text = F.when(F.col("event_type") == "signup", "Account opened").when(F.col("event_type") == "purchase", F.when(F.col("value") > 50, "Large purchase").otherwise("Purchase")).otherwise(F.col("event_type"))
    one = e.where(R.in_days("ts", "2024-01-05", "2024-01-10")).select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), F.concat(text, R.browser(agent)).alias("message"))
    two = o.where(R.in_days("o_orderdate", "1997-01-01", "1997-01-31")).select(F.lit("order").alias("origin"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("message"))
    return one.union(two)


def log_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(unified_log(spark, d), [F.desc("origin"), F.desc("id")], 50, 3)


def user_listing(spark: SparkSession, d: str) -> DataFrame:
    found = R.search(table(spark, d, "customer"), "r#00000001", ["c_name", "c_mktsegment"])
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(orders, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


def no_orders(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", T.mask(F.col("c_name")).alias("masked"))


def top_routes(spark: SparkSession, d: str) -> DataFrame:
    path = T.request_path(F.col("url"))
    routes = table(spark, d, "pages").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return routes.orderBy(F.desc("n"), "path").limit(10)


def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.request_path(F.col("url")).alias("path"))


def field_precision(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    wrong = F.count_if(F.col("l_returnflag") == "R")
    return li.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("fields"), (1 - wrong / F.count(F.lit(1))).alias("field_precision"))


def recent_totals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(R.trailing("o_orderdate", AS_OF, 400))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def hourly_counter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("total"))


def additive_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    keys = [F.to_date("ts").alias("day"), F.col("event_type")]
    old, new = (e.where(f"event_id % 4 {op} 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("total")) for op in ("<>", "="))
    return R.add_counts(old, new, ["day", "event_type"], "total")


def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return R.insert_missing(s, new, "s_suppkey")


def merge_keep_existing(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    old = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 2 == 0).alias("checked"))
    new = s.select((F.col("s_suppkey") * 7).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5 == 0).alias("checked"))
    return R.merge_keep(old, new, "id", new_first=["nation"], either=["checked"])


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Heads and sizes that differ from a user's turn to the next; digests of whole texts where neither tells them apart."""
    c = table(spark, d, "conversations").where("role = 'user'")
    head, size = F.left("text", F.lit(3)), F.length("text").cast("string")
    # The last 64 characters are the digest; what stands before them is equal where head and size are.
    whole = F.concat(size, F.lit(":"), head, F.sha2("text", 256))
    values = {"head": head, "size": size, "text": whole}
    rows = c.select("conv_id", (F.col("turn") / 2).cast("int").alias("step"), F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()]).alias("f"))
    rows = rows.select("conv_id", "step", F.inline("f"))
    before, after = rows, rows.withColumn("step", F.col("step") - 1).where("step >= 0")
    log = R.change_log(before, after, ["conv_id", "step"], "field", "value")
    log = log.where("field <> 'text' OR left(old, length(old) - 64) = left(new, length(new) - 64)")
    shown = lambda v: F.when(F.col("field") == "text", F.right(v, F.lit(64))).otherwise(F.col(v)).alias(v)
    return log.select("conv_id", "step", "field", shown("old"), shown("new"))


def keep_newest(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 25).select("event_type", "event_id")


def rate_check(spark: SparkSession, d: str) -> DataFrame:
    rows = R.rate_window(table(spark, d, "events"), ["user_id"], "ts", 3600)
    return rows.where("recent > 1").select("event_id", "recent")


def state_transition(spark: SparkSession, d: str) -> DataFrame:
    guard = F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 200000)
    rows = R.guarded_update(table(spark, d, "orders"), guard, o_orderstatus=F.lit("Q"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def expiring_soon(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_add(F.to_date("o_orderdate"), 90).alias("expires"))
    left = F.datediff("expires", F.lit(AS_OF).cast("date"))
    return o.withColumn("days_left", left).where("days_left BETWEEN 0 AND 60").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name", "expires", "days_left")


def running_share(spark: SparkSession, d: str) -> DataFrame:
    """Orders per segment with the segment's place by count."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "c_mktsegment")).cast("long"))


_PATH = r"""coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''),
 '^[a-z]+://[^/]+', ''), '/\d+/', '/:id/', 'g'), '/\d+$', '/:id'), '/[A-Za-z0-9_.-]{24,}$', '/:token'), '/+$', ''), 80), ''), '/')"""
_LOG = """
SELECT 'event' AS origin, event_id AS id,
  CASE event_type WHEN 'signup' THEN 'Account opened' WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'Large purchase' ELSE 'Purchase' END ELSE event_type END
  || [' · Edge', ' · Firefox', ' · Chrome', ' · Safari', ''][user_id % 5 + 1] AS message
FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-11'
UNION ALL SELECT 'order', o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-02-01'
"""

QUERIES = {
    traffic_daily: """
      WITH s AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY))::DATE AS day)
      SELECT s.day, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, count(event_id) AS all_events,
             count(DISTINCT user_id) AS active_users, coalesce(sum(round(value * 100)::BIGINT), 0)::BIGINT AS amount
      FROM s LEFT JOIN events e ON e.ts::DATE = s.day GROUP BY s.day""",
    kpi_row: """SELECT *, orders + errors AS items FROM (SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders,
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors)""",
    owner_summary: """SELECT o_custkey, count(*) AS n_total, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_finished,
      count(*) FILTER (o_orderstatus = 'P') AS n_partial FROM orders GROUP BY 1""",
    latest_per_owner: """SELECT o_custkey, o_orderstatus, o_orderkey FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    lateral_top1: """SELECT c_custkey, c_name, o_orderpriority AS last_priority FROM customer LEFT JOIN LATERAL (SELECT o_orderpriority FROM orders
      WHERE o_custkey = c_custkey AND o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""",
    sequence_folio: """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS folio FROM orders)
      SELECT o_orderkey, folio, lpad(folio::VARCHAR, 4, '0') || '_' || coalesce(left(c_mktsegment, 3), 'XXX') AS visible_id FROM n LEFT JOIN customer ON c_custkey = o_custkey""",
    continued_numbers: """SELECT o_orderkey, v AS version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders)
      WHERE o_orderdate >= DATE '1996-01-01'""",
    alerts_anti_join: """SELECT o_orderkey AS id, t AS threshold FROM orders, (VALUES (90), (30), (7), (0)) v(t) WHERE o_orderstatus = 'O'
      AND date_diff('day', DATE '1998-06-01', o_orderdate::DATE) <= t AND NOT (o_orderkey % 3 = 0 AND 30 <= t)""",
    unified_log: _LOG,
    log_page: f"SELECT * FROM ({_LOG}) ORDER BY origin DESC, id DESC LIMIT 50 OFFSET 100",
    user_listing: """SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer
      WHERE lower(concat_ws(' ', c_name, c_mktsegment)) LIKE '%r#00000001%'""",
    no_orders: """SELECT c_custkey, left(c_name, 4) || repeat('•', greatest(0, length(c_name) - 6)) || right(c_name, 2) AS masked FROM customer
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    top_routes: f"SELECT {_PATH} AS path, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, path LIMIT 10",
    path_normalize: f"SELECT page_id, {_PATH} AS path FROM pages",
    field_precision: """SELECT l_linestatus, count(*) AS fields, 1 - count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS field_precision FROM lineitem GROUP BY 1""",
    recent_totals: """SELECT o_orderpriority, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders
      WHERE o_orderdate > TIMESTAMP '1998-12-01' - INTERVAL 400 DAY GROUP BY 1""",
    hourly_counter: "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS total FROM events GROUP BY 1, 2",
    additive_upsert: "SELECT ts::DATE AS day, event_type, count(*) AS total FROM events GROUP BY 1, 2",
    insert_missing: """SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    merge_keep_existing: """WITH o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, c_nationkey AS nation, c_custkey % 2 = 0 AS checked FROM customer),
      n AS (SELECT s_suppkey * 7 AS id, s_name AS name, s_nationkey AS nation, s_suppkey % 5 = 0 AS checked FROM supplier)
      SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, coalesce(n.nation, o.nation) AS nation, coalesce(o.checked, false) OR coalesce(n.checked, false) AS checked
      FROM o FULL JOIN n ON o.id = n.id""",
    change_log: """WITH r AS (SELECT conv_id, (turn // 2)::INT AS step, unnest(['head', 'size']) AS field, unnest([left(text, 3), length(text)::VARCHAR]) AS value FROM conversations WHERE role = 'user')
      SELECT coalesce(b.conv_id, a.conv_id) AS conv_id, coalesce(b.step, a.step) AS step, coalesce(b.field, a.field) AS field, b.value AS old, a.value AS new
      FROM r b FULL JOIN (SELECT conv_id, step - 1 AS step, field, value FROM r WHERE step >= 1) a ON a.conv_id = b.conv_id AND a.step = b.step AND a.field = b.field
      WHERE b.value IS DISTINCT FROM a.value
      UNION ALL SELECT conv_id, (b.turn // 2)::INT, 'text', sha256(b.text), sha256(a.text) FROM conversations b JOIN conversations a USING (conv_id)
      WHERE b.role = 'user' AND a.role = 'user' AND a.turn // 2 = b.turn // 2 + 1 AND left(a.text, 3) = left(b.text, 3) AND length(a.text) = length(b.text) AND a.text <> b.text""",
    keep_newest: "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 25",
    rate_check: """SELECT event_id, recent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 1""",
    state_transition: """SELECT CASE WHEN o_orderstatus IN ('O', 'P') AND o_totalprice > 200000 THEN 'Q' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1""",
    expiring_soon: """SELECT o_orderkey, c_name, (o_orderdate::DATE + 90)::DATE AS expires, date_diff('day', DATE '1998-12-01', (o_orderdate::DATE + 90)::DATE)::INT AS days_left
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE date_diff('day', DATE '1998-12-01', (o_orderdate::DATE + 90)::DATE) BETWEEN 0 AND 60""",
    running_share: """SELECT c_mktsegment, n, row_number() OVER (ORDER BY n DESC, c_mktsegment) AS place FROM
      (SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)""",
}
