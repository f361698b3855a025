"""Extracted fields, answers, confirmation, repair by position, seals and runs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.operators import fields as X
from docmeter.sources.tables import read_table as table

STEPS = {"blur": 0.2, "jpeg": 0.5, "noise": 0.35, "rotation": 0.75}
#: A fixed key for the round trip of the query; a user passes a key of their own.
QUERY_KEY = "0123456789abcdef"


def flatten_first(spark: SparkSession, d: str) -> DataFrame:
    """Orders as samples of pages (their lines by number, part, flag, status and supplier), each with two fields: the first value of a name wins."""
    line = table(spark, d, "lineitem")
    field = lambda name, v: F.struct(name.alias("name"), v.cast("string").alias("value"))
    page = F.struct("l_linenumber", "l_partkey", F.array(field(F.col("l_returnflag"), F.col("l_partkey")), field(F.col("l_linestatus"), F.col("l_suppkey"))).alias("fields"))
    return X.flattened(line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(page)).alias("pages")), "l_orderkey", "pages")


def envelope_answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers of a service: errors have status 503 or 400 and a code from the user, the others their fields."""
    e = table(spark, d, "events")
    error = F.to_json(F.struct(F.lit("failed").alias("error"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("U"), "user_id")).alias("codigo")))
    fine = F.concat(F.lit('{"tipo_documento":"'), "event_type", F.lit('","datos":'), "props", F.lit(',"metadatos":{"tiempo_procesamiento_ms":'), F.col("value").cast("string"), F.lit("}}"))
    bad = F.col("event_type") == "error"
    status = F.when(bad & (F.col("user_id") % 2 == 0), 503).when(bad, 400).otherwise(200)
    body = F.when(bad & (F.col("user_id") % 5 == 0), "gateway").when(bad, error).otherwise(fine)
    a = e.select("event_id", X.answer(status, body).alias("a"))
    return a.select("event_id", "a.status", "a.code", "a.retryable", "a.doc_type", F.col("a.fields")["k"].alias("k"), "a.total_ms")


def logged_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the fields in 'field=value' items made of each customer's row."""
    items = F.split(F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("c_name", "c_mktsegment", "c_nationkey")]), ";")
    return table(spark, d, "customer").select("c_custkey", F.array_join(X.field_names(items), ",").alias("names"))


def confirm_errors(spark: SparkSession, d: str) -> DataFrame:
    """Order fields as a user would confirm them: a required clerk flag, a status, a date or a word in its place."""
    o = table(spark, d, "orders")
    fields = F.create_map(
        F.lit("status"), F.col("o_orderstatus"),
        F.lit("issued"), F.when(F.col("o_totalprice") < 50000, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.lit("priority"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
    )
    o = o.select("o_orderkey", fields.alias("m"))
    errors = X.confirmation_errors(F.col("m"), ["priority"], {"status": ("^[FO]$", "F or O")}, ["issued"], "dd/mm/yyyy", "required")
    return o.select("o_orderkey", F.explode(errors).alias("field", "message"))


def type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """The order's status against its lines', with warnings from the line's numbers."""
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_tax", "l_discount")
    j = j.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    listed = lambda on, name: F.when(on, F.array(F.lit(name)))
    v = X.judged(F.col("o_orderstatus"), F.col("l_linestatus"), listed(F.col("l_tax") > 0.055, "tax"), listed(F.col("l_discount") > 0.075, "discount"), F.array())
    j = j.select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "v.refused", F.array_join("v.warnings", "; ").alias("warnings"))


def template_repair(spark: SparkSession, d: str) -> DataFrame:
    """Brands in capitals whose digits were read as letters and whose letters as digits come back by the template."""
    noisy = F.translate(F.upper(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))), "BA1250", "84IZSO")
    return table(spark, d, "part").select("p_partkey", X.by_template(noisy, "LLLLLADD").alias("brand"))


def name_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Cuts of the words of a part's name, kind and name into three groups, the second no shorter than the third."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name", "p_brand"), " ")
    p = table(spark, d, "part").select("p_partkey", words.alias("w"))
    cuts = X.three_parts(F.col("w"), lambda g, a, b: F.length(a) >= F.length(b))
    return p.select("p_partkey", F.inline(cuts))


def placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations that are no answer: empty, little more than a label, or punctuation first."""
    t = table(spark, d, "conversations")
    return t.where(X.placeholder(F.col("text"), ["Thtion", "ing", "Thank you"], 60)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def step_activation(spark: SparkSession, d: str) -> DataFrame:
    """The steps that are drawn for each document."""
    return X.active_steps(table(spark, d, "documents"), "doc_id", STEPS, 42)


def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names are sealed but for every third row of before; all of them open."""
    c, key = table(spark, d, "customer"), F.lit(QUERY_KEY)
    stored = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(X.sealed(F.col("c_name"), key))
    return c.select("c_custkey", stored.alias("stored")).select("c_custkey", X.opened(F.col("stored"), key).alias("c_name"))


def authorised_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests, customers as their devices, nations as accounts."""
    devices = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), (F.col("c_acctbal") < 0).alias("revoked"), (F.col("c_custkey") % 4).alias("token_version")
    )
    users = table(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") < 4).alias("active"), (F.col("n_nationkey") % 4).cast("long").alias("account_version"))
    return X.authorised(table(spark, d, "orders").select("o_orderkey", "o_custkey"), devices, users, "o_custkey", "n_nationkey").select("o_orderkey", "n_name")


def write_policies(spark: SparkSession, d: str) -> DataFrame:
    """Orders of 1996 and before meet those of 1996 and later, as the policies skip and overwrite leave them."""
    o = table(spark, d, "orders")
    old = o.where("year(o_orderdate) <= 1996").select("o_orderkey", F.lit("old").alias("side"))
    new = o.where("year(o_orderdate) >= 1996").select("o_orderkey", F.lit("new").alias("side"))
    out = [X.admitted(old, new, "o_orderkey", p).select(F.lit(p).alias("policy"), "o_orderkey", "side") for p in ("skip", "overwrite")]
    return out[0].unionByName(out[1])


def hidden_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Share of finished orders by priority, 1996 against 1998, and whether a priority got worse though the whole got better."""

    def run(year: int) -> DataFrame:
        rows = table(spark, d, "orders").where(f"year(o_orderdate) = {year}")
        return rows.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("r"), F.count(F.lit(1)).alias("t"))

    return X.gains(run(1996), run(1998), "o_orderpriority", "r", "t")


def performance(spark: SparkSession, d: str) -> DataFrame:
    """Events as timed samples of users: the value in hundredths is the time, clicks carry a load of the model."""
    hundredths = F.round(F.col("value") * 100).cast("long")
    e = table(spark, d, "events").select("user_id", hundredths.alias("ms"), F.when(F.col("event_type") == "click", hundredths % 50).alias("load"), (F.col("event_type") == "error").alias("failed"))
    return X.performance(e, ["user_id"], "ms", "load", "failed")


QUERIES = {
    flatten_first: """WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus, l_suppkey::VARCHAR) AS page,
        l_returnflag, l_linestatus, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supp FROM lineitem),
      f AS (SELECT l_orderkey, page, 1 AS pos, l_returnflag AS field, part AS value FROM p UNION ALL SELECT l_orderkey, page, 2, l_linestatus, supp FROM p)
      SELECT l_orderkey, field, value FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, field ORDER BY page, pos) = 1""",
    envelope_answers: """SELECT event_id, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN bad AND user_id % 5 = 0 THEN 'RESPUESTA_INVALIDA' WHEN bad AND user_id % 3 > 0 THEN 'U' || user_id WHEN bad AND user_id % 2 = 0 THEN 'HTTP_503' WHEN bad THEN 'HTTP_400' END AS code,
      bad AND user_id % 2 = 0 AS retryable, CASE WHEN NOT bad THEN event_type END AS doc_type, CASE WHEN NOT bad THEN props->>'$.k' END AS k, CASE WHEN NOT bad THEN value END AS total_ms
      FROM (SELECT *, event_type = 'error' AS bad FROM events)""",
    logged_names: "SELECT c_custkey, 'c_name,c_mktsegment,c_nationkey' AS names FROM customer",
    confirm_errors: """SELECT o_orderkey, 'priority' AS field, 'required' AS message FROM orders WHERE o_orderpriority = '5-LOW'
      UNION ALL SELECT o_orderkey, 'status', 'F or O' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
      UNION ALL SELECT o_orderkey, 'issued', 'dd/mm/yyyy' FROM orders WHERE o_totalprice < 50000""",
    type_mismatch: """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderstatus <> l_linestatus THEN 'chosen ' || o_orderstatus || ', seen ' || l_linestatus END AS refused,
      concat_ws('; ', CASE WHEN l_tax > 0.055 THEN 'some fields were malformed' END, CASE WHEN l_discount > 0.075 THEN 'some fields do not stand in the document' END) AS warnings
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    template_repair: "SELECT p_partkey, left(replace(upper(p_brand), '#', '-'), 8) AS brand FROM part",
    name_cuts: """WITH w AS (SELECT p_partkey, string_split(concat_ws(' ', p_name, p_type, p_name, p_brand), ' ') AS w FROM part),
      a AS (SELECT p_partkey, w, unnest(range(1, len(w) - 1)) AS i FROM w), b AS (SELECT p_partkey, w, i, unnest(range(i + 1, len(w))) AS j FROM a)
      SELECT p_partkey, i::INT AS i, j::INT AS j FROM b WHERE length(array_to_string(w[i + 1:j], ' ')) >= length(array_to_string(w[j + 1:], ' '))""",
    placeholders: """SELECT role, count(*) AS n FROM (SELECT role, trim(text) AS v FROM conversations) WHERE v = '' OR (contains(v, 'Thtion') AND length(v) < 66) OR (contains(v, 'ing') AND length(v) < 63)
      OR (contains(v, 'Thank you') AND length(v) < 69) OR regexp_matches(v, '^[():,.\\-]') GROUP BY 1""",
    step_activation: """SELECT doc_id, step, u FROM (SELECT doc_id, step, p, ('0x' || substr(sha256('42:' || step || ':' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u
      FROM documents, (VALUES ('blur', 0.2::DOUBLE), ('jpeg', 0.5::DOUBLE), ('noise', 0.35::DOUBLE), ('rotation', 0.75::DOUBLE)) s(step, p)) WHERE u < p""",
    sealed_round_trip: "SELECT c_custkey, nullif(c_name, '') AS c_name FROM customer",
    authorised_orders: """SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      WHERE c_acctbal >= 0 AND n_regionkey < 4 AND c_custkey % 4 = n_nationkey % 4""",
    write_policies: """SELECT p AS policy, o_orderkey, CASE WHEN y > 1996 THEN 'new' WHEN y < 1996 OR p = 'skip' THEN 'old' ELSE 'new' END AS side
      FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), (VALUES ('skip'), ('overwrite')) v(p)""",
    hidden_regressions: """WITH s AS (SELECT year(o_orderdate) AS y, o_orderpriority, grouping(o_orderpriority) AS g, count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE AS share
        FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY GROUPING SETS ((y, o_orderpriority), (y))),
      j AS (SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(a.g, b.g) AS g, a.share AS base, b.share AS new FROM (FROM s WHERE y = 1996) a
        FULL JOIN (FROM s WHERE y = 1998) b ON a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AND a.g = b.g),
      v AS (SELECT *, CASE WHEN base IS NULL OR new IS NULL THEN 'no_data' WHEN new > base THEN 'better' WHEN new < base THEN 'worse' ELSE 'same' END AS verdict FROM j)
      SELECT o_orderpriority, base, new, verdict, (SELECT count(*) FILTER (g = 1 AND verdict = 'better') > 0 AND count(*) FILTER (g = 0 AND verdict = 'worse') > 0 FROM v) AS hidden_regression FROM v""",
    performance: """SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS timed, avg(ms) FILTER (ok) AS mean_ms, avg(ms - coalesce(load, 0)) FILTER (ok) AS mean_ms_without_load,
      CASE WHEN sum(ms) > 0 AND count(*) FILTER (ok) > 0 THEN count(*) FILTER (ok) / (sum(ms)::DOUBLE / 1000) END AS per_second, 'sum of times' AS basis, sum(load)::BIGINT AS load_ms
      FROM (SELECT user_id, ms, CASE WHEN event_type = 'click' THEN ms % 50 END AS load, event_type <> 'error' AS ok FROM (SELECT *, round(value * 100)::BIGINT AS ms FROM events)) GROUP BY 1""",
}
