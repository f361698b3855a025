"""Evaluation reports over field results derived from the table part, and other tables for classification and latency.

Expected values come from part; what a reader would have answered is a fixed distortion of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.functions import text as T
from docmeter.functions.compare import field_status
from docmeter.operators import evaluation as E
from docmeter.operators.splits import split_of
from docmeter.sources.tables import read_table as table

SCHEMA_FIELDS = ("note",)


def _k(m: int):
    return F.col("p_partkey") % m


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Sample grain: keys of the groupings, failure, predicted type."""
    preset = F.element_at(F.array(F.lit("none"), F.lit("default"), F.lit("heavy")), (_k(3) + 1).cast("int"))
    failed = _k(29) == 0
    return table(spark, d, "part").select(
        "p_partkey",
        F.col("p_type").alias("doc_type"),
        preset.alias("preset"),
        split_of(F.col("p_partkey").cast("string"), 7).alias("split"),
        failed.alias("failed"),
        F.when(~failed, _k(11) != 0).alias("type_correct"),
        "p_name",
        "p_brand",
        "p_size",
    )


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Field grain: expected, actual, status, scored, cer, criticality."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (_k(900)).cast("int"))
    dmy = F.date_format(day, "dd/MM/yyyy")
    size = F.col("p_size").cast("string")
    name = F.when(_k(7) == 0, F.upper("p_name")).when(_k(7) == 1, F.translate("p_name", "ae", "43")).when(_k(7) == 3, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).when(_k(7) != 2, F.col("p_name"))
    brand = F.when(_k(5) == 0, F.lower(F.concat_ws(" ", F.left("p_brand", F.lit(2)), F.substring("p_brand", 3, 99)))).when(_k(5) == 1, F.concat("p_brand", F.lit("X"))).otherwise(F.col("p_brand"))
    code = F.when(_k(4) == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(_k(4) == 1, F.concat(F.lit("0"), size)).otherwise(size)
    date = F.when(_k(6) == 0, F.date_format(day, "yyyy-MM-dd")).when(_k(6) == 1, F.date_format(F.date_add(day, 1), "dd MM yyyy")).when(_k(6) == 2, F.lit("31/02/2021")).otherwise(dmy)
    empty = F.when(_k(8) == 0, F.lit("x"))

    def field(n, kind, weight, applies, expected, actual):
        return F.struct(F.lit(n).alias("field"), F.lit(kind).alias("kind"), F.lit(weight).alias("criticality"), applies.alias("applicable"), expected.alias("expected"), actual.alias("actual"))

    rows = _samples(spark, d).where("NOT failed").select(
        "p_partkey", "doc_type", "preset", "split",
        F.inline(F.array(
            field("name", "text", 2, F.lit(True), F.col("p_name"), name),
            field("brand", "identifier", 3, _k(10) != 9, F.col("p_brand"), brand),
            field("size", "code", 1, F.lit(True), size, code),
            field("date", "date", 3, F.lit(True), dmy, date),
            field("note", "text", 1, F.lit(True), F.lit(""), empty),
        )),
    )
    status = field_status(F.col("kind"), F.col("expected"), F.col("actual"), F.col("applicable"))
    rows = rows.withColumn("status", status).withColumn("scored", F.col("status") != "NOT_APPLICABLE")
    missing = F.when(F.col("scored"), F.when(T.blank(F.col("actual")), F.when(F.col("expected") == "", 0.0).otherwise(1.0)).otherwise(T.character_error_rate(F.col("expected"), F.col("actual"))))
    return rows.withColumn("cer", missing)


def compare_status(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("p_partkey", "field", "status")


def cer_by_group(spark: SparkSession, d: str) -> DataFrame:
    edits = F.levenshtein("expected", "actual").cast("long")
    rows = _fields(spark, d).where("scored AND actual IS NOT NULL AND expected <> ''")
    return rows.groupBy("field", "preset").agg(F.sum(edits).alias("edits"), F.sum(F.length("expected")).alias("characters"), F.count_if(F.col("cer") > 0.5).alias("bad"))


def grouping_sets_report(spark: SparkSession, d: str) -> DataFrame:
    groups = [[], ["doc_type"], ["split"], ["preset"], ["doc_type", "preset"]]
    out = E.group_summary(_fields(spark, d), _samples(spark, d), groups)
    return out.select("doc_type", "split", "preset", "grouping", "samples", "failed", "scored", "correct", "exact", "partial", "accuracy", "exact_rate")


def field_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return E.field_histogram(_fields(spark, d), ["field", "doc_type"])


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).groupBy("field").pivot("status", ["EXACT", "NORMALIZED", "PARTIAL", "MISMATCH", "MISSING"]).count().fillna(0)


def error_patterns_topn(spark: SparkSession, d: str) -> DataFrame:
    return E.error_patterns(_fields(spark, d), ["field", "doc_type"], 20)


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    out = E.recommendations(_fields(spark, d), ["field", "doc_type", "preset"], "criticality")
    return out.withColumn("impact", F.col("impact").cast("long")).withColumn("priority", F.col("priority").cast("long"))


def bench_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _fields(spark, d).where("scored")
    right = F.col("status").isin("EXACT", "NORMALIZED")
    return rows.rollup("doc_type").agg(
        F.grouping_id().alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(right).alias("hits"), F.count_if(right & (F.col("criticality") >= 3)).alias("critical_hits")
    )


def pooled_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("preset")
    pools = F.array_compact(F.array(p, F.when(p.isin("none", "default"), F.lit("none+default")), F.lit("all")))
    return E.pooled(_fields(spark, d).where("scored"), pools, F.col("status").isin("EXACT", "NORMALIZED"))


def field_regressions(spark: SparkSession, d: str) -> DataFrame:
    rows = _fields(spark, d).select("p_partkey", "field", F.col("status").isin("EXACT", "NORMALIZED").alias("ok"))
    new = rows.withColumn("ok", F.when(_k(13) == 0, ~F.col("ok")).otherwise(F.col("ok")))
    return E.regressions(rows, new, ["p_partkey"], "field", "ok")


def run_compare(spark: SparkSession, d: str) -> DataFrame:
    def run(part: str) -> DataFrame:
        rows = table(spark, d, "orders").where(f"year(o_orderdate) = {part}")
        return rows.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    return E.compare_runs(run("1996"), run("1997"), ["o_orderpriority", "o_orderstatus"], "n", True, 3.0)


def sample_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (o.where(f"year(o_orderdate) = {y}").select("o_custkey").distinct() for y in (1996, 1997))
    return E.sample_differences(a, b, "o_custkey")


def _keyword_language(c):
    """A language by its commonest words; null without a signal, ties to the first."""
    words = {"en": (" the ", " of "), "fr": (" le ", " et "), "de": (" der ", " die "), "es": (" el ", " los ")}
    low = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    score = lambda ws: sum(F.contains(low, F.lit(w)).cast("int") for w in ws)
    best = F.array_max(F.array(*[F.struct(score(ws).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("l")) for i, (n, ws) in enumerate(words.items())]))
    return F.when(best["s"] > 0, best["l"])


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("truth"), _keyword_language(F.col("text")).alias("predicted"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(_predicted(spark, d), "truth", "predicted")


def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion_matrix(_predicted(spark, d), "truth", "predicted", ["en", "fr", "de", "es"])


def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.classification(_predicted(spark, d), "truth", "predicted")


def classification_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.classification_summary(_predicted(spark, d), "truth", "predicted").drop("macro_f1")


def percentiles_gated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error").withColumn("bucket", F.col("user_id") % 40)
    return E.latency(e, ["bucket"], "value", "failed")


_SAMPLES = """
  SELECT p_partkey, p_type AS doc_type, ['none', 'default', 'heavy'][p_partkey % 3 + 1] AS preset,
    CASE WHEN u < 0.6 THEN 'dev' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split, p_partkey % 29 = 0 AS failed, p_name, p_brand, p_size
  FROM (SELECT *, ('0x' || substr(sha256('split:7:' || p_partkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM part)"""
_DATE = lambda c: f"""CASE WHEN regexp_matches(trim({c}), '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN try_strptime(trim({c}), '%d/%m/%Y')
   WHEN regexp_matches(trim({c}), '^\\d{{1,2}} +\\d{{1,2}} +\\d{{4}}$') THEN try_strptime(trim({c}), '%d %m %Y')
   WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN try_strptime(trim({c}), '%Y-%m-%d') END"""  # noqa: E731
_NORM = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
_FIELDS = f"""
  WITH s AS ({_SAMPLES}), d AS (SELECT *, (DATE '2020-01-01' + (p_partkey % 900)::INT)::DATE AS day, p_size::VARCHAR AS sz, p_partkey AS k FROM s WHERE NOT failed), f AS (
    SELECT p_partkey, doc_type, preset, split, 'name' AS field, 'text' AS kind, 2 AS criticality, true AS applicable, p_name AS expected,
      CASE k % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN translate(p_name, 'ae', '43') WHEN 2 THEN NULL WHEN 3 THEN '  ' || p_name || ' ' ELSE p_name END AS actual FROM d
    UNION ALL SELECT p_partkey, doc_type, preset, split, 'brand', 'identifier', 3, k % 10 <> 9, p_brand,
      CASE k % 5 WHEN 0 THEN lower(left(p_brand, 2) || ' ' || substr(p_brand, 3)) WHEN 1 THEN p_brand || 'X' ELSE p_brand END FROM d
    UNION ALL SELECT p_partkey, doc_type, preset, split, 'size', 'code', 1, true, sz, CASE k % 4 WHEN 0 THEN ' ' || sz || ' ' WHEN 1 THEN '0' || sz ELSE sz END FROM d
    UNION ALL SELECT p_partkey, doc_type, preset, split, 'date', 'date', 3, true, strftime(day, '%d/%m/%Y'),
      CASE k % 6 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime((day + 1)::DATE, '%d %m %Y') WHEN 2 THEN '31/02/2021' ELSE strftime(day, '%d/%m/%Y') END FROM d
    UNION ALL SELECT p_partkey, doc_type, preset, split, 'note', 'text', 1, true, '', CASE WHEN k % 8 = 0 THEN 'x' END FROM d
  ), fields AS (
    SELECT *, status <> 'NOT_APPLICABLE' AS scored FROM (SELECT *, CASE
      WHEN NOT applicable THEN 'NOT_APPLICABLE' WHEN expected = '' AND coalesce(trim(actual), '') = '' THEN 'EXACT' WHEN expected = '' THEN 'EXTRA'
      WHEN coalesce(trim(actual), '') = '' THEN 'MISSING' WHEN actual = expected THEN 'EXACT'
      WHEN kind = 'identifier' THEN CASE WHEN upper(regexp_replace(actual, '\\s+', '', 'g')) = upper(regexp_replace(expected, '\\s+', '', 'g')) THEN 'NORMALIZED' ELSE 'MISMATCH' END
      WHEN kind = 'code' THEN CASE WHEN upper(trim(actual)) = upper(trim(expected)) THEN 'NORMALIZED' ELSE 'MISMATCH' END
      WHEN kind = 'text' THEN CASE WHEN {_NORM("actual")} = {_NORM("expected")} THEN 'NORMALIZED' WHEN strip_accents({_NORM("actual")}) = strip_accents({_NORM("expected")}) THEN 'PARTIAL' ELSE 'MISMATCH' END
      WHEN kind = 'date' THEN CASE WHEN ({_DATE("actual")}) IS NULL OR ({_DATE("expected")}) IS NULL THEN 'UNINTERPRETABLE' WHEN ({_DATE("actual")}) = ({_DATE("expected")}) THEN 'NORMALIZED' ELSE 'MISMATCH' END
      END AS status FROM f))"""
_STATUS = ("EXACT", "NORMALIZED", "PARTIAL", "MISMATCH", "UNINTERPRETABLE", "MISSING", "EXTRA", "EXTRA_SCHEMA", "NOT_APPLICABLE")
_RIGHT, _WRONG = "status IN ('EXACT', 'NORMALIZED')", "status IN ('MISMATCH', 'MISSING', 'UNINTERPRETABLE', 'EXTRA')"
_SCORE = lambda a, b: f"(contains(low, ' {a} ')::INT + contains(low, ' {b} ')::INT)"
_PREDICTED = f"""SELECT doc_id, lang AS truth, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS predicted
  FROM (SELECT *, {_SCORE("the", "of")} AS en, {_SCORE("le", "et")} AS fr, {_SCORE("der", "die")} AS de, {_SCORE("el", "los")} AS es FROM (SELECT doc_id, lang, ' ' || lower(text) || ' ' AS low FROM documents))"""
_CELLS = f"SELECT truth, coalesce(predicted, '(unclassified)') AS predicted, count(*) AS n FROM ({_PREDICTED}) GROUP BY ALL"

QUERIES = {
    compare_status: f"{_FIELDS} SELECT p_partkey, field, status FROM fields",
    cer_by_group: f"""{_FIELDS} SELECT field, preset, sum(levenshtein(expected, actual))::BIGINT AS edits, sum(length(expected))::BIGINT AS characters,
      count(*) FILTER (CASE WHEN trim(actual) = '' THEN 1.0 ELSE levenshtein(expected, actual)::DOUBLE / length(expected) END > 0.5) AS bad
      FROM fields WHERE scored AND actual IS NOT NULL AND expected <> '' GROUP BY 1, 2""",
    grouping_sets_report: f"""{_FIELDS}, fs AS (SELECT doc_type, split, preset, grouping(doc_type, split, preset) AS g, count(*) FILTER (scored) AS scored, count(*) FILTER (scored AND {_RIGHT}) AS correct,
        count(*) FILTER (scored AND status = 'EXACT') AS exact, count(*) FILTER (status = 'PARTIAL') AS partial FROM fields GROUP BY GROUPING SETS ((), (doc_type), (split), (preset), (doc_type, preset))),
      ss AS (SELECT doc_type, split, preset, grouping(doc_type, split, preset) AS g, count(*) AS samples, count(*) FILTER (failed) AS failed FROM s GROUP BY GROUPING SETS ((), (doc_type), (split), (preset), (doc_type, preset)))
      SELECT ss.doc_type, ss.split, ss.preset, ss.g AS grouping, samples, failed, scored, correct, exact, partial, correct::DOUBLE / scored AS accuracy, exact::DOUBLE / scored AS exact_rate
      FROM ss JOIN fs ON ss.g = fs.g AND ss.doc_type IS NOT DISTINCT FROM fs.doc_type AND ss.split IS NOT DISTINCT FROM fs.split AND ss.preset IS NOT DISTINCT FROM fs.preset""",
    field_aggregate: f"{_FIELDS} SELECT field, doc_type, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in _STATUS)
    + f""", count(*) FILTER (scored) AS scored, count(*) FILTER (scored AND {_RIGHT})::DOUBLE / nullif(count(*) FILTER (scored), 0) AS accuracy,
      count(*) FILTER (scored AND {_WRONG}) AS errors FROM fields GROUP BY 1, 2""",
    status_pivot: f"{_FIELDS} SELECT field, " + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in ("EXACT", "NORMALIZED", "PARTIAL", "MISMATCH", "MISSING")) + " FROM fields GROUP BY 1",
    error_patterns_topn: f"{_FIELDS} SELECT field, doc_type, status, count(*) AS n FROM fields WHERE {_WRONG} OR status = 'PARTIAL' GROUP BY ALL ORDER BY n DESC, field, doc_type, status LIMIT 20",
    recommendations: f"""{_FIELDS}, p AS (SELECT field, doc_type, preset, criticality, status, count(*) AS c FROM fields WHERE scored AND {_WRONG} GROUP BY ALL),
      r AS (SELECT field, doc_type, preset, criticality, sum(c)::BIGINT AS errors, arg_max(status, (c, status)) AS dominant FROM p GROUP BY ALL)
      SELECT *, (errors * criticality)::BIGINT AS impact, row_number() OVER (ORDER BY errors * criticality DESC, field, doc_type, preset) AS priority FROM r ORDER BY priority LIMIT 15""",
    bench_rollup: f"""{_FIELDS} SELECT doc_type, grouping(doc_type) AS total, count(*) AS n, count(*) FILTER ({_RIGHT}) AS hits, count(*) FILTER ({_RIGHT} AND criticality >= 3) AS critical_hits
      FROM fields WHERE scored GROUP BY ROLLUP (doc_type)""",
    pooled_accuracy: f"""{_FIELDS} SELECT pool, count(*) AS n, count(*) FILTER (ok) AS hits, count(*) FILTER (ok)::DOUBLE / count(*) AS accuracy FROM (SELECT {_RIGHT} AS ok,
      unnest(list_filter([preset, CASE WHEN preset IN ('none', 'default') THEN 'none+default' END, 'all'], lambda x: x IS NOT NULL)) AS pool FROM fields WHERE scored) GROUP BY 1""",
    field_regressions: f"""{_FIELDS} SELECT field, count(*) FILTER (NOT ({_RIGHT}) AND p_partkey % 13 = 0) AS gained, count(*) FILTER ({_RIGHT} AND p_partkey % 13 = 0) AS lost FROM fields GROUP BY 1""",
    run_compare: """WITH r AS (SELECT year(o_orderdate) AS y, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT * FROM r WHERE y = 1996), b AS (SELECT * FROM r WHERE y = 1997)
      SELECT o_orderpriority, o_orderstatus, a.n AS base, b.n AS new, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'no_data' WHEN b.n - a.n > 3 THEN 'better' WHEN b.n - a.n < -3 THEN 'worse' ELSE 'same' END AS verdict
      FROM a FULL JOIN b USING (o_orderpriority, o_orderstatus)""",
    sample_sets: """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
      SELECT *, only_base = 0 AND only_new = 0 AS comparable FROM (SELECT (SELECT count(*) FROM a WHERE o_custkey NOT IN (FROM b)) AS only_base, (SELECT count(*) FROM b WHERE o_custkey NOT IN (FROM a)) AS only_new)""",
    confusion: _CELLS,
    confusion_pivot: f"SELECT truth, " + ", ".join(f"coalesce(sum(n) FILTER (predicted = '{x}'), 0)::BIGINT AS \"{x}\"" for x in ("en", "fr", "de", "es", "(unclassified)")) + f" FROM ({_CELLS}) GROUP BY 1",
    classification_metrics: f"""WITH c AS ({_CELLS}), a AS (SELECT truth AS label, sum(n)::BIGINT AS support, coalesce(sum(n) FILTER (truth = predicted), 0)::BIGINT AS hits FROM c GROUP BY 1),
      p AS (SELECT predicted AS label, sum(n)::BIGINT AS predicted FROM c WHERE predicted <> '(unclassified)' GROUP BY 1), j AS (SELECT label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted FROM a FULL JOIN p USING (label))
      SELECT *, hits::DOUBLE / nullif(predicted, 0) AS precision, hits::DOUBLE / nullif(support, 0) AS recall, CASE WHEN hits > 0 THEN 2.0::DOUBLE * hits / (predicted + support) END AS f1 FROM j""",
    classification_summary: f"""SELECT *, right_::DOUBLE / n AS accuracy FROM (SELECT count(*) AS n, count(*) FILTER (truth = predicted) AS right_, count(*) FILTER (predicted IS NULL) AS unclassified,
      count(*) FILTER (predicted IS NOT NULL AND truth <> predicted) AS crossed FROM ({_PREDICTED}))""".replace("*, right_::", 'n, right_ AS "right", unclassified, crossed, right_::'),
    percentiles_gated: """SELECT user_id % 40 AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS error_rate, count(v) AS timed,
      CASE WHEN count(v) >= 2 THEN quantile_disc(v, 0.5) END AS p50, CASE WHEN count(v) >= 20 THEN quantile_disc(v, 0.95) END AS p95, CASE WHEN count(v) >= 100 THEN quantile_disc(v, 0.99) END AS p99
      FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1""",
}
