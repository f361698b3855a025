"""Classification, grounding, layout, repair and streams over documents, pages, benchmark and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.functions import codes as C
from docmeter.functions import dates as D
from docmeter.functions import geometry
from docmeter.functions import text as T
from docmeter.operators import layout, rules
from docmeter.sources.scratch import scratch_path
from docmeter.sources.tables import read_table as table
from docmeter.streaming import counters


def hourly_stream(spark: SparkSession, d: str) -> DataFrame:
    """The hourly counter as a stream over the events; equals the batch count."""
    base = scratch_path(spark, "hourly")
    source = f"{d}/events.parquet"
    stream = counters.file_stream(spark, source, spark.read.parquet(source).schema)
    counters.run_to_table(counters.hourly(stream, "ts", [F.col("event_type")], None), f"{base}/out", f"{base}/checkpoint")
    out = counters.latest(spark, f"{base}/out", ["hour", "event_type"], "total")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def value_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Fields of each document that its text bears out: its first word does, a made-up one doesn't."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    first = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    fields = F.create_map(F.lit("first"), first, F.lit("made_up"), F.concat(F.lit("ZQ"), F.col("doc_id").cast("string"), F.lit("QZ")), F.lit("free"), F.lit("anything"))
    out = rules.grounded(docs.withColumn("fields", fields), "fields", "text", ["first", "made_up"])
    return out.select("doc_id", F.array_join("removed", ",").alias("removed"), F.size("fields").cast("long").alias("kept"))


def type_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Types of benchmark texts that were given titles by item."""
    titles = F.array(*[F.lit(x) for x in ("Credencial para votar. Clave de elector", "Acta de nacimiento", "Passport / Pasaporte", "Constancia de la clave; RENAPO", "nothing")])
    t = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", F.element_at(titles, (F.col("item_id") % 5 + 1).cast("int")), "text").alias("text"))
    return t.select("item_id", rules.document_type(F.col("text")).alias("doc_type"))


def fuzzy_classify(spark: SparkSession, d: str) -> DataFrame:
    """Titles with two wrong characters are still found, anywhere in the text."""
    noisy = F.when(F.col("item_id") % 2 == 0, "CREDENC1AL PARA V0TAR").otherwise("nothing of the kind")
    t = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", "text", noisy).alias("text"))
    return t.select("item_id", rules.tolerant_hits(F.col("text"), ["CREDENCIAL PARA VOTAR", "REGISTRO CIVIL"]).alias("hits"))


#: Titles by kind: clean, read with some faults, read with too many.
TITLES = (
    ("CREDENCIAL PARA VOTAR, CLAVE DE ELECTOR", "CREDENC1AL PARAVOTAR - CLAVE DE ELECT0R", "CR3DENC1AL P4R4 V0T4R CL4V3"),
    ("Acta de nacimiento, registro civil", "ACTA DE NAC1MIENTO / REG1STRO CIVIL", "ACT NACMNTO RGSTRO"),
    ("PASAPORTE date of birth", "PASAP0RTE DATE OFBIRTH", "PASPRT DTE"),
    ("Clave unica de registro de poblacion RENAPO", "CLAVE UN1CA DE REG1STRO DE P0BLACION RENAPO", "CLVE UNCA RGSTRO"),
    ("VIGENCIA EMISION LOCALIDAD", "CREDENCIAL PARA VOTAR, ACTA DE NACIMIENTO, REGISTRO CIVIL", "P<<MEX LOPEZ <<<<<<<<"),
)


def tolerant_types(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a title of some kind, clean or noisy, in the middle of their text."""
    k = F.col("doc_id")
    title = F.element_at(F.array(*[F.lit(x) for t in TITLES for x in t]), (k % 15 + 1).cast("int"))
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat_ws(" ", F.left("text", half), title, F.substr("text", half + 1))
    return rules.tolerant_type(table(spark, d, "documents").select("doc_id", text.alias("text")), "text").select("doc_id", "doc_type")


#: Kind, letters, points and the pieces of which a run of so few edits holds one whole: a cheap test before the edits are counted.
_SIGNALS = [(kind, phrase.replace(" ", ""), points, [piece for _, piece in rules.Sought.of(phrase).pieces]) for kind, phrases in rules.TYPE_PHRASES for phrase, points in phrases]
TOLERANT_SQL = f"""WITH t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(upper(strip_accents(concat_ws(' ', left(text, length(text) // 2), {[x for t in TITLES for x in t]}[doc_id % 15 + 1], substr(text, length(text) // 2 + 1)))), '[^A-Z0-9<]+', ' ', 'g')), ' ') AS w
    FROM documents),
  word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
  placed AS (SELECT doc_id, length(x) AS n, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, x FROM word WHERE x <> ''),
  ahead AS (SELECT doc_id, upto - n AS start, string_agg(x, '') OVER w AS ahead, list(upto) OVER w AS ends FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN CURRENT ROW AND 38 FOLLOWING)),
  span AS (SELECT DISTINCT doc_id, left(ahead, n) AS s FROM (SELECT doc_id, ahead, (unnest(ends) - start)::INT AS n FROM ahead) WHERE n BETWEEN 5 AND 38),
  kinds AS (SELECT DISTINCT s FROM span),
  sig(kind, p, points, pieces) AS (VALUES {", ".join(f"('{a}', '{b}', {c}, {e})" for a, b, c, e in _SIGNALS)}),
  like_ AS (SELECT s, kind, p, points FROM kinds JOIN sig 
    ON CASE WHEN abs(length(s) - length(p)) <= length(p) * 16 // 100 AND len([x FOR x IN pieces IF contains(s, x)]) > 0 THEN levenshtein(s, p) <= length(p) * 16 // 100 ELSE false END),
  whole AS (SELECT doc_id, array_to_string(w, '') AS c FROM t),
  found AS (SELECT DISTINCT doc_id, kind, p, points FROM span JOIN like_ USING (s)
    UNION ALL SELECT doc_id, kind, rx, points FROM whole, (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in rules.TYPE_STRUCTURES)}) v(kind, rx, points) WHERE regexp_matches(c, rx)),
  score AS (SELECT doc_id, kind, sum(points) AS points, max(points) AS most FROM found GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC) AS r, coalesce(lead(points) OVER (PARTITION BY doc_id ORDER BY points DESC), 0) AS next FROM score)
  SELECT doc_id, CASE WHEN points >= 3 AND points - next >= 2 AND most >= 2 THEN kind END AS doc_type FROM documents LEFT JOIN (FROM best WHERE r = 1) USING (doc_id)"""


def row_cluster(spark: SparkSession, d: str) -> DataFrame:
    """All words of pages placed on a grid come back as their rows."""
    words = F.posexplode(F.split(T.collapse(F.regexp_replace("html", "<[^>]+>", " ")), " ")).alias("i", "text")
    w = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), words)
    top = F.floor(F.col("i") / 6) * 12.0 + (F.col("i") % 3)
    boxes = w.select("doc_id", "page", (F.col("i") % 6 * 50.0).alias("left"), top.alias("top"), (F.col("i") % 6 * 50.0 + 40).alias("right"), (top + 9).alias("bottom"), "text")
    return layout.rows_of_boxes(boxes)


def reconcile_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the rules repair for customers whose code stands in a text, long form."""
    c = table(spark, d, "customer")
    birth = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 15000).cast("int"))
    curp = C.build_curp(F.lit("ANA"), F.lit("LOPEZ"), F.lit("MORA"), birth, F.lit("M"), F.lit("JC"), F.lit("0"))
    c, curp = c.select("c_custkey", F.explode(F.array(curp)).alias("code")), F.col("code")
    k = F.col("c_custkey") % 4
    fields = F.create_map(
        F.lit("curp"), F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.translate(curp, "0", "9")).otherwise(curp),
        F.lit("given"), F.lit("ANA"), F.lit("surname1"), F.lit("LOPEZ"), F.lit("surname2"), F.lit("MORA"),
        F.lit("sex"), F.when(k == 2, F.lit("M")),
    )
    rows = c.select("c_custkey", F.lit("CURP").alias("kind"), F.concat(F.lit("Clave: "), curp, F.lit(" Folio: 12345678")).alias("text"), fields.alias("fields"))
    out = rules.reconcile(rows, "kind", "text", "fields")
    return out.select("c_custkey", F.inline("changes"))


def business_rules(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("issued"), F.year("o_orderdate").alias("y"))
    c, i = rules.curp_rule(F.col("issued"), "1998-06-01"), rules.ine_rule(F.col("y"), "1998-06-01")
    return o.select("o_orderkey", c["expires"].alias("expires"), c["refused"].alias("refused"), i["expires"].alias("year_end"), i["refused"].alias("expired"))


def long_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    month = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS]), (k % 12 + 1).cast("int"))
    t = F.concat(F.lit("Dado a "), (k % 31 + 1).cast("string"), F.lit(" de "), month, F.lit(" de "), (1980 + k % 40).cast("string"), F.lit("."))
    return table(spark, d, "orders").select("o_orderkey", D.spanish_long_date(t).alias("day"))


def elector_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys built for customers, some with another's sex or an impossible state."""
    c = table(spark, d, "customer")
    birth, k = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") % 12000).cast("int")), F.col("c_custkey") % 6
    key = C.elector_key(F.lit("ANA"), F.lit("LOPEZ"), F.lit("MORA"), birth, F.when(k == 1, 77).otherwise(14), F.when(k == 2, "H").otherwise("M"), F.lit("100"))
    c = c.select("c_custkey", birth.alias("birth"), F.explode(F.array(F.when(k == 3, F.lower(key)).otherwise(key))).alias("key"))
    return c.select("c_custkey", "key", F.array_join(C.elector_key_errors(F.col("key"), F.col("birth"), F.lit("M")), ",").alias("errors"))


def projected_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of parts under a shift and a doubling, by order of the part's size."""
    p = table(spark, d, "part")
    x = F.col("p_size").cast("double")
    fields = p.select(F.col("p_partkey").alias("sample_id"), (F.col("p_partkey") % 2).alias("page_index"), F.struct(x.alias("x0"), (x + 1).alias("y0"), (x + 4).alias("x1"), (x + 3).alias("y1")).alias("box"))
    matrix = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((2, 0, 10), (0, 2, -1), (0, 0, 1))])
    log = p.select(F.col("p_partkey").alias("sample_id"), (F.col("p_partkey") % 2).alias("page_index"), matrix.alias("matrix"))
    return geometry.projected(fields, log).select("sample_id", "box_px.*")


def passport_lines(spark: SparkSession, d: str) -> DataFrame:
    """Second lines of passports with one digit changed in each fifth: its checks must fail."""
    c = table(spark, d, "customer")
    line = C.td3_line2(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("UTO"), F.lit("1980-01-02").cast("date"), F.lit("F"), F.lit("2030-03-04").cast("date"), F.lit(None).cast("string"))
    c, line = c.select("c_custkey", F.explode(F.array(line)).alias("line")), F.col("line")
    seen = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("9"), F.substring(line, 2, 43))).otherwise(line)
    return c.select("c_custkey", F.array_join(C.td3_errors(seen), ",").alias("errors"))


QUERIES = {
    hourly_stream: "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS total FROM events GROUP BY 1, 2",
    value_grounding: "SELECT doc_id, 'made_up' AS removed, 2::BIGINT AS kept FROM documents",
    type_classifier: "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'INE' WHEN 1 THEN 'ACTA' WHEN 2 THEN 'PASAPORTE' WHEN 3 THEN 'CURP' END AS doc_type FROM benchmark",
    fuzzy_classify: "SELECT item_id, (item_id % 2 = 0)::INT AS hits FROM benchmark",
    tolerant_types: TOLERANT_SQL,
    row_cluster: None,
    reconcile_changes: None,
    business_rules: """SELECT o_orderkey, (o_orderdate::DATE + 90)::DATE AS expires, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-06-01') > 90 THEN 'older than allowed'
      WHEN date_diff('day', o_orderdate::DATE, DATE '1998-06-01') < -1 THEN 'dated in the future' END AS refused, make_date(year(o_orderdate), 12, 31) AS year_end,
      CASE WHEN make_date(year(o_orderdate), 12, 31) < DATE '1998-06-01' THEN 'expired' END AS expired FROM orders""",
    long_dates: "SELECT o_orderkey, try_strptime((1980 + o_orderkey % 40) || '-' || (o_orderkey % 12 + 1) || '-' || (o_orderkey % 31 + 1), '%Y-%m-%d')::DATE AS day FROM orders",
    elector_keys: """SELECT c_custkey, CASE k WHEN 3 THEN lower(key) ELSE key END AS key, CASE k WHEN 1 THEN 'state' WHEN 2 THEN 'sex' WHEN 3 THEN 'structure' ELSE '' END AS errors FROM (SELECT c_custkey, c_custkey % 6 AS k,
      'LPMRAN' || strftime((DATE '1960-01-01' + (c_custkey % 12000)::INT)::DATE, '%y%m%d') || CASE c_custkey % 6 WHEN 1 THEN '77' ELSE '14' END || CASE c_custkey % 6 WHEN 2 THEN 'H' ELSE 'M' END || '100' AS key FROM customer)""",
    projected_boxes: """SELECT p_partkey AS sample_id, 2.0::DOUBLE * p_size + 10 AS x0, 2.0::DOUBLE * (p_size + 1) - 1 AS y0, 2.0::DOUBLE * (p_size + 4) + 10 AS x1, 2.0::DOUBLE * (p_size + 3) - 1 AS y1 FROM part""",
    passport_lines: """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'number,composite' ELSE '' END AS errors FROM customer""",
}
