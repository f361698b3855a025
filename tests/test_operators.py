"""Operators on rows made by hand."""

import hashlib
import json
import re

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docmeter.operators import evaluation as E
from docmeter.operators import layout, relational, rules, splits
from docmeter.plans import relational as plans
from docmeter.plans import texts
from docmeter.sources import tables
from docmeter.streaming import counters


def test_alerts_keep_every_threshold(spark):
    items = spark.createDataFrame([(1, "2024-01-06"), (2, "2024-03-15")], "id int, expires string").withColumn("expires", F.to_date("expires"))
    sent = spark.createDataFrame([(2, 90)], "id int, threshold int")
    got = sorted((r.id, r.threshold) for r in relational.expiry_alerts(items, sent, "2024-01-01").collect())
    assert got == [(1, 7), (1, 30), (1, 90)]


def test_percentile_gates(spark):
    df = spark.createDataFrame([(1, float(i), False) for i in range(1, 21)], "g int, ms double, failed boolean")
    r = E.latency(df, ["g"], "ms", "failed").first()
    assert (r.p50, r.p95, r.p99) == (10.0, 19.0, None)


def test_macro_f1_counts_missing_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", None), ("a", "c")], "t string, p string")
    r = E.classification_summary(df, "t", "p").first()
    assert (r.n, r.right, r.unclassified, r.crossed) == (3, 1, 1, 1) and abs(r.macro_f1 - (2 / 3) / 2) < 1e-9


def test_round_robin_and_pending(spark):
    df = spark.createDataFrame([("x", k, i) for i, k in enumerate("nndddh")], "s string, k string, id int")
    got = [r.k for r in splits.round_robin(df, "s", "k", ["n", "d", "h"], "id", 5).orderBy("taken").collect()]
    assert got == ["n", "d", "h", "n", "d"]
    done = spark.createDataFrame([(0, "ok", None), (1, "error", True), (2, "error", False)], "id int, status string, retryable boolean")
    assert sorted(r.id for r in splits.pending(df.select("id"), done, "id").collect()) == [1, 3, 4, 5]


def test_round_robin_takes_every_kind_of_the_table(spark):
    df = spark.createDataFrame([("x", k, i) for i, k in enumerate(["b", None, "a", "b", None])] + [("y", "c", 9)], "s string, k string, id int")
    got = [(r.s, r.k, r.id) for r in splits.round_robin(df, "s", "k", None, "id", 4).orderBy("s", "taken").collect()]
    assert got == [("x", "a", 2), ("x", "b", 0), ("x", None, 1), ("x", "b", 3), ("y", "c", 9)]


def test_row_cluster(spark):
    df = spark.createDataFrame([(1, 1, 50.0, 1.0, 90.0, 10.0, "b"), (1, 1, 0.0, 0.0, 40.0, 9.0, "a"), (1, 1, 0.0, 20.0, 9.0, 30.0, "c"), (1, 1, None, 0.0, 1.0, 1.0, "x")], "doc_id int, page int, left double, top double, right double, bottom double, text string")
    assert [r.text for r in layout.rows_of_boxes(df).orderBy("row").collect()] == ["a b", "c"]


def test_compare_runs_without_data(spark):
    base = spark.createDataFrame([("a", 10), ("b", 14)], "k string, n int")
    new = spark.createDataFrame([("a", 35), ("c", 7)], "k string, n int")
    got = {r.k: (r.base, r.new, r.verdict) for r in E.compare_runs(base, new, ["k"], "n", True, 3.0).collect()}
    assert got == {"a": (10, 35, "better"), "b": (14, None, "no_data"), "c": (None, 7, "no_data")}


def test_row_cluster_places_all_words(spark, tmp_path):
    pages = [(1, "<p>" + " ".join(f"w{i}" for i in range(4001)) + "</p>"), (2, "<b>one</b> two"), (3, " ".join(f"x{i % 7}" for i in range(61))), (4, "<br>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    words = {i: re.sub("<[^>]+>", " ", html).split() for i, html in pages}
    want = {(i, n // 6): " ".join(w[n : n + 6]) for i, w in words.items() for n in range(0, len(w), 6)}
    assert {(r.doc_id, r.row): r.text for r in texts.row_cluster(spark, str(tmp_path)).collect()} == want


def test_fuzzy_classify_searches_the_whole_text(spark, tmp_path):
    far = "lorem ipsum dolor " * 20
    items = [(0, far), (1, far + "REGISTR0 CIVIL " + far), (3, far), (4, far + "REG1STRO CIV1L")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.item_id: r.hits for r in texts.fuzzy_classify(spark, str(tmp_path)).collect()} == {0: 1, 1: 1, 3: 0, 4: 2}


def test_tolerant_type(spark):
    far = "lorem ipsum dolor sit amet " * 1300
    cases = [
        ("CREDENCLAL PARA VOTAR. VIGENCIA 2030", "INE"),  # 2 + 1
        (far + "CREDENCIAL PARA V0TAR " + far + "D0MICILIO", "INE"),  # beyond 30,000 characters
        ("CREDENCIAL PARA VOTAR", None),  # 2 points
        ("VIGENCIA EMISION LOCALIDAD SECCION", None),  # no strong signal
        ("CREDENCIAL PARA VOTAR VIGENCIA ACTA DE NACIMIENTO", None),  # margin 1
        ("P<MEXLOPEZ<<ANA<<<<<<<<", "PASAPORTE"),  # structures only: 2 + 1
        ("LPMRAN60010114M100 domicilio", "INE"),  # elector's key and a phrase
        ("Acta de Nacimíento / Registro Civil", "ACTA"),
        ("CLAVE UNICA DE REGISTR0 DE POBLACION RENAPO", "CURP"),
        ("", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    assert [r.doc_type for r in rules.tolerant_type(rows, "text").orderBy("i").collect()] == [w for _, w in cases]


def test_change_log_tells_whole_texts_apart(spark, tmp_path):
    said = {1: ["the cat", "the dog", "the dog"], 2: ["abc", "xyz", "xyzz"], 3: [None, "a", None], 4: ["same"]}
    turns = [(c, 2 * i, "user", x) for c, xs in said.items() for i, x in enumerate(xs)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.step, r.field): (r.old, r.new) for r in plans.change_log(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {k: v for k, v in got.items() if k[2] == "text"} == {(1, 0, "text"): (sha("the cat"), sha("the dog"))}
    assert got[2, 0, "head"] == ("abc", "xyz") and got[2, 1, "size"] == ("3", "4") and (2, 1, "head") not in got
    assert got[3, 0, "head"] == (None, "a") and got[4, 0, "size"] == ("4", None) and (1, 1, "text") not in got


def test_grounding_and_consensus(spark):
    r = spark.range(1).select(rules.consensus(F.array(F.lit("abc"), F.lit("abd"), F.lit("abc"))).alias("c"), rules.confidence(F.lit(3), 4, F.lit(1), F.lit(0)).alias("s")).first()
    assert (r.c, r.s) == ("abc", 0.7)


def test_types(spark):
    r = spark.range(1).select(rules.document_type(F.lit("Pasaporte. Constancia de la clave RENAPO")).alias("a"), rules.document_type(F.lit("hola")).alias("b")).first()
    assert (r.a, r.b) == ("CURP", None)


def test_json_lines(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join([json.dumps({"sample_id": "a", "v": "1"}), "", "{bad", json.dumps({"sample_id": "a", "v": "2"})]))
    schema = StructType([StructField("sample_id", StringType()), StructField("v", StringType())])
    assert [(r.sample_id, r.v) for r in tables.read_answers(spark, str(path), schema).collect()] == [("a", "2")]
    batch = {r.sample_id: r.rejected for r in tables.read_batch(spark, str(path), schema).collect()}
    assert batch["line_2"] == "{bad" and batch["a"] is None


def test_csv_sink(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(2, 'a"b'), (1, "x")], "k int, v string"), str(tmp_path / "o"), ["k"])
    text = next((tmp_path / "o").glob("*.csv")).read_text()
    assert text.splitlines() == ['"k","v"', '"1","x"', '"2","a""b"']


def test_stream_deduplicates_over_restarts(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for more in (None, [(2,), (3,)]):
        if more:
            spark.createDataFrame(more, "k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = counters.file_stream(spark, str(tmp_path / "in"), df.schema)
        counters.deduplicated(stream, "k", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
