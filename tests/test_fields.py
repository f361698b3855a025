"""Field operators on small rows: nulls, empty tables, ties and failures."""

import pytest
from pyspark.sql import functions as F

from docmeter.functions import codes as C
from docmeter.functions.compare import compare_values
from docmeter.functions.text import strip_accents
from docmeter.operators import evaluation as E
from docmeter.operators import fields as X


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_first_value_wins_over_pages_even_if_null(spark):
    pages = "array<struct<fields:array<struct<name:string,value:string>>>>"
    rows = spark.createDataFrame(
        [(1, [([("a", None), ("b", "x")],), ([("a", "2"), ("c", "3"), ("c", "4")],)]), (2, []), (3, None), (4, [(None,), ([(None, "q"), ("a", "5")],)])], f"id long, pages {pages}"
    )
    got = sorted(tuple(r) for r in X.flattened(rows, "id", "pages").collect())
    assert got == [(1, "a", None), (1, "b", "x"), (1, "c", "3"), (4, "a", "5")]
    assert X.flattened(rows.where("false"), "id", "pages").count() == 0


def test_answers(spark):
    rows = spark.createDataFrame(
        [(200, '{"datos": {"a": 1, "b": null, "c": {"d": 2}}, "error": "ignored"}'), (200, "[]"), (502, None), (429, '{"codigo": "BUSY"}'), (404, "{}"), (200, '{"error": "x"}')], "s int, b string"
    )
    got = [r.a for r in rows.select(X.answer(F.col("s"), F.col("b")).alias("a")).collect()]
    assert [(a.status, a.code, a.retryable) for a in got] == [
        ("ok", None, False), ("error", "RESPUESTA_INVALIDA", False), ("error", "RESPUESTA_INVALIDA", True),
        ("error", "BUSY", True), ("error", "HTTP_404", False), ("error", "HTTP_200", False),
    ]
    assert got[0].fields == {"a": "1", "b": None, "c": '{"d":2}'}


def test_confirmation(spark):
    m = F.create_map(F.lit("curp"), F.lit("ab c1"), F.lit("given"), F.lit("Ana"), F.lit("day"), F.lit("31/02/2020"), F.lit("sex"), F.lit(None).cast("string"))
    errors = X.confirmation_errors(m, ["sex", "absent", "given"], {"curp": ("^[A-Z]+$", "letters"), "sex": ("^[HM]$", "H or M")}, ["day"], "no date", "required")
    got = one(spark, X.confirmed(m, ["curp"], ["given"]).alias("m"), errors.alias("e"))
    assert got.m == {"curp": "ABC1", "given": "ANA", "day": "31/02/2020", "sex": None}
    assert got.e == {"sex": "required", "absent": "required", "curp": "letters", "day": "no date"}


def test_another_type_is_refused(spark):
    none = F.lit(None).cast("array<string>")
    got = one(spark, *[X.judged(F.lit(a).cast("string"), F.lit(b).cast("string"), none, F.array(F.lit("x")), F.array().cast("array<string>")).alias(n) for n, a, b in (("p", "A", "B"), ("q", None, "B"), ("r", "A", None), ("s", "A", "A"))])
    assert [x.refused for x in got] == ["chosen A, seen B", None, "chosen A, seen none", None]
    assert got.p.warnings == ["some fields do not stand in the document"]


def test_repair_by_place(spark):
    got = one(spark, X.by_template(F.lit("1OO1"), "LDAS"), X.by_template(F.lit("AB"), "DDDD"), X.by_template(F.lit(None).cast("string"), "LD"))
    assert list(got) == ["I0OI", "48", None]


def test_cuts_of_names(spark):
    words = lambda s: F.split(F.lit(s), " ")
    always = lambda g, a, b: F.lit(True)
    got = one(spark, *[X.three_parts(words(s), always).alias(f"c{i}") for i, s in enumerate(("a b", "a b c", "a b c d"))])
    assert [[tuple(c) for c in cuts] for cuts in got] == [[], [(1, 2)], [(1, 2), (1, 3), (2, 3)]]
    code = C.build_curp(F.lit("MARIA JOSE"), F.lit("DE LA CRUZ"), F.lit("MORA"), F.lit("1990-01-02").cast("date"), F.lit("M"), F.lit("JC"), F.lit("0"))
    assert list(one(spark, X.full_name_fits(code, F.lit("MARIA JOSE DE LA CRUZ MORA")), X.full_name_fits(code, F.lit("PEDRO RUIZ SOTO")))) == [True, False]


def test_placeholders(spark):
    values = ("Sexo: H", "", " ", "(s) x", "ANA", "Sexo: " + "x" * 40, None)
    got = one(spark, *[X.placeholder(F.lit(v).cast("string"), ["Sexo:"]).alias(f"c{i}") for i, v in enumerate(values)])
    assert list(got) == [True, True, True, True, False, False, False]


def test_seals(spark):
    key = F.lit("0123456789abcdef")
    text = F.lit("ñandú")
    got = one(
        spark, X.sealed(text, key).startswith(X.SEALED), X.opened(X.sealed(text, key), key), X.opened(X.sealed(text, key), F.lit("f" * 16)),
        X.opened(text, key), X.sealed(F.lit(""), key), X.opened(F.lit(None).cast("string"), key), X.opened(F.lit(X.SEALED + "AAAA"), key),
    )
    assert list(got) == [True, "ñandú", None, "ñandú", None, None, None]


def test_write_policies(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    old, new = rows((1, "a"), (2, "b"), (None, "n")), rows((2, "c"), (3, "d"), (None, "m"))
    kept = lambda df: sorted(tuple(r) for r in df.where("id IS NOT NULL").collect())
    assert kept(X.admitted(old, new, "id", "skip")) == [(1, "a"), (2, "b"), (3, "d")]
    assert kept(X.admitted(old, new, "id", "overwrite")) == [(1, "a"), (2, "c"), (3, "d")]
    assert X.admitted(old, new, "id", "skip").where("id IS NULL").count() == 2
    assert X.admitted(old, new.where("id = 3"), "id", "append").count() == 4
    with pytest.raises(Exception, match="exists already: 2"):
        X.admitted(old, new, "id", "error").collect()
    with pytest.raises(ValueError):
        X.admitted(old, new, "id", "other")


def test_regression_hidden_by_the_whole(spark):
    run = lambda *r: spark.createDataFrame(list(r), "k string, r long, t long")
    got = X.gains(run(("a", 1, 10), ("b", 5, 10), ("gone", 0, 1)), run(("a", 9, 10), ("b", 4, 10)), "k", "r", "t").collect()
    assert {r.k: r.verdict for r in got} == {None: "better", "a": "better", "b": "worse", "gone": "no_data"}
    assert all(r.hidden_regression for r in got)


def test_throughput_basis(spark):
    rows = spark.createDataFrame([("a", 1000, 500, False), ("a", 3000, None, False), ("a", 4000, None, True), ("b", None, None, True)], "k string, ms long, l long, f boolean")
    got = {r.k: r for r in X.performance(rows, ["k"], "ms", "l", "f").collect()}
    assert (got["a"].n, got["a"].timed, got["a"].mean_ms, got["a"].mean_ms_without_load, got["a"].per_second, got["a"].load_ms) == (3, 2, 2000.0, 1750.0, 0.25, 500)
    assert (got["b"].timed, got["b"].mean_ms, got["b"].per_second) == (0, None, None)
    clocked = X.performance(rows, ["k"], "ms", "l", "f", F.lit(4.0)).where("k = 'a'").first()
    assert (clocked.per_second, clocked.basis) == (0.5, "wall clock")


def test_a_field_that_the_base_lacks_was_wrong(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, field string, ok boolean")
    got = E.regressions(rows((1, "a", True)), rows((1, "a", False), (1, "b", True), (2, "a", True)), ["id"], "field", "ok").collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, 1), ("b", 1, 0)]


def test_one_text_in_two_forms(spark):
    same = lambda e, a: compare_values(F.lit("text"), F.lit(e), F.lit(a))
    got = one(spark, same("Jos\u00e9", "Jose\u0301"), same("straße", "STRASSE"), same("Ñandú", "N\u0303ANDU\u0301"), same("José", "Jose"), same("José", "Juan"), strip_accents(F.lit("Jose\u0301 N\u0303")))
    assert list(got) == ["NORMALIZED", "NORMALIZED", "NORMALIZED", "PARTIAL", "MISMATCH", "Jose N"]
