"""Rules of whole records: cuts of names, zone lines, form, gates, and what odd records give."""

import datetime
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docmeter.operators import records as V
from docmeter.plans import records as plans


def broken(spark, doc_type, *maps, catalogue=()):
    rows = spark.createDataFrame(list(enumerate(maps)), "id int, fields map<string,array<string>>")
    out = {}
    for r in V.violations(rows, "id", doc_type, catalogue=catalogue).collect():
        out.setdefault(r["id"], []).append(r["rule"])
    return out


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain_letters(given, first, second):
    """By hand, for names without particles."""
    g, a, b = (x.split()[0] if x else "" for x in (given, first, second))
    inner = lambda w, kind: next((c for c in w[1:] if c in kind), "X")
    consonants = "BCDFGHJKLMNPQRSTVWXYZ"
    return a[0] + inner(a, "AEIOU") + (b[:1] or "X") + g[0] + "".join(inner(w, consonants) for w in (a, b, g))


def test_letters_of_names(spark):
    lit = F.lit
    cases = [("ANA", "RUIZ", "LOPEZ", "RULAZPN"), ("MARIA ELENA", "DE LA CRUZ", "", "CUXERXL"), ("JOSE", "ÑUÑEZ", "VACA", "XUVJXCS"), ("OMAR", "MARTA", "MEDINA", "MXMORDM")]
    for given, first, second, want in cases:
        assert value(spark, V.name_letters(lit(given), lit(first), lit(second))) == want
    assert value(spark, V.key_letters(lit("ANA"), lit("RUIZ"), lit("LOPEZ"))) == "RZLPAN"


def test_cuts_of_names(spark):
    words = ["ANA", "ROSA", "RUIZ", "MATA", "LOPEZ"]
    names = [" ".join(w) for n in (2, 3, 4) for w in itertools.permutations(words, n)][:60]
    code = plain_letters("ANA ROSA", "RUIZ", "LOPEZ")
    full = f"{code[:4]}800101MJC{code[4:]}09"

    def fits(name):
        w = name.split()
        cuts = [(i, j) for i in range(1, len(w)) for j in range(i + 1, len(w))]
        return any(plain_letters(" ".join(w[:i]), " ".join(w[i:j]), " ".join(w[j:])) == code for i, j in cuts)

    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["x"] for r in rows.select("n", V.fits_full_name(F.lit(full), F.col("n")).alias("x")).collect()}
    assert got == {n: fits(n) for n in names}
    assert any(got.values()) and not all(got.values())
    assert not value(spark, V.fits_full_name(F.lit(full), F.lit("ANA")))


@pytest.mark.parametrize(
    "surnames,given,want",
    [("RUIZ LOPEZ", "ANA", "RUIZ<LOPEZ<<ANA<<<<<"), ("RUIZ LOPEZ", "ANA ROSA MARIA", "RUIZ<LOPEZ<<ANA<ROSA"), ("MUÑOZ-O'HARA DE LA CRUZ", "ANA", "MUNOZ<O<HARA<DE<L<<A"), ("RUIZ", "", "RUIZ<<<<<<<<<<<<<<<<")],
)
def test_zone_name(spark, surnames, given, want):
    assert value(spark, V.zone_name(F.lit(surnames), F.lit(given), 20)) == want[:20].ljust(20, "<")


def test_form_comes_first(spark):
    catalogue = [V.Field("curp", pattern="^[A-Z]{4}"), V.Field("nombre"), V.Field("curps_asociadas", lines=True)]
    right = {"curp": ["ABCD"], "nombre": ["ANA"], "curps_asociadas": []}
    got = broken(spark, "curp", right | {"curp": ["abcd"], "more": ["x"]}, {"curp": ["ABCD", "ABCD"], "nombre": None}, None, right, catalogue=catalogue)
    assert sorted(got[0]) == ["curp:pattern", "more:surplus"]
    assert sorted(got[1]) == ["curp:lines", "curps_asociadas:missing", "nombre:lines"]
    assert sorted(got[2]) == ["curp:missing", "curps_asociadas:missing", "nombre:missing"]
    assert got[3] == ["curp_structure"]


def test_unreadable_stands_alone_and_gates_hold(spark):
    names = {f"{w}_{p}": ["ANA"] for w in ("reg", "p1", "p2") for p in ("nombres", "primer_apellido", "segundo_apellido")} | {"nombre_director": ["ANA"]}
    born = {"reg_fecha_nacimiento": ["01/01/2001"], "fecha_registro": ["30/02/2001"], "reg_sexo": ["MUJER"]}
    got = broken(spark, "acta", names | born | {"reg_nombres": ["ana"]}, names | born | {"reg_sexo": ["M"], "p1_nombres": ["ana"]}, names | born | {"reg_fecha_nacimiento": ["2001-01-01"]})
    assert got[0] == ["unreadable"]
    assert sorted(got[1]) == ["p1_nombres_capitals", "sex_word"]
    assert got[2] == ["unreadable"]


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a", {"curp": ["X"]}), (1, "b", {"curp": ["X"]})], "rule int, _bad string, fields map<string,array<string>>")
    got = V.violations(rows.withColumnRenamed("rule", "id").withColumn("rule", F.lit("clash")), "id", "curp")
    assert got.columns == ["id", "rule"]
    assert sorted(map(tuple, got.collect())) == [(1, "curp_structure"), (1, "curp_structure"), (1, "nombre_capitals"), (1, "nombre_capitals")]
    assert V.violations(rows.limit(0).withColumnRenamed("rule", "id"), "id", "pasaporte").count() == 0


@pytest.mark.parametrize("office,number", [("7", "12"), ("7", "12345"), ("7", "123456"), ("7", "1234567"), ("12345", "8"), ("7", "123465"), ("7", "124456"), ("", "")])
def test_identifier_parts_as_in_sql(spark, office, number):
    """Numbers longer than their places count as the SQL counts them: by their first digits."""
    identifier = "14123" + office.rjust(4, "0")[:4] + "2001" + "123456"[:5].rjust(5, "0") + "9"
    holds = next(r.holds for stage in V.RULES["acta"].stages for r in stage if r.code == "identifier_parts")
    got = value(spark, holds(F.lit(identifier), F.lit(office), F.lit(datetime.date(2001, 3, 15)), F.lit(number)))
    sql = next(stage["identifier_parts"] for stage in plans.STAGES_SQL["acta"][0] if "identifier_parts" in stage)
    row = f"SELECT ['{identifier}'] AS identificador_electronico, ['{office}'] AS oficialia, ['15/03/2001'] AS fecha_registro, ['{number}'] AS numero_acta"
    assert got == duckdb.sql(f"SELECT {sql} FROM ({row})").fetchall()[0][0]
    assert got == number.startswith("12345")


def test_rules_are_compiled(spark):
    """A generator interprets its argument, so none holds a stage's rules."""
    rows = spark.createDataFrame([(1, {"curp": ["X"]})], "id int, fields map<string,array<string>>")
    plan = V.violations(rows, "id", "curp", catalogue=[V.Field("curp")])._jdf.queryExecution().optimizedPlan().toString()
    generators = re.findall(r"Generate .*", plan)
    assert sum(not re.match(r"Generate explode\(array\(_\w+#\d+\)\)", g) for g in generators) == 1
