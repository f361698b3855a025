"""Values worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from docmeter.functions import codes as C
from docmeter.functions import compare as K
from docmeter.functions import dates as D
from docmeter.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    r = one(
        spark,
        ident=T.identifier(F.lit(" ab c\t1 ")), code=T.code(F.lit(" a b ")), plain=T.plain_text(F.lit(" Ab  C ")), bare=T.strip_accents(F.lit("ÑÁé")),
        keep=T.upper_keep_enye(F.lit("ñandú")), mask=T.mask(F.lit("ABCDEFGHIJ")), short=T.mask(F.lit("ABC")), init=T.holder_initials(F.lit("de la Cruz"), F.lit(None), F.lit("mac")),
        none=T.holder_initials(F.lit(None)), path=T.request_path(F.lit("http://h/a/12/b/a123456789012345678901234/?x=1")), root=T.request_path(F.lit("/")),
        json=T.first_json_object(F.lit("```json {\"a\": 1} ```")), cer=T.character_error_rate(F.lit("abcd"), F.lit("abXd")), cer0=T.character_error_rate(F.lit(""), F.lit("x")),
        fm=T.strip_front_matter(F.lit("---\nk: v\n---\nbody")), clean=T.clean_markup(F.lit("<!-- c -->| a &amp; b |\n---\n# title")),
    )
    assert (r.ident, r.code, r.plain, r.bare, r.keep) == ("ABC1", "A B", "ab c", "NAe", "ÑANDU")
    assert (r.mask, r.init, r.none, r.path, r.root) == ("ABCD••••IJ", "CM", "XXX", "/a/:id/b/:token", "/")
    assert (r.json, r.cer, r.cer0, r.fm, r.clean) == ('{"a": 1}', 0.25, 1.0, "body", "a & b\ntitle")


def test_words(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", "x"), (None, "x")], "e string, a string")
    assert [r.w for r in df.select(T.word_error_rate("e", "a").alias("w")).collect()] == [1 / 3, 1.0, None]


def test_dates(spark):
    r = one(spark, a=D.parse_date(F.lit("1/2/2020")), b=D.parse_date(F.lit("01  02 2020")), c=D.parse_date(F.lit("2020-2-1")), bad=D.parse_date(F.lit("31/02/2021")),
            long=D.spanish_long_date(F.lit("a 12 de mayo de 2022")), leap=D.add_years(F.lit("2020-02-29").cast("date"), 1), age=D.age_on(F.lit("2000-02-29").cast("date"), F.lit("2024-02-28").cast("date")))
    assert r.a == r.b == r.c == dt.date(2020, 2, 1) and r.bad is None
    assert (r.long, r.leap, r.age) == (dt.date(2022, 5, 12), dt.date(2021, 2, 28), 23)


def test_codes(spark):
    curp = C.build_curp(F.lit("ANA"), F.lit("LÓPEZ"), F.lit("MORA"), F.lit("1990-12-31").cast("date"), F.lit("M"), F.lit("JC"), F.lit("0"))
    df = spark.range(1).select(F.explode(F.array(curp)).alias("c"))
    r = df.select("c", C.curp_errors(F.col("c")).alias("ok"), C.curp_birth_date(F.col("c")).alias("b"), C.curp_errors(F.lit("x")).alias("bad")).first()
    assert r.c[:17] == "LOMA901231MJCPRN0" and r.ok == [] and r.b == dt.date(1990, 12, 31) and r.bad == ["structure"]
    total = sum("0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ".index(x) * (18 - i) for i, x in enumerate(r.c[:17]))
    assert r.c[17] == str((10 - total % 10) % 10)
    line = spark.range(1).select(F.explode(F.array(C.td3_line2(F.lit("L898902C3"), F.lit("UTO"), F.lit("1974-08-12").cast("date"), F.lit("F"), F.lit("2012-04-15").cast("date"), F.lit("ZE184226B")))).alias("l"))
    r = line.select("l", C.td3_errors(F.col("l")).alias("e"), C.td3_errors(F.concat(F.lit("9"), F.substring("l", 2, 43))).alias("w")).first()
    assert r.l == "L898902C36UTO7408122F1204159ZE184226B<<<<<10" and r.e == [] and r.w == ["number", "composite"]


def test_keyed_hash(spark):
    import hashlib
    import hmac

    assert one(spark, h=C.keyed_hash("key", F.lit("text"))).h == hmac.new(b"key", b"text", hashlib.sha256).hexdigest()


def test_statuses(spark):
    cases = [
        ("code", "07", "7", True, "MISMATCH"), ("code", "a", " A", True, "NORMALIZED"), ("identifier", "A B", "ab", True, "NORMALIZED"), ("text", "José  Paz", "jose paz", True, "PARTIAL"),
        ("address", "C. 5, A", "c 5 a", True, "NORMALIZED"), ("date", "01/02/2020", "2020-02-01", True, "NORMALIZED"), ("date", "01/02/2020", "soon", True, "UNINTERPRETABLE"),
        ("sex_mx", "M", "mujer", True, "NORMALIZED"), ("sex_icao", "M", "hombre", True, "NORMALIZED"), ("text", "", None, True, "EXACT"), ("text", "", "x", True, "EXTRA"),
        ("text", "x", " ", True, "MISSING"), ("text", "x", "x", False, "NOT_APPLICABLE"),
    ]
    df = spark.createDataFrame(cases, "kind string, e string, a string, ap boolean, want string")
    got = df.select("want", K.field_status(F.col("kind"), F.col("e"), F.col("a"), F.col("ap")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
