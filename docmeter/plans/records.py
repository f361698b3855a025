"""Records of four document types made of customers, nations and regions, some damaged, and the rules that they break."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.functions import codes as C
from docmeter.functions.dates import MONTHS
from docmeter.operators import records as V
from docmeter.operators import repair as R
from docmeter.plans.repair import _CONS, _DV, _HAS_DIGIT, _IN, _W, _WHOLE, PEOPLE_SQL, _named, people

# What a record says, from columns of a person, in SQL that both engines read: field, its line or lines, and by the key's
# remainder the damaged line or lines. The rules are judged by V.violations on one side and by the SQL below on the other.
PARTS = {"ine": 16, "curp": 10, "pasaporte": 9, "acta": 14}
_NEXT = "cast((cast(substr({0}, 18, 1) as int) + 1) % 10 as string)"
RECORDS: dict[str, dict[str, tuple[list[str], dict[int, list[str]]]]] = {
    "ine": {
        "nombre": (["first", "second", "given"], {6: ["lower(first)", "second", "given"]}),
        "domicilio": (["concat('CALLE ', k)", "'COL. CENTRO 06000'", "concat('CIUDAD, ', abbr, '.')"], {4: ["concat('CALLE ', k)", "'COL. CENTRO 06000'", "'CIUDAD, ZZZ.'"], 5: ["concat('CALLE ', k)", "'COL. CENTRO 06000'"]}),
        "clave_elector": (["k18"], {14: ["lower(k18)"]}),
        "curp": (["curp"], {3: [f"concat(left(curp, 17), {_NEXT.format('curp')})"]}),
        "fecha_nacimiento": (["dmy"], {11: ["'31/02/1980'"]}),
        "sexo": (["sex"], {7: ["translate(sex, 'HM', 'MH')"]}),
        "emision": (["cast(2016 + k % 5 as string)"], {}),
        "vigencia": (["cast(2026 + k % 5 as string)"], {1: ["'2050'"]}),
        "anio_registro": (["'2016 00'"], {2: ["'1950 00'"]}),
        "estado": (["no2"], {15: ["'40'"]}),
        "seccion": (["'0042'"], {}),
        "ocr": (["concat('0042', lpad(cast(k as string), 9, '0'))"], {8: ["concat('9042', lpad(cast(k as string), 9, '0'))"]}),
        "cic": (["lpad(cast(k as string), 9, '0')"], {12: ["'999999999'"]}),
        "mrz": (["card1", "card2", "card3"], {9: ["card1", "concat('99', substr(card2, 3))", "card3"], 13: ["card1", "card2", "rpad('SOMEONE<<ELSE', 30, '<')"]}),
        "foto": (["'avatar:0123456789abcdef'"], {}),
        "foto_secundaria": (["'avatar:0123456789abcdef'"], {10: ["'avatar:fedcba9876543210'"]}),
    },
    "curp": {
        "curp": (["curp"], {8: [f"concat(left(curp, 17), {_NEXT.format('curp')})"]}),
        "nombre": (["concat_ws(' ', given, first, second)"], {1: ["concat_ws(' ', second, first, given)"]}),
        "nombre_destinatario": (["concat_ws(' ', given, first, second)"], {2: ["given"]}),
        "codigo_barras": (["curp"], {}),
        "codigo_barras_texto": (["curp"], {2: ["'NONE'"]}),
        "entidad_registro": (["state"], {3: ["'MEXICALI'"]}),
        "fecha_inscripcion": (["'01/06/2000'"], {4: ["'01/01/1900'"]}),
        "lugar_fecha": (["'Ciudad de México, a 5 de mayo de 2020'"], {5: ["'Puebla, 5 de mayo de 2020'"], 6: ["'Ciudad de México, a 31 de mayo de 2000'"], 9: ["'Ciudad de México, a 5 de mayu de 2020'"]}),
        "qr_datos": (["concat('MOCK DATA|', curp)"], {7: ["'MOCK DATA|'"]}),
        "curps_asociadas": ([], {7: ["curp", "curp", "curp"]}),
    },
    "pasaporte": {
        "apellidos": (["concat_ws(' ', first, second)"], {1: ["concat_ws(' ', second, first)"]}),
        "nombres": (["given"], {8: ["lower(given)"]}),
        "lugar_nacimiento": (["state"], {4: ["'OTHER'"]}),
        "curp": (["curp"], {}),
        "numero_pasaporte": (["number"], {7: ["'X00000000'"]}),
        "fecha_nacimiento": (["replace(dmy, '/', ' ')"], {6: ["dmy"]}),
        "fecha_expedicion": (["'29 02 2020'"], {2: ["'01 03 2019'"], 5: ["'01 01 2040'"]}),
        "fecha_caducidad": (["'28 02 2030'"], {}),
        "sexo": (["translate(sex, 'HM', 'MF')"], {3: ["sex"]}),
        "mrz": (["pass1", "pass2"], {2: ["pass1", "concat('Z', substr(pass2, 2))"]}),
        "foto": (["'avatar:0123456789abcdef'"], {}),
        "foto_secundaria": (["'avatar:0123456789abcdef'"], {5: ["'avatar:fedcba9876543210'"]}),
    },
    "acta": {
        "reg_nombres": (["given"], {1: ["lower(given)"]}),
        "reg_primer_apellido": (["first"], {2: ["'OTHER'"]}),
        "reg_segundo_apellido": (["second"], {}),
        "reg_sexo": (["CASE sex WHEN 'H' THEN 'HOMBRE' ELSE 'MUJER' END"], {3: ["sex"]}),
        "reg_fecha_nacimiento": (["dmy"], {4: ["'1980-01-01'"]}),
        "reg_lugar_nacimiento": (["state"], {}),
        "curp": (["curp"], {}),
        **{f"{p}_{part}": ([value], {}) for p, own in (("p1", "first"), ("p2", "second")) for part, value in (("nombres", "given"), ("primer_apellido", own), ("segundo_apellido", "first"))},
        "p1_curp": (["father"], {5: ["curp"]}),
        "p2_curp": (["mother"], {6: ["'NONE'"]}),
        "p1_nacionalidad": (["CASE st WHEN 'NE' THEN 'OTRA' ELSE 'MEXICANA' END"], {7: ["CASE st WHEN 'NE' THEN 'MEXICANA' ELSE 'OTRA' END"]}),
        "p2_nacionalidad": (["CASE st WHEN 'NE' THEN 'OTRA' ELSE 'MEXICANA' END"], {}),
        "fecha_registro": (["'15/03/2001'"], {8: ["'15/03/1930'"], 9: ["'15/15/2001'"]}),
        "entidad_registro": (["'JALISCO'"], {10: ["'NACIDO EN EL EXTRANJERO'"]}),
        "municipio_registro": (["'GUADALAJARA'"], {}),
        "oficialia": (["'7'"], {}),
        "libro": (["'3'"], {}),
        "numero_acta": (["cast(k as string)"], {}),
        "identificador_electronico": (["concat('14', '123', '0007', '2001', lpad(cast(k as string), 5, '0'), '9')"], {11: ["concat('09', '123', '0008', '2001', lpad(cast(k as string), 5, '0'), '9')"]}),
        "identificador_barcode": (["concat('14', '123', '0007', '2001', lpad(cast(k as string), 5, '0'), '9')"], {}),
        "codigo_verificacion": (["'V1'"], {}),
        "codigo_verificacion_barcode": (["'V1'"], {12: ["'V2'"]}),
        "nombre_director": (["'ANA RUIZ'"], {}),
        "certificacion": (["'CERTIFICA'", "'ANA RUIZ'"], {12: ["'CERTIFICA'"]}),
        "firma_electronica": (["'QUJD'", "'QUI='"], {13: ["'QUJD'", "'QUI'"]}),
        "qr": (["'MOCK DATA|qr'"], {}),
    },
}
#: A certificate's code repeats its fields, so it is made of them; its damage is of its last part.
_CORE = "concat_ws('|', 'MOCK DATA', 'ACTA2D', " + ", ".join(RECORDS["acta"][f][0][0] for f in V.CODE_2D_FIELDS) + ", {0})"
RECORDS["acta"]["codigo_2d"] = ([_CORE.format("repeat('QUJD', 32)")], {11: [_CORE.format("'QUJ'")], 13: [_CORE.format("'QUJD'")]})


def _value(doc_type: str, field: str, array: str) -> str:
    """A field's lines, damaged or not, as SQL; ``array`` is how the engine writes an array."""
    right, damaged = RECORDS[doc_type][field]
    lines = lambda x: array.format(", ".join(x)) if x else "NO_LINES"
    if not damaged:
        return lines(right)
    cases = " ".join(f"WHEN {r} THEN {lines(x)}" for r, x in damaged.items())
    return f"CASE k % {PARTS[doc_type]} {cases} ELSE {lines(right)} END"


def _parent(given: Column, first: Column, second: Column, sex: str) -> Column:
    birth = F.date_format(F.date_sub("birth", 9000 if sex == "H" else 8000), "yyMMdd")
    body = V.bound(V.name_letters(given, first, second), lambda n: F.concat(F.left(n, F.lit(4)), birth, F.lit(sex), F.col("st"), F.substring(n, 5, 3), F.lit("0")))
    return V.bound(body, lambda b: F.concat(b, C.curp_check_digit(b)))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    """A person with what documents are made of."""
    p = people(spark, d).withColumns({"k": F.col("c_custkey"), "st": F.substring("curp", 12, 2), "dmy": F.date_format("birth", "dd/MM/yyyy")})
    found = lambda i: V.state_attribute(i, 0, F.col("st"))
    given, first, second, k = F.col("given"), F.col("first"), F.col("second"), F.col("k")
    p = p.withColumns({"k18": F.concat(V.key_letters(given, first, second), F.date_format("birth", "yyMMdd"), F.coalesce(F.nullif(F.lpad(found(1), 2, "0"), F.lit("00")), F.lit("87")), "sex", F.lpad((k % 1000).cast("string"), 3, "0")), "state": found(2), "abbr": found(3), "no2": F.lpad(found(1), 2, "0"), "number": F.concat(F.lit("G"), F.lpad(k.cast("string"), 8, "0"))})
    cic = F.lpad(k.cast("string"), 9, "0")
    card = V.td1_lines(cic, F.concat(F.lit("0042"), cic), F.col("birth"), F.col("sex"), 2026 + k % 5, first, second, given)
    passport = V.td3_lines(F.col("number"), F.col("birth"), F.translate("sex", "HM", "MF"), F.lit("2030-02-28").cast("date"), F.concat_ws(" ", first, second), given)
    p = _named(p, card=card, passport=passport, father=_parent(given, first, first, "H"), mother=_parent(given, second, first, "M"))
    at = lambda c, i: F.get(F.col(c), i)
    return p.select("k", "given", "first", "second", "sex", "curp", "dmy", "st", "k18", "state", "abbr", "no2", "number", "father", "mother", *[at("card", i).alias(f"card{i + 1}") for i in range(3)], *[at("passport", i).alias(f"pass{i + 1}") for i in range(2)])


def record_violations(spark: SparkSession, d: str) -> DataFrame:
    """A record of each type a person, and the rules that it breaks."""
    people_ = _subjects(spark, d)
    out = []
    for doc_type, fields in RECORDS.items():
        entries = ", ".join(f"'{f}', " + _value(doc_type, f, "array({0})").replace("NO_LINES", "cast(array() as array<string>)") for f in fields)
        rows = _named(people_.select(F.col("k").alias("c_custkey"), F.expr(f"map({entries})").alias("fields")), fields=F.col("fields"))
        catalogue = [V.Field(f, lines=len(right) != 1) for f, (right, _) in fields.items()]
        out.append(V.violations(rows, "c_custkey", doc_type, catalogue=catalogue).select("c_custkey", F.lit(doc_type).alias("doc_type"), "rule"))
    return reduce(DataFrame.unionByName, out)


def _stage_sql(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{code}' END" for code, ok in rules.items()) + "], lambda x: x IS NOT NULL)"


_DAY = lambda c, sep="/": f"CASE WHEN regexp_matches({c}, '^[0-9]{{2}}{sep}[0-9]{{2}}{sep}[0-9]{{4}}$') THEN CAST(try_strptime({c}, '%d{sep}%m{sep}%Y') AS DATE) END"
_BORN = lambda c: f"CAST(try_strptime('19' || substr({c}, 5, 6), '%Y%m%d') AS DATE)"
_SHAPED = lambda c: f"regexp_matches({c}, '{C.CURP_PATTERN}')"
_VALID = lambda c: f"({_SHAPED(c)} AND {_HAS_DIGIT(c)} = substr({c}, 18, 1) AND {_BORN(c)} IS NOT NULL)"
_UP = lambda c: f"{c} = upper({c})"
_FIRST4 = lambda g, a, b: f"(left({_W(f'upper({a})')}, 1) || {_IN(f'upper({a})', 'AEIOU')} || left(upper({b}), 1) || left(upper({g}), 1))"
_INNER = lambda g, a, b: f"({_IN(f'upper({a})', _CONS)} || {_IN(f'upper({b})', _CONS)} || {_IN(f'upper({g})', _CONS)})"
_FITS = lambda c, g, a, b: f"(left({c}, 4) = {_FIRST4(g, a, b)} AND substr({c}, 14, 3) = {_INNER(g, a, b)})"
_AGE = lambda b, on: f"(year({on}) - year({b}) - CASE WHEN strftime({on}, '%m%d') < strftime({b}, '%m%d') THEN 1 ELSE 0 END)"
_NAME_FIELD = lambda s, g, n: f"rpad(CASE WHEN length({s}) + 2 + length({g}) <= {n} THEN {s} || '<<' || {g} WHEN {n} - length({s}) - 2 >= 1 THEN {s} || '<<' || left({g}, {n} - length({s}) - 2) ELSE left({s}, {n - 3}) || '<<' || left({g}, 1) END, {n}, '<')"
_ZONED = lambda c: f"replace(upper({c}), ' ', '<')"
_D = lambda s: f"({s} || {_DV(s)})"


def _code_sql(field: str, c: str) -> dict[str, str]:
    return {f"{field}_structure": _SHAPED(c), f"{field}_date": f"NOT {_SHAPED(c)} OR {_BORN(c)} IS NOT NULL", f"{field}_check_digit": f"NOT {_SHAPED(c)} OR {_HAS_DIGIT(c)} = substr({c}, 18, 1)"}


def _person_sql(field: str, c: str, g: str, a: str, b: str, sex: str, born: str | None) -> dict[str, str]:
    rules = {"letters": f"left({c}, 4) = {_FIRST4(g, a, b)}", "sex": f"substr({c}, 11, 1) = {sex}", "consonants": f"substr({c}, 14, 3) = {_INNER(g, a, b)}"}
    rules |= {"birth": f"substr({c}, 5, 6) = strftime({born}, '%y%m%d')"} if born else {}
    return {f"{field}_{name}": f"NOT {_VALID(c)} OR {ok}" for name, ok in rules.items()}


def _fields_sql(doc_type: str) -> str:
    """A row a person with each field's lines as a list."""
    pieces = [f"{_value(doc_type, f, '[{0}]').replace('NO_LINES', '[]::VARCHAR[]')} AS {f}" for f in RECORDS[doc_type]]
    return f"SELECT k, {', '.join(pieces)} FROM subject".replace("as string)", "as varchar)")


_ONE = {t: {f: f"{f}[1]" for f, (right, _) in fields.items() if len(right) == 1} for t, fields in RECORDS.items()}
_I, _P, _Z, _A = (_ONE[t] for t in ("ine", "curp", "pasaporte", "acta"))
_STATE_MAP = lambda by, out: "MAP {" + ", ".join(f"'{row[by]}': '{row[out]}'" for row in V.STATE_ROWS) + "}"
_NAME_OF = lambda c: f"{_STATE_MAP(0, 2)}[substr({c}, 12, 2)]"
_YMD = lambda d: f"strftime({d}, '%y%m%d')"
_CARD2 = lambda b, s, y: f"({_D(b)} || {s} || {_D(y)} || 'MEX<<<<<<<<<<<')"
_WHOLE1 = lambda a, b: f"(substr({a}, 6, 25) || left({b}, 7) || substr({b}, 9, 7) || substr({b}, 19, 11))"
_BI, _BA, _REG = _DAY(_I["fecha_nacimiento"]), _DAY(_A["reg_fecha_nacimiento"]), _DAY(_A["fecha_registro"])
_BZ, _EZ, _XZ = (_DAY(_Z[f], " ") for f in ("fecha_nacimiento", "fecha_expedicion", "fecha_caducidad"))
_KEY_OK = f"regexp_matches({_I['clave_elector']}, '{R.STRICT_KEY}')"
_key_sql = lambda ok: f"NOT {_KEY_OK} OR {ok}"
_M = lambda i: f"mrz[{i}]"
_DIGIT = lambda line, at, n: f"{_DV(f'substr({_M(line)}, {at}, {n})')} = substr({_M(line)}, {at + n}, 1)"
_YEAR = lambda f: f"CAST({f} AS INT)"
_WORDS = r"^Ciudad de México, a ([0-9]{1,2}) de ([a-z]+) de ([0-9]{4})$"
_ISSUED = f"CAST(try_strptime(regexp_extract({_P['lugar_fecha']}, '{_WORDS}', 3) || '-' || list_position({list(MONTHS)}, regexp_extract({_P['lugar_fecha']}, '{_WORDS}', 2)) || '-' || regexp_extract({_P['lugar_fecha']}, '{_WORDS}', 1), '%Y-%m-%d') AS DATE)"
_WORDED = f"regexp_matches({_P['lugar_fecha']}, '{_WORDS}')"
_CUT = lambda c, g, w: f"len(list_filter([{_FITS(c, g, w + '[1]', w + '[j + 1]')} FOR j IN range(1, len({w}))], lambda x: x)) > 0"
# All cuts of a whole name: given names begin with word 1, the surnames with words i and j.
_CUTS = lambda c, w: f"len(list_filter(flatten([[{_FITS(c, w + '[1]', w + '[i]', w + '[j]')} FOR j IN range(i + 1, len({w}) + 1)] FOR i IN range(2, len({w}))]), lambda x: x)) > 0"
_CODE = "codigo_2d[1]"
_BODY = "concat_ws('|', 'MOCK DATA', 'ACTA2D', " + ", ".join(f"{f}[1]" for f in V.CODE_2D_FIELDS) + ")"
_TAIL = f"string_split({_CODE}, '|')[-1]"
_SAME = f"{_CODE} = {_BODY} || '|' || {_TAIL}"
_B64 = lambda c: f"(regexp_matches({c}, '^[A-Za-z0-9+/]*={{0,2}}$') AND length({c}) % 4 = 0)"
_SEX_OF = f"CASE {_A['reg_sexo']} WHEN 'HOMBRE' THEN 'H' WHEN 'MUJER' THEN 'M' END"
_NO_OF = f"lpad({_STATE_MAP(2, 1)}[{_A['entidad_registro']}], 2, '0')"
_ABROAD = f"{_A['entidad_registro']} = 'NACIDO EN EL EXTRANJERO'"


def _parent_sql(p: str, sex: str) -> dict[str, str]:
    c = f"{p}_curp[1]"
    return {
        **_code_sql(f"{p}_curp", c), **_person_sql(f"{p}_curp", c, f"{p}_nombres[1]", f"{p}_primer_apellido[1]", f"{p}_segundo_apellido[1]", f"'{sex}'", None),
        f"{p}_older": f"NOT {_VALID(c)} OR {_AGE(_BORN(c), _BA)} >= 15",
        f"{p}_nationality": f"NOT {_VALID(c)} OR ({p}_nacionalidad[1] = 'MEXICANA') = (substr({c}, 12, 2) <> 'NE')",
    }


#: Stages of rules as SQL; those of ``open`` don't keep later stages from being judged.
STAGES_SQL: dict[str, tuple[list[dict[str, str]], list[str]]] = {
    "ine": ([
        {"unreadable": f"len(nombre) = 3 AND {_BI} IS NOT NULL AND regexp_matches(emision[1] || vigencia[1] || left(anio_registro[1], 4) || estado[1], '^[0-9]+$')"},
        {
            "nombre_capitals": " AND ".join(_UP(f"nombre[{i}]") for i in (1, 2, 3)), "domicilio_capitals": "array_to_string(domicilio, '') = upper(array_to_string(domicilio, ''))", "clave_elector_capitals": _UP(_I["clave_elector"]), "curp_capitals": _UP(_I["curp"]),
            **_code_sql("curp", _I["curp"]), **_person_sql("curp", _I["curp"], "nombre[3]", "nombre[1]", "nombre[2]", "sexo[1]", _BI),
            "key_structure": _KEY_OK, "key_date": _key_sql("try_strptime('20' || substr(clave_elector[1], 7, 6), '%Y%m%d') IS NOT NULL"), "key_state": _key_sql("substr(clave_elector[1], 13, 2) BETWEEN '01' AND '32'"),
            "key_birth": _key_sql(f"substr(clave_elector[1], 7, 6) = {_YMD(_BI)}"), "key_sex": _key_sql("substr(clave_elector[1], 15, 1) = sexo[1]"),
            "key_state_of_code": _key_sql(f"substr(clave_elector[1], 13, 2) = coalesce(lpad({_STATE_MAP(0, 1)}[substr(curp[1], 12, 2)], 2, '0'), substr(clave_elector[1], 13, 2))"),
            "key_letters": _key_sql("left(clave_elector[1], 6) = " + " || ".join(f"left({w}, 1) || {_IN(w, _CONS)}" for w in (f"upper(nombre[{i}])" for i in (1, 2, 3)))),
            "valid_ten_years": f"{_YEAR('vigencia[1]')} = {_YEAR('emision[1]')} + 10", "registered_of_age": f"CAST(left(anio_registro[1], 4) AS INT) BETWEEN year({_BI}) + 18 AND {_YEAR('emision[1]')}",
            "issued_of_age": f"{_AGE(_BI, 'make_date(' + _YEAR('emision[1]') + ', 12, 31)')} >= 18", "state_exists": f"{_YEAR('estado[1]')} BETWEEN 1 AND 32", "ocr_section": "starts_with(ocr[1], seccion[1])",
            "address_lines": "len(domicilio) = 3", "address_colony": "len(domicilio) <> 3 OR regexp_matches(domicilio[2], '^COL[.] .* [0-9]{5}$')",
            "address_state": f"len(domicilio) <> 3 OR CAST({_STATE_MAP(3, 1)}[regexp_extract(domicilio[3], '^.+, ([A-Z]+)[.]$', 1)] AS INT) = {_YEAR('estado[1]')}",
            "td1_shape": "len(mrz) = 3 AND len(list_filter(mrz, lambda x: regexp_matches(x, '^[A-Z0-9<]{30}$'))) = 3", "td1_number": _DIGIT(1, 6, 9), "td1_birth": _DIGIT(2, 1, 6), "td1_expiry": _DIGIT(2, 9, 6),
            "td1_composite": f"{_DV(_WHOLE1('mrz[1]', 'mrz[2]'))} = substr(mrz[2], 30, 1)", "td1_name": "regexp_matches(mrz[3], '^[A-Z].*<<')", "photo_pair": "foto[1] = foto_secundaria[1]",
        },
        {"td1_fields": "substr(mrz[1], 6, 9) = cic[1] AND substr(mrz[1], 16, 2) = '<<' AND substr(mrz[1], 18) = ocr[1]"},
        {"td1_whole": f"mrz[1] = 'IDMEX' || {_D('cic[1]')} || '<<' || ocr[1] AND left(mrz[2], 29) = {_CARD2(_YMD(_BI), 'translate(sexo[1], ' + repr('HM') + ', ' + repr('MF') + ')', '(right(vigencia[1], 2) || ' + repr('1231') + ')')} AND mrz[3] = {_NAME_FIELD(_ZONED('(nombre[1] || ' + repr(' ') + ' || nombre[2])'), _ZONED('nombre[3]'), 30)}"},
    ], ["photo_pair"]),
    "curp": ([
        {**_code_sql("curp", _P["curp"]), "nombre_capitals": _UP(_P["nombre"])},
        {"unreadable": f"{_NAME_OF(_P['curp'])} IS NOT NULL AND {_DAY(_P['fecha_inscripcion'])} IS NOT NULL AND (NOT {_WORDED} OR {_ISSUED} IS NOT NULL)"},
        {
            "curp_name": _CUTS(_P["curp"], "string_split(nombre[1], ' ')"), "addressee": "nombre_destinatario[1] = nombre[1]", "barcode": "codigo_barras_texto[1] = codigo_barras[1]", "state_of_code": f"entidad_registro[1] = {_NAME_OF(_P['curp'])}",
            "inscribed_after_birth": f"{_DAY(_P['fecha_inscripcion'])} >= {_BORN(_P['curp'])}", "place_and_date": _WORDED, "issued_after_inscription": f"NOT {_WORDED} OR {_ISSUED} >= {_DAY(_P['fecha_inscripcion'])}",
            "qr_code": "contains(qr_datos[1], curp[1])", "associated": f"len(list_filter(curps_asociadas, lambda x: x = curp[1] OR left(x, 16) <> left(curp[1], 16) OR NOT {_VALID('x')})) = 0", "associated_two": "len(curps_asociadas) <= 2",
        },
    ], []),
    "pasaporte": ([
        {"apellidos_capitals": _UP(_Z["apellidos"]), "nombres_capitals": _UP(_Z["nombres"]), "lugar_nacimiento_capitals": _UP(_Z["lugar_nacimiento"]), **_code_sql("curp", _Z["curp"])},
        {"unreadable": f"{_BZ} IS NOT NULL AND {_EZ} IS NOT NULL AND {_XZ} IS NOT NULL AND {_NAME_OF(_Z['curp'])} IS NOT NULL AND substr(curp[1], 11, 1) IN ('H', 'M')"},
        {
            "curp_names": _CUT(_Z["curp"], "nombres[1]", "string_split(apellidos[1], ' ')"), "curp_birth": f"{_BORN(_Z['curp'])} = {_BZ}", "curp_sex": "translate(substr(curp[1], 11, 1), 'HM', 'MF') = sexo[1]", "state_of_code": f"lugar_nacimiento[1] = {_NAME_OF(_Z['curp'])}",
            "dates_in_order": f"{_BZ} < {_EZ} AND {_EZ} < {_XZ}", "valid_years": " OR ".join(f"{_XZ} = {_EZ} + INTERVAL {n} YEAR" for n in (3, 6, 10)),
            "td3_shape": "len(mrz) = 2 AND len(list_filter(mrz, lambda x: regexp_matches(x, '^[A-Z0-9<]{44}$'))) = 2", "td3_number": _DIGIT(2, 1, 9), "td3_birth": _DIGIT(2, 14, 6), "td3_expiry": _DIGIT(2, 22, 6), "td3_composite": f"{_DV(_WHOLE('mrz[2]'))} = substr(mrz[2], 44, 1)",
            "photo_pair": "foto[1] = foto_secundaria[1]",
        },
        {"td3_whole": f"mrz[1] = 'P<MEX' || {_NAME_FIELD(_ZONED('apellidos[1]'), _ZONED('nombres[1]'), 39)} AND left(mrz[2], 43) = {_D('numero_pasaporte[1]')} || 'MEX' || {_D(_YMD(_BZ))} || sexo[1] || {_D(_YMD(_XZ))} || '<<<<<<<<<<<<<<0'"},
    ], ["photo_pair"]),
    "acta": ([
        {"unreadable": f"{_BA} IS NOT NULL"},
        {**{f"{f}_capitals": _UP(f"{f}[1]") for f in [f"{w}_{x}" for w in ("reg", "p1", "p2") for x in ("nombres", "primer_apellido", "segundo_apellido")] + ["nombre_director"]}, "sex_word": "reg_sexo[1] IN ('HOMBRE', 'MUJER')"},
        {"unreadable": f"{_REG} IS NOT NULL"},
        {
            **_code_sql("curp", _A["curp"]), **_person_sql("curp", _A["curp"], "reg_nombres[1]", "reg_primer_apellido[1]", "reg_segundo_apellido[1]", _SEX_OF, _BA), "state_of_code": f"reg_lugar_nacimiento[1] = {_NAME_OF(_A['curp'])}",
            **_parent_sql("p1", "H"), **_parent_sql("p2", "M"), "surnames_of_parents": "reg_primer_apellido[1] = p1_primer_apellido[1] AND reg_segundo_apellido[1] = p2_primer_apellido[1]", "registered_after_birth": f"{_REG} >= {_BA}",
            "state_exists": f"NOT {_ABROAD} AND {_NO_OF} IS NOT NULL", "identifier_state": f"{_ABROAD} OR {_NO_OF} IS NULL OR left(identificador_electronico[1], 2) = {_NO_OF}",
            "identifier_parts": f"substr(identificador_electronico[1], 6, 13) = lpad(oficialia[1], 4, '0') || year({_REG}) || lpad(numero_acta[1], 5, '0')",
            "identifier_barcode": "identificador_barcode[1] = identificador_electronico[1]", "verification_barcode": "codigo_verificacion_barcode[1] = codigo_verificacion[1]", "director_named": "contains(array_to_string(certificacion, ' '), nombre_director[1])",
            "signature_base64": _B64("array_to_string(firma_electronica, '')"), "code_2d_mark": f"starts_with({_CODE}, 'MOCK DATA|')", "code_2d_length": f"length({_CODE}) BETWEEN 300 AND 600", "code_2d_fields": _SAME,
            "code_2d_base64": f"NOT ({_SAME}) OR {_B64(_TAIL)}", "code_2d_load": f"NOT ({_SAME}) OR NOT {_B64(_TAIL)} OR length(rtrim({_TAIL}, '=')) * 3 // 4 >= 32", "code_2d_differs": f"NOT ({_SAME}) OR {_CODE} <> qr[1]",
        },
    ], [f"{w}_{x}_capitals" for w in ("reg", "p1", "p2") for x in ("nombres", "primer_apellido", "segundo_apellido")] + ["nombre_director_capitals"]),
}


def _type_sql(t: str) -> str:
    """Rules broken by the records of a type, as a chain of stages, without the end."""
    stages, open_rules = STAGES_SQL[t]
    fixed = [f for f, (right, _) in RECORDS[t].items() if len(right) == 1]
    form = _stage_sql({f"{f}:lines": f"len({f}) = 1" for f in fixed})
    out = [f"{t}_0 AS (SELECT *, {form} AS bad, len({form}) = 0 AS going FROM ({_fields_sql(t)}))"]
    for i, rules in enumerate(stages, 1):
        broken = f"CASE WHEN going THEN {_stage_sql(rules)} ELSE [] END"
        gates = f"len(list_filter(newly, lambda x: NOT list_contains({open_rules or ['']}, x))) = 0"
        out.append(f"{t}_{i} AS (SELECT * EXCLUDE (newly) REPLACE (list_concat(bad, newly) AS bad, going AND {gates} AS going) FROM (SELECT *, {broken} AS newly FROM {t}_{i - 1}))")
    return ",\n  ".join(out)


RECORD_VIOLATIONS_SQL = f"""WITH {PEOPLE_SQL},
  told AS (SELECT c_custkey AS k, given, first, second, sex, birth, curp, substr(curp, 12, 2) AS st, strftime(birth, '%d/%m/%Y') AS dmy, state_no, 'G' || lpad(c_custkey::VARCHAR, 8, '0') AS number, lpad(c_custkey::VARCHAR, 9, '0') AS cic_, {_YMD("birth")} AS b FROM people),
  subject0 AS (SELECT *, {_STATE_MAP(0, 2)}[st] AS state, {_STATE_MAP(0, 3)}[st] AS abbr, lpad({_STATE_MAP(0, 1)}[st], 2, '0') AS no2,
    {" || ".join(f"left({w}, 1) || {_IN(w, _CONS)}" for w in ("first", "second", "given"))} || b || state_no || sex || lpad((k % 1000)::VARCHAR, 3, '0') AS k18,
    {_FIRST4("given", "first", "first")} || strftime((birth - 9000)::DATE, '%y%m%d') || 'H' || st || {_INNER("given", "first", "first")} || '0' AS father17,
    {_FIRST4("given", "second", "first")} || strftime((birth - 8000)::DATE, '%y%m%d') || 'M' || st || {_INNER("given", "second", "first")} || '0' AS mother17,
    'IDMEX' || {_D("cic_")} || '<<0042' || cic_ AS card1, {_CARD2("b", "translate(sex, 'HM', 'MF')", "((26 + k % 5)::VARCHAR || '1231')")} AS card2_, {_NAME_FIELD(_ZONED("(first || ' ' || second)"), _ZONED("given"), 30)} AS card3,
    'P<MEX' || {_NAME_FIELD(_ZONED("(first || ' ' || second)"), _ZONED("given"), 39)} AS pass1, {_D("number")} || 'MEX' || {_D("b")} || translate(sex, 'HM', 'MF') || {_D("'300228'")} || '<<<<<<<<<<<<<<0' AS pass2_ FROM told),
  subject AS (SELECT *, father17 || {_HAS_DIGIT("father17")} AS father, mother17 || {_HAS_DIGIT("mother17")} AS mother, card2_ || {_DV(_WHOLE1("card1", "card2_"))} AS card2, pass2_ || {_DV(_WHOLE("pass2_"))} AS pass2 FROM subject0),
  {",\n  ".join(map(_type_sql, RECORDS))}
  {" UNION ALL ".join(f"SELECT k AS c_custkey, '{t}' AS doc_type, unnest(CASE WHEN list_contains(bad, 'unreadable') THEN ['unreadable'] ELSE bad END) AS rule FROM {t}_{len(STAGES_SQL[t][0])}" for t in RECORDS)}"""

QUERIES = {record_violations: RECORD_VIOLATIONS_SQL}
