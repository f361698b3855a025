"""Identity codes and passport lines made of customers, nations and regions, damaged as recognition damages them, and repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.functions import codes as C
from docmeter.functions import labels as L
from docmeter.functions import text as T
from docmeter.operators import fields as X
from docmeter.operators import repair as R
from docmeter.sources.tables import read_table as table
from docmeter.sources.tables import fixed as _named
from docmeter.sources.tables import spread

STATES = list(R.STATES)
LETTERS_OF = "".join(R.REPAIR_LETTER), "".join(R.REPAIR_LETTER.values())
DIGITS_OF = "".join(R.REPAIR_DIGIT), "".join(R.REPAIR_DIGIT.values())


def people(spark: SparkSession, d: str) -> DataFrame:
    """A person a customer: nation (its number in letters) and segment are the surnames, the region is the given name, all else comes from the key."""
    c = spread(table(spark, d, "customer")).join(F.broadcast(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")), "c_nationkey")
    c = c.join(F.broadcast(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")), "n_regionkey")
    k = F.col("c_custkey")
    birth = F.date_add(F.lit("1940-01-01").cast("date"), (k * 7919 % 21000).cast("int"))
    sex = F.when(k % 2 == 0, "H").otherwise("M")
    c = c.select("c_custkey", "c_name", F.translate("n_name", "0123456789_", "ABCDEFGHIJ").alias("first"), F.col("c_mktsegment").alias("second"), F.col("r_name").alias("given"), birth.alias("birth"), sex.alias("sex"))
    c = R.with_hints(c, "given", "first", "second", "birth", "sex")
    state = F.element_at(F.array(*map(F.lit, STATES)), (k % len(STATES) + 1).cast("int"))
    c = _named(c, body=F.concat(F.left("hints", F.lit(11)), state, F.substring("hints", 14, 3), (k % 10).cast("string")))
    return _named(c, curp=F.concat("body", C.curp_check_digit(F.col("body"))))


_W = lambda w: f"regexp_extract({w}, '^[A-Z]+')"
_IN = lambda w, letters: f"coalesce(nullif(regexp_extract(substr({_W(w)}, 2), '[{letters}]'), ''), 'X')"
_CONS = "B-DF-HJ-NP-TV-Z"
PEOPLE_SQL = f"""person AS (SELECT c_custkey, c_name, translate(n_name, '0123456789_', 'ABCDEFGHIJ') AS first, c_mktsegment AS second, r_name AS given, (DATE '1940-01-01' + (c_custkey * 7919 % 21000)::INT)::DATE AS birth,
    CASE WHEN c_custkey % 2 = 0 THEN 'H' ELSE 'M' END AS sex, {STATES}[c_custkey % {len(STATES)} + 1] AS state, {[*R.STATES.values()]}[c_custkey % {len(STATES)} + 1] AS state_no
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
  hinted AS (SELECT *, left({_W("first")}, 1) || {_IN("first", "AEIOU")} || left({_W("second")}, 1) || left({_W("given")}, 1) || strftime(birth, '%y%m%d') || sex AS head,
    {_IN("first", _CONS)} || {_IN("second", _CONS)} || {_IN("given", _CONS)} AS inner3 FROM person),
  people AS (SELECT *, body || ((10 - list_sum([(instr('{C.CURP_ALPHABET}', substr(body, i, 1)) - 1) * (19 - i) FOR i IN range(1, 18)]) % 10) % 10)::BIGINT AS curp
    FROM (SELECT *, head || state || inner3 || c_custkey % 10 AS body FROM hinted))"""


# Repair by check digit.


def _misread(c: Column) -> Column:
    """Each digit as the letter, each letter as the digit that it is taken for."""
    return F.translate(c, LETTERS_OF[0] + "OIZSBGTDQLH", LETTERS_OF[1] + "01258670" + "01N")


def _hurt(code: Column, places: list[Column]) -> Column:
    """The code with the characters at these places (from 0) misread."""
    hit = lambda i: F.array_contains(F.array(*places), i)
    at = lambda i: F.substr(code, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(18)), lambda i: F.when(hit(i - 1), _misread(at(i))).otherwise(at(i))), "")


def code_repair(spark: SparkSession, d: str) -> DataFrame:
    """Codes damaged at none, one, two and three places, and what the check digit makes of them."""
    k = F.col("c_custkey")
    where = [(k % 18).cast("int"), ((k * 5 + 7) % 18).cast("int"), ((k * 11 + 3) % 18).cast("int")]
    rows = F.array(*[F.struct(F.lit(n).alias("damaged"), (_hurt(F.col("curp"), where[:n]) if n else F.col("curp")).alias("token")) for n in range(4)])
    rows = people(spark, d).select("c_custkey", F.explode(rows).alias("r")).select("c_custkey", "r.*")
    return rows.select("c_custkey", "damaged", "token", R.repaired(F.col("token")).alias("code"))


_READ = [("L", c, x) for c, x in R.REPAIR_LETTER.items()] + [("L", "L", "I"), ("L", "0", "D"), ("L", "0", "Q")]
_READ += [("D", c, x) for c, x in R.REPAIR_DIGIT.items()] + [("S", "N", "H"), ("S", "N", "M"), ("S", "K", "H")]
_READ += [("A", c, x) for t in (R.REPAIR_DIGIT, R.REPAIR_LETTER) for c, x in t.items()]
_MISREAD_SQL = f"translate(substr(curp, i, 1), '{LETTERS_OF[0]}OIZSBGTDQLH', '{LETTERS_OF[1]}0125867001N')"
CODE_REPAIR_SQL = f"""WITH {PEOPLE_SQL},
  t AS (SELECT c_custkey, damaged::INT AS damaged, array_to_string([CASE WHEN (damaged > 0 AND i - 1 = c_custkey % 18) OR (damaged > 1 AND i - 1 = (c_custkey * 5 + 7) % 18)
      OR (damaged > 2 AND i - 1 = (c_custkey * 11 + 3) % 18) THEN {_MISREAD_SQL} ELSE substr(curp, i, 1) END FOR i IN range(1, 19)], '') AS token FROM people, range(4) r(damaged)),
  b AS (SELECT *, CASE WHEN try_cast(substr(token, 5, 2) AS INT) > 26 THEN left(token, 16) || translate(substr(token, 17, 1), '{DIGITS_OF[0]}', '{DIGITS_OF[1]}') || substr(token, 18) ELSE token END AS base FROM t),
  readings(kind, seen, other) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _READ)}),
  o AS (SELECT DISTINCT c_custkey, damaged, base, i, other FROM b, range(1, 19) p(i) JOIN readings ON kind = substr('{R.CURP_TEMPLATE}', i, 1) AND seen = substr(base, i, 1)),
  c AS (SELECT c_custkey, damaged, 0 AS k, base AS code FROM b
    UNION ALL SELECT c_custkey, damaged, 1, left(base, i - 1) || other || substr(base, i + 1) FROM o
    UNION ALL SELECT x.c_custkey, x.damaged, 2, left(x.base, x.i - 1) || x.other || substr(x.base, x.i + 1, y.i - x.i - 1) || y.other || substr(x.base, y.i + 1)
      FROM o x JOIN o y ON x.c_custkey = y.c_custkey AND x.damaged = y.damaged AND x.i < y.i),
  v AS (SELECT DISTINCT * FROM c WHERE regexp_matches(code, '{R.STRICT_CURP}')
    AND (10 - list_sum([(instr('{C.CURP_ALPHABET}', substr(code, i, 1)) - 1) * (19 - i) FOR i IN range(1, 18)]) % 10) % 10 = substr(code, 18, 1)::INT),
  n AS (SELECT c_custkey, damaged, k, min(code) AS code, count(*) AS ways FROM v GROUP BY c_custkey, damaged, k QUALIFY k = min(k) OVER (PARTITION BY c_custkey, damaged))
  SELECT c_custkey, damaged, token, CASE WHEN ways = 1 THEN code END AS code FROM t LEFT JOIN n USING (c_custkey, damaged)"""


# Correction from a text with hints.


def _card(p: DataFrame) -> DataFrame:
    """A text a person, with a code and an elector key that recognition split, misread, cut short or lengthened."""
    k, curp = F.col("c_custkey"), F.col("curp")
    p = R.with_expected_key(p, "given", "first", "second", "birth", "sex", "curp")
    key = F.concat("expected", F.lpad((k % 1000).cast("string"), 3, "0"))
    p = _named(p, key=key)
    part = lambda c, i, n: F.substring(c, i, n)
    letters = lambda c: F.translate(c, "015", "OIS")
    hurt = (
        F.when(k % 7 == 1, F.concat_ws(" ", part(curp, 1, 4), part(curp, 5, 8), part(curp, 13, 6)))
        .when(k % 7 == 2, F.concat(part(curp, 1, 13), F.lit("XZZ"), part(curp, 17, 2)))
        .when(k % 7 == 3, F.concat(part(curp, 1, 15), part(curp, 17, 2)))
        .when(k % 7 == 4, F.concat(part(curp, 1, 6), F.lit("Q"), part(curp, 7, 12)))
        .when(k % 7 == 5, F.concat(part(curp, 1, 4), letters(part(curp, 5, 6)), part(curp, 11, 8)))
        .when(k % 7 == 6, F.concat(part(curp, 1, 4), part(curp, 9, 2), part(curp, 7, 2), part(curp, 5, 2), part(curp, 11, 8)))
        .otherwise(curp)
    )
    worn = (
        F.when(k % 5 == 1, F.concat(part("key", 1, 6), letters(part("key", 7, 8)), part("key", 15, 4)))
        .when(k % 5 == 2, F.concat_ws(" ", part("key", 1, 9), part("key", 10, 9)))
        .when(k % 5 == 3, F.concat(part("key", 1, 4), F.lit("WW"), part("key", 7, 12)))
        .when(k % 5 == 4, F.concat(part("key", 1, 3), F.lit("H"), part("key", 4, 15)))
        .otherwise(F.col("key"))
    )
    text = F.concat_ws("\n", F.concat_ws(" ", F.lit("Clave Unica CURP:"), hurt), F.concat_ws(" ", F.lit("Electar"), worn), F.concat_ws(" ", F.lit("Titular"), "c_name", F.when(k % 3 == 0, hurt)))
    return p.withColumn("text", text)


def code_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The code and the elector key of each person's text, and whether they were corrected."""
    p = _card(people(spark, d))
    curps = R.corrected_curps(p, "c_custkey", "text", "hints").withColumnsRenamed({"code": "curp", "corrected": "curp_corrected"})
    keys = R.corrected_elector_keys(p, "c_custkey", "text", "expected").withColumnsRenamed({"code": "elector_key", "corrected": "key_corrected"})
    return p.select("c_custkey").join(curps, "c_custkey", "left").join(keys, "c_custkey", "left")


def _confusion_sql(c: str) -> str:
    resolved: dict[str, str] = {}
    for group in T.CONFUSED:
        resolved |= dict.fromkeys(group, group[0])
    return f"translate({c}, '{''.join(resolved)}', '{''.join(resolved.values())}')"


_HAS_DIGIT = lambda c: f"((10 - list_sum([(instr('{C.CURP_ALPHABET}', substr({c}, i, 1)) - 1) * (19 - i) FOR i IN range(1, 18)]) % 10) % 10)::BIGINT::VARCHAR"
_TO_DIGIT = "".join(X.TO_DIGIT), "".join(X.TO_DIGIT.values())
_TO_LETTER = "".join(X.TO_LETTER), "".join(X.TO_LETTER.values())


def _placed_sql(c: str, template: str) -> str:
    """A string read by its template, stretch by stretch."""
    out, at = [], 0
    while at < len(template):
        kind = template[at]
        n = 1
        while at + n < len(template) and template[at + n] == kind:
            n += 1
        piece = f"substr({c}, {at + 1}, {n})"
        table_ = {"D": _TO_DIGIT, "L": _TO_LETTER, "S": _TO_LETTER}.get(kind)
        out.append(f"translate({piece}, '{table_[0]}', '{table_[1]}')" if table_ else piece)
        at += n
    return " || ".join(out)


def _tried_sql(places: tuple[int, ...]) -> str:
    return "array_to_string([CASE WHEN list_contains(" + str(list(places)) + ", i) AND substr(hints, i + 1, 1) <> '.' THEN substr(hints, i + 1, 1) ELSE substr(b, i + 1, 1) END FOR i IN range(18)], '')"


_GROUPS = ((), (13, 14, 15), tuple(range(4, 10)), tuple(range(4, 10)) + (13, 14, 15), (0, 1, 2, 3, 13, 14, 15), tuple(range(18)))
CODE_CORRECTIONS_SQL = f"""WITH {PEOPLE_SQL},
  known AS (SELECT *, head || '..' || inner3 || '..' AS hints, expected || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS key FROM (SELECT *,
    left({_W("first")}, 1) || {_IN("first", _CONS)} || left({_W("second")}, 1) || {_IN("second", _CONS)} || left({_W("given")}, 1) || {_IN("given", _CONS)} || strftime(birth, '%y%m%d') || state_no || sex AS expected FROM people)),
  hurt AS (SELECT *, CASE c_custkey % 7 WHEN 1 THEN left(curp, 4) || ' ' || substr(curp, 5, 8) || ' ' || substr(curp, 13) WHEN 2 THEN left(curp, 13) || 'XZZ' || substr(curp, 17)
      WHEN 3 THEN left(curp, 15) || substr(curp, 17) WHEN 4 THEN left(curp, 6) || 'Q' || substr(curp, 7) WHEN 5 THEN left(curp, 4) || translate(substr(curp, 5, 6), '015', 'OIS') || substr(curp, 11)
      WHEN 6 THEN left(curp, 4) || substr(curp, 9, 2) || substr(curp, 7, 2) || substr(curp, 5, 2) || substr(curp, 11) ELSE curp END AS c,
    CASE c_custkey % 5 WHEN 1 THEN left(key, 6) || translate(substr(key, 7, 8), '015', 'OIS') || substr(key, 15) WHEN 2 THEN left(key, 9) || ' ' || substr(key, 10)
      WHEN 3 THEN left(key, 4) || 'WW' || substr(key, 7) WHEN 4 THEN left(key, 3) || 'H' || substr(key, 4) ELSE key END AS e FROM known),
  line AS (SELECT c_custkey, hints, expected, l, list_filter([regexp_replace(upper(w), '[^A-Z0-9ÑÍ|!$]', '', 'g') FOR w IN string_split(['Clave Unica CURP: ' || c, 'Electar ' || e,
      'Titular ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c ELSE '' END][l], ' ')], lambda w: w <> '') AS parts FROM hurt, range(1, 4) r(l)),
  run AS (SELECT c_custkey, hints, expected, l, i * 4 + n AS place, array_to_string(parts[i:i + n - 1], '') AS token FROM line, range(1, 12) a(i), range(1, 5) b(n) WHERE i + n - 1 <= len(parts)),
  tok AS (SELECT c_custkey, hints, expected, token, min((l, place)) AS place, bool_and(l <> 2) AS far FROM run WHERE length(token) BETWEEN 17 AND 19 GROUP BY ALL),
  var AS (SELECT *, unnest(CASE length(token) WHEN 18 THEN [token] WHEN 19 THEN [left(token, i - 1) || substr(token, i + 1) FOR i IN range(1, 20)] ELSE [left(token, i - 1) || 'X' || substr(token, i) FOR i IN range(1, 19)] END) AS v,
    generate_subscripts(CASE length(token) WHEN 18 THEN [0] WHEN 19 THEN range(19) ELSE range(18) END, 1) AS vi FROM tok),
  base AS (SELECT DISTINCT c_custkey, hints, token, CASE WHEN substr(b, 5, 2)::INT > 30 THEN left(b, 16) || translate(substr(b, 17, 1), '{_TO_DIGIT[0]}', '{_TO_DIGIT[1]}') || substr(b, 18) ELSE b END AS b
    FROM (SELECT *, {_placed_sql("v", R.CURP_TEMPLATE)} AS b FROM var) WHERE regexp_matches(b, '^[A-Z]{{4}}[0-9]{{6}}[HM][A-Z]{{2}}') AND list_contains({STATES}, substr(b, 12, 2))),
  tried AS (SELECT *, [{", ".join(_tried_sql(g) for g in _GROUPS)}] AS tries FROM base),
  strong AS (SELECT *, list_filter(tries, lambda t: regexp_matches(t, '{R.STRICT_CURP}') AND {_HAS_DIGIT("t")} = substr(b, 18, 1))[1] AS sure FROM tried),
  offer AS (SELECT c_custkey, token, sure, coalesce(sure, CASE WHEN NOT regexp_matches(token, '{R.STRICT_CURP}') THEN left(tries[6], 17) || {_HAS_DIGIT("tries[6]")} END) AS code FROM strong),
  away AS (SELECT *, levenshtein({_confusion_sql("code")}, {_confusion_sql("token")}) AS d FROM offer WHERE code IS NOT NULL),
  cand AS (SELECT c_custkey, token, code, sure IS NULL OR code <> token AS corrected, d + CASE WHEN sure IS NULL THEN 2 ELSE 0 END AS penalty FROM away
    WHERE (sure IS NOT NULL AND d <= 6) OR (sure IS NULL AND d <= 4 AND regexp_matches(code, '{R.STRICT_CURP}'))),
  vote AS (SELECT a.c_custkey, a.code, a.corrected, a.penalty, sum(least(8, levenshtein({_confusion_sql("a.code")}, {_confusion_sql("r.token")}))) + CASE WHEN a.penalty >= 2 AND a.corrected THEN 2 ELSE 0 END AS total
    FROM (SELECT DISTINCT c_custkey, code, corrected, penalty FROM cand) a JOIN (SELECT DISTINCT c_custkey, token FROM cand) r USING (c_custkey) GROUP BY a.c_custkey, a.code, a.corrected, a.penalty),
  curps AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY total, penalty, code, corrected) = 1),
  kv AS (SELECT c_custkey, expected, token, place, far, v, vi, {_placed_sql("v", R.KEY_TEMPLATE)} AS b, regexp_matches(token, '{R.STRICT_KEY}') AND left(token, 6) = left(expected, 6) AS fine FROM var WHERE length(token) > 17),
  ko AS (SELECT *, CASE WHEN fine THEN token WHEN {_confusion_sql("left(expected, 4)")} = {_confusion_sql("left(v, 4)")} THEN expected || substr(b, 16, 3) END AS code FROM kv WHERE fine OR regexp_matches(substr(b, 16, 3), '^[0-9]{{3}}$')),
  ka AS (SELECT *, CASE WHEN fine THEN 0 ELSE levenshtein({_confusion_sql("code")}, {_confusion_sql("token")}) END AS d FROM ko WHERE code IS NOT NULL),
  keys AS (SELECT * FROM ka WHERE fine OR d <= 7 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, far, place, vi, code) = 1)
  SELECT people.c_custkey, curps.code AS curp, curps.corrected AS curp_corrected, keys.code AS elector_key, keys.code <> keys.token AS key_corrected
  FROM people LEFT JOIN curps USING (c_custkey) LEFT JOIN keys ON keys.c_custkey = people.c_custkey"""



# Passport lines.


def zone_repair(spark: SparkSession, d: str) -> DataFrame:
    """What the rules change in the lines of each person's passport, read whole, with one edit, with several confusions or in part."""
    k = F.col("c_custkey")
    p = people(spark, d).withColumns({"number": F.concat(F.lit("G"), F.lpad(k.cast("string"), 8, "0")), "sex": F.when(F.col("sex") == "H", "M").otherwise("F")})
    p = p.withColumn("expiry", F.date_add(F.lit("2026-01-01").cast("date"), (k % 3000).cast("int")))
    dated = lambda c: (F.date_format(c, "yyMMdd"), C.mrz_check_digit(F.date_format(c, "yyMMdd")))
    p = _named(p, front=F.concat("number", C.mrz_check_digit(F.col("number")), F.lit("MEX"), *dated("birth"), "sex", *dated("expiry"), F.lit("<" * 14 + "0")))
    front = F.col("front")
    p = _named(p, line2=F.concat(front, C.mrz_check_digit(F.concat(F.left(front, F.lit(10)), F.substring(front, 14, 7), F.substring(front, 22, 22)))))
    p = _named(p, line1=F.rpad(F.concat(F.lit("P<MEX"), R.zone_names(F.col("first"), F.col("second"), F.col("given"))), 44, "<"))
    line, at = F.col("line2"), (k * 7 % 44 + 1).cast("int")
    cut = lambda a, n: F.substr(line, a, n)
    head, tail = cut(F.lit(1), at - 1), cut(at + 1, F.lit(44))
    seen2 = (
        F.when(k % 8 == 1, F.concat(head, F.translate(cut(at, F.lit(1)), "0123456789GMEXF<", "OIZ3A5687Q6NFKPL"), tail))
        .when(k % 8 == 2, F.concat(head, tail))
        .when(k % 8 == 3, F.concat(head, F.lit("7"), cut(at, F.lit(44))))
        .when(k % 8 == 4, F.concat(cut(F.lit(1), F.lit(13)), F.translate(cut(F.lit(14), F.lit(6)), "015", "OIS"), cut(F.lit(20), F.lit(1)), cut(F.lit(21), F.lit(24))))
        .when(k % 8 == 5, F.concat(F.lit("ZZZ"), cut(F.lit(4), F.lit(29)), F.lit(" ##")))
        .when(k % 8 > 5, F.lit("none"))
        .otherwise(F.concat(cut(F.lit(1), F.lit(20)), F.lit(" "), F.replace(cut(F.lit(21), F.lit(24)), F.lit("<"), F.lit("«"))))
    )
    first_line = F.when(k % 4 == 0, F.col("line1")).when(k % 4 == 1, F.translate("line1", "S", "5")).otherwise("Pasaporte")
    now = F.create_map(
        F.lit("line2"), F.when(k % 8 == 6, F.concat(cut(F.lit(1), F.lit(28)), F.lit(" "), cut(F.lit(29), F.lit(16)))).when(k % 8 == 7, line),
        F.lit("line1"), F.when(k % 4 == 2, F.lower("line1")), F.lit("number"), F.col("number"), F.lit("birth"), F.date_format("birth", "dd/MM/yyyy"),
        F.lit("expiry"), F.date_format("expiry", "dd/MM/yyyy"), F.lit("sex"), F.col("sex"), F.lit("given"), F.col("given"), F.lit("first"), F.col("first"), F.lit("second"), F.col("second"),
    )
    rows = p.select("c_custkey", F.concat_ws("\n", F.lit("PASSPORT"), first_line, seen2).alias("text"), now.alias("fields"))
    return R.zone_changes(_named(rows, text=F.col("text")), "c_custkey", "text", "fields")


_ZONE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DV = lambda s: f"(list_sum([greatest(instr('{_ZONE}', substr({s}, i, 1)) - 1, 0) * [7, 3, 1][(i - 1) % 3 + 1] FOR i IN range(1, length({s}) + 1)]) % 10)::BIGINT::VARCHAR"
_WHOLE = lambda s: f"(left({s}, 10) || substr({s}, 14, 7) || substr({s}, 22, 22))"


def _valid_sql(s: str) -> str:
    parts = ((1, 9, 10), (14, 6, 20), (22, 6, 28), (29, 14, 43))
    checks = [f"{_DV(f'substr({s}, {a}, {n})')} = substr({s}, {at}, 1)" for a, n, at in parts] + [f"{_DV(_WHOLE(s))} = substr({s}, 44, 1)"]
    return f"(regexp_matches({s}, '^[A-Z0-9<]{{44}}$') AND " + " AND ".join(checks) + ")"


_NAME_SQL = lambda c: f"replace(trim({c}), ' ', '<')"
_D15 = lambda c: f"translate({c}, '{DIGITS_OF[0]}', '{DIGITS_OF[1]}')"
ZONE_REPAIR_SQL = f"""WITH {PEOPLE_SQL},
  pass AS (SELECT c_custkey AS k, 'G' || lpad(c_custkey::VARCHAR, 8, '0') AS number, strftime(birth, '%y%m%d') AS b, CASE sex WHEN 'H' THEN 'M' ELSE 'F' END AS sex,
    strftime((DATE '2026-01-01' + (c_custkey % 3000)::INT)::DATE, '%y%m%d') AS e, rpad('P<MEX' || {_NAME_SQL("first")} || '<' || {_NAME_SQL("second")} || '<<' || {_NAME_SQL("given")}, 44, '<') AS line1, first, second, given FROM people),
  front AS (SELECT *, number || {_DV("number")} || 'MEX' || b || {_DV("b")} || sex || e || {_DV("e")} || '<<<<<<<<<<<<<<0' AS front FROM pass),
  line AS (SELECT *, front || {_DV(_WHOLE("front"))} AS line2, (k * 7 % 44 + 1)::INT AS pl FROM front),
  seen AS (SELECT *, CASE WHEN k % 8 = 0 THEN line2 WHEN k % 8 = 1 THEN left(line2, pl - 1) || translate(substr(line2, pl, 1), '0123456789GMEXF<', 'OIZ3A5687Q6NFKPL') || substr(line2, pl + 1)
      WHEN k % 8 = 2 THEN left(line2, pl - 1) || substr(line2, pl + 1) WHEN k % 8 = 3 THEN left(line2, pl - 1) || '7' || substr(line2, pl)
      WHEN k % 8 = 4 THEN left(line2, 13) || translate(substr(line2, 14, 6), '015', 'OIS') || substr(line2, 20) WHEN k % 8 = 5 THEN 'ZZZ' || substr(line2, 4, 29) || '##' ELSE 'NONE' END AS s2,
    CASE k % 4 WHEN 0 THEN line1 WHEN 1 THEN translate(line1, 'S', '5') ELSE 'PASAPORTE' END AS s1,
    CASE k % 8 WHEN 6 THEN left(line2, 28) || ' ' || substr(line2, 29) WHEN 7 THEN line2 END AS now2, CASE WHEN k % 4 = 2 THEN lower(line1) END AS now1, rtrim(line1, '<') AS told FROM line),
  win AS (SELECT *, CASE WHEN regexp_matches(s2, '{R.LINE2_HEAD}') THEN substr(s2, instr(s2, regexp_extract(s2, '{R.LINE2_HEAD}')), 44) END AS strict,
    CASE WHEN regexp_matches(s2, '{R.LINE2_LAX}') THEN substr(s2, instr(s2, regexp_extract(s2, '{R.LINE2_LAX}')), 44) END AS lax, replace(now2, ' ', '') AS n2 FROM seen),
  judged AS (SELECT *, coalesce({_valid_sql("n2")}, false) AS ok2, coalesce({_valid_sql("strict")}, false) AS whole FROM win),
  hurt AS (SELECT k, strict AS w FROM judged WHERE NOT ok2 AND NOT whole AND strict IS NOT NULL),
  sign(c) AS (SELECT substr('{_ZONE}<', i, 1) FROM range(1, 38) r(i)),
  edit AS (SELECT DISTINCT k, w, i, left(w, i - 1) || c || substr(w, i + 1) AS x, c FROM hurt, range(1, 45) r(i), sign WHERE length(w) = 44 AND c <> substr(w, i, 1)
    UNION ALL SELECT DISTINCT k, w, 0, left(w, i - 1) || c || substr(w, i), '' FROM hurt, range(1, 45) r(i), sign WHERE length(w) = 43),
  fits AS (SELECT *, (i = 0 OR CASE WHEN i IN (10, 14, 15, 16, 17, 18, 19, 20, 22, 23, 24, 25, 26, 27, 28) THEN regexp_matches(c, '[0-9]') AND NOT regexp_matches(substr(w, i, 1), '[0-9]')
      WHEN i BETWEEN 29 AND 42 THEN c = '<' WHEN i IN (11, 12, 13) THEN regexp_matches(c, '[A-Z]') AND NOT regexp_matches(substr(w, i, 1), '[A-Z]')
      WHEN i = 21 THEN c IN ('M', 'F', '<') AND substr(w, i, 1) NOT IN ('M', 'F', '<') ELSE false END) AS better FROM (SELECT DISTINCT k, w, i, x, c FROM edit) WHERE {_valid_sql("x")}),
  one AS (SELECT k, CASE WHEN count(DISTINCT x) = 1 THEN min(x) WHEN count(*) FILTER (better AND i > 0) = 1 THEN min(x) FILTER (better) END AS x FROM fits GROUP BY k),
  multi AS (SELECT k, f || {_DV(_WHOLE("f"))} AS m FROM (SELECT k, left(v, 9) || {_D15("substr(v, 10, 1)")} || 'MEX' || {_D15("substr(v, 14, 7)")} || substr(v, 21, 1) || {_D15("substr(v, 22, 7)")} || '<<<<<<<<<<<<<<0' AS f
    FROM (SELECT k, rpad(coalesce(strict, lax), 44, '<') AS v FROM judged WHERE NOT ok2 AND length(coalesce(strict, lax)) >= 30))),
  al AS (SELECT *, list_sum([(substr(coalesce(strict, lax), i, 1) = substr(line2, i, 1))::INT FOR i IN range(1, 29)]) >= 14 AS agreed FROM judged),
  two AS (SELECT k, now2 AS before, CASE WHEN ok2 THEN n2 WHEN whole THEN strict WHEN x IS NOT NULL THEN x WHEN {_valid_sql("m")} THEN m WHEN agreed THEN line2 END AS after,
      CASE WHEN ok2 OR whole OR x IS NOT NULL THEN 'line2_literal' WHEN {_valid_sql("m")} THEN 'line2_repaired' WHEN agreed THEN 'line2_from_fields' END AS rule FROM al LEFT JOIN one USING (k) LEFT JOIN multi USING (k)),
  wins AS (SELECT *, upper(now1) AS n1, least(length(s1), length(told)) AS n FROM seen),
  ones AS (SELECT k, now1 AS before, CASE WHEN n1 IS NOT NULL THEN n1 WHEN s1 = line1 OR (starts_with(s1, 'P<MEX') AND levenshtein(left(s1, n), left(told, n)) <= greatest(2, n // 8)) THEN line1 END AS after,
    CASE WHEN n1 IS NOT NULL OR s1 = line1 THEN 'line1_literal' ELSE 'line1_from_fields' END AS rule FROM wins)
  SELECT k AS c_custkey, 'line2' AS field, before, after, rule, rule <> 'line2_literal' AS derived FROM two WHERE after IS NOT NULL AND after IS DISTINCT FROM before
  UNION ALL SELECT k, 'line1', before, after, rule, rule <> 'line1_literal' FROM ones WHERE after IS NOT NULL AND after IS DISTINCT FROM before"""


# Labels and values.

LABELS = ["CUSTOMER", "SEGMENT", "NATION", "REGION", "BALANCE"]


def label_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of a form a customer: beside the label, a line or two below it, behind an empty line, or cut off by the next label."""
    c = table(spark, d, "customer").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    c = c.join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    k = F.col("c_custkey")
    lines = F.array(
        F.concat(F.when(k % 3 == 0, "Customer - ").otherwise("CUSTOMER: "), "c_name"), F.lit("Segment"), F.when(k % 4 == 1, "").when(k % 4 == 2, "Region").otherwise(F.col("c_mktsegment")), F.col("c_mktsegment"),
        F.when(k % 5 > 0, "Nation or state :").otherwise("Natl."), F.col("r_name"),
    )
    c = c.select("c_custkey", F.explode(F.array(lines)).alias("lines"))
    known = lambda x: F.upper(x).rlike("^(?:" + "|".join(LABELS) + ")")
    found = {"name": (["CUSTOMER"], 1), "segment": (["MARKET", "SEGMENT"], 2), "nation": (["NATION(?: OR STATE)?"], 1)}
    return c.select("c_custkey", *[F.array_join(L.label_values(F.col("lines"), p, known, n), "|").alias(name) for name, (p, n) in found.items()])


LABEL_VALUES_SQL = """SELECT c_custkey, c_name AS name, CASE c_custkey % 4 WHEN 1 THEN c_mktsegment WHEN 2 THEN '' ELSE c_mktsegment || '|' || c_mktsegment END AS segment,
  CASE WHEN c_custkey % 5 > 0 THEN r_name ELSE '' END AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""


def label_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Brands, types and names of parts against labels: the likest label of each part, at least half alike."""
    p = table(spark, d, "part")
    labels = ["STANDARD POLISHED", "SMALL BRUSHED STEEL", "PROMO", "ECONOMY ANODIZED"]
    read = F.translate(F.upper("p_type"), "EO", "FQ")
    each = F.explode(F.array(*map(F.lit, labels))).alias("label")
    rows = p.select("p_partkey", read.alias("seen"), each)
    rows = rows.withColumn("ratio", L.likeness(F.col("seen"), F.col("label"), 0.5))
    best = rows.groupBy("p_partkey").agg(F.max(F.struct("ratio", "label")).alias("b"))
    return best.where("b.ratio > 0").select("p_partkey", F.col("b.label").alias("label"), F.round("b.ratio", 4).alias("ratio"))


QUERIES = {
    code_repair: CODE_REPAIR_SQL,
    code_corrections: CODE_CORRECTIONS_SQL,
    zone_repair: ZONE_REPAIR_SQL,
    label_values: LABEL_VALUES_SQL,
    label_likeness: None,
}
