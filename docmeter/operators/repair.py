"""Repair of identity codes that optical recognition has damaged, from their check digits and from other fields.

``repaired`` needs nothing but the code: it finds the fewest confusions whose undoing makes the check digit right, if there is
one way only. ``corrected_curps`` and ``corrected_elector_keys`` read codes out of whole texts and use what else is known of
a person: names, birth date and sex fix most places of a code.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docmeter.functions.codes import CURP_ALPHABET, bound, curp_check_digit, mrz_check_digit
from docmeter.functions.dates import parse_date
from docmeter.functions.labels import any_like
from docmeter.functions.text import confusion_class, strip_accents
from docmeter.operators.fields import TO_DIGIT, TO_LETTER
from docmeter.sources.tables import fixed

# Confusions that a repair by check digit may undo, the strict form of both codes, and state numbers.
REPAIR_DIGIT = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "T": "7"}
REPAIR_LETTER = {"0": "O", "1": "I", "2": "Z", "5": "S", "8": "B", "6": "G", "7": "T"}
CODE_TOKEN = r"(?<![A-Za-z0-9])[A-Za-z0-9|!]{4} ?[A-Za-z0-9|!]{14}(?![A-Za-z0-9])"
STRICT_CURP = r"^[A-Z]{4}\d{6}[HM][A-Z]{2}[B-DF-HJ-NP-TV-ZÑ]{3}[A-Z0-9]\d$"
STRICT_KEY = r"^[A-Z]{6}\d{8}[HM]\d{3}$"
CURP_TEMPLATE, KEY_TEMPLATE = "LLLLDDDDDDSLLLLLAD", "LLLLLLDDDDDDDDSDDD"
STATES = {
    "AS": "01", "BC": "02", "BS": "03", "CC": "04", "CL": "05", "CM": "06", "CS": "07", "CH": "08", "DF": "09", "DG": "10", "GT": "11",
    "GR": "12", "HG": "13", "JC": "14", "MC": "15", "MN": "16", "MS": "17", "NT": "18", "NL": "19", "OC": "20", "PL": "21", "QT": "22",
    "QR": "23", "SP": "24", "SL": "25", "SR": "26", "TC": "27", "TS": "28", "TL": "29", "VZ": "30", "YN": "31", "ZS": "32", "NE": "87",
}
HINT_PARTICLES = ("DE", "DEL", "LA", "LAS", "LOS", "Y", "MC", "MAC", "VAN", "VON", "DA", "DI", "DD")
HINT_COMMON = ("JOSE", "J", "J.", "MARIA", "MA", "MA.", "M", "M.")

_LETTERS, _DIGITS, _CONSONANTS = string.ascii_uppercase, string.digits, "BCDFGHJKLMNPQRSTVWXYZ"
_PLACES = (*[_LETTERS] * 4, *[_DIGITS] * 6, "HM", *[_LETTERS] * 2, *[_CONSONANTS] * 3, _LETTERS + _DIGITS, _DIGITS)
_VALUE = np.array([max(0, CURP_ALPHABET.find(chr(c))) for c in range(128)])


def _readings(place: int, c: str) -> list[str]:
    """What may stand at a place where ``c`` was read, itself first; only what the code's form allows there, '' for the rest."""
    kind = CURP_TEMPLATE[place]
    other: list[str] = []
    if kind in "LA":
        other += [REPAIR_LETTER.get(c, "")] if kind == "L" else [REPAIR_DIGIT.get(c, ""), REPAIR_LETTER.get(c, "")]
    if kind == "L":
        other += ["I"] if c in "L1" else []
        other += ["D", "Q"] if c == "0" else []
    elif kind == "D":
        other.append(REPAIR_DIGIT.get(c, ""))
    elif kind == "S":
        other += {"N": ["H", "M"], "K": ["H"]}.get(c, [])
    fits = [x for x in dict.fromkeys(other) if x and x != c and x in _PLACES[place]]
    return [c if c in _PLACES[place] else "", *fits]


def _tables() -> np.ndarray:
    """Readings by place, character read and choice, as character codes; 0 is none."""
    out = np.zeros((18, 128, 4), np.int64)
    for place in range(18):
        for c in _LETTERS + _DIGITS:
            for i, x in enumerate(_readings(place, c)):
                out[place, ord(c), i] = ord(x) if x else 0
    return out


_READINGS = _tables()


def _fewest_changes(read: np.ndarray, most: int) -> list[str | None]:
    """Codes (rows of 18 characters) with the fewest changes, up to ``most``, if there is one way only.

    A table by changes and remainder of the check sum counts the ways place by place; a second one adds up their choices, so
    that where the count is one the sum is the way.
    """
    n = len(read)
    ways = np.zeros((n, most + 1, 10), np.int64)
    ways[:, 0, 0] = 1
    choice = np.zeros_like(ways)
    for place in range(18):
        next_ways, next_choice = np.zeros_like(ways), np.zeros_like(ways)
        for i in range(4):
            x = _READINGS[place, read[:, place], i]
            some = np.flatnonzero(x)
            step = (np.arange(10)[None] - (18 - place) * _VALUE[x[some]][:, None]) % 10
            w, c = (np.take_along_axis(t[some], step[:, None, :], 2) for t in (ways, choice))
            if i == 0:
                next_ways[some], next_choice[some] = w, c
            else:
                next_ways[some, 1:] += w[:, :-1]
                next_choice[some, 1:] += c[:, :-1] + i * 4**place * w[:, :-1]
        ways, choice = next_ways, next_choice
    found = ways[:, :, 0] > 0
    least = found.argmax(1)
    at = np.arange(n)
    sure = found.any(1) & (ways[at, least, 0] == 1)
    picked = choice[at, least, 0]
    taken = np.stack([_READINGS[p, read[:, p], (picked >> (2 * p)) & 3] for p in range(18)], 1).astype(np.uint8)
    return [bytes(t).decode() if s else None for t, s in zip(taken, sure, strict=True)]


def _repaired_list(tokens: list[str | None], most: int = 2) -> list[str | None]:
    out: list[str | None] = [None] * len(tokens)
    at = [i for i, t in enumerate(tokens) if t is not None and len(t) == 18 and t.isascii()]
    if at:
        read = np.frombuffer("".join(tokens[i] for i in at).encode(), np.uint8).reshape(-1, 18)
        for i, code in zip(at, _fewest_changes(read, most), strict=True):
            out[i] = code
    return out


@F.pandas_udf(StringType())
def _repair_one(tokens: pd.Series) -> pd.Series:
    return pd.Series(_repaired_list(tokens.tolist()), dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _repair_each(lists: pd.Series) -> pd.Series:
    sizes = [0 if x is None else len(x) for x in lists]
    flat = _repaired_list([t for x in lists if x is not None for t in x])
    ends = np.cumsum(sizes)
    return pd.Series([None if x is None else flat[e - s : e] for x, s, e in zip(lists, sizes, ends, strict=True)], dtype=object)


def _as_read(token: Column) -> Column:
    """Capitals without spaces; what looks like a capital I is one. Of those born before 2000 the 17th place is a digit."""
    t = F.translate(F.upper(F.translate(F.regexp_replace(token, r"\s", ""), "l", "I")), "|!", "II")
    place = F.substring(t, 17, 1)
    old = (F.length(t) == 18) & (F.try_to_number(F.substring(t, 5, 2), F.lit("99")) > 26)
    digit = F.translate(place, "".join(REPAIR_DIGIT), "".join(REPAIR_DIGIT.values()))
    return F.when(old, F.concat(F.left(t, F.lit(16)), digit, F.substring(t, 18, 1))).otherwise(t)


def repaired(token: Column) -> Column:
    """The valid population code that differs from a damaged one in the fewest confusable characters, two at most.

    Null where no such code exists, where several differ in the same fewest places, and for null; spaces do not count. A
    valid code is itself.
    """
    return _repair_one(_as_read(token))


def codes_in(text: Column) -> Column:
    """The distinct valid codes of a whole text, damaged ones repaired, in order of their first place; null text has none."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE_TOKEN), F.lit(0)), _as_read)
    return F.array_distinct(F.array_compact(_repair_each(F.array_distinct(tokens))))


# Hints: a code as far as other fields tell it, a string of 18 characters with '.' at places they do not tell.


def _hint_name(name: Column) -> Column:
    """In capitals without accents, ñ kept."""
    return F.translate(F.upper(strip_accents(F.translate(name, "Ññ", "~~"))), "~", "Ñ")


_PARTICLES = "(?:(?:" + "|".join(HINT_PARTICLES) + r")[\s\-]+)*"


def hint_word(name: Column) -> Column:
    """The first word that is no particle, else the first word; '' for null and for names without words."""
    plain = _hint_name(F.coalesce(name, F.lit("")))
    found = F.regexp_extract(plain, r"^[\s\-]*" + _PARTICLES + r"([^\s\-]+)", 1)
    return F.when(found.isin(*HINT_PARTICLES), F.regexp_extract(plain, r"([^\s\-]+)", 1)).otherwise(found)


def given_hint_word(name: Column) -> Column:
    """As ``hint_word``, but the next one after a common given name that is not alone."""
    plain = _hint_name(F.coalesce(name, F.lit("")))
    both = r"^[\s\-]*" + _PARTICLES + r"([^\s\-]+)[\s\-]+" + _PARTICLES + r"([^\s\-]+)"
    first, second = F.regexp_extract(plain, both, 1), F.regexp_extract(plain, both, 2)
    return F.when(first.isin(*HINT_COMMON) & (second != "") & ~second.isin(*HINT_PARTICLES), second).otherwise(hint_word(name))


def _inner(word: Column, letters: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.substr(word, F.lit(2)), f"[{letters}]", 0), F.lit("")), F.lit("X"))


def _letter(word: Column) -> Column:
    return F.translate(F.left(word, F.lit(1)), "Ñ", "X")


def _consonant(word: Column) -> Column:
    return F.translate(_inner(word, "B-DF-HJ-NÑP-TV-Z"), "Ñ", "X")


def with_hints(rows: DataFrame, given: str, first: str, second: str, birth: str, sex: str, name: str = "hints") -> DataFrame:
    """Adds what names, birth date and sex (H, M) tell of a population code. A null or empty name tells nothing, but for an empty
    second surname, which stands as X."""
    words = {"_w1": hint_word(F.col(first)), "_w2": hint_word(F.col(second)), "_wn": given_hint_word(F.col(given))}
    rows = fixed(rows, **words)
    w1, w2, wn = map(F.col, words)
    told = lambda known, c: F.when(known, c).otherwise(F.lit("."))
    has_second = F.col(second).isNotNull()
    second_letter = F.when(w2 == "", "X").otherwise(_letter(w2))
    date = F.coalesce(F.date_format(birth, "yyMMdd"), F.lit("......"))
    hints = F.concat(
        told(w1 != "", _letter(w1)), told(w1 != "", _inner(w1, "AEIOU")), told(has_second, second_letter), told(wn != "", _letter(wn)), date,
        F.when(F.col(sex).isin("H", "M"), F.col(sex)).otherwise("."), F.lit(".."),
        told(w1 != "", _consonant(w1)), told(has_second, _consonant(w2)), told(wn != "", _consonant(wn)), F.lit(".."),
    )
    return fixed(rows, **{name: hints}).drop(*words)


def agrees(code: Column, hints: Column) -> Column:
    """Whether a code is as the hints tell, at every place they tell."""
    at = lambda c, i: F.substr(c, i, F.lit(1))
    return F.forall(F.sequence(F.lit(1), F.length(hints)), lambda i: (at(hints, i) == ".") | (at(hints, i) == at(code, i)))


def _by_place(code: Column, template: str) -> Column:
    """A string of 18 characters with digits read where digits belong and letters where letters do, a stretch at a time."""
    tables = {"D": TO_DIGIT, "L": TO_LETTER, "S": TO_LETTER, "A": {}}
    out, at = [], 0
    for kind, stretch in groupby(template, lambda k: {"S": "L"}.get(k, k)):
        n = len([*stretch])
        t = tables[kind]
        piece = F.substring(code, at + 1, n)
        out.append(F.translate(piece, "".join(t), "".join(t.values())) if t else piece)
        at += n
    return F.concat(*out)


def _with_hints(code: Column, hints: Column, places: tuple[int, ...]) -> Column:
    at = lambda c, i: F.substring(c, i + 1, 1)
    return F.concat(*[F.when(at(hints, i) != ".", at(hints, i)).otherwise(at(code, i)) if i in places else at(code, i) for i in range(18)])


def fragments(rows: DataFrame, key: str, text: str, label: str = "", carry: Sequence[str] = (), lengths: tuple[int, int] = (16, 20), most: int = 4) -> DataFrame:
    """(key, carry, token, far, place): runs of up to four neighbouring parts of a line whose characters together have such a length.

    Recognition splits words. Parts are the line's words in capitals without other signs. ``far`` is whether none of the line's
    first four words is like ``label``. A token that repeats comes again. Columns to carry are the key's own.
    """
    held = [key, *carry]
    lines = rows.select(*held, F.posexplode(F.split(F.upper(F.col(text)), r"\R")).alias("_line", "_words"))
    lines = lines.select(*held, "_line", F.filter(F.split("_words", r"\s+"), lambda w: w != "").alias("_words"))
    parts = F.filter(F.transform("_words", lambda w: F.regexp_replace(w, "[^A-Z0-9ÑÍ|!$]", "")), lambda w: w != "")
    lines = lines.select(*held, "_line", "_words", parts.alias("_parts")).where("size(_parts) > 0")
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("_parts")),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(most), F.size("_parts") - i + 1)), lambda n: F.struct((i * most + n).alias("place"), F.array_join(F.slice("_parts", i, n), "").alias("token"))
            ),
        )
    )
    runs = F.filter(runs, lambda r: F.length(r["token"]).between(*lengths))
    lines = lines.select(*held, "_line", "_words", F.explode(runs).alias("_r"))
    near = any_like(F.slice("_words", 1, 4), label, 0.6) if label else F.lit(False)
    return lines.select(*held, F.col("_r.token").alias("token"), (~near).alias("far"), F.struct("_line", "_r.place").alias("place"))


def _variants(token: Column, shorter: bool) -> Column:
    """Strings of 18 characters: the token itself, one of 19 with any character left out, one of 17 with an X put in anywhere."""
    cut = lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1, F.lit(18)))
    put = lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.lit("X"), F.substr(token, i, F.lit(18)))
    out = F.when(F.length(token) == 18, F.array(token)).when(F.length(token) == 19, F.transform(F.sequence(F.lit(1), F.lit(19)), cut))
    if shorter:
        out = out.when(F.length(token) == 17, F.transform(F.sequence(F.lit(1), F.lit(18)), put))
    return out.otherwise(F.array().cast("array<string>"))


def _apart(a: Column, b: Column) -> Column:
    """Edits between two readings, characters that recognition mixes up being one."""
    return F.levenshtein(confusion_class(a), confusion_class(b))


def consensus(candidates: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, code, corrected): of each key's candidates (token, code, corrected, penalty) the one nearest to all its readings.

    A reading's distance counts ``most`` at most; a corrected candidate with a penalty of 2 or more pays 2. Ties go to the
    smaller penalty, then code. Readings and candidates are distinct ones.
    """
    # A document has as many readings as its text has tokens that look like a code.
    met = candidates.groupBy(key).agg(F.collect_set("token").alias("_read"), F.collect_set(F.struct("penalty", "code", "corrected")).alias("_o"))
    met = met.select(key, "_read", F.explode("_o").alias("_o")).select(key, "_read", "_o.*")
    away = F.aggregate("_read", F.lit(0), lambda a, t: a + F.least(_apart(F.col("code"), t), F.lit(most)))
    total = met.withColumn("_d", away + F.when((F.col("penalty") >= 2) & F.col("corrected"), 2).otherwise(0))
    return total.groupBy(key).agg(F.min(F.struct("_d", "penalty", "code", "corrected")).alias("_b")).select(key, "_b.code", "_b.corrected")


def corrected_curps(rows: DataFrame, key: str, text: str, hints: str) -> DataFrame:
    """(key, code, corrected): the population code of each text, corrected with the hints; keys without enough evidence are left out.

    Strong evidence is a check digit as read that fits after some group of hinted places is put in, at most 6 edits from
    the reading; weak evidence a code with all hints and its own check digit, at most 4 edits away, unless the reading is
    well formed: then the fault may be anywhere. Null texts have no code; ``key`` tells texts apart.
    """
    tokens = fragments(rows.withColumn("_h", F.col(hints)), key, text, carry=["_h"], lengths=(17, 19))
    v = tokens.select(key, "token", "_h", F.explode(_variants(F.col("token"), True)).alias("_v"))
    v = v.select(key, "token", "_h", _by_place(F.col("_v"), CURP_TEMPLATE).alias("_b"))
    v = v.where(F.col("_b").rlike(r"^[A-Z]{4}\d{6}[HM][A-Z]{2}") & F.substring("_b", 12, 2).isin(*STATES))
    old = F.substring("_b", 5, 2).cast("int") > 30
    digit = _by_place(F.substring("_b", 17, 1), "D")
    v = v.withColumn("_b", F.when(old, F.concat(F.left("_b", F.lit(16)), digit, F.substring("_b", 18, 1))).otherwise(F.col("_b")))
    b, h = F.col("_b"), F.col("_h")
    inner, date = (13, 14, 15), tuple(range(4, 10))
    groups = ((), inner, date, inner + date, (0, 1, 2, 3, *inner), tuple(range(18)))
    tries = F.array(*[_with_hints(b, h, g) for g in groups])
    right = lambda c: F.coalesce(c.rlike(STRICT_CURP) & (curp_check_digit(F.left(c, F.lit(17))) == F.substring(b, 18, 1)), F.lit(False))
    v = v.select(key, "token", "_b", "_h", F.explode(F.array(tries)).alias("_tries"))
    v = v.select(key, "token", "_b", "_tries", F.explode(F.array(F.get(F.filter("_tries", right), F.lit(0)))).alias("_strong"))
    whole = F.left(F.element_at("_tries", len(groups)), F.lit(17))
    weak = F.when(F.col("_strong").isNull() & ~F.col("token").rlike(STRICT_CURP), F.concat(whole, curp_check_digit(whole)))
    v = v.select(key, "token", "_strong", F.explode(F.array(F.coalesce("_strong", weak))).alias("code"))
    away = _apart(F.col("code"), F.col("token"))
    v = v.where("code IS NOT NULL").select(key, "token", "_strong", "code", away.alias("_away"))
    strong = F.col("_strong").isNotNull()
    v = v.where((strong & (F.col("_away") <= 6)) | (~strong & F.col("code").rlike(STRICT_CURP) & (F.col("_away") <= 4)))
    corrected = ~strong | (F.col("code") != F.col("token"))
    return consensus(v.select(key, "token", "code", corrected.alias("corrected"), (F.col("_away") + F.when(strong, 0).otherwise(2)).alias("penalty")), key)


def with_expected_key(rows: DataFrame, given: str, first: str, second: str, birth: str, sex: str, curp: str, name: str = "expected") -> DataFrame:
    """Adds the first 15 places of an elector key as other fields tell it; null unless all but the second surname are known."""
    words = {"_w1": hint_word(F.col(first)), "_w2": hint_word(F.col(second)), "_wn": given_hint_word(F.col(given))}
    for c, value in words.items():
        rows = rows.withColumn(c, F.explode(F.array(value)))
    pair = lambda w: F.when(F.col(w) == "", "XX").otherwise(F.concat(_letter(F.col(w)), _consonant(F.col(w))))
    number = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.substring(curp, 12, 2)]
    known = (F.col(given) != "") & (F.col(first) != "") & F.col(sex).isin("H", "M")
    key = F.when(known, F.concat(*map(pair, words), F.date_format(birth, "yyMMdd"), number, F.col(sex)))
    return rows.withColumn(name, F.explode(F.array(key))).drop(*words)


def corrected_elector_keys(rows: DataFrame, key: str, text: str, expected: str) -> DataFrame:
    """(key, code, corrected): the elector key of each text, the nearest to its reading; ties go to lines with a label like ELECTOR,
    then to the first place.

    A well-formed reading stays, if its letters are the expected ones. With an expectation a token gives its last three digits
    and must be within 7 edits and begin with the same four letters, mixed-up ones being one; without, the token itself counts
    where its characters fit by place. Null texts have no key.
    """
    tokens = fragments(rows.withColumn("_e", F.col(expected)), key, text, "ELECTOR", ["_e"], (18, 19))
    e, t = F.col("_e"), F.col("token")
    fine = t.rlike(STRICT_KEY) & (e.isNull() | t.startswith(F.left(e, F.lit(6))))
    v = tokens.select(key, "token", "far", "place", "_e", F.posexplode(F.when(fine, F.array(t)).otherwise(_variants(t, False))).alias("_i", "_v"), fine.alias("_fine"))
    v = v.withColumn("_b", F.explode(F.array(_by_place(F.col("_v"), KEY_TEMPLATE)))).where(F.col("_fine") | F.substring("_b", 16, 3).rlike(r"^\d{3}$"))
    told = F.concat(e, F.substring("_b", 16, 3))
    same_start = confusion_class(F.left(e, F.lit(4))) == confusion_class(F.left("_v", F.lit(4)))
    code = F.when(F.col("_fine"), t).when(e.isNotNull(), F.when(same_start, told)).when(F.col("_b").rlike(STRICT_KEY), F.col("_b"))
    v = v.withColumn("code", F.explode(F.array(code))).where("code IS NOT NULL")
    away = F.when(F.col("_fine"), 0).when(e.isNotNull(), _apart(F.col("code"), t)).otherwise(F.levenshtein("code", "token"))
    v = v.withColumn("_away", away).where(F.col("_fine") | e.isNull() | (F.col("_away") <= 7))
    best = v.groupBy(key).agg(F.min(F.struct("_away", "far", "place", "_i", "code", "token")).alias("_m"))
    return best.select(key, "_m.code", (F.col("_m.code") != F.col("_m.token")).alias("corrected"))


# The two lines of a passport's machine-readable zone.

# Signs read instead of the filler, where a second line begins (strictly and with confusions), letters for a sex.
FILLERS = "‹«＜≤〈"
LINE2_HEAD = r"[A-Z0-9]{9}[0-9]MEX[0-9]{6}[0-9][MF<][0-9]{6}[0-9]"
LINE2_LAX = r"[A-Z0-9]{9}[0-9OQDIL]M[E5]X[0-9OQDIL]{6}"
ZONE_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<"

#: Each check digit's place and the places that it covers, in order; the last one covers most of the others.
_CHECKS = ((9, range(9)), (19, range(13, 19)), (27, range(21, 27)), (42, range(28, 42)), (43, [*range(10), *range(13, 20), *range(21, 43)]))
_DIGIT_PLACES = [at for at, _ in _CHECKS]
_ZONE_VALUE = np.array([ZONE_ALPHABET.find(chr(c)) % 36 if chr(c) in ZONE_ALPHABET else 0 for c in range(128)])
_ZONE_CODES = np.frombuffer(ZONE_ALPHABET.encode(), np.uint8)


def _coefficients() -> np.ndarray:
    """Five rows: weights of the places a check covers, and -1 for the digit itself; a valid line gives 0 modulo 10 in each."""
    out = np.zeros((5, 44), np.int64)
    for row, (at, covered) in enumerate(_CHECKS):
        for i, place in enumerate(covered):
            out[row, place] = (7, 3, 1)[i % 3]
        out[row, at] -= 1
    return out


_WEIGHTS = _coefficients()


def _needed() -> np.ndarray:
    """By place and what the five checks lack without it (as a number of five digits): its value modulo 10, 10 for any, -1 for none."""
    out = np.full((44, 10**5), -1, np.int8)
    for place in range(44):
        if not _WEIGHTS[:, place].any():
            out[place, 0] = 10
            continue
        for x in range(10):
            out[place, (-_WEIGHTS[:, place] * x) % 10 @ _POWERS] = x
    return out


_POWERS = 10 ** np.arange(4, -1, -1)
_NEEDED = _needed()


def _fillable(lines: np.ndarray, places: np.ndarray) -> list[tuple[int, int, str]]:
    """(row, place, character): what makes all five checks of a line of 44 right if it is written at one of ``places[row]``.

    The checks are linear, so a place's character is told by what they lack without it.
    """
    values = _ZONE_VALUE[lines]
    wrong = ~np.isin(lines[:, _DIGIT_PLACES], _ZONE_CODES[:10])
    row = np.arange(len(lines))[:, None]
    rest = ((values @ _WEIGHTS.T)[:, None, :] - _WEIGHTS.T[places] * values[row, places][:, :, None]) % 10
    needed = _NEEDED[places, rest @ _POWERS]
    # Check digits are digits: none may be another sign but the one that is written.
    others = wrong.sum(1)[:, None] - (wrong[:, None, :] & (places[:, :, None] == np.array(_DIGIT_PLACES))).any(2)
    found = []
    for r, p in np.argwhere((needed >= 0) & (others == 0)):
        place, x = int(places[r, p]), needed[r, p]
        signs = ZONE_ALPHABET[:10] if place in _DIGIT_PLACES else ZONE_ALPHABET
        found += [(int(r), place, c) for c in signs if x == 10 or _ZONE_VALUE[ord(c)] % 10 == x]
    return found


def _zone_valid(line: str) -> bool:
    if len(line) != 44 or any(c not in ZONE_ALPHABET for c in line):
        return False
    codes = np.frombuffer(line.encode(), np.uint8)
    return all(line[d] in string.digits for d in _DIGIT_PLACES) and not ((_WEIGHTS @ _ZONE_VALUE[codes]) % 10).any()


def _expected_at(place: int, c: str) -> bool:
    if place in (9, 19, 27, *range(13, 19), *range(21, 27)):
        return c.isdigit()
    if 28 <= place <= 41:
        return c == "<"
    return c.isalpha() if place in (10, 11, 12) else c in "MF<" if place == 20 else True


def _one_edits(lines: Sequence[str]) -> list[str | None]:
    """Lines of one length: 43, 44 or 45."""
    n, length = len(lines), len(lines[0])
    codes = np.frombuffer("".join(lines).encode(), np.uint8).reshape(n, length)
    found: list[dict[str, tuple[int, str]]] = [{} for _ in lines]
    if length == 45:
        cut = codes[:, [[i for i in range(45) if i != out] for out in range(45)]]
        valid = ~((_ZONE_VALUE[cut] @ _WEIGHTS.T) % 10).any(2) & np.isin(cut[:, :, _DIGIT_PLACES], _ZONE_CODES[:10]).all(2)
        for r, i in np.argwhere(valid):
            found[r][lines[r][:i] + lines[r][i + 1 :]] = int(i), ""
    elif length == 43:
        holes = np.insert(codes, 0, ord("<"), 1)[:, [[*range(1, at + 1), 0, *range(at + 1, 44)] for at in range(44)]].reshape(-1, 44)
        for h, p, c in _fillable(holes, np.tile(np.arange(44), n)[:, None]):
            line = lines[h // 44]
            found[h // 44][line[:p] + c + line[p:]] = p, c
    else:
        for r, p, c in _fillable(codes, np.tile(np.arange(44), (n, 1))):
            if c != lines[r][p]:
                found[r][lines[r][:p] + c + lines[r][p + 1 :]] = p, c
        for r, line in enumerate(lines):
            if len(found[r]) > 1:
                found[r] = {x: (p, c) for x, (p, c) in found[r].items() if _expected_at(p, c) and not _expected_at(p, line[p])}
    return [next(iter(x)) if len(x) == 1 else None for x in found]


def one_edits(lines: Sequence[str], batch: int = 512) -> list[str | None]:
    """For each line the valid line of 44 that is one character written, left out or put in away from it, if there is one.

    Of several by writing, the one that puts an expected character in the place of an unexpected one.
    """
    out: list[str | None] = [None] * len(lines)
    for length in (43, 44, 45):
        at = [i for i, x in enumerate(lines) if len(x) == length and all(c in ZONE_ALPHABET for c in x)]
        for first in range(0, len(at), batch):
            some = at[first : first + batch]
            for i, x in zip(some, _one_edits([lines[i] for i in some]), strict=True):
                out[i] = x
    return out


def one_edit(line: str) -> str | None:
    return one_edits([line])[0]


@F.pandas_udf(ArrayType(StringType()))
def _one_edit_each(lists: pd.Series) -> pd.Series:
    found = iter(one_edits([w for x in lists if x is not None for w in x]))
    return pd.Series([None if x is None else [next(found) for _ in x] for x in lists], dtype=object)


def zone_text(text: Column) -> Column:
    """Capitals with one sign for the filler and without basic entities."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.upper(F.translate(text, FILLERS, "<" * len(FILLERS)))


def zone_valid(line: Column) -> Column:
    """Whether a second line of 44 characters has all five check digits right; null is not."""
    at = lambda i, n: F.substring(line, i, n)
    parts = ((at(1, 9), 10), (at(14, 6), 20), (at(22, 6), 28), (at(29, 14), 43), (F.concat(at(1, 10), at(14, 7), at(22, 22)), 44))
    ok = line.rlike("^[A-Z0-9<]{44}$")
    for covered, place in parts:
        ok = ok & (mrz_check_digit(covered) == at(place, 1))
    return F.coalesce(ok, F.lit(False))


def _windows(lines: Column, head: str) -> Column:
    """Stretches of up to 44 characters of each line from where ``head`` stands."""
    rest = 44 - 28 if head == LINE2_HEAD else 44 - 19
    found = lambda x: F.zip_with(
        F.regexp_extract_all(x, F.lit(f"({head})(?=(.{{0,{rest}}}))"), F.lit(1)), F.regexp_extract_all(x, F.lit(f"({head})(?=(.{{0,{rest}}}))"), F.lit(2)), lambda a, b: F.concat(a, b)
    )
    return F.array_distinct(F.flatten(F.transform(lines, found)))


def _multiple(window: Column) -> Column:
    """A window with digits where digits belong, no personal number and its own last two digits; null if another check fails."""
    digit = lambda w, i, n: F.translate(F.substring(w, i, n), "".join(REPAIR_DIGIT), "".join(REPAIR_DIGIT.values()))
    front = lambda w: F.concat(F.left(w, F.lit(9)), digit(w, 10, 1), F.lit("MEX"), digit(w, 14, 7), F.substring(w, 21, 1), digit(w, 22, 7), F.lit("<" * 14 + "0"))
    whole = lambda f: F.concat(F.left(f, F.lit(10)), F.substring(f, 14, 7), F.substring(f, 22, 22))
    told = lambda w: bound(front(w), lambda f: F.concat(f, mrz_check_digit(whole(f))))
    return F.when(F.length(window) >= 30, bound(F.rpad(window, 44, "<"), told))


def zone_names(first: Column, second: Column, given: Column) -> Column:
    """Surnames and given names as a first line writes them; null without a first surname or given name or with other signs than letters."""
    words = lambda c: F.regexp_replace(F.trim(F.translate(F.upper(strip_accents(F.coalesce(c, F.lit("")))), "Ñ", "N")), r"\s+", "<")
    surnames = F.when(words(second) == "", words(first)).otherwise(F.concat_ws("<", words(first), words(second)))
    out = F.concat(surnames, F.lit("<<"), words(given))
    return F.when((words(first) != "") & (words(given) != "") & out.rlike("^[A-Z<]+$"), out)


def zone_changes(rows: DataFrame, key: str, text: str, fields: str, derived: bool = True) -> DataFrame:
    """(key, field, before, after, rule, derived): what a passport's text and fields say its zone lines should be, where they are not.

    ``fields`` is a map with line1, line2, number, birth and expiry (d/m/yyyy), sex (M, F), given, first and second. A line that is
    valid stays, but for its spelling. Rules for the second line, the first that gives one: as it stands in the text or one
    edit away (line2_literal); with several confusions undone (line2_repaired, derived); put together from the fields, if half
    of some window of the text agrees (line2_from_fields, derived). For the first: as it stands (line1_literal); from the
    names, if a noisy line begins like it (line1_from_fields, derived). Null texts have no lines. ``key`` tells rows apart.
    """

    m = F.col(fields)
    squeeze = lambda c: F.regexp_replace(zone_text(c), r"\s+", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), squeeze), lambda x: x != "")
    r = fixed(rows.select(key, text, fields), _lines=lines)
    r = fixed(r, _now2=squeeze(m["line2"]), _now1=squeeze(m["line1"]), _strict=_windows(F.col("_lines"), LINE2_HEAD), _lax=_windows(F.col("_lines"), LINE2_LAX))
    r = fixed(r, _ok2=zone_valid(F.col("_now2")))
    exact = F.get(F.filter("_strict", zone_valid), F.lit(0))
    r = fixed(r, _exact=F.when(~F.col("_ok2"), exact))
    # Only rows without an exact line are searched for edits.
    r = r.withColumn("_edits", F.array_distinct(F.array_compact(_one_edit_each(F.when(~F.col("_ok2") & F.col("_exact").isNull(), F.col("_strict"))))))
    r = fixed(r, _edit=F.when(F.size("_edits") == 1, F.get("_edits", F.lit(0))))
    r = fixed(r, _both=F.array_distinct(F.concat("_strict", "_lax")))
    several = F.get(F.filter(F.transform("_both", _multiple), zone_valid), F.lit(0))
    number = F.regexp_replace(F.upper(F.coalesce(m["number"], F.lit(""))), "[^A-Z0-9]", "")
    day = lambda f: F.date_format(parse_date(m[f]), "yyMMdd")
    r = fixed(r, _several=F.when(~F.col("_ok2"), several), _number=number, _birth=day("birth"), _expiry=day("expiry"), _sex=F.upper(F.trim(m["sex"])))
    digit = lambda c: mrz_check_digit(F.col(c))
    plain = F.concat("_number", digit("_number"), F.lit("MEX"), "_birth", digit("_birth"), "_sex", "_expiry", digit("_expiry"), F.lit("<" * 14 + "0"))
    r = fixed(r, _plain=F.when((F.length("_number") == 9) & F.col("_sex").isin("M", "F"), plain))
    whole = F.concat(F.left("_plain", F.lit(10)), F.substring("_plain", 14, 7), F.substring("_plain", 22, 22))
    r = fixed(r, _built=F.concat("_plain", mrz_check_digit(whole)))
    same = lambda w: F.size(F.filter(F.sequence(F.lit(1), F.lit(28)), lambda i: F.substr(w, i, F.lit(1)) == F.substr("_built", i, F.lit(1))))
    r = fixed(r, _agreed=F.when(zone_valid(F.col("_built")) & F.exists("_both", lambda w: same(w) >= 14), F.col("_built")))

    expected = F.concat(F.lit("P<MEX"), zone_names(m["first"], m["second"], m["given"]))
    r = fixed(r, _told=expected)
    heads = F.filter(F.transform("_lines", lambda x: F.regexp_extract(x, r"^.{0,6}?(P[^A-Z0-9]?MEX.*)$", 1)), lambda x: x != "")
    r = fixed(r, _heads=F.array_distinct(heads))
    valid1 = lambda w: F.coalesce(w.rlike("^P<MEX[A-Z<]{39}$") & (F.col("_told").isNull() | w.startswith(F.rtrim(F.left("_told", F.lit(44)), F.lit("<")))), F.lit(False))
    begun = lambda w: F.least(F.length(w), F.length("_told"))
    room = lambda w: F.greatest(F.lit(2), F.floor(begun(w) / 8))
    noisy = F.transform("_heads", lambda w: F.regexp_replace(w, "[^A-Z0-9<]", "<"))
    like = F.exists(noisy, lambda w: (begun(w) >= 12) & (F.levenshtein(F.substr(w, F.lit(1), begun(w)), F.substr("_told", F.lit(1), begun(w))) <= room(w)))
    full = F.rpad("_told", 44, "<")
    literal1 = F.get(F.filter("_heads", valid1), F.lit(0))
    r = fixed(r, _ok1=valid1(F.col("_now1")), _literal1=literal1, _derived1=F.when(like, full))

    def change(field: str, rule: str, value: Column, derives: bool) -> Column:
        told = F.struct(F.lit(field).alias("field"), m[field].alias("before"), value.alias("after"), F.lit(rule).alias("rule"), F.lit(derives).alias("derived"))
        return F.when(value.isNotNull() & (not derives or derived), told)

    second = F.when(F.col("_ok2"), change("line2", "line2_literal", F.col("_now2"), False)).otherwise(
        F.coalesce(
            change("line2", "line2_literal", F.coalesce("_exact", "_edit"), False),
            change("line2", "line2_repaired", F.col("_several"), True),
            change("line2", "line2_from_fields", F.col("_agreed"), True),
        )
    )
    first = F.when(F.col("_ok1"), change("line1", "line1_literal", F.col("_now1"), False)).otherwise(
        F.coalesce(change("line1", "line1_literal", F.col("_literal1"), False), change("line1", "line1_from_fields", F.col("_derived1"), True))
    )
    log = r.select(key, F.explode(F.array_compact(F.array(first, second))).alias("_c")).select(key, "_c.*")
    return log.where(~F.col("before").eqNullSafe(F.col("after")))
