"""Identity codes: check digits, structure and coherence, built from array expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import age_on  # noqa: F401
from .text import name_words

# Fixed values of the population code: alphabet, structure, vowels, particles and given names to skip.
CURP_ALPHABET = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"
CURP_PATTERN = r"^[A-Z][AEIOUX][A-Z]{2}\d{6}[HMX][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[0-9A-Z]\d$"
VOWELS = ("A", "E", "I", "O", "U")
NAME_PARTICLES = ("DA", "DAS", "DE", "DEL", "DER", "DI", "DIE", "DD", "EL", "LA", "LAS", "LE", "LES", "LOS", "MAC", "MC", "VAN", "VON", "Y")
SKIPPED_NAMES = ("JOSE", "J", "MARIA", "MA", "M")
MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _weighted(c: Column, alphabet: str, weights: Callable[[Column], Sequence[Column | int]]) -> Column:
    """Sum of the characters' places in the alphabet (0 for others) times their weights, right modulo 10.

    Each character becomes the last digit of its place; three at a time are read as a number x. Modulo 10 its digits are x // 100,
    x // 10 and x. ``weights`` are those of the i-th three, i from 0.
    """
    digits = F.regexp_replace(F.translate(c, alphabet + "<", "".join(str(i % 10) for i in range(len(alphabet))) + "0"), "[^0-9]", "0")
    starts = F.sequence(F.lit(1), F.length(c), F.lit(3))
    threes = bound(F.concat(digits, F.lit("00")), lambda d: F.transform(starts, lambda i: F.substr(d, i, F.lit(3)).cast("int")))
    part = lambda x, n: F.call_function("div", x, F.lit(n)) if n > 1 else x
    terms = F.transform(threes, lambda x, i: sum((part(x, n) * w for n, w in zip((100, 10, 1), weights(i), strict=True)), F.lit(0).cast("long")))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def curp_check_digit(c17: Column) -> Column:
    """Weights 18 to 2; null unless there are 17 characters of the alphabet."""
    total = lambda c: _weighted(c, CURP_ALPHABET, lambda i: [18 - 3 * i - n for n in range(3)])
    return bound(c17, lambda c: F.when(c.rlike("^[0-9A-ZÑ]{17}$"), ((10 - total(c) % 10) % 10).cast("string")))


def mrz_check_digit(c: Column) -> Column:
    """Weights 7, 3, 1 in turn; the filler and anything unknown counts 0."""
    return bound(c, lambda c: F.when(F.length(c) > 0, (_weighted(c, MRZ_ALPHABET, lambda i: (7, 3, 1)) % 10).cast("string")))


def curp_birth_date(c: Column) -> Column:
    """The century comes from the 17th place: a digit means before 2000."""
    century = F.when(F.substring(c, 17, 1).rlike("[0-9]"), "19").otherwise("20")
    return F.try_to_date(F.concat(century, F.substring(c, 5, 6)), "yyyyMMdd")


def curp_errors(c: Column) -> Column:
    """Codes of what is wrong: structure alone, else date and check digit."""
    ok = F.coalesce(c.rlike(CURP_PATTERN), F.lit(False))
    later = F.array_compact(
        F.array(
            F.when(curp_birth_date(c).isNull(), F.lit("date")),
            F.when(curp_check_digit(F.substring(c, 1, 17)) != F.substring(c, 18, 1), F.lit("check_digit")),
        )
    )
    return F.when(ok, later).otherwise(F.array(F.lit("structure")))


def significant_word(name: Column, given: bool = False) -> Column:
    words = name_words(name)
    kept = F.filter(words, lambda w: ~w.isin(*NAME_PARTICLES))
    kept = F.when(F.size(kept) > 0, kept).otherwise(words)
    if given:
        skip = (F.size(kept) > 1) & F.get(kept, F.lit(0)).isin(*SKIPPED_NAMES)
        return F.coalesce(F.when(skip, F.get(kept, F.lit(1))).otherwise(F.get(kept, F.lit(0))), F.lit(""))
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def _initial(word: Column) -> Column:
    return F.when((word == "") | word.startswith("Ñ"), "X").otherwise(F.left(word, F.lit(1)))


def curp_name_letters(given: Column, first: Column, second: Column, rude: tuple[str, ...] = ()) -> Column:
    """Places 1 to 4; a word of ``rude`` has its second letter replaced by X."""
    w1, w2, wn = significant_word(first), significant_word(second), significant_word(given, True)
    vowel = F.coalesce(F.nullif(F.regexp_extract(F.substr(w1, F.lit(2)), "[AEIOU]", 0), F.lit("")), F.lit("X"))
    four = F.concat(_initial(w1), vowel, _initial(w2), _initial(wn))
    return F.when(four.isin(*rude), F.concat(F.left(four, F.lit(1)), F.lit("X"), F.substring(four, 3, 2))).otherwise(four) if rude else four


def curp_consonants(given: Column, first: Column, second: Column) -> Column:
    def inner(w: Column) -> Column:
        found = F.regexp_extract(F.substr(w, F.lit(2)), "[B-DF-HJ-NÑP-TV-Z]", 0)
        return F.when((found == "") | (found == "Ñ"), "X").otherwise(found)

    return F.concat(inner(significant_word(first)), inner(significant_word(second)), inner(significant_word(given, True)))


def build_curp(given: Column, first: Column, second: Column, birth: Column, sex: Column, state: Column, homoclave: Column) -> Column:
    base = F.concat(curp_name_letters(given, first, second), F.date_format(birth, "yyMMdd"), sex, state, curp_consonants(given, first, second), homoclave)
    return F.concat(base, curp_check_digit(base))


def td3_line2(number: Column, country: Column, birth: Column, sex: Column, expiry: Column, personal: Column) -> Column:
    """Second line of a passport's machine-readable zone, with its five check digits."""
    n, p = F.rpad(number, 9, "<"), F.rpad(F.coalesce(personal, F.lit("")), 14, "<")
    b, e = F.date_format(birth, "yyMMdd"), F.date_format(expiry, "yyMMdd")
    nd, bd, ed = mrz_check_digit(n), mrz_check_digit(b), mrz_check_digit(e)
    pd_ = F.when(F.rtrim(p, F.lit("<")) == "", "<").otherwise(mrz_check_digit(p))
    return F.concat(n, nd, country, b, bd, sex, e, ed, p, pd_, mrz_check_digit(F.concat(n, nd, b, bd, e, ed, p, pd_)))


def td3_errors(line: Column) -> Column:
    part = lambda at, n: F.substring(line, at, n)
    checks = (("number", part(1, 9), part(10, 1)), ("birth", part(14, 6), part(20, 1)), ("expiry", part(22, 6), part(28, 1)))
    whole = F.concat(part(1, 10), part(14, 7), part(22, 22))
    wrong = [F.when(mrz_check_digit(v) != d, F.lit(n)) for n, v, d in checks] + [F.when(mrz_check_digit(whole) != part(44, 1), F.lit("composite"))]
    return F.when(F.length(line) == 44, F.array_compact(F.array(*wrong))).otherwise(F.array(F.lit("length")))


def failed(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that don't hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def elector_key(given: Column, first: Column, second: Column, birth: Column, state: Column, sex: Column, suffix: Column) -> Column:
    """Initial and first inner consonant of both surnames and the given name, birth date, state number, sex, three digits."""
    words = (significant_word(first), significant_word(second), significant_word(given, True))
    consonant = lambda w: F.translate(F.coalesce(F.nullif(F.regexp_extract(F.substr(w, F.lit(2)), "[B-DF-HJ-NÑP-TV-Z]", 0), F.lit("")), F.lit("X")), "Ñ", "X")
    letters = [F.concat(_initial(w), consonant(w)) for w in words]
    return F.concat(*letters, F.date_format(birth, "yyMMdd"), F.lpad(state.cast("string"), 2, "0"), sex, suffix)


def elector_key_errors(key: Column, birth: Column | None = None, sex: Column | None = None) -> Column:
    """Structure alone, else date, state (1 to 32) and, where given, agreement with birth date and sex."""
    part = lambda at, n: F.substring(key, at, n)
    rules = [("date", F.try_to_date(F.concat(F.lit("20"), part(7, 6)), "yyyyMMdd").isNotNull()), ("state", part(13, 2).between("01", "32"))]
    if birth is not None:
        rules.append(("birth", part(7, 6) == F.date_format(birth, "yyMMdd")))
    if sex is not None:
        rules.append(("sex", part(15, 1) == sex))
    ok = F.coalesce(key.rlike(r"^[A-Z]{6}\d{8}[HM]\d{3}$"), F.lit(False))
    return F.when(ok, failed(*rules)).otherwise(F.array(F.lit("structure")))


def td1_errors(l1: Column, l2: Column, l3: Column) -> Column:
    """Three lines of 30 characters of an identity card: issuer, three check digits and the composite one, name line."""
    at = lambda c, i, n: F.substring(c, i, n)
    shape = F.lit(True)
    for line in (l1, l2, l3):
        shape &= F.coalesce(line.rlike("^[A-Z0-9<]{30}$"), F.lit(False))
    whole = F.concat(at(l1, 6, 25), at(l2, 1, 7), at(l2, 9, 7), at(l2, 19, 11))
    rules = (
        ("issuer", l1.startswith("ID") & (at(l1, 3, 3) == "MEX") & (at(l2, 16, 3) == "MEX")),
        ("number", mrz_check_digit(at(l1, 6, 9)) == at(l1, 15, 1)),
        ("birth", mrz_check_digit(at(l2, 1, 6)) == at(l2, 7, 1)),
        ("sex", at(l2, 8, 1).isin("M", "F", "X", "<")),
        ("expiry", mrz_check_digit(at(l2, 9, 6)) == at(l2, 15, 1)),
        ("composite", mrz_check_digit(whole) == at(l2, 30, 1)),
        ("name", l3.rlike("^[A-Z].*<<")),
    )
    return F.when(shape, failed(*rules)).otherwise(F.array(F.lit("structure")))


def hash_unit(key: Column) -> Column:
    """The first eight bytes of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def hash_bucket(key: Column, total: int) -> Column:
    """The first eight bytes of SHA-256 modulo ``total``: unsigned, hence decimal."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % total).cast("int")


def keyed_hash(secret: str, value: Column) -> Column:
    """HMAC with SHA-256 by its definition over built-in functions."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)
