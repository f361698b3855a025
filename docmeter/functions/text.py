"""Text normalisers, masks and distances as Column builders."""

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Accented capitals and small letters with their plain forms.
ACCENTED = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇáàâäãéèêëíìîïóòôöõúùûüç"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCaaaaaeeeeiiiiooooouuuuc"
PARTICLES = ("DE", "DEL", "LA", "LAS", "LOS", "Y", "MC", "MAC", "VAN", "VON", "DA", "DI", "DAS", "DOS")
#: Characters that optical recognition mixes up, by the first of each class; a later class overrides an earlier one.
CONFUSED = ("0ODQUC", "1IL|!ÍJ", "5S$", "8BR3E", "6G", "7TF", "2Z", "4A", "UV", "MN", "HN")
SPACE = r"[\s\x{00A0}]+"
#: The characters of Unicode's category of space separators.
SPACES = "".join(chr(c) for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def collapse_or_null(c: Column) -> Column:
    """User input: collapsed and trimmed; nothing left is null."""
    return F.nullif(collapse(c), F.lit(""))


def blank(c: Column) -> Column:
    """Null, empty and white space only are the same."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", "")) == "", F.lit(True))


def identifier(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def code(c: Column) -> Column:
    return F.upper(F.trim(c))


def _composable() -> dict[str, str]:
    """Letters of all alphabets up to U+1FFF that have a decomposed spelling, longest spelling first."""
    whole = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.normalize("NFC", chr(c)) == chr(c)]
    pieces = {unicodedata.normalize("NFD", w): w for w in whole if unicodedata.normalize("NFD", w) != w}
    return dict(sorted(pieces.items(), key=lambda x: (-len(x[0]), x[0])))


COMPOSABLE = _composable()


def composed(c: Column) -> Column:
    """Letters that are written with combining marks as one character; other marks stay."""
    parts, wholes = (F.split(F.lit("|".join(x)), r"\|") for x in (COMPOSABLE, COMPOSABLE.values()))
    pieced = F.aggregate(F.sequence(F.lit(1), F.lit(len(COMPOSABLE))), c, lambda t, i: F.replace(t, F.element_at(parts, i), F.element_at(wholes, i)))
    return F.when(c.rlike(r"\p{M}"), pieced).otherwise(c)


def plain_text(c: Column) -> Column:
    """Composed, without regard to case (ß is ss, final sigma a sigma) and runs of white space."""
    return F.translate(F.replace(F.lower(collapse(composed(c))), F.lit("ß"), F.lit("ss")), "ς", "σ")


def spaced_small(c: Column) -> Column:
    """Small letters letter by letter (Σ is σ at the end of a word too), runs of blanks and line ends as one space, no space of any kind around."""
    for capital, small in (("Σ", "σ"), ("İ", "i")):
        c = F.replace(c, F.lit(capital), F.lit(small))
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\f\r]+", " "), F.lit(SPACES)))


def address(c: Column) -> Column:
    return plain_text(F.regexp_replace(c, "[,.;]", " "))


def strip_accents(c: Column) -> Column:
    """Plain letters; combining marks of decomposed text go."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), ACCENTED + "Ññ", PLAIN + "Nn")


def upper_keep_enye(c: Column) -> Column:
    return F.translate(F.upper(c), ACCENTED, PLAIN)


def name_words(c: Column) -> Column:
    """Words of a name in capitals, Ñ kept, everything else that is no letter a separator."""
    return F.filter(F.split(F.regexp_replace(upper_keep_enye(c), "[^A-ZÑ]+", " "), " "), lambda w: w != "")


def icao(c: Column) -> Column:
    """Machine-readable zone letters: Ñ as N, each run of separators one filler."""
    return F.regexp_replace(F.translate(upper_keep_enye(F.trim(c)), "Ñ", "N"), "[^A-Z0-9]+", "<")


def comparison_key(c: Column) -> Column:
    """For a search of values in text: no accents, no white space, none of - . , / |."""
    return F.upper(F.regexp_replace(strip_accents(c), r"[\s\-.,/|]+", ""))


def confusion_class(c: Column) -> Column:
    resolved: dict[str, str] = {}
    for group in CONFUSED:
        resolved |= dict.fromkeys(group, group[0])
    return F.translate(c, "".join(resolved), "".join(resolved.values()))


def drop_control(c: Column) -> Column:
    """Recognised text: no control characters but line ends and tabs, single spaces, at most one blank line."""
    c = F.regexp_replace(c, r"[\p{Cc}&&[^\n\t]]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\n.*?---\n", "")


def clean_markup(c: Column) -> Column:
    """Raw recognised text: basic entities, front matter, comments, table bars, bullets and rule lines."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)\A---.*?---\s*", ""), r"(?s)<!--.*?-->", " ")
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^[\s|#·*>]+", ""))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\|+", " "), r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[-:\s]+$")), "\n")


def mask(c: Column, head: int = 4, tail: int = 2) -> Column:
    n = F.greatest(F.lit(0), F.length(c) - head - tail)
    return F.concat(F.left(c, F.lit(head)), F.repeat(F.lit("•"), n), F.right(c, F.lit(tail)))


def initial(c: Column) -> Column:
    """First letter of the first word that is no particle, else of the first word; '' without words."""
    words = F.filter(F.split(F.regexp_replace(F.upper(strip_accents(F.coalesce(c, F.lit("")))), "[^A-Z]+", " "), " "), lambda w: w != "")
    useful = F.filter(words, lambda w: ~w.isin(*PARTICLES))
    return F.coalesce(F.left(F.coalesce(F.get(useful, F.lit(0)), F.get(words, F.lit(0))), F.lit(1)), F.lit(""))


def holder_initials(*names: Column) -> Column:
    return F.coalesce(F.nullif(F.concat(*[initial(n) for n in names]), F.lit("")), F.lit("XXX"))


def request_path(c: Column) -> Column:
    """Path without query; numbers and long tokens as markers, no trailing slashes, 80 characters."""
    c = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[a-z]+://[^/]+", "")
    c = F.regexp_replace(c, r"/\d+(?=/|$)", "/:id")
    c = F.regexp_replace(c, r"/[A-Za-z0-9_.-]{24,}(?=/|$)", "/:token")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(c, r"/+$", ""), F.lit(80)), F.lit("")), F.lit("/"))


def first_json_object(c: Column) -> Column:
    """The outermost braces of an answer, without fences and thinking aloud."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0), F.lit(""))


def text_budget(c: Column, context: int, output: int) -> Column:
    return F.left(c, F.lit(max(2000, min(8000, (context - output - 1000) * 3))))


def character_error_rate(expected: Column, actual: Column) -> Column:
    """Edits over the expected length; may exceed 1. An empty expectation gives 0 or 1."""
    rate = F.levenshtein(expected, actual) / F.nullif(F.length(expected), F.lit(0))
    return F.coalesce(rate.cast("double"), F.when(F.length(actual) > 0, 1.0).otherwise(0.0))


@F.pandas_udf(DoubleType())
def word_error_rate(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Edits of words over the expected words; null where either side is null."""

    def rate(e: str | None, a: str | None) -> float | None:
        if e is None or a is None:
            return None
        x, y = e.split(), a.split()
        if not x:
            return float(bool(y))
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
        return row[-1] / len(x)

    return pd.Series([rate(e, a) for e, a in zip(expected, actual, strict=True)], dtype="float64")


def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


_nfc.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
nfc_casefold = F.pandas_udf(_nfc, StringType())
