"""Dates as Column builders; what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names in order.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def parse_date(c: Column) -> Column:
    """d/m/yyyy, d m yyyy (plain spaces) or yyyy-m-d; impossible days are null."""
    c = F.trim(c)
    dmy, ymd = r"^(\d{1,2})(?:/| +)(\d{1,2})(?:/| +)(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    one = c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") | c.rlike(r"^\d{1,2} +\d{1,2} +\d{4}$")
    part = F.regexp_extract
    return F.when(one, _date(part(c, dmy, 3), part(c, dmy, 2), part(c, dmy, 1))).when(
        c.rlike(ymd), _date(part(c, ymd, 1), part(c, ymd, 2), part(c, ymd, 3))
    )


def strict_dmy(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), parse_date(c))


# Fixed value: a date in words, as certificates write it; one spelling of a month beside those above.
LONG_DATE = r"(?i)(?<![\p{L}\p{N}_])a\s+(\d{1,2})\s+de\s+([A-Za-zÁÉÍÓÚáéíóú]+)\s+(?:de|del)\s+(\d{4})"
OTHER_SPELLING = {"setiembre": "septiembre"}


def spanish_long_date(c: Column) -> Column:
    """The first 'a 12 de mayo de 2022' of the text; null where its month is none."""
    month = F.translate(F.lower(F.regexp_extract(c, LONG_DATE, 2)), "íé", "ie")
    for other, usual in OTHER_SPELLING.items():
        month = F.when(month == other, usual).otherwise(month)
    number = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month), F.lit(0)).cast("string")
    return F.when(c.rlike(LONG_DATE) & number.isNotNull(), _date(F.regexp_extract(c, LONG_DATE, 3), number, F.regexp_extract(c, LONG_DATE, 1)))


def add_years(c: Column, years: int) -> Column:
    """29 February becomes 28 February."""
    return F.add_months(c, 12 * years)


def age_on(birth: Column, day: Column) -> Column:
    """Whole years: one born on 29 February is a year older on 1 March of a common year."""
    later = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - later.cast("int")


def last_day_of_year(year: Column) -> Column:
    return F.try_to_date(F.concat(year.cast("string"), F.lit("-12-31")), "yyyy-MM-dd")


def day_spine(spark, first: str, last: str):
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS day")
