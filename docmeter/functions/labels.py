"""Labels of forms: how like two labels are, and the values that stand beside or under a label."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import strip_accents


def label_letters(c: Column) -> Column:
    """Capitals and single spaces as they are, without accents or other signs, trimmed."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z ]", ""))


def block_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Twice the characters in common blocks over all characters; 0 below ``least``.

    Common is the longest block that both strings hold, the first one in ``a``, then in ``b``, and likewise what is common left
    and right of it. Strings that share too few characters of any order are not compared.
    """
    size = len(a) + len(b)
    if not a or not b or 2 * (Counter(a) & Counter(b)).total() < least * size:
        return 0.0
    places = defaultdict(list)
    for j, c in enumerate(b):
        places[c].append(j)
    common, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best, at, ends = 0, (0, 0), {}
        for i in range(a0, a1):
            here = {j: ends.get(j - 1, 0) + 1 for j in places[a[i]] if b0 <= j < b1}
            for j, n in here.items():
                if n > best:
                    best, at = n, (i + 1, j + 1)
            ends = here
        if best:
            common += best
            todo += [(a0, at[0] - best, b0, at[1] - best), (at[0], a1, at[1], b1)]
    ratio = 2 * common / size
    return ratio if ratio >= least else 0.0


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else block_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """``block_ratio`` of two labels by their letters. Pairs whose lengths alone rule ``least`` out never leave the JVM; they are 0, as are nulls."""
    x, y = label_letters(a), label_letters(b)
    near = 2 * F.least(F.length(x), F.length(y)) >= least * (F.length(x) + F.length(y))
    found = _ratio(F.when(near, x), F.when(near, y))
    return F.when(found >= least, found).otherwise(0.0) if least else found


def any_like(words: Column, label: str, least: float) -> Column:
    """Whether one of the words is like the label; null and empty lists hold none."""

    @F.pandas_udf("boolean")
    def found(lists: pd.Series) -> pd.Series:
        seen: dict[str, bool] = {}
        for w in {w for x in lists if x is not None for w in x}:
            seen[w] = block_ratio(w, label, least) >= least
        return pd.Series([x is not None and any(seen[w] for w in x) for x in lists], dtype=bool)

    n = len(label)
    near = lambda w: 2 * F.least(F.length(w), F.lit(n)) >= least * (F.length(w) + n)
    return found(F.filter(F.transform(words, label_letters), near))


def label_values(lines: Column, patterns: Sequence[str], is_label: Callable[[Column], Column], most: int = 1) -> Column:
    """Values of the first line that begins with one of the patterns: what follows it there, else up to ``most`` lines below.

    Between label and value a colon or dash may stand. Empty lines below count but give nothing, and a line that is a label
    itself ends the search. Patterns have no groups of their own and disregard case; the first that fits a line counts. No such
    line, or null, gives an empty array.
    """
    whole = [rf"(?iu)^(?:{p})\s*[:\-]?\s*(.*)$" for p in patterns]

    def any_hit(line: Column) -> Column:
        out = F.lit(False)
        for p in whole:
            out = out | line.rlike(p)
        return out

    at = F.get(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: any_hit(F.get(lines, i))), F.lit(0))
    line = F.get(lines, at)
    inline = F.lit(None).cast("string")
    for p in reversed(whole):
        inline = F.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 1))).otherwise(inline)
    below = F.transform(F.slice(lines, at + 2, most), lambda x: F.trim(x))
    ends = F.array_position(F.transform(below, is_label), True)
    below = F.filter(F.when(ends > 0, F.slice(below, 1, ends.cast("int") - 1)).otherwise(below), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when((F.size(lines) <= 0) | lines.isNull() | at.isNull(), none).when(inline != "", F.array(inline)).otherwise(below)
