"""Secret scans: fixed patterns, and a randomness test battery over encoded tokens.

The base kinds are regular expressions whose matches fail by length. The method adds the
kind ``random``: tokens of at least 20 characters of an inferred encoding (hexadecimal,
base32, base36, base62, base64) that three tests of the hypothesis "the symbols are uniform
and independent" do not reject:

* chi-squared: the counts of the alphabet's symbols are uniform (exact variance for short tokens);
* runs: symbols switch between the alphabet's halves as often as coin tosses do;
* serial correlation: each symbol says nothing of the next one.

Their p-values are combined by Bonferroni's rule, which holds whatever their dependence is.
Tokens are put into strata by length, since a long token is rejected far more easily, and
within each stratum the Benjamini-Hochberg procedure decides which tokens are called not
random: of the tokens it discards, a share of at most ``fdr`` is expected to be random. The
procedure reads p-values from a histogram (``BINS`` bins a stratum), counted over all rows.

Everything is a Spark SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

# Patterns and least lengths of the base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
BINS, FDR = 400, 0.01
#: Lower bounds of the strata of token length.
STRATA = (20, 24, 32, 40, 64, 128)

_SPAN = "struct<start:int,end:int,kind:int>"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Name, full-match pattern and alphabet; the first that fits is the token's encoding. All need a digit and a letter.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex upper", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    ("base36 upper", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64 url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def _literal(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters, as array of start, end, kind.

    Places are code points. The texts between the matches (``split``) and the matches themselves (``regexp_extract_all``)
    add up to the places.
    """
    p = _literal(pattern)
    sizes = f"transform(regexp_extract_all({text}, {p}, 0), m -> length(m))"
    tested = sizes if group == 0 else f"transform(regexp_extract_all({text}, {p}, {group}), m -> length(m))"
    gaps = f"transform(split({text}, {p}, -1), s -> length(s))"
    steps = f"zip_with(zip_with({sizes}, {tested}, (a, b) -> struct(a AS size, b AS tested)), slice({gaps}, 1, size({sizes})), (m, g) -> struct(m.size AS size, m.tested AS tested, g AS gap))"
    start = f"struct(0 AS at, CAST(array() AS array<{_SPAN}>) AS found)"
    grown = f"concat(acc.found, array(struct(acc.at + x.gap AS start, acc.at + x.gap + x.size AS end, {kind} AS kind)))"
    merge = f"(acc, x) -> struct(acc.at + x.gap + x.size AS at, CASE WHEN x.tested >= {least} THEN {grown} ELSE acc.found END AS found)"
    whole = f"aggregate({steps}, {start}, {merge}, acc -> acc.found)"
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN {whole} ELSE CAST(array() AS array<{_SPAN}>) END")


def _two_sided(z: str) -> str:
    """P(|Z| >= |z|) for a standard normal Z, by the usual five-term approximation of erfc."""
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1D / (1D + 0.3275911D * {x}))"
    poly = f"((((1.061405429D * {t} - 1.453152027D) * {t} + 1.421413741D) * {t} - 0.284496736D) * {t} + 0.254829592D) * {t}"
    return f"({poly} * exp(-{x} * {x}))"


def battery(token: str) -> Column:
    """Struct of encoding, n, the three statistics z_chi, z_runs, z_serial and the combined p of a token column; null without encoding.

    Padding (``=``) is no symbol. p is near 1 for random tokens and near 0 for others.
    """
    bare = f"rtrim('=', {token})"
    alphabet = "CASE " + " ".join(f"WHEN {bare} RLIKE {_literal(p)} THEN '{a}'" for _, p, a in ENCODINGS) + " END"
    name = "CASE " + " ".join(f"WHEN {bare} RLIKE {_literal(p)} THEN '{n}'" for n, p, _ in ENCODINGS) + " END"
    first = f"named_struct('name', {name}, 'k', CAST(length({alphabet}) AS DOUBLE), 'x', transform(filter(split({bare}, ''), ch -> ch <> ''), ch -> CAST(locate(ch, {alphabet}) - 1 AS DOUBLE)))"

    def let(value: str, var: str, body: str) -> str:
        return f"element_at(transform(array({value}), {var} -> {body}), 1)"

    n = "CAST(size(e.x) AS DOUBLE)"
    squares = "aggregate(array_distinct(e.x), 0D, (s, v) -> s + pow(CAST(size(filter(e.x, w -> w = v)) AS DOUBLE), 2))"
    chi = f"(e.k / {n} * {squares} - {n} - (e.k - 1)) / sqrt(2D * (e.k - 1) * ({n} - 1) / {n})"
    pairs = "zip_with(slice(e.x, 1, size(e.x) - 1), slice(e.x, 2, size(e.x) - 1), (a, b) -> struct(a AS a, b AS b))"
    switches = f"aggregate({pairs}, 0D, (s, q) -> s + CASE WHEN (q.a >= e.k / 2) = (q.b >= e.k / 2) THEN 0D ELSE 1D END)"
    runs = f"({switches} - ({n} - 1) / 2) / sqrt(({n} - 1) / 4)"
    products = f"aggregate({pairs}, 0D, (s, q) -> s + (q.a - (e.k - 1) / 2) * (q.b - (e.k - 1) / 2))"
    serial = f"{products} / ((e.k * e.k - 1) / 12) / sqrt({n} - 1)"
    tests = f"named_struct('encoding', e.name, 'n', size(e.x), 'z_chi', {chi}, 'z_runs', {runs}, 'z_serial', {serial})"
    low = f"CASE WHEN t.z_chi > 0 THEN {_two_sided('t.z_chi')} / 2 ELSE 1D END"
    p = f"least(1D, 3D * least({low}, {_two_sided('t.z_runs')}, {_two_sided('t.z_serial')}))"
    made = let(tests, "t", f"named_struct('encoding', t.encoding, 'n', t.n, 'z_chi', t.z_chi, 'z_runs', t.z_runs, 'z_serial', t.z_serial, 'p', {p})")
    return F.expr(f"CASE WHEN length({token}) > 0 THEN {let(first, 'e', f'CASE WHEN e.k IS NOT NULL THEN {made} END')} END")


def _stratum(n: Column) -> Column:
    out = F.lit(STRATA[0])
    for low in STRATA[1:]:
        out = F.when(n >= low, low).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    """0 for p = 1, rising as p falls; a quarter of a decade in 10 bins."""
    return F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * 10)).cast("int")


def cutoffs(tokens: DataFrame, fdr: float = FDR) -> DataFrame:
    """Benjamini-Hochberg by stratum: the least bin whose tokens (and those of all higher bins) are called not random.

    ``tokens`` has stratum and bin. One row per stratum at most, with cut; a bin's largest p stands for its tokens.
    """
    counts = tokens.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    worse = W.partitionBy("stratum").orderBy(F.desc("bin"))
    counts = counts.withColumns({"rank": F.sum("n").over(worse), "m": F.sum("n").over(W.partitionBy("stratum"))})
    largest = F.pow(F.lit(10.0), -F.col("bin") / 10)
    return counts.where(largest <= fdr * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of ``docs``: key and spans, an array of (start, end, kind) by start, then kind (index into KINDS).

    * Base kinds are found in the whole text and always stay; a random token inside or across a base span is not repeated.
    * Null and empty texts have no spans. Repeated rows are scanned alike (each counts as a token of its own in the false
      discovery control). An empty table gives an empty table. Columns other than key and text are left out.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = F.concat(
        spans("_text", ASSIGN, 0, ASSIGN_VALUE, 2),
        spans("_text", ACCESS, 1, ACCESS_LENGTH),
        spans("_text", HEX.replace("+", f"{{{HEX_LENGTH},}}+"), 2, HEX_LENGTH),
    )
    at = spans("_text", TOKEN, 3, STRATA[0])
    rows = rows.select(key, base.alias("_base"), at.alias("_at"), "_text")
    free = F.expr("filter(_at, c -> NOT exists(_base, b -> b.start < c.end AND c.start < b.end))")
    rows = rows.withColumn("_free", free)
    named = F.expr("transform(_free, c -> struct(c.start, c.end, substring(_text, c.start + 1, c.end - c.start) AS token))")
    rows = rows.select(key, "_base", named.alias("_free"))
    # The texts end here: what follows is spans and the few candidate tokens.
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-scan")
    tokens = rows.select("_row", F.explode("_free").alias("c")).select("_row", "c.start", "c.end", battery("c.token").alias("t"))
    tokens = tokens.where("t IS NOT NULL").select("_row", "start", "end", _stratum(F.col("t.n")).alias("stratum"), _bin(F.col("t.p")).alias("bin"))
    # At most one row per stratum.
    cut = F.broadcast(cutoffs(tokens, fdr))
    random = tokens.join(cut, "stratum", "left").where("cut IS NULL OR bin < cut")
    random = random.groupBy("_row").agg(F.collect_list(F.expr("struct(start, end, 3 AS kind)")).alias("_random"))
    out = rows.join(random, "_row", "left")
    none = F.expr(f"CAST(array() AS array<{_SPAN}>)")
    merged = F.concat("_base", F.coalesce(F.col("_random"), none))
    ordered = F.expr("transform(array_sort(transform(s, x -> struct(x.start AS start, x.kind AS kind, x.end AS end))), x -> struct(x.start, x.end, x.kind))")
    return out.select(key, merged.alias("s")).select(key, ordered.alias("spans"))


def joined(which: str) -> Column:
    """kind:start:end of a span array, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({which}, x -> concat_ws(':', element_at({names}, x.kind + 1), x.start, x.end)), ',')")
