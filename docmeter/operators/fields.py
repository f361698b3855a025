"""Extracted fields: flattening, answers of a service, checks before confirmation, repair by position, seals, runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmeter.functions import dates as D
from docmeter.functions.codes import curp_consonants, curp_name_letters, hash_unit
from docmeter.functions.compare import verdict
from docmeter.functions.text import identifier

# What optical recognition reads instead of digits and of letters, answers worth another try, the mark of a sealed value.
TO_DIGIT = {
    "O": "0", "Q": "0", "D": "0", "U": "0", "C": "0", "I": "1", "L": "1", "|": "1", "!": "1", "Í": "1", "J": "1", "T": "7",
    "Z": "2", "S": "5", "$": "5", "B": "8", "G": "6", "A": "4", "E": "8", "F": "7",
}
TO_LETTER = {"0": "O", "1": "I", "2": "Z", "5": "S", "8": "B", "6": "G", "7": "T", "4": "A", "3": "B"}
RETRY_STATUS = (429, 500, 502, 503, 504)
SEALED = "sealed:"


def flattened(rows: DataFrame, key: str, pages: str) -> DataFrame:
    """(key, field, value): the first value of each field name over a sample's pages in order; null names are left out.

    ``pages`` is an array of structs with an array ``fields`` of (name, value). A null value counts as a first one.
    """
    p = rows.select(key, F.posexplode(pages).alias("_page", "_p"))
    f = p.select(key, "_page", F.posexplode("_p.fields").alias("_at", "_f")).where("_f.name IS NOT NULL")
    first = f.groupBy(key, F.col("_f.name").alias("field")).agg(F.min_by(F.struct("_f.value"), F.struct("_page", "_at")).alias("_v"))
    return first.select(key, "field", F.col("_v.value").alias("value"))


def answer(status: Column, body: Column) -> Column:
    """A service's answer as (status, code, retryable, doc_type, fields, total_ms).

    An error by status or by an ``error`` without fields carries its code, of its ``detail`` if that is an object, HTTP_n without
    one; a body that is no JSON object is RESPUESTA_INVALIDA, worth another try from 500 on.
    """
    detail = "struct<codigo: string, code: string>"
    schema = f"error string, codigo string, code string, detail {detail}, tipo_documento string, datos map<string,string>, metadatos struct<tiempo_procesamiento_ms: double>"
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    b = F.from_json(body, schema)
    told = lambda at: F.coalesce(F.nullif(at["codigo"], F.lit("")), F.nullif(at["code"], F.lit("")))
    failed = (status >= 400) | (b["error"].isNotNull() & b["datos"].isNull())
    given = F.when(b["detail"].isNotNull(), told(b["detail"])).otherwise(told(b))
    code = F.when(~is_object, "RESPUESTA_INVALIDA").when(failed, F.coalesce(given, F.concat(F.lit("HTTP_"), status.cast("string"))))
    ok = code.isNull()
    return F.struct(
        F.when(ok, "ok").otherwise("error").alias("status"),
        code.alias("code"),
        F.when(~is_object, status >= 500).when(failed, status.isin(*RETRY_STATUS)).otherwise(False).alias("retryable"),
        F.when(ok, b["tipo_documento"]).alias("doc_type"),
        F.when(ok, b["datos"]).alias("fields"),
        F.when(ok, b["metadatos"]["tiempo_procesamiento_ms"]).alias("total_ms"),
    )


def field_names(items: Column) -> Column:
    """'field=value' items without their values, so that nothing extracted gets into a log."""
    return F.transform(items, lambda x: F.split_part(x, F.lit("="), F.lit(1)))


def confirmed(fields: Column, codes: Sequence[str], names: Sequence[str]) -> Column:
    """The map a user confirms: codes in capitals without spaces, names in capitals, null values as they are."""
    return F.transform_values(
        fields, lambda k, v: F.when(k.isin(*codes), identifier(v)).when(k.isin(*names), F.upper(v)).otherwise(v)
    )


def confirmation_errors(
    fields: Column, required: Sequence[str], patterns: Mapping[str, tuple[str, str]], dates: Sequence[str], date_error: str, missing: str
) -> Column:
    """Map of field to message: required ones that are null or empty, malformed ones, dates that can't be read."""
    value = lambda f: F.nullif(fields[f], F.lit(""))
    found = [F.when(value(f).isNull(), F.struct(F.lit(f), F.lit(missing))) for f in required]
    found += [F.when(value(f).isNotNull() & ~value(f).rlike(rx), F.struct(F.lit(f), F.lit(said))) for f, (rx, said) in patterns.items()]
    found += [F.when(value(f).isNotNull() & D.parse_date(value(f)).isNull(), F.struct(F.lit(f), F.lit(date_error))) for f in dates]
    return F.map_from_entries(F.array_compact(F.array(*found)))


def judged(chosen: Column, seen: Column, invalid: Column, ungrounded: Column, corrected: Column) -> Column:
    """(refused, warnings): another type than the chosen one is refused; each list that isn't empty is a warning. Null lists are empty."""
    refused = F.when(chosen.isNotNull() & ~chosen.eqNullSafe(seen), F.concat(F.lit("chosen "), chosen, F.lit(", seen "), F.coalesce(seen, F.lit("none"))))
    said = ((invalid, "some fields were malformed"), (ungrounded, "some fields do not stand in the document"), (corrected, "some fields were corrected"))
    return F.struct(refused.alias("refused"), F.array_compact(F.array(*[F.when(F.size(F.coalesce(a, F.array())) > 0, t) for a, t in said])).alias("warnings"))


def by_template(token: Column, template: str) -> Column:
    """Characters confused by recognition repaired by place: L and S letters, D digits, A either; cut to the shorter one."""

    def place(i: int, kind: str) -> Column:
        c = F.substring(token, i + 1, 1)
        if kind == "D":
            return F.translate(c, "".join(TO_DIGIT), "".join(TO_DIGIT.values()))
        return F.translate(c, "".join(TO_LETTER), "".join(TO_LETTER.values())) if kind in "LS" else c

    return F.concat(*[place(i, kind) for i, kind in enumerate(template)])


def three_parts(words: Column, fits: Callable[[Column, Column, Column], Column]) -> Column:
    """Cuts (i, j) of the words into three groups, none empty, for which ``fits`` (given, first, second) holds."""
    n = F.size(words)
    text = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    ends = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    cuts = F.flatten(F.transform(ends(F.lit(1), n - 2), lambda i: F.transform(ends(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return F.filter(cuts, lambda c: fits(text(F.lit(1), c["i"]), text(c["i"] + 1, c["j"] - c["i"]), text(c["j"] + 1, n - c["j"])))


def full_name_fits(curp: Column, full_name: Column) -> Column:
    """Whether some cut of the name into given names and two surnames agrees with the code's letters."""
    agrees = lambda g, a, b: (curp_name_letters(g, a, b) == F.left(curp, F.lit(4))) & (curp_consonants(g, a, b) == F.substring(curp, 14, 3))
    return F.size(three_parts(F.split(F.trim(F.regexp_replace(full_name, r"\s+", " ")), " "), agrees)) > 0


def placeholder(value: Column, labels: Sequence[str], room: int = 30) -> Column:
    """Whether a value is no value: empty, a label with little else, or begins with a bracket or punctuation. Null is none."""
    v = F.trim(value)
    seen = [F.contains(v, F.lit(x)) & (F.length(v) < len(x) + room) for x in labels]
    any_label = seen[0] if seen else F.lit(False)
    for s in seen[1:]:
        any_label = any_label | s
    return F.coalesce((v == "") | any_label | v.rlike(r"^[():,.\-]"), F.lit(False))


def active_steps(rows: DataFrame, key: str, steps: Mapping[str, float], seed: int) -> DataFrame:
    """(key, step, u): the steps whose draw u in [0, 1) from seed, step and key lies below their probability."""
    listed = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(float(p)).alias("p")) for s, p in sorted(steps.items())])
    drawn = rows.select(key, F.inline(listed)).withColumn("u", hash_unit(F.concat_ws(":", F.lit(str(seed)), "step", F.col(key).cast("string"))))
    return drawn.where(F.col("u") < F.col("p")).select(key, "step", "u")


def sealed(value: Column, key: Column) -> Column:
    """AES-GCM with a mark in front; null and empty become null."""
    return F.when(value != "", F.concat(F.lit(SEALED), F.base64(F.aes_encrypt(value, key, F.lit("GCM")))))


def opened(value: Column, key: Column) -> Column:
    """The clear text of a sealed value; what bears no mark is clear already, what can't be opened is null."""
    body = F.unbase64(F.substr(value, F.lit(len(SEALED) + 1)))
    return F.when(value.startswith(SEALED), F.try_aes_decrypt(body, key, F.lit("GCM")).cast("string")).otherwise(value)


def authorised(requests: DataFrame, devices: DataFrame, users: DataFrame, device: str, user: str) -> DataFrame:
    """Requests of devices that aren't revoked, of active users, whose token version is the account's."""
    known = devices.where("NOT revoked").join(users.where("active"), user).where("token_version = account_version")
    return requests.join(known.drop("revoked", "active", "token_version", "account_version"), device)


def admitted(existing: DataFrame, new: DataFrame, key: str, policy: str) -> DataFrame:
    """The table after a write: error and append fail on a key that exists, skip keeps the old row, overwrite the new one.

    Null keys never exist, so their rows are always added.
    """
    if policy == "overwrite":
        return existing.join(new.select(key), key, "left_anti").unionByName(new)
    if policy == "skip":
        return existing.unionByName(new.join(existing.select(key), key, "left_anti"))
    if policy not in ("error", "append"):
        raise ValueError(f"unknown policy: {policy}")
    taken = existing.select(key, F.lit(True).alias("_taken")).distinct()
    clash = F.when(F.col("_taken"), F.raise_error(F.concat(F.lit("exists already: "), F.col(key).cast("string"))).cast("boolean"))
    return existing.unionByName(new.join(taken, key, "left").where(clash.isNull()).drop("_taken"))


def gains(base: DataFrame, new: DataFrame, key: str, right: str, total: str, tolerance: float = 0.0) -> DataFrame:
    """Share of right ones by key and over all (key null) of two runs, the verdict, and whether a key got worse though all got better."""

    def shares(rows: DataFrame, name: str) -> DataFrame:
        by = rows.rollup(key).agg(F.sum(right).alias("r"), F.sum(total).alias("t"), F.grouping(key).alias("overall"))
        return by.select(key, "overall", F.try_divide(F.col("r").cast("double"), F.col("t")).alias(name))

    b, n = shares(base.where(F.col(key).isNotNull()), "base"), shares(new.where(F.col(key).isNotNull()), "new").withColumnsRenamed({key: "_key", "overall": "_overall"})
    both = b.join(n, b[key].eqNullSafe(n["_key"]) & (b["overall"] == n["_overall"]), "full")
    both = both.select(F.coalesce(key, "_key").alias(key), F.coalesce("overall", "_overall").alias("overall"), "base", "new")
    both = both.withColumn("verdict", verdict(F.col("base"), F.col("new"), F.lit(True), tolerance))
    better, worse = (F.count_if((F.col("overall") == o) & (F.col("verdict") == v)) > 0 for o, v in ((1, "better"), (0, "worse")))
    flag = both.agg((better & worse).alias("hidden_regression"))  # one row
    return both.drop("overall").crossJoin(F.broadcast(flag))


def performance(rows: DataFrame, keys: Sequence[str], ms: str, load_ms: str, failed: str, wall_s: Column | None = None) -> DataFrame:
    """Samples, mean time with and without loading of the model, and answers a second: over the wall clock where it is known,
    else over the times of all samples, failed ones too. Means are of samples that didn't fail and have a time.
    """
    good = ~F.col(failed) & F.col(ms).isNotNull()
    timed = F.sum(ms) / 1000
    seconds = timed if wall_s is None else F.when(F.max(wall_s) > 0, F.max(wall_s)).otherwise(timed)
    basis = F.lit("sum of times") if wall_s is None else F.when(F.max(wall_s) > 0, "wall clock").otherwise("sum of times")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(good).alias("timed"),
        F.avg(F.when(good, F.col(ms))).alias("mean_ms"),
        F.avg(F.when(good, F.col(ms) - F.coalesce(F.col(load_ms), F.lit(0)))).alias("mean_ms_without_load"),
        F.try_divide(F.when(F.count_if(good) > 0, F.count_if(good)), F.when(seconds > 0, seconds)).alias("per_second"),
        basis.alias("basis"),
        F.sum(load_ms).alias("load_ms"),
    )
