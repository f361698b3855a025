"""Evaluation of extracted fields: summaries, classification, latency, errors and comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmeter.functions.compare import CORRECT, ERRORS, STATUSES, verdict

UNCLASSIFIED = "(unclassified)"


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0; division of counts, hence not rounded here."""
    return F.try_divide(a.cast("double"), b)


def expected_actual(expected: DataFrame, actual: DataFrame, keys: Sequence[str], schema_fields: Sequence[str]) -> DataFrame:
    """Full join of expected and actual fields; fields only the answer has are EXTRA_SCHEMA or EXTRA and unscored."""
    both = expected.withColumn("_known", F.lit(True)).join(actual, list(keys), "full")
    known = F.coalesce("_known", F.lit(False))
    extra = F.when(F.col("field").isin(*schema_fields), "EXTRA_SCHEMA").otherwise("EXTRA")
    return both.withColumn("extra", F.when(~known, extra)).drop("_known")


def group_summary(fields: DataFrame, samples: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Summaries for several groupings at once by GROUPING SETS, one pass over fields and one over samples.

    ``fields``: grouping columns, status, scored, cer. ``samples``: grouping columns, failed, type_correct. ``grouping``
    tells a grouping's total from a null key.
    """
    keys = list(dict.fromkeys(c for g in groups for c in g))
    sets = [[F.col(c) for c in g] for g in groups]
    level = F.grouping_id().alias("grouping")
    by_field = fields.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        level,
        F.count_if("scored").alias("scored"),
        F.count_if(F.col("scored") & F.col("status").isin(*CORRECT)).alias("correct"),
        F.count_if(F.col("scored") & (F.col("status") == "EXACT")).alias("exact"),
        F.count_if(F.col("status") == "PARTIAL").alias("partial"),
        F.count_if(F.col("status") == "EXTRA_SCHEMA").alias("extra_schema"),
        F.avg("cer").alias("mean_cer"),
    )
    by_sample = samples.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        level,
        F.count(F.lit(1)).alias("samples"),
        F.count_if("failed").alias("failed"),
        F.avg(F.col("type_correct").cast("int")).alias("type_accuracy"),
    )
    same = F.lit(True)
    for c in [*keys, "grouping"]:
        same &= F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("scored", "correct", "exact", "partial", "extra_schema")]
    joined = by_sample.alias("s").join(by_field.alias("f"), same, "left")
    return joined.select(
        "s.*", *zero, ratio(F.col("correct"), F.col("scored")).alias("accuracy"), ratio(F.col("exact"), F.col("scored")).alias("exact_rate"), "mean_cer"
    )


def field_histogram(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per field: rows of each status (all, zero-filled), and rates over the scored ones."""
    n = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES}
    scored = F.count_if("scored")
    return fields.groupBy(*keys).agg(
        *n.values(),
        scored.alias("scored"),
        ratio(F.count_if(F.col("scored") & F.col("status").isin(*CORRECT)), scored).alias("accuracy"),
        F.count_if(F.col("scored") & F.col("status").isin(*ERRORS)).alias("errors"),
    )


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Cells (truth, predicted, n); no prediction is a column of its own."""
    p = F.coalesce(F.col(predicted), F.lit(UNCLASSIFIED))
    return rows.groupBy(F.col(truth).alias("truth"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    cells = confusion(rows, truth, predicted)
    return cells.groupBy("truth").pivot("predicted", [*labels, UNCLASSIFIED]).agg(F.sum("n")).fillna(0)


def classification(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label: support, hits, precision, recall, F1 (null where undefined). Labels are those of either column."""
    cells = confusion(rows, truth, predicted)
    actual = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    guessed = cells.where(F.col("predicted") != UNCLASSIFIED).groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    out = actual.join(guessed, "label", "full").fillna(0)
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    f1 = F.try_divide(2.0 * F.col("hits"), F.when((F.col("hits") > 0), F.col("predicted") + F.col("support")))
    return out.withColumns({"precision": p, "recall": r, "f1": f1})


def classification_summary(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, macro F1 (over labels with support; no F1 counts 0), share without prediction, wrong labels."""
    labels = classification(rows, truth, predicted)
    macro = labels.where("support > 0").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"))
    t, p = F.col(truth), F.col(predicted)
    total = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t == p).alias("right"),
        F.count_if(p.isNull()).alias("unclassified"),
        F.count_if(p.isNotNull() & (t != p)).alias("crossed"),
    )
    return total.join(macro, F.lit(True)).withColumn("accuracy", ratio(F.col("right"), F.col("n")))


def percentile(c: str, p: float, least: int = 0) -> Column:
    """Nearest rank; null below ``least`` values."""
    value = F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")
    return F.when(F.count(c) >= least, value)


def latency(rows: DataFrame, keys: Sequence[str], ms: str, failed: str) -> DataFrame:
    """Error rate, mean and gated percentiles of the rows that didn't fail, and throughput over all timed rows."""
    ok = rows.withColumn("_ms", F.when(~F.col(failed), F.col(ms)))
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if(F.col(failed)), F.count(F.lit(1))).alias("error_rate"),
        F.count("_ms").alias("timed"),
        percentile("_ms", 0.5, 2).alias("p50"),
        percentile("_ms", 0.95, 20).alias("p95"),
        percentile("_ms", 0.99, 100).alias("p99"),
    )


def error_patterns(fields: DataFrame, keys: Sequence[str], top: int = 20) -> DataFrame:
    """The most frequent (keys, status) among errors and partial hits; ties by key."""
    found = fields.where(F.col("status").isin(*ERRORS, "PARTIAL")).groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), *keys, "status").limit(top)


def recommendations(fields: DataFrame, keys: Sequence[str], weight: str, top: int = 15) -> DataFrame:
    """Fields by errors times weight, with their dominant error (ties to the name last in the alphabet) and its numbers."""
    wrong = fields.where(F.col("scored") & F.col("status").isin(*ERRORS))
    per = wrong.groupBy(*keys, weight, "status").agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy(*keys, weight).agg(F.sum("c").alias("errors"), F.max_by("status", F.struct("c", "status")).alias("dominant"))
    out = out.withColumn("impact", F.col("errors") * F.col(weight)).orderBy(F.desc("impact"), *keys).limit(top)
    return out.withColumn("priority", F.row_number().over(W.orderBy(F.desc("impact"), *keys)))


def compare_runs(base: DataFrame, new: DataFrame, keys: Sequence[str], metric: str, higher: bool, tolerance: float = 0.0) -> DataFrame:
    """Full join of two runs' metrics with the verdict; a metric that one run lacks has no data."""
    b, n = base.select(*keys, F.col(metric).alias("base")), new.select(*keys, F.col(metric).alias("new"))
    joined = b.join(n, list(keys), "full")
    return joined.withColumn("verdict", verdict(F.col("base"), F.col("new"), F.lit(higher), tolerance))


def sample_differences(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: how many keys only one of the runs has, and whether the runs can be compared."""
    a = base.join(new, key, "left_anti").agg(F.count(F.lit(1)).alias("only_base"))
    b = new.join(base, key, "left_anti").agg(F.count(F.lit(1)).alias("only_new"))
    return a.join(b, F.lit(True)).withColumn("comparable", (F.col("only_base") == 0) & (F.col("only_new") == 0))


def regressions(base: DataFrame, new: DataFrame, key: Sequence[str], field: str, right: str) -> DataFrame:
    """Per field: rows that got right or wrong between two runs, over the samples of both; a field that the base lacks was wrong."""
    had = base.select(*key, field, F.col(right).alias("was"))
    both = new.join(base.select(*key).distinct(), list(key), "left_semi").select(*key, field, F.col(right).alias("now"))
    joined = both.join(had, [*key, field], "left").withColumn("was", F.coalesce("was", F.lit(False)))
    return joined.groupBy(field).agg(F.count_if(~F.col("was") & F.col("now")).alias("gained"), F.count_if(F.col("was") & ~F.col("now")).alias("lost"))


def pooled(rows: DataFrame, groups: Column, right: Column) -> DataFrame:
    """Accuracy by groups of which a row may be in several."""
    exploded = rows.select(F.explode(groups).alias("pool"), right.alias("right"))
    return exploded.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("hits")).withColumn("accuracy", ratio(F.col("hits"), F.col("n")))
