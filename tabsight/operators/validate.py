"""Checks over the results of many runs. Inputs carry ``(table_name, run_id)``; every check is a filter and a group-by."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut
from ..functions.numbers import ratio
from ..options import DEFAULTS, Options

RUN = ["table_name", "run_id"]


def _check(df: DataFrame, name: str, bad: Column, severity: str = "fail") -> DataFrame:
    """One verdict per run from a count of findings."""
    return df.groupBy(*RUN).agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("findings")).select(
        *RUN, F.lit(name).alias("check"), F.when(F.col("findings") == 0, "pass").otherwise(severity).alias("status"), "findings")


def check_rows(actual: DataFrame, accounting: DataFrame) -> DataFrame:
    """``rows`` of the cleaned table against ``final_rows`` of the row accounting."""
    both = accounting.join(actual, RUN, "left")
    return _check(both, "row_reconciliation", F.col("rows") != F.col("final_rows"))


def check_schema(blueprint: DataFrame, columns: DataFrame) -> DataFrame:
    """Every blueprint column that was not dropped is in the cleaned table."""
    present = columns.select(*RUN, "column").distinct().withColumn("_there", F.lit(True))
    both = blueprint.where(~F.coalesce("dropped", F.lit(False))).join(present, RUN + ["column"], "left")
    return _check(both, "schema_consistency", F.col("_there").isNull())


def check_bounds(scores: DataFrame, stats: DataFrame, correlations: DataFrame) -> DataFrame:
    """Score in 0..100, statistics finite, correlations in -1..1. ``stats`` is long: ``(metric, value)``."""
    value, r = F.col("value"), F.col("r")
    infinite = F.isnan(value) | (F.abs(value) == float("inf"))
    return _check(scores, "score_bounds", ~F.col("score").between(0, 100)).unionByName(
        _check(stats, "stats_finite", F.coalesce(infinite, F.lit(False)))).unionByName(
        _check(correlations, "correlation_bounds", F.coalesce(F.abs(r) > 1.0001, F.lit(False))))


def check_trend_n(trends: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    return _check(trends, "trend_sample", F.coalesce(F.col("significant") & (F.col("n") < opts.trend_min_n), F.lit(False)), "warn")


def check_rules(totals: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """The rule that fails most often, against the tolerance."""
    worst = totals.groupBy(*RUN).agg(F.max_by("rule", F.struct("fail_pct", "rule")).alias("worst_rule"),
                                     F.max("fail_pct").alias("worst_pct"))
    return worst.select(*RUN, F.lit("business_rules").alias("check"),
                        F.when(F.col("worst_pct") <= opts.max_rule_fail_pct, "pass").otherwise("warn").alias("status"),
                        "worst_rule", "worst_pct")


def check_merges(merges: DataFrame, raw_counts: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Merges that change many rows or join two common values. ``raw_counts``: ``(…, column, value, n)``."""
    totals = raw_counts.groupBy(*RUN, "column").agg(F.sum("n").alias("_rows"))
    key = RUN + ["column"]
    raw = raw_counts.select(*key, F.col("value").alias("raw"), F.col("n").alias("_raw"))
    target = raw_counts.select(*key, F.col("value").alias("canonical"), F.col("n").alias("_target"))
    m = merges.join(totals, key, "left").join(raw, key + ["raw"], "left").join(target, key + ["canonical"], "left")

    def share(c):
        return ratio(c, F.greatest("_rows", F.lit(1))) * 100

    common = (share(F.coalesce("_raw", "row_count")) > opts.merge_common_pct) & (
        share(F.coalesce("_target", F.lit(0))) > opts.merge_common_pct)
    return m.select(*key, "raw", "canonical", F.round(share(F.col("row_count")), 2).alias("changed_pct"),
                    ((share(F.col("row_count")) > opts.merge_change_pct) | common).alias("unsafe"))


def merges_verdict(checked: DataFrame) -> DataFrame:
    return _check(checked, "merge_safety", F.col("unsafe"))


def cohen_kappa(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Agreement of two label columns beyond chance, from the counts of label pairs."""
    keys = keys or []
    cells = cut(df.dropna(subset=[a, b]).groupBy(*keys, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(
        F.count("*").alias("_n")))
    base = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    left = cells.groupBy(*keys, F.col("_a").alias("_l")).agg(F.sum("_n").alias("_na"))
    right = cells.groupBy(*keys, F.col("_b").alias("_l")).agg(F.sum("_n").alias("_nb"))
    chance = left.join(right, keys + ["_l"]).groupBy(*keys).agg(F.sum(F.col("_na").cast("double") * F.col("_nb")).alias("_e"))
    both = base.join(chance, keys, "left") if keys else base.join(chance)  # without keys one row each
    observed = F.col("_same") / F.col("n")
    expected = F.coalesce("_e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(expected >= 1, 1.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    return both.select(*keys, "n", observed.alias("observed"), expected.alias("expected"), kappa.alias("kappa"))


def validation_score(checks: list[DataFrame], review: DataFrame | None = None, weak_trends: DataFrame | None = None) -> DataFrame:
    """Score, verdict and confidence per run. ``review``: runs with ``review_required``; ``weak_trends``: runs with ``n``."""
    rows = reduce(lambda x, y: x.unionByName(y), [c.select(*RUN, "check", "status") for c in checks])
    s = rows.groupBy(*RUN).agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "fail").alias("failed"),
                               F.count_if(F.col("status") == "warn").alias("warned"))
    s = s.join(review.select(*RUN, "review_required"), RUN, "left") if review is not None else s.withColumn("review_required", F.lit(False))
    s = s.join(weak_trends.select(*RUN, F.col("n").alias("_weak")), RUN, "left") if weak_trends is not None else s.withColumn("_weak", F.lit(0))
    score = F.round(100.0 * (F.col("checks") - F.col("failed") - F.col("warned") * 0.5) / F.col("checks"), 2)
    s = s.withColumn("validation_score", score).withColumn("passed", F.col("failed") == 0)
    sure = F.col("validation_score") / 100 * F.when(F.col("review_required"), 0.5).otherwise(1.0) - F.least(
        F.lit(0.25), F.coalesce("_weak", F.lit(0)) * 0.05)
    return s.select(*RUN, "checks", "failed", "warned", "validation_score", "passed",
                    F.round(F.greatest(F.lit(0.0), sure), 3).alias("confidence"))
