"""Statistical outliers: z-score, z-score of the logarithm for skewed positive columns, wide fences for other skewed ones."""

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import numeric_columns, pct, skewness_agg
from ..functions.quantiles import column_quantiles
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options

# Name tokens of columns whose amounts measure the impact.
IMPACT_WORDS = {"revenue", "sales", "amount", "total", "value", "price"}


def impact_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if set(re.findall(r"[a-z0-9]+", c.lower())) & IMPACT_WORDS]


def anomaly_rules(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> dict[str, dict]:
    """Per column the method and the test. One aggregate for all columns, plus quartiles where fences are needed."""
    metrics = {}
    for c in columns:
        v = quoted(c).cast("double")
        log = F.log1p(F.when(v > 0, v))
        metrics[c] = {"n": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "skew": skewness_agg(v), "lo": F.min(v),
                      "lmean": F.avg(log), "lsd": F.stddev_samp(log)}
    stats = {r["column"]: r for r in long_agg(df, metrics).collect()}  # one row per column
    usable = [c for c in columns if stats[c]["n"] >= 4 and stats[c]["sd"]]
    skewed = [c for c in usable if abs(stats[c]["skew"]) > opts.anomaly_skew and stats[c]["lo"] <= 0]
    fences = {r["column"]: r["q"] for r in column_quantiles(df, skewed, [0.25, 0.75], opts).collect()} if skewed else {}
    out = {}
    for c in usable:
        s, v = stats[c], quoted(c).cast("double")
        if c in fences:
            q1, q3 = fences[c]
            if q3 == q1:
                continue
            k = opts.anomaly_fence * (q3 - q1)
            method, test, mean, sd = "iqr", (v < q1 - k) | (v > q3 + k), s["mean"], s["sd"]
        elif abs(s["skew"]) > opts.anomaly_skew:
            if not s["lsd"]:
                continue
            method, mean, sd = "log_zscore", s["lmean"], s["lsd"]
            test = F.abs((F.log1p(v) - mean) / sd) > opts.z_limit
        else:
            method, mean, sd = "zscore", s["mean"], s["sd"]
            test = F.abs((v - mean) / sd) > opts.z_limit
        out[c] = dict(method=method, test=F.coalesce(test, F.lit(False)), mean=mean, sd=sd, skew=s["skew"])
    return out


def _impact(df: DataFrame, c: str) -> Column:
    return sum((F.coalesce(F.abs(quoted(i)), F.lit(0.0)) for i in impact_columns(df) or [c]), F.lit(0.0))


def anomalies(df: DataFrame, columns: list[str], opts: Options = DEFAULTS, rules: dict | None = None) -> DataFrame:
    """Per column with flagged values: method, count and the numbers behind it. ``rules`` saves finding them again."""
    rules = anomaly_rules(df, columns, opts) if rules is None else rules
    schema = "column string, method string, count long, skewness double, col_mean double, col_std double"
    if not rules:
        return df.sparkSession.createDataFrame([], schema)
    return long_agg(df, {c: {
        "method": F.lit(r["method"]), "count": F.count_if(r["test"]), "skewness": F.lit(round(r["skew"], 4)),
        "col_mean": F.lit(round(r["mean"], 4)), "col_std": F.lit(round(r["sd"], 4))} for c, r in rules.items()}).where(F.col("count") > 0)


def anomaly_rows(df: DataFrame, columns: list[str], keys: list[str], opts: Options = DEFAULTS, rules: dict | None = None) -> DataFrame:
    """``(keys…, column, value)`` of every flagged value."""
    rules = anomaly_rules(df, columns, opts) if rules is None else rules
    cells = F.array_compact(F.array(*[F.when(r["test"], F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")))
                                      for c, r in rules.items()]))
    return df.select(*[quoted(k) for k in keys], F.explode(cells).alias("_c")).select(*[quoted(k) for k in keys], "_c.*")


def anomaly_impact(df: DataFrame, columns: list[str], opts: Options = DEFAULTS, rules: dict | None = None) -> DataFrame:
    """Money on the flagged rows of each column, largest first."""
    rules = anomaly_rules(df, columns, opts) if rules is None else rules
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, method string, count long, business_impact double")
    return long_agg(df, {c: {
        "method": F.lit(r["method"]), "count": F.count_if(r["test"]),
        "business_impact": F.sum(F.when(r["test"], _impact(df, c)))} for c, r in rules.items()}).where(
        F.col("count") > 0).orderBy(F.desc("business_impact"))


def anomaly_summary(df: DataFrame, columns: list[str], opts: Options = DEFAULTS, rules: dict | None = None) -> DataFrame:
    rules = anomaly_rules(df, columns, opts) if rules is None else rules
    hits = [r["test"].cast("int") for r in rules.values()]
    row = F.greatest(*hits, F.lit(0)) if hits else F.lit(0)
    flagged = [F.max(h) for h in hits]
    return df.agg(sum(flagged, F.lit(0)).alias("flagged_columns"),
                  F.coalesce(F.sum(sum(hits, F.lit(0))), F.lit(0)).alias("flagged_values"),
                  F.coalesce(F.sum(row), F.lit(0)).alias("flagged_rows"),
                  pct(F.coalesce(F.sum(row), F.lit(0)), F.count("*")).alias("flagged_row_pct"))
