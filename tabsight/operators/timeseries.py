"""Growth, seasonality and linear trends over an explicit date column."""

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ordered import row_index
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options


def _growth(totals: DataFrame, order: list[str], label) -> DataFrame:
    # One row per period: a handful of rows per year, so one ordered window over all of them is small.
    w = Window.orderBy(*order)
    before = F.lag("total").over(w)
    return totals.withColumn("growth_pct", F.try_divide(F.col("total") - before, before) * 100).where(
        F.col("growth_pct").isNotNull()).withColumn("label", label)


def growth_monthly(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Sum per month and its change against the month before; months without a base are left out."""
    totals = df.groupBy(F.year(quoted(date)).alias("year"), F.month(quoted(date)).alias("month")).agg(
        F.sum(quoted(metric)).alias("total")).where("year is not null")
    return _growth(totals, ["year", "month"], F.format_string("%d-M%02d", "year", "month"))


def growth_quarterly(df: DataFrame, date: str, metric: str) -> DataFrame:
    totals = df.groupBy(F.year(quoted(date)).alias("year"), F.quarter(quoted(date)).alias("quarter")).agg(
        F.sum(quoted(metric)).alias("total")).where("year is not null")
    return _growth(totals, ["year", "quarter"], F.format_string("%d-Q%d", "year", "quarter"))


def growth_yearly(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Yearly roll-up of the monthly sums."""
    months = df.where(quoted(date).isNotNull()).groupBy(F.year(quoted(date)).alias("year"), F.month(quoted(date)).alias("month")).agg(
        F.sum(quoted(metric)).alias("total"))
    years = months.groupBy("year").agg(F.sum("total").alias("total"), F.count("*").alias("months"))
    w = Window.orderBy("year")  # one row per year
    before = F.lag("total").over(w)
    return years.withColumn("growth_pct", F.try_divide(F.col("total") - before, before) * 100)


def _season(df: DataFrame, part, metric: str, label) -> DataFrame:
    means = df.where(part.isNotNull()).groupBy(part.alias("period")).agg(F.avg(quoted(metric)).alias("average"))
    # At most twelve periods, so one window over them all.
    best = Window.orderBy(F.desc("average"), "period")
    worst = Window.orderBy("average", "period")
    return means.select("period", label.alias("label"), "average", (F.row_number().over(best) == 1).alias("is_best"),
                        (F.row_number().over(worst) == 1).alias("is_worst"))


def _names(words: str):
    return F.array(*[F.lit(w) for w in words.split()])


def seasonality_month(df: DataFrame, date: str, metric: str) -> DataFrame:
    names = _names("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec")
    return _season(df, F.month(quoted(date)), metric, F.element_at(names, F.col("period")))


def seasonality_quarter(df: DataFrame, date: str, metric: str) -> DataFrame:
    return _season(df, F.quarter(quoted(date)), metric, F.concat(F.lit("Q"), F.col("period").cast("string")))


def seasonality_weekday(df: DataFrame, date: str, metric: str) -> DataFrame:
    return _season(df, F.weekday(quoted(date)), metric, F.element_at(_names("Mon Tue Wed Thu Fri Sat Sun"), F.col("period") + 1))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def month_index(df: DataFrame, date: str):
    return F.year(quoted(date)) * 12 + F.month(quoted(date))


def trend_regression(df: DataFrame, columns: list[str], date: str | None = None, order_by: list[str] | None = None,
                     opts: Options = DEFAULTS) -> DataFrame:
    """Least squares of each column on the month index (or on the row position), all columns in one aggregate."""
    if date is not None:
        base, x, axis = df, month_index(df, date).cast("double"), f"{date}_year_month_index"
    else:
        base, x, axis = row_index(df, order_by, "_x", opts), F.col("_x").cast("double"), "row_index"
    sums = {}
    for c in columns:
        y = quoted(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        xs, ys = F.when(both, x), F.when(both, y)
        sums[c] = {"n": F.count_if(both), "mx": F.avg(xs), "my": F.avg(ys), "sxx": F.regr_sxx(ys, xs), "syy": F.regr_syy(ys, xs),
                   "sxy": F.regr_sxy(ys, xs)}
    s = long_agg(base, sums).where("n >= 3")
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    r2 = F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")), F.lit(0.0))
    s = s.withColumns({"slope": slope, "r_squared": r2, "dof": F.col("n") - 2}).where("slope is not null")
    s = s.withColumn("std_err", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(
        (1 - F.col("r_squared")) * F.col("syy"), F.col("sxx") * F.col("dof")))))
    t = F.try_divide(F.col("slope"), F.col("std_err"))
    s = s.withColumn("t", F.when(F.col("std_err") == 0, F.when(F.col("slope") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(t))

    @F.pandas_udf("double")  # one row per column
    def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) for a, b in zip(t, dof)])

    s = s.withColumn("p_value", p_value("t", "dof"))
    return s.select(
        "column", F.round("slope", 6).alias("slope"), F.round(F.col("my") - F.col("slope") * F.col("mx"), 4).alias("intercept"),
        F.round("r_squared", 4).alias("r_squared"), F.round("p_value", 4).alias("p_value"), F.round("std_err", 6).alias("std_err"),
        F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("trend"), (F.col("p_value") < 0.05).alias("significant"),
        F.lit(axis).alias("x_axis"), "n")
