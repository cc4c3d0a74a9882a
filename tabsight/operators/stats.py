"""Descriptive statistics, distributions and breakdowns by one dimension."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut, made_once
from ..functions.numbers import kurtosis_agg, numeric_columns, pct, skewness_agg
from ..functions.partitions import held
from ..functions.quantiles import column_quantiles, exact_quantiles
from ..functions.reshape import long_agg, text_cells, value_counts
from ..functions.text import quoted
from ..options import DEFAULTS, Options


def describe_numeric(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Moments in one aggregate, quartiles from the exact quantiles. The columns are held while both are made; one row per column comes out."""
    narrow = df.select(*[quoted(c) for c in columns])
    with held(narrow):
        moments = long_agg(narrow, {c: {
            "count": F.count(quoted(c)), "mean": F.avg(quoted(c)), "std": F.stddev_samp(quoted(c)), "variance": F.var_samp(quoted(c)),
            "min": F.min(quoted(c)).cast("double"), "max": F.max(quoted(c)).cast("double"),
            "skewness": skewness_agg(quoted(c)), "kurtosis": kurtosis_agg(quoted(c)), "_rows": F.count("*")} for c in columns}).collect()
        quartiles = {r["column"]: r["q"] for r in column_quantiles(narrow, columns, [0.25, 0.5, 0.75], opts, rows=moments[0]["_rows"]).collect()}
    rows = [(r["column"], r["count"], r["mean"], q[1], r["std"], r["variance"], r["min"], r["max"], q[0], q[2], r["skewness"], r["kurtosis"])
            for r in moments if (q := quartiles.get(r["column"])) is not None]
    names = ["mean", "median", "std", "variance", "min", "max", "q1", "q3", "skewness", "kurtosis"]
    return df.sparkSession.createDataFrame(rows, "column string, count long, " + ", ".join(f"{n} double" for n in names))


def category_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, count, pct)``, null kept as a value."""
    counts = value_counts(df, columns)
    total = df.agg(F.count("*")).scalar()
    return counts.select("column", "value", F.col("n").alias("count"), pct(F.col("n"), total).alias("pct"))


def category_top_other(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Columns of many values: the most frequent ones and one ``Other`` row for the rest."""
    counts = cut(value_counts(df, columns))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").asc_nulls_last())
    top = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= opts.max_bars)
    sizes = counts.groupBy("column").agg(F.sum("n").alias("_total"), F.count("*").alias("_values"))
    kept = top.join(sizes, "column").where((F.col("_values") <= opts.max_bars) | (F.col("_rn") <= opts.top_bars))
    rest = (kept.where(F.col("_values") > opts.max_bars).groupBy("column", "_total").agg(F.sum("n").alias("_kept"))
            .select("column", F.lit(opts.other_label).alias("value"), (F.col("_total") - F.col("_kept")).alias("n"), "_total"))
    both = kept.select("column", "value", "n", "_total").unionByName(rest)
    return both.select("column", "value", F.col("n").alias("count"), pct(F.col("n"), F.col("_total")).alias("pct"))


def standardize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``<column>_z`` of the numeric columns."""
    columns = columns or numeric_columns(df)
    stats = {r["column"]: r for r in long_agg(df, {c: {"m": F.avg(quoted(c)), "s": F.stddev_samp(quoted(c))} for c in columns}).collect()}
    return df.select("*", *[((quoted(c) - stats[c]["m"]) / F.lit(stats[c]["s"] or 1.0)).alias(f"{c}_z") for c in columns])


def box_stats(df: DataFrame, column: str, group: str | None = None, opts: Options = DEFAULTS) -> DataFrame:
    """Quartiles and whiskers, for the column or per label, however many there are."""
    label = quoted(group).cast("string") if group else F.lit("all")
    long = made_once(df.select(label.alias("label"), quoted(column).cast("double").alias("value")).dropna(), "box")
    q = exact_quantiles(long, ["label"], "value", [0.25, 0.5, 0.75], opts)
    spread = F.col("q")[2] - F.col("q")[0]
    fences = q.select("label", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
                      (F.col("q")[0] - opts.fence * spread).alias("_lo"), (F.col("q")[2] + opts.fence * spread).alias("_hi"))
    inside = F.when(F.col("value").between(F.col("_lo"), F.col("_hi")), F.col("value"))
    return (long.join(fences, "label").groupBy("label", "q1", "median", "q3")
            .agg(F.count("*").alias("n"), F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
                 F.count_if(inside.isNull()).alias("outliers")))


def histogram(df: DataFrame, column: str, bins: int | None = None, opts: Options = DEFAULTS) -> DataFrame:
    """Equal-width bins between the smallest and largest value, empty bins included."""
    v = quoted(column).cast("double")
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).first()
    schema = "bin long, lower double, upper double, count long"
    if not r["n"]:
        return df.sparkSession.createDataFrame([], schema)
    k = min(bins or opts.bins, r["n"])
    lo, hi = (r["lo"], r["hi"]) if r["lo"] < r["hi"] else (r["lo"] - 0.5, r["hi"] + 0.5)
    found = df.where(v.isNotNull()).groupBy(F.least(F.width_bucket(v, F.lit(lo), F.lit(hi), F.lit(k)), F.lit(k)).alias("bin")).agg(
        F.count("*").alias("count"))
    width = (hi - lo) / k
    return df.sparkSession.range(1, k + 1).toDF("bin").join(found, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * width).alias("lower"), (F.lit(lo) + F.col("bin") * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"))


def derived_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Means of the derived metrics."""
    columns = columns or [c for c in numeric_columns(df) if c.startswith("derived_")]
    return long_agg(df, {c: {"mean": F.avg(quoted(c))} for c in columns})


def mean_by(df: DataFrame, dim: str, metrics: dict[str, str]) -> DataFrame:
    """Means per label of a dimension."""
    return (df.where(quoted(dim).isNotNull()).groupBy(quoted(dim).alias("label"))
            .agg(*[F.round(F.avg(quoted(c)), 2).alias(name) for name, c in metrics.items()]))


def discount_margin_by_rep(df, rep, discount, margin) -> DataFrame:
    return mean_by(df, rep, {"avg_discount": discount, "avg_margin": margin})


def order_value_by_segment(df, segment, revenue) -> DataFrame:
    return mean_by(df, segment, {"avg_order_value": revenue})


def shipping_cost_by_region(df, region, shipping) -> DataFrame:
    return mean_by(df, region, {"avg_shipping_cost": shipping})


def margin_by_category_month(df: DataFrame, category: str, month: str, margin: str) -> DataFrame:
    return (df.dropna(subset=[category, month, margin]).groupBy(quoted(category).alias("category"), quoted(month).alias("month"))
            .agg(F.round(F.avg(quoted(margin)), 2).alias("avg_margin")))


def margin_by_month(df: DataFrame, month: str, margin: str) -> DataFrame:
    return df.groupBy(quoted(month).alias("month")).agg(F.avg(quoted(margin)).alias("avg_margin"))


def discount_return_rate(df: DataFrame, discount: str, returned: str, buckets: int = 4, opts: Options = DEFAULTS) -> DataFrame:
    """Share of returned rows per quantile bucket of the discount; right-closed, equal edges merged."""
    rows = df.select(quoted(discount).cast("double").alias("d"), quoted(returned).cast("int").alias("r")).dropna()
    edges = column_quantiles(rows, ["d"], [i / buckets for i in range(buckets + 1)], opts).collect()
    cuts = sorted(set(edges[0]["q"])) if edges else []
    schema = "bucket int, lower double, upper double, return_rate_pct double, records long"
    if len(cuts) < 2:
        return df.sparkSession.createDataFrame([], schema)
    bucket = F.when(F.col("d") <= cuts[1], 1)
    for i, edge in enumerate(cuts[2:], start=2):
        bucket = bucket.when(F.col("d") <= edge, i)
    bounds = F.array(*[F.lit(c) for c in cuts])
    return rows.groupBy(bucket.alias("bucket")).agg(
        F.round(F.avg("r") * 100, 2).alias("return_rate_pct"), F.count("*").alias("records")).select(
        "bucket", F.element_at(bounds, F.col("bucket")).alias("lower"), F.element_at(bounds, F.col("bucket") + 1).alias("upper"),
        "return_rate_pct", "records")


def lead_time(df: DataFrame, column: str, opts: Options = DEFAULTS) -> DataFrame:
    stats = long_agg(df, {column: {"n": F.count(quoted(column)), "mean_days": F.round(F.avg(quoted(column)), 2),
                                   "min_days": F.round(F.min(quoted(column)), 2), "max_days": F.round(F.max(quoted(column)), 2)}})
    q = column_quantiles(df, [column], [0.5], opts)
    return stats.where("n > 0").join(q, "column").select("*", F.round(F.col("q")[0], 2).alias("median_days")).drop("q")


def lead_time_by(df: DataFrame, column: str, dims: list[str], n: int = 5, opts: Options = DEFAULTS) -> DataFrame:
    """Mean, median and count per label of every dimension of two labels and more; the slowest and fastest n labels."""
    narrow = made_once(df.select(*[quoted(c) for c in dict.fromkeys([column, *dims])]), "lead-times")
    cells = text_cells(narrow, dims, [column], keep_null=False).where(quoted(column).isNotNull()).withColumnsRenamed(
        {"column": "dimension", column: "_days"})
    groups = cells.groupBy("dimension", "value").agg(F.avg("_days").alias("mean_days"), F.count("*").alias("orders"))
    sizes = groups.groupBy("dimension").agg(F.count("*").alias("labels")).where("labels > 1")
    small = groups.join(sizes, "dimension")
    med = exact_quantiles(cells, ["dimension", "value"], "_days", [0.5], opts)
    slow = Window.partitionBy("dimension").orderBy(F.desc("mean_days"), "value")
    fast = Window.partitionBy("dimension").orderBy("mean_days", F.desc("value"))
    return (small.join(med, ["dimension", "value"]).withColumn("rank_slow", F.row_number().over(slow))
            .withColumn("rank_fast", F.row_number().over(fast)).where((F.col("rank_slow") <= n) | (F.col("rank_fast") <= n))
            .select("dimension", "value", "mean_days", F.col("q")[0].alias("median_days"), "orders", "rank_slow", "rank_fast"))
