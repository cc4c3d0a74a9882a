"""The numbers behind a requested chart, checked against the table before anything runs."""

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import made_once
from ..functions.numbers import numeric_columns
from ..functions.quantiles import exact_quantiles
from ..functions.text import quoted
from ..options import DEFAULTS, Options
from .stats import box_stats, histogram

CHARTS = ("bar", "line", "histogram", "box", "scatter")


def chart_query(df: DataFrame, chart: str, x: str, y: str | None = None, group_by: str | None = None, agg: str = "sum",
                not_allowed: set[str] = frozenset(), opts: Options = DEFAULTS) -> DataFrame:
    """bar: y per x, the largest 15; line: y per x, all in the order of x; histogram and box of x; scatter of x and y. Raises ValueError on a bad request."""
    numeric = set(numeric_columns(df))

    def usable(c, number=True):
        if c is None or c not in df.columns or c in not_allowed or (number and c not in numeric):
            raise ValueError(f"column '{c}' is not a usable{' numeric' if number else ''} column")

    if chart not in CHARTS:
        raise ValueError(f"unsupported chart type '{chart}'")
    if chart == "histogram":
        usable(x)
        return histogram(df, x, opts.bins, opts)
    if chart == "box":
        usable(x)
        return box_stats(df, x, group_by if group_by in df.columns and group_by not in not_allowed else None, opts)
    if chart == "scatter":
        usable(x)
        usable(y)
        return df.select(quoted(x).alias("x"), quoted(y).alias("y")).dropna()
    usable(x, number=False)
    usable(y)
    rows = df.where(quoted(x).isNotNull()).groupBy(quoted(x).cast("string").alias("label"))
    if agg == "median":
        # A label of any size is safe: exact_quantiles searches big groups by histograms.
        long = made_once(df.select(quoted(x).cast("string").alias("label"), quoted(y).cast("double").alias("v")).dropna(), "labels")
        out = exact_quantiles(long, ["label"], "v", [0.5], opts).select("label", F.col("q")[0].alias("value"))
    else:
        made = {"mean": F.avg, "count": F.count}.get(agg, F.sum)(quoted(y))
        out = rows.agg(made.alias("value"))
    return out.orderBy("label") if chart == "line" else out.orderBy(F.desc("value"), "label").limit(opts.chart_rows)
