"""Rankings of a metric over categorical dimensions."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.reshape import text_cells
from ..functions.text import has_token, name_tokens, quoted
from ..options import DEFAULTS, Options

# Name tokens of dimensions that are always ranked.
PRIORITY_WORDS = ["region", "category", "segment", "representative"]


def dimension_totals(df: DataFrame, metric: str, dims: list[str]) -> DataFrame:
    """``(dimension, value, total, mean, records)`` for all dimensions from one scan, combined before the shuffle.

    The totals are written once: the two ends, the sizes and the choice of dimensions all read them.
    """
    cells = text_cells(df.withColumn("_m", quoted(metric).cast("double")), dims, ["_m"], keep_null=False)
    return cut(cells.groupBy(F.col("column").alias("dimension"), "value").agg(
        F.coalesce(F.sum("_m"), F.lit(0.0)).alias("total"), F.avg("_m").alias("mean"), F.count("_m").alias("records")))


def ranked(totals: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """The best and worst n labels per dimension, with shares and the number of labels.

    Only the two ends of a dimension are sorted; the ends are cut inside every task first.
    """
    n = opts.rank_n
    sizes = totals.groupBy("dimension").agg(F.sum("total").alias("_all"), F.count("*").alias("total_categories"))
    best = Window.partitionBy("dimension").orderBy(F.desc("total"), "value")
    worst = Window.partitionBy("dimension").orderBy("total", F.desc("value"))
    top = totals.withColumn("rank_top", F.row_number().over(best)).where(F.col("rank_top") <= n)
    bottom = totals.withColumn("rank_bottom", F.row_number().over(worst)).where(F.col("rank_bottom") <= n)
    ends = top.select("dimension", "value", "total", "mean", "records", "rank_top", F.lit(None).cast("int").alias("rank_bottom")).unionByName(
        bottom.select("dimension", "value", "total", "mean", "records", F.lit(None).cast("int").alias("rank_top"), "rank_bottom"))
    both = ends.groupBy("dimension", "value", "total", "mean", "records").agg(
        F.max("rank_top").alias("rank_top"), F.max("rank_bottom").alias("rank_bottom"))
    share = F.coalesce(F.round(F.try_divide(F.col("total"), F.col("_all")) * 100, 2), F.lit(0.0))
    return both.join(sizes, "dimension").select(
        "dimension", "value", "total", "mean", "records", share.alias("share_pct"), "rank_top", "rank_bottom", "total_categories")


def rank_dimension(df: DataFrame, metric: str, dims: list[str], opts: Options = DEFAULTS) -> DataFrame:
    return ranked(dimension_totals(df, metric, dims), opts)


def select_dimensions(totals: DataFrame, order: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Dimensions of two labels and more: priority names first, the rest by spread of shares.

    ``Options.most_labels`` and ``Options.max_dimensions`` leave out long dimensions and all but the first ones; neither is set by default.
    """
    stats = totals.groupBy("dimension").agg(
        F.count("*").alias("labels"), F.sum("total").alias("_all"), F.max("total").alias("_max"), F.min("total").alias("_min"))
    fit = stats.where((F.col("labels") > 1) & (F.col("_all") != 0))
    if opts.most_labels is not None:
        fit = fit.where(F.col("labels") <= opts.most_labels)
    spread = (F.col("_max") - F.col("_min")) / F.col("_all") * 100
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("dimension"))
    fit = fit.select("dimension", "labels", spread.alias("spread"), place.alias("_place"),
                     has_token(name_tokens(F.col("dimension")), PRIORITY_WORDS).alias("priority"))
    # One row per dimension of the table.
    w = Window.orderBy(F.desc("priority"), F.when(~F.col("priority"), -F.col("spread")), "_place")
    ranked_all = fit.withColumn("rank", F.row_number().over(w)).select("dimension", "labels", "spread", "priority", "rank")
    return ranked_all if opts.max_dimensions is None else ranked_all.where(F.col("priority") | (F.col("rank") <= opts.max_dimensions))


def profit_breakdown(df: DataFrame, profit: str, dims: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Ranking on profit over the dimensions that qualify."""
    totals = dimension_totals(df, profit, dims)
    return ranked(totals.join(select_dimensions(totals, dims, opts).select("dimension"), "dimension", "left_semi"), opts)
