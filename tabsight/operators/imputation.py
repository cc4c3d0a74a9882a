"""Filling missing values: statistics of one column, row order, neighbours, regressions, and the plan over a table."""

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import numeric_columns
from ..functions.ordered import forward_fill
from ..functions.quantiles import column_quantiles
from ..functions.reshape import long_agg, value_counts
from ..functions.text import quoted
from ..options import DEFAULTS, Options
from .neighbours import impute_knn
from .regression import impute_iterative

BLOCKED_TAGS = ("currency", "financial")
DONE_BEFORE_FILLS = ("impute_knn", "impute_iterative")


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Smallest most frequent value per column, from counts combined before the shuffle."""
    numeric = [c for c in columns if c in set(numeric_columns(df))]
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    number = F.when(F.col("column").isin(numeric), F.col("value").try_cast("double"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), number, "value")).alias("v"))
    return {r["column"]: r["v"] for r in best.collect()}  # one row per column


def fill_values(df: DataFrame, actions: dict[str, str], opts: Options = DEFAULTS) -> dict:
    """The constant to put into each column: mean, median, mode or label."""
    by = {}
    for c, a in actions.items():
        by.setdefault(a, []).append(c)
    out = {}
    if by.get("impute_mean"):
        means = long_agg(df, {c: {"v": F.avg(quoted(c))} for c in by["impute_mean"]})
        out.update({r["column"]: r["v"] for r in means.collect()})
    if by.get("impute_median"):
        out.update({r["column"]: r["q"][0] for r in column_quantiles(df, by["impute_median"], [0.5], opts).collect()})
    if by.get("impute_mode"):
        out.update(modes(df, by["impute_mode"]))
    out.update({c: opts.unknown_label for c in by.get("impute_unknown_label", [])})
    return {c: v for c, v in out.items() if v is not None}


def _fill(df: DataFrame, values: dict) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}

    def filled(c):
        kind = types[c].simpleString()
        if isinstance(values[c], float) and kind in ("tinyint", "smallint", "int", "bigint"):
            return F.coalesce(quoted(c).cast("double"), F.lit(values[c]))
        return F.coalesce(quoted(c), F.lit(values[c]).cast(kind))

    return df.select(*[filled(c).alias(c) if c in values else quoted(c) for c in df.columns])


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return _fill(df, fill_values(df, dict.fromkeys(columns, "impute_mean")))


def impute_median(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> DataFrame:
    return _fill(df, fill_values(df, dict.fromkeys(columns, "impute_median"), opts))


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    return _fill(df, fill_values(df, dict.fromkeys(columns, "impute_mode")))


def impute_label(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> DataFrame:
    return df.fillna(opts.unknown_label, subset=columns)


def impute_ffill(df: DataFrame, columns: list[str], order_by: list[str], opts: Options = DEFAULTS) -> DataFrame:
    return forward_fill(df, columns, order_by, opts)


def drop_rows_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def drop_column(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def impute_plan(df: DataFrame, actions: dict[str, str], tags: dict[str, str] | None = None, keys: list[str] | None = None,
                order_by: list[str] | None = None, features: list[str] | None = None,
                opts: Options = DEFAULTS) -> DataFrame:
    """One action per column. Money is never filled.

    Every statistic and every model comes from the table as given, so the order of the actions does not matter. Constant
    fills and dropped columns are one projection. ``keys`` identify a row (needed by ``impute_knn``), ``order_by`` gives
    the row order (needed by ``impute_forward_fill``).
    """
    tags = tags or {}
    todo = {c: a for c, a in actions.items() if c in df.columns and tags.get(c) not in BLOCKED_TAGS}
    features = features or [c for c in numeric_columns(df)
                            if tags.get(c) not in ("identifier", "datetime", *BLOCKED_TAGS) and c not in (keys or [])]

    def named(action):
        return [c for c, a in todo.items() if a == action]

    constants = fill_values(df, todo, opts)
    out = df
    if named("impute_knn"):
        out = impute_knn(out, named("impute_knn"), keys, features, opts, source=df)
    if named("impute_iterative"):
        out = impute_iterative(out, named("impute_iterative"), features, opts, source=df)
    if named("impute_forward_fill"):
        out = forward_fill(out, named("impute_forward_fill"), order_by, opts)
    if named("drop_rows"):
        out = out.dropna(subset=named("drop_rows"))
    return _fill(out, constants).drop(*named("drop_column"))
