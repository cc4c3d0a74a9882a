"""Row rewrites: money, types, text, encodings, clipping, scaling, date parts, derived metrics."""

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..functions.dates import parse_datetime
from ..functions.numbers import numeric_columns, ratio, whole_word
from ..functions.quantiles import column_quantiles
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options


def _rewrite(df: DataFrame, new: dict, extra=None) -> DataFrame:
    """One projection: replaced columns keep their place, extra columns follow."""
    out = [new[c].alias(c) if c in new else quoted(c) for c in df.columns]
    return df.select(*out, *[e.alias(n) for n, e in (extra or {}).items()])


# ---- money, types, text ----

def clean_currency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Money text to double with a ``<column>_parse_failed`` flag; numeric columns pass unchanged."""
    numeric = set(numeric_columns(df))
    parsed = {c: quoted(c).cast("double") if c in numeric else X.parse_money(quoted(c)) for c in columns}
    flags = {f"{c}_parse_failed": (quoted(c).isNotNull() & parsed[c].isNull()).cast("int") for c in columns}
    return _rewrite(df, parsed, flags)


def currency_checks(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Per cleaned money column: nulls, failures, largest amount, and whether it must stop the run."""
    stats = long_agg(df, {c: {
        "nulls": F.count("*") - F.count(quoted(c)), "failed": F.coalesce(F.sum(quoted(f"{c}_parse_failed")), F.lit(0)),
        "parsed": F.count(quoted(c)), "max_abs": F.max(F.abs(quoted(c)))} for c in columns})
    return stats.withColumn("critical", (F.col("parsed") == 0) | (F.coalesce("max_abs", F.lit(0.0))
                                                                 > opts.rules["currency_limit"]))


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns to their intended type; what does not fit becomes null, for dates with a ``<column>_parse_failed`` flag as for money."""
    numeric = set(numeric_columns(df))
    physical = {f.name: f.dataType.simpleString() for f in df.schema}

    def to(c, kind):
        if kind in ("float", "int"):
            value = quoted(c).cast("double") if c in numeric else X.to_number(quoted(c))
            whole = F.when(value == F.floor(value), value.try_cast("bigint"))
            return whole if kind == "int" and physical[c] == "string" else (quoted(c) if c in numeric else value)
        if kind == "datetime":
            return parse_datetime(quoted(c)) if physical[c] == "string" else quoted(c)
        if kind == "boolean":
            return X.to_boolean(quoted(c))
        return X.null_text(quoted(c).cast("string"))

    new = {c: to(c, k) for c, k in types.items() if c in df.columns}
    flags = {f"{c}_parse_failed": (X.null_text(quoted(c)).isNotNull() & new[c].isNull()).cast("int") for c in new
             if types[c] == "datetime" and physical[c] == "string"}
    return _rewrite(df, new, flags)


def null_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return _rewrite(df, {c: X.null_text(quoted(c)) for c in columns})


def canonical_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return _rewrite(df, {c: X.canonical_text(quoted(c)) for c in columns})


def category_label_norm(df: DataFrame, columns: list[str]) -> DataFrame:
    return _rewrite(df, {c: X.category_label(quoted(c)) for c in columns})


# ---- encodings ----

def encode_ordinal(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """``<column>__ordinal``: position in the given order, null for other labels."""
    from itertools import chain
    norm = {" ".join(re.sub(r"[_\-]+", " ", v).split()).casefold(): i for i, v in enumerate(order)}
    index = F.create_map(*chain(*[(F.lit(k), F.lit(i)) for k, i in norm.items()]))
    return df.withColumn(f"{column}__ordinal", index[X.category_label(quoted(column).cast("string"))])


def one_hot_labels(df: DataFrame, column: str, opts: Options = DEFAULTS) -> tuple[list[str], bool] | None:
    """Labels to encode and whether the rest goes to one bucket; None for near-unique columns.

    The labels that reach the driver are at most ``one_hot_full + 1``.
    """
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    top = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(opts.one_hot_full + 1).collect()]
    if len(top) <= opts.one_hot_full:
        return sorted(top), False
    distinct, rows = counts.agg(F.count("*")).first()[0], df.count()
    if distinct / rows > opts.near_unique:
        return None
    return sorted(top[:opts.one_hot_top]), True


def encode_one_hot(df: DataFrame, column: str, opts: Options = DEFAULTS) -> DataFrame:
    """One 0/1 column per label; above ten labels the top eight and ``Other`` (which also takes nulls)."""
    found = one_hot_labels(df, column, opts)
    if found is None:
        return df
    labels, rest = found
    value = quoted(column).cast("string")
    if rest:
        labels = [v for v in labels if v != opts.other_label]
    flags = {f"{column}__{v}": F.coalesce((value == v).cast("int"), F.lit(0)) for v in labels}
    if rest:
        flags[f"{column}__{opts.other_label}"] = F.coalesce((~value.isin(labels)).cast("int"), F.lit(1))
    return _rewrite(df, {}, flags)


# ---- clipping and scaling ----

def clip_bounds(df: DataFrame, columns: list[str], risk: str = "low", skewed: set[str] = frozenset(),
                opts: Options = DEFAULTS) -> dict[str, tuple[float, float, str]]:
    """Bounds per column: percentiles on risky tables or skewed columns, else Tukey fences."""
    limits = {"critical": (0.01, 0.99), "high": (0.05, 0.95)}.get(risk, (0.025, 0.975))
    lo, hi = limits
    n = {r["column"]: r["n"] for r in long_agg(df, {c: {"n": F.count(quoted(c))} for c in columns}).collect()}
    out = {}
    for r in column_quantiles(df, columns, [0.25, 0.75, lo, hi], opts).collect():
        c, (q1, q3, plo, phi) = r["column"], r["q"]
        if n[c] < opts.min_fence_values:
            continue
        if risk in ("critical", "high") or c in skewed:
            bound = (plo, phi, f"percentile_{int(lo * 100)}_{int(hi * 100)}")
        elif q3 == q1:
            continue
        else:
            bound = (q1 - opts.fence * (q3 - q1), q3 + opts.fence * (q3 - q1), "iqr")
        if bound[0] < bound[1]:
            out[c] = bound
    return out


def clip_outliers(df: DataFrame, columns: list[str], risk: str = "low", skewed: set[str] = frozenset(),
                  opts: Options = DEFAULTS) -> DataFrame:
    """Values pulled to the bounds; ``_raw`` keeps the old value, ``_was_clipped`` marks changed rows."""
    new, extra = {}, {}
    for c, (lo, hi, _) in clip_bounds(df, columns, risk, skewed, opts).items():
        v = quoted(c).cast("double")
        new[c] = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))
        if f"{c}_raw" not in df.columns:
            extra[f"{c}_raw"] = quoted(c)
        extra[f"{c}_was_clipped"] = F.coalesce((v < lo) | (v > hi), F.lit(False))
    return _rewrite(df, new, extra)


# The words below are fixed values: names of columns that hold counts.
def is_count_name(name: str) -> bool:
    return whole_word(name, ["count", "counts", "qty", "quantity", "quantities", "units", "num", "number"])


def scale_minmax(df: DataFrame, columns: list[str], overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """``<column>_scaled`` in 0..1 and the parameters ``(column, min, max)``; constant columns are left out."""
    params = long_agg(df, {c: {"min": F.min(quoted(c)).cast("double"), "max": F.max(quoted(c)).cast("double")}
                           for c in columns}).where("min < max")
    ranges = {r["column"]: (r["min"], r["max"]) for r in params.collect()}  # one row per column
    scaled = {c: (quoted(c).cast("double") - lo) / (hi - lo) for c, (lo, hi) in ranges.items()}
    extra = {f"{c}_raw": quoted(c) for c in ranges if f"{c}_raw" not in df.columns}
    extra.update({f"{c}_scaled": e for c, e in scaled.items()})
    return _rewrite(df, scaled if overwrite else {}, extra), params


def unscale_minmax(df: DataFrame, params: DataFrame) -> DataFrame:
    """Original values back into ``<column>`` from ``<column>_scaled``."""
    ranges = {r["column"]: (r["min"], r["max"]) for r in params.collect()}  # one row per column
    return _rewrite(df, {c: quoted(f"{c}_scaled") * (hi - lo) + lo for c, (lo, hi) in ranges.items()})


# ---- dates ----

def date_features(df: DataFrame, columns: list[str]) -> DataFrame:
    extra = {}
    for c in columns:
        d = parse_datetime(quoted(c)) if df.schema[c].dataType.simpleString() == "string" else quoted(c)
        extra.update({
            f"{c}_year": F.year(d), f"{c}_month": F.month(d), f"{c}_quarter": F.quarter(d), f"{c}_day": F.dayofmonth(d),
            f"{c}_day_of_week": F.weekday(d), f"{c}_is_weekend": F.coalesce((F.weekday(d) >= 5).cast("int"), F.lit(0)),
            f"{c}_week_of_year": F.weekofyear(d)})
    return _rewrite(df, {}, extra)


# ---- derived metrics ----

# Whole-word column names per role, when no column carries the role.
METRIC_NAMES = {
    "revenue": ["revenue", "total_sales", "net_sales", "total_amount"],
    "cost": ["cost_price", "cost", "expense", "cogs", "expenditure"],
    "units": ["units_sold", "units", "quantity", "qty", "volume"],
    "price": ["unit_price", "price", "rate", "mrp", "selling_price"],
    "discount": ["discount_amount", "discount", "rebate", "deduction"],
    "budget": ["budget", "target", "planned", "projected"],
    "tax": ["tax_amount", "tax", "vat", "gst", "duty"],
    "shipping": ["shipping", "freight", "delivery_cost", "logistics"],
}


def find_column(columns, words) -> str | None:
    return next((c for c in columns if whole_word(c, words)), None)


def metric_columns(df: DataFrame, roles: dict[str, str] | None = None) -> dict:
    """Which column plays which part: a tagged numeric column first, then its name; at least 80 % numbers.

    One aggregate tells the share of numbers and whether a revenue column varies.
    """
    roles = roles or {}
    numeric = [c for c in df.columns if c in set(numeric_columns(df))]
    stats = {r["column"]: r for r in long_agg(df, {c: {
        "share": F.coalesce(ratio(F.count(quoted(c)), F.count("*")), F.lit(0.0)),
        "varies": F.coalesce(F.min(quoted(c)) < F.max(quoted(c)), F.lit(False))} for c in numeric}).collect()} if numeric else {}
    usable = [c for c in numeric if stats[c]["share"] >= 0.8]
    out = {}
    for role, words in METRIC_NAMES.items():
        tagged = [c for c in usable if roles.get(c) == role and (role != "revenue" or stats[c]["varies"])]
        named = find_column(df.columns, words)
        out[role] = tagged[0] if tagged else (named if named in usable else None)
    plain = {re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in df.columns}
    out["order_date"], out["ship_date"] = plain.get("order_date"), plain.get("ship_date")
    out["spend"] = [c for c in usable if roles.get(c) == "spend"]
    return out


def derive_metrics(df: DataFrame, roles: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """``derived_*`` columns and, for each, the columns it comes from. Zero divisors give null."""
    m = metric_columns(df, roles)
    made, sources = {}, {}

    def col(role):
        return quoted(m[role]).cast("double")

    def add(name, expr, *used):
        made[f"derived_{name}"], sources[f"derived_{name}"] = expr, list(used)

    if m["revenue"] and m["cost"]:
        profit = col("revenue") - col("cost")
        add("profit", profit, m["revenue"], m["cost"])
        add("profit_margin_pct", ratio(profit, col("revenue")) * 100, "derived_profit", m["revenue"])
    if m["revenue"] and m["units"]:
        add("revenue_per_unit", ratio(col("revenue"), col("units")), m["revenue"], m["units"])
    if m["order_date"] and m["ship_date"]:
        def seconds(c):
            d = parse_datetime(quoted(c)) if df.schema[c].dataType.simpleString() == "string" else quoted(c)
            # Wall-clock seconds: no time zone and no daylight saving in a number of days.
            days = F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date"))
            return days * 86400.0 + F.hour(d) * 3600 + F.minute(d) * 60 + F.extract(F.lit("SECOND"), d).cast("double")
        add("days_to_ship", (seconds(m["ship_date"]) - seconds(m["order_date"])) / 86400, m["order_date"], m["ship_date"])
    if not m["revenue"] and m["price"] and m["units"]:
        add("total_revenue", col("price") * col("units"), m["price"], m["units"])
    if m["revenue"] and m["discount"]:
        add("revenue_after_discount", col("revenue") - col("discount"), m["revenue"], m["discount"])
        add("discount_pct", ratio(col("discount"), col("revenue")) * 100, m["discount"], m["revenue"])
    if m["revenue"] and m["budget"]:
        variance = col("revenue") - col("budget")
        add("budget_variance", variance, m["revenue"], m["budget"])
        add("budget_variance_pct", ratio(variance, col("budget")) * 100, "derived_budget_variance", m["budget"])
    if m["cost"] and m["tax"] and m["shipping"]:
        add("total_cost", col("cost") + col("tax") + col("shipping"), m["cost"], m["tax"], m["shipping"])
    elif m["cost"] and m["tax"]:
        add("total_cost_with_tax", col("cost") + col("tax"), m["cost"], m["tax"])
    if not m["revenue"] and len(m["spend"]) >= 2:
        add("total_spend", sum((F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in m["spend"]), F.lit(0.0)), *m["spend"])
    return _rewrite(df, {}, made), sources


def derivation_table(spark, sources: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(d, s) for d, used in sources.items() for s in used], "derived string, source string")
