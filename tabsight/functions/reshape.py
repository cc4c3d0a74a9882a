"""One-row aggregates to long form, and first values per column."""

from pyspark.sql import Column, DataFrame, functions as F

from .text import quoted


def long_agg(df: DataFrame, metrics: dict[str, dict[str, Column]], name: str = "column") -> DataFrame:
    """One scan computes ``{row label: {metric: aggregate}}``; the result has one row per label."""
    labels = list(metrics)
    if not labels:
        raise ValueError("nothing to aggregate")
    names = list(metrics[labels[0]])
    wide = df.agg(*[metrics[r][m].alias(f"{i}_{m}") for i, r in enumerate(labels) for m in names])
    rows = F.array(*[F.struct(F.lit(r).alias(name), *[F.col(f"{i}_{m}").alias(m) for m in names])
                     for i, r in enumerate(labels)])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def text_cells(df: DataFrame, columns, keys=(), keep_null: bool = True) -> DataFrame:
    """``(keys…, column, value)`` with every value as text."""
    if not columns:
        nothing = F.lit(None).cast("string")
        return df.limit(0).select(*[quoted(k) for k in keys], nothing.alias("column"), nothing.alias("value"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])
    if not keep_null:
        cells = F.filter(cells, lambda x: x["value"].isNotNull())
    return df.select(*[quoted(k) for k in keys], F.explode(cells).alias("_c")).select(*[quoted(k) for k in keys], "_c.*")


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """``(column, value, n)``: the one table behind distinct counts, modes and distributions.

    Counts are combined before the shuffle, so a value that fills a third of all rows costs one row per task.
    """
    return text_cells(df, columns or df.columns).groupBy("column", "value").agg(F.count("*").alias("n"))


HEAD_ROWS = 20


def first_values(df: DataFrame, columns, n: int, order_by=None) -> dict[str, list[str]]:
    """The first n non-null values of each column, as text, in row order (ties and no order: by all columns).

    The first rows are a top-k without a sort and serve most columns; a column that is mostly null there gets its own.
    """
    order_by = list(order_by or [])
    order = [quoted(c) for c in order_by + [c for c in df.columns if c not in order_by]]
    cells = [quoted(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
    head = df.orderBy(*order).limit(HEAD_ROWS).select(*cells).collect()
    out = {}
    for i, c in enumerate(columns):
        values = [r[i] for r in head if r[i] is not None][:n]
        if len(values) < n and len(head) == HEAD_ROWS:
            values = [r[0] for r in df.where(quoted(c).isNotNull()).orderBy(*order).limit(n).select(cells[i]).collect()]
        out[c] = values
    return out
