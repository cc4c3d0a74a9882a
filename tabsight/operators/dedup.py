"""Duplicates and row guards."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.fingerprint import row_hash
from ..functions.partitions import parts_for
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options
from .cleaning import canonical_text

# Key columns used when none is tagged as identifier.
KEY_NAMES = ["transaction_id", "order_id", "invoice_id", "customer_id", "id"]


def distinct_rows(df: DataFrame) -> DataFrame:
    """Equal rows once. A task keeps its different rows in memory, so a table larger than the session's partitions are meant for is dealt by row hash into as many
    tasks as its size asks; the hash is one of the grouping columns and decides nothing."""
    parts = parts_for(df)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) or any("map<" in t or "variant" in t for _, t in df.dtypes):
        return df.dropDuplicates()
    name = "_row_hash"
    while name in df.columns:
        name += "_"
    return df.select("*", row_hash(df.columns).alias(name)).repartition(parts, name).dropDuplicates().select(*[quoted(c) for c in df.columns])


def dedup_exact(df: DataFrame, expected_duplicates: int | None = None) -> DataFrame:
    """Equal rows once; with ``expected_duplicates`` the number removed is checked first."""
    out = distinct_rows(df)
    if expected_duplicates is not None:
        removed = df.count() - out.count()
        if removed != expected_duplicates:
            raise ValueError(f"expected {expected_duplicates} duplicate rows, found {removed}")
    return out


def dedup_canonical(df: DataFrame, text_columns: list[str]) -> DataFrame:
    return distinct_rows(canonical_text(df, text_columns))


def business_keys(columns: list[str], identifiers: list[str]) -> list[str]:
    keys = [c for c in identifiers if c in columns]
    return keys or [c for c in KEY_NAMES if c in columns]


def dedup_by_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """First row per key in the given order.

    The minimum is combined inside every task first, so a key that fills a third of the table is no hot spot.
    """
    row = F.struct(*[quoted(c) for c in df.columns])
    first = df.groupBy(*[quoted(k) for k in keys]).agg(F.min_by(row, F.struct(*[quoted(c) for c in order_by])).alias("_row"))
    return first.select("_row.*")


def duplicate_samples(df: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent duplicated rows as text. Rows are compared by their cells, so a null and the text ``null`` stay apart; only the text shows them alike."""
    cells = [quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    groups = df.select(*cells).groupBy(*[f"c{i}" for i in range(len(cells))]).agg(F.count("*").alias("n")).where("n > 1")
    signature = F.concat_ws("|", *[F.coalesce(F.col(f"c{i}").cast("string"), F.lit("null")) for i in range(len(cells))])
    return groups.select(signature.alias("signature"), "n").orderBy(F.desc("n"), "signature").limit(limit)


def _sizes(**frames: DataFrame) -> DataFrame:
    """One row with the row count of every frame."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b), counts)  # one row each


def row_survival(before: DataFrame, after: DataFrame, step: str, opts: Options = DEFAULTS) -> DataFrame:
    b, a = F.col("rows_before"), F.col("rows_after")
    return _sizes(rows_before=before, rows_after=after).select(
        F.lit(step).alias("step"), b, a, F.coalesce(F.round(F.try_divide(a * 100.0, b), 2), F.lit(100.0)).alias("survival_pct"),
        (a >= b * opts.survival_share).alias("survives"))


def assert_survival(before_rows: int, after_rows: int, step: str, opts: Options = DEFAULTS) -> None:
    if after_rows < before_rows * opts.survival_share:
        raise ValueError(f"{step}: {after_rows} of {before_rows} rows left, below {opts.survival_share:.0%}")


def null_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns of both tables whose number of nulls changed."""
    shared = [c for c in before.columns if c in after.columns]

    def nulls(df, name):
        return long_agg(df, {c: {name: F.count("*") - F.count(quoted(c))} for c in shared})

    return nulls(before, "nulls_before").join(nulls(after, "nulls_after"), "column").where(
        "nulls_before <> nulls_after").withColumn("change", F.col("nulls_after") - F.col("nulls_before"))


def row_accounting(raw: DataFrame, exact: DataFrame, canonical: DataFrame, final: DataFrame) -> DataFrame:
    return _sizes(input_rows=raw, _e=exact, _c=canonical, final_rows=final).select(
        "input_rows", (F.col("input_rows") - F.col("_e")).alias("exact_duplicates_removed"),
        (F.col("_e") - F.col("_c")).alias("canonical_duplicates_removed"),
        (F.col("_c") - F.col("final_rows")).alias("imputation_drops"), "final_rows")
