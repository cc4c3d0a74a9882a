"""Correlation tables, strong pairs, leakage and formula pairs."""

import re
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.distinct import unique_columns
from ..functions.lineage import written
from ..functions.moments import BLOCK, all_pair_sums, correlations, pair_sums
from ..functions.numbers import string_columns
from ..functions.ranks import twice_ranks
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options
from .selection import DATE_PART_SUFFIXES


def measures(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.endswith(DATE_PART_SUFFIXES)]


WIDE = 24  # columns from which pairs are summed by matrix products in Python tasks; fewer are one JVM aggregate


def complete_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col1, col2, r)`` over a table without nulls. Few columns: one covariance per pair and one deviation per column in one aggregate, of which one number per
    pair comes to the driver. Many: sums of products in blocks of columns, and the pairs stay a table."""
    if len(columns) > WIDE:
        return correlations(all_pair_sums(df, columns), columns, 3)
    pairs = list(combinations(range(len(columns)), 2))
    x = [quoted(c).cast("double") for c in columns]
    row = df.agg(F.count("*").alias("n"), *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(x)],
                 *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    rows = []
    for i, j in pairs if row["n"] >= 3 else []:
        scale = row[f"s{i}"] * row[f"s{j}"]
        rows.append((columns[i], columns[j], row[f"c{i}_{j}"] / scale if scale else None))
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, r double")


def corr_pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col1, col2, r)`` over rows complete in all columns; empty below three such rows."""
    columns = measures(columns)
    complete = df.select(*[quoted(c) for c in columns]).dropna()
    return complete_correlations(complete, columns)


def corr_spearman(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Pearson r of average ranks over rows complete in all columns; empty below three such rows.

    One sort of all cells ranks all columns; the ranks go back to their rows in one shuffle, and products of ranks are summed per pair of columns.
    """
    columns = measures(columns)
    p = len(columns)
    complete = df.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    rows = written(complete.select(F.monotonically_increasing_id().alias("row"), "*"), "spearman")
    n = rows.count()
    if n < 3 or p < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, r double")
    cells = twice_ranks(rows, p, n, opts.rank_cells)
    by_row = cells.repartition("row").sortWithinPartitions("row", "i").select("rank2")

    def matrices(batches):
        """Whole rows of p ranks around their mean."""
        rest = np.zeros(0)
        for batch in batches:
            flat = np.concatenate((rest, batch.column(0).to_numpy().astype(np.float64) - (n + 1)))
            whole = len(flat) // p * p
            rest = flat[whole:]
            yield flat[:whole].reshape(-1, p)

    blocks = [list(range(a, min(a + BLOCK, p))) for a in range(0, p, BLOCK)]
    parts = []
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            both = left if left is right else left + right
            parts.append(pair_sums(by_row, left, right, lambda batches, both=both: (m[:, both] for m in matrices(batches))))
    return correlations(reduce(lambda a, b: a.unionAll(b), parts), columns, 3)


def strong_pairs(pairs: DataFrame, formulaic: DataFrame, leakage: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Pairs with \\|r\\| >= 0.5 and whether they are findings, formulas, or excluded for a suspicious column."""
    big = pairs.withColumn("r", F.round("r", 4)).where(F.abs("r") >= opts.report_r)
    bad = leakage.select(F.col("column").alias("_bad")).distinct()
    known = formulaic.select("col1", "col2").withColumn("_formula", F.lit(True))
    out = big.join(known, ["col1", "col2"], "left")
    out = out.join(bad, F.col("col1") == F.col("_bad"), "left").withColumnRenamed("_bad", "_b1")
    out = out.join(bad, F.col("col2") == F.col("_bad"), "left")
    kind = (F.when(F.col("_formula"), "formulaic").when(F.col("_b1").isNotNull() | F.col("_bad").isNotNull(), "excluded")
            .otherwise("strong"))
    return out.select("col1", "col2", F.col("r").alias("pearson_r"), F.when(F.col("r") > 0, "positive").otherwise("negative")
                      .alias("direction"), F.when(F.abs("r") >= opts.strong_r, "strong").otherwise("moderate").alias("strength"),
                      kind.alias("kind"))


# Name parts of model outputs and technical keys; the first two count only as whole words.
LEAK_WORDS = ["id", "index"]
LEAK_PARTS = ["classifier", "naive_bayes", "_score", "_proba", "predicted_", "clientnum", "customerid", "_uuid"]


def leaky_name(name: str) -> bool:
    words = re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    return bool(set(words) & set(LEAK_WORDS)) or any(p in name.lower() for p in LEAK_PARTS)


def leakage_columns(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(column, reason)``: by name, by one near-perfect partner and otherwise none, or by being unique."""
    spark = df.sparkSession
    named = spark.createDataFrame([(c, "name") for c in df.columns if leaky_name(c)], "column string, reason string")
    both = pairs.select(F.col("col1").alias("column"), "r").unionAll(pairs.select(F.col("col2").alias("column"), "r"))
    partner = both.groupBy("column").agg(
        F.count_if(F.abs("r") > 0.98).alias("_one"), F.count_if(F.abs("r") < 0.1).alias("_zero"), F.count("*").alias("_all"))
    # With two numeric columns a perfect pair says nothing, so three are needed.
    twins = partner.where("_one = 1 and _zero >= _all - 2 and _all >= 2").select("column", F.lit("twin").alias("reason"))
    keys = string_columns(df) + [f.name for f in df.schema if f.dataType.simpleString() == "bigint"]
    out = named.unionAll(twins)
    unique = unique_columns(df, keys)
    return out.unionAll(spark.createDataFrame([(c, "unique") for c in unique], "column string, reason string")) if unique else out


def formulaic_pairs(df: DataFrame, columns: list[str], sources: dict[str, list[str]]) -> DataFrame:
    """Pairs tied by a formula: a known derivation, or a derived column equal to another one in every row."""
    columns = measures(columns)
    pairs = list(combinations(columns, 2))
    known = [(a, b, "derivation") for a, b in pairs if b in sources.get(a, []) or a in sources.get(b, [])]
    maybe = [(a, b) for a, b in pairs if (a, b, "derivation") not in known and (sources.get(a) or sources.get(b))
             and (a.startswith("derived_") or b.startswith("derived_"))]
    spark = df.sparkSession
    out = spark.createDataFrame(known, "col1 string, col2 string, reason string")
    if not maybe:
        return out
    complete = df.select(*[quoted(c).cast("double").alias(c) for c in columns]).dropna()
    close = long_agg(complete, {f"{i}": {
        "same": F.bool_and(F.abs(quoted(a) - quoted(b)) <= 1e-9 + 1e-9 * F.abs(quoted(b))), "n": F.count("*")}
        for i, (a, b) in enumerate(maybe)}, "_i").where("same and n >= 3")
    names = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2")) for a, b in maybe])
    return out.unionAll(close.select(names[F.col("_i").cast("int")].alias("_p")).select("_p.*", F.lit("equal").alias("reason")))
