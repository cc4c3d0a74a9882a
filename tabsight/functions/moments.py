"""Sums of products of many column pairs by matrix products inside tasks, so that a plan doesn't grow with the square of the columns."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import quoted

BLOCK = 512  # columns of a block; a task holds the sums of two blocks
FLAT = 1e-12  # a variance below this part of the sum of squares is rounding

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def batch_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch of double columns; null is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_columns else np.zeros((batch.num_rows, 0))


def pair_sums(rows: DataFrame, left: list[int], right: list[int], matrices=None) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) over the rows that have both columns, for i of ``left`` and j > i of ``right``.

    ``rows`` has a double column for each of ``left`` and then of ``right`` (once if they are the same); ``matrices`` turns batches into such rows instead. Each task
    passes on one row per pair, and the sums are combined before the shuffle.
    """
    both = left != right
    at = len(left) if both else 0

    def sums(batches):
        total = np.zeros((6, len(left), len(right)))
        for x in map(batch_matrix, batches) if matrices is None else matrices(batches):
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            m = known.astype(np.float64)
            a, b, ma, mb = x[:, :len(left)], x[:, at:], m[:, :len(left)], m[:, at:]
            total += [ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b]
        i, j = np.nonzero(np.array(left)[:, None] < np.array(right)[None])
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(left)[i], pa.int32()), pa.array(np.array(right)[j], pa.int32()), *[pa.array(t[i, j]) for t in total]],
                                             ["i", "j", *SUMS])

    parts = rows.mapInArrow(sums, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def all_pair_sums(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """``pair_sums`` of all pairs, block by block: each scan reads the columns of two blocks. Values are taken from the least of their column, which keeps
    sums small and those of a constant column zero."""
    low = df.agg(*[F.min(quoted(c)).cast("double").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    cells = [(quoted(c).cast("double") - F.lit(low[f"m{i}"] or 0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    blocks = [list(range(a, min(a + block, len(columns)))) for a in range(0, len(columns), block)]
    parts = []
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            parts.append(pair_sums(df.select(*[cells[i] for i in (left if left is right else left + right)]), left, right))
    return reduce(lambda a, b: a.unionAll(b), parts)


def correlations(sums: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """``(col1, col2, r)`` of ``pair_sums``; null for a side that doesn't vary, and pairs of fewer than ``least`` rows are left out."""
    names = F.array(*[F.lit(c) for c in columns])
    vx, vy = (F.col(f"s{s}{s}") - F.col(f"s{s}") * F.col(f"s{s}") / F.col("n") for s in "xy")
    both = F.sqrt(vx) * F.sqrt(vy)
    varies = (vx > FLAT * F.col("sxx")) & (vy > FLAT * F.col("syy"))
    r = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / both)))
    return sums.where(F.col("n") >= least).select(names[F.col("i")].alias("col1"), names[F.col("j")].alias("col2"), r.alias("r"))


def power_sums(df: DataFrame, columns: list[str], middle: list[float], width: list[float], pairs: bool = True) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, s3, s4): sums of products of columns i < j over the rows that have both, and for i = j of the powers of one column, of the values
    less their column's ``middle`` in parts of its ``width``. One scan; a task passes on one row per pair. The columns must hold no NaN or infinity."""
    cells = [((quoted(c).cast("double") - F.lit(m)) / F.lit(w)).alias(f"x{i}") for i, (c, m, w) in enumerate(zip(columns, middle, width))]
    k = len(columns)
    i, j = np.triu_indices(k) if pairs else (np.arange(k), np.arange(k))

    def sums(batches):
        total, high = np.zeros((6, k, k)), np.zeros((2, k, k))
        for x in map(batch_matrix, batches):
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            m, square = known.astype(np.float64), x * x
            if pairs:
                total += [m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x]
            else:
                of_one = [m.sum(axis=0), x.sum(axis=0), x.sum(axis=0), *[square.sum(axis=0)] * 3]
                total += [np.diag(s) for s in of_one]
            high += [np.diag((square * x).sum(axis=0)), np.diag((square * square).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in (*total, *high)]], ["i", "j", *POWERS])

    parts = df.select(*cells).mapInArrow(sums, "i int, j int, " + ", ".join(f"{s} double" for s in POWERS))
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in POWERS])


POWERS = [*SUMS, "s3", "s4"]


def shape_of(n: float, s1: float, s2: float, s3: float, s4: float) -> tuple[float | None, float | None]:
    """Population skewness and excess kurtosis from sums of powers; null for values that don't vary."""
    if not n:
        return None, None
    mean, square = s1 / n, s2 / n
    m2 = square - mean * mean
    if m2 <= FLAT * square:
        return None, None
    m3 = s3 / n - 3 * mean * square + 2 * mean ** 3
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * square - 3 * mean ** 4
    return m3 / m2 ** 1.5, m4 / (m2 * m2) - 3
