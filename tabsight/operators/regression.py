"""Iterative imputation by Bayesian ridge regressions.

The models are linear, so a row's filled values follow from its known values and the models so far. Each model needs one scan: tasks replay the earlier
models on their rows and sum products, and one small matrix of columns by columns comes back (``distributed_rounds``).

A row's pattern of missing columns never changes, and where few patterns occur a filled value is an affine function of the known values that depends on the
pattern alone. Then one scan collects the sums of products per pattern, and all rounds run on those small matrices (``fit``). Both ways compute the same models.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.moments import batch_matrix
from ..functions.numbers import numeric_columns
from ..functions.quantiles import column_quantiles
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options


MOST_PATTERNS = 256  # patterns up to which their matrices come to the driver


def bayesian_ridge(n: float, gram: np.ndarray, xty: np.ndarray, yty: float, rounds: int = 300, tol: float = 1e-3):
    """Weights from centred moments by evidence maximisation (MacKay 1992, Tipping 2001)."""
    prior = 1e-6
    values, vectors = np.linalg.eigh(gram)
    values = np.clip(values, 0.0, None)
    solid = values > 1e-12 * values.max(initial=0.0)  # columns that repeat others leave directions of nothing but rounding
    turned = np.where(solid, vectors.T @ xty, 0.0)
    noise, weight = 1.0 / (yty / n + np.finfo(float).eps), 1.0
    last = None

    def solve():
        return vectors @ np.where(solid, turned / (values + weight / noise), 0.0)

    for _ in range(rounds):
        w = solve()
        error = max(yty - 2 * w @ xty + w @ gram @ w, 1e-14 * yty)  # less is rounding: an exact relation has no noise
        used = float(np.sum(noise * values / (weight + noise * values)))
        weight = (used + 2 * prior) / (float(w @ w) + 2 * prior)
        noise = (n - used + 2 * prior) / (error + 2 * prior)
        if last is not None and np.abs(last - w).sum() < tol:
            break
        last = w
    return solve()


def pattern_moments(df: DataFrame, features: list[str], centre: dict[str, float]) -> dict[str, np.ndarray]:
    """Per pattern ('1' = known) the matrix of sums of products of (1, known values), missing ones as 0."""
    x = [F.lit(1.0)] + [F.coalesce(quoted(c).cast("double") - centre[c], F.lit(0.0)) for c in features]
    pattern = F.concat(*[F.when(quoted(c).isNull(), "0").otherwise("1") for c in features])
    size = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(size) for j in range(i, size)]
    rows = df.groupBy(pattern.alias("_p")).agg(F.array(*sums).alias("_s")).collect()  # one row per pattern
    out = {}
    upper = np.triu_indices(size)
    for r in rows:
        m = np.zeros((size, size))
        m[upper] = r["_s"]
        out[r["_p"]] = m + np.triu(m, 1).T
    return out


def fit(moments: dict[str, np.ndarray], start: np.ndarray, reach: np.ndarray, rounds: int, tol: float = 1e-3):
    """Per pattern the matrix that maps (1, known values) to all values.

    ``start`` are the first fills, ``reach`` the largest absolute value per column; both centred.
    """
    p = len(start)
    maps = {}
    for pattern in moments:
        a = np.zeros((p, p + 1))
        for j in range(p):
            if pattern[j] == "1":
                a[j, j + 1] = 1.0
            else:
                a[j, 0] = start[j]
        maps[pattern] = a
    total = sum(m[0, 0] for m in moments.values())
    known = np.array([sum(m[0, 0] for q, m in moments.items() if q[j] == "1") for j in range(p)])
    order = [j for j in np.argsort(total - known, kind="stable") if 0 < known[j] < total]
    def gram(j):
        full = np.zeros((p + 1, p + 1))
        for pattern, m in moments.items():
            if pattern[j] == "1":
                lift = np.vstack([np.eye(1, p + 1), maps[pattern]])
                full += lift @ m @ lift.T
        return full

    def learnt(j, w, shift):
        others = [i for i in range(p) if i != j]
        for pattern, a in maps.items():
            if pattern[j] == "0":
                new = w[others] @ a[others]
                new[0] += shift
                a[j] = new

    _rounds(order, gram, learnt, reach, rounds, tol)
    return maps


def _rounds(order: list[int], gram, learnt, reach: np.ndarray, rounds: int, tol: float) -> None:
    """The rounds themselves: a model per column from ``gram(j)``, the sums of products of (1, all values) over the rows that know column j; ``learnt`` takes it.
    They end when no model's fills can move by more than ``tol`` of the largest value."""
    p, models = len(reach), {}
    limit = tol * (reach.max() if p else 0.0)
    for _ in range(rounds):
        moved = 0.0
        for j in order:
            others = [i for i in range(p) if i != j]
            full = gram(j)
            n = full[0, 0]
            mean = full[0, 1:] / n
            centred = full[1:, 1:] - n * np.outer(mean, mean)
            w = np.zeros(p)
            w[others] = bayesian_ridge(n, centred[np.ix_(others, others)], centred[others, j], centred[j, j])
            shift = mean[j] - mean @ w
            last = models.get(j)
            moved = max(moved, np.inf if last is None else abs(shift - last[1]) + np.abs(w - last[0]) @ reach)
            models[j] = (w, shift)
            learnt(j, w, shift)
        if moved < limit:
            break


def replay(x: np.ndarray, start: np.ndarray, updates: list[tuple[int, np.ndarray, float]]) -> np.ndarray:
    """Centred rows with NaN filled by the first fills and then, in order, by all models."""
    hole = np.isnan(x)
    out = np.where(hole, start, x)
    rows = [np.flatnonzero(hole[:, j]) for j in range(x.shape[1])]
    for j, w, shift in updates:
        out[rows[j], j] = out[rows[j]] @ w + shift
    return out


def distributed_rounds(source: DataFrame, features: list[str], centre: np.ndarray, start: np.ndarray, reach: np.ndarray, known: np.ndarray, total: int,
                       rounds: int, tol: float = 1e-3) -> list[tuple[int, np.ndarray, float]]:
    """All models in order, each from one scan of the features. Any number of patterns: nothing is kept per pattern."""
    p, updates = len(features), []
    rows = source.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def gram(j):
        before = list(updates)

        def sums(batches):
            full = np.zeros((p + 1, p + 1))
            for batch in batches:
                x = batch_matrix(batch) - centre
                x = replay(x[~np.isnan(x[:, j])], start, before)
                x = np.column_stack([np.ones(len(x)), x])
                full += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(range(full.size), pa.int32()), pa.array(full.ravel())], ["at", "sum"])

        parts = rows.where(F.col(f"x{j}").isNotNull()).mapInArrow(sums, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
        full = np.zeros((p + 1) ** 2)
        full[[r["at"] for r in parts]] = [r["sum"] for r in parts]
        return full.reshape(p + 1, p + 1)

    order = [j for j in np.argsort(total - known, kind="stable") if 0 < known[j] < total]
    _rounds(order, gram, lambda j, w, shift: updates.append((j, w, shift)), reach, rounds, tol)
    return updates


def impute_iterative(df: DataFrame, columns: list[str], features: list[str] | None = None, opts: Options = DEFAULTS,
                     source: DataFrame | None = None) -> DataFrame:
    """Fills ``columns`` of ``df`` from models over ``features`` learned on ``source`` (default: the same table)."""
    source = df if source is None else source
    features = features or numeric_columns(source)
    if len(features) < 2:
        return df
    stats = {r["column"]: r for r in long_agg(source, {c: {
        "mean": F.coalesce(F.avg(quoted(c)), F.lit(0.0)), "lo": F.min(quoted(c)).cast("double"),
        "hi": F.max(quoted(c)).cast("double"), "known": F.count(quoted(c)), "total": F.count("*")} for c in features}).collect()}
    centre = {c: stats[c]["mean"] for c in features}
    medians = {r["column"]: r["q"][0] for r in column_quantiles(source, features, [0.5], opts).collect()}
    start = np.array([medians.get(c, 0.0) - centre[c] for c in features])
    reach = np.array([max(abs((stats[c]["lo"] or 0.0) - centre[c]), abs((stats[c]["hi"] or 0.0) - centre[c])) for c in features])
    todo = [c for c in columns if c in features]
    pattern = F.concat(*[F.when(quoted(c).isNull(), "0").otherwise("1") for c in features])
    if source.select(pattern.alias("_p")).distinct().limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        middle = np.array([centre[c] for c in features])
        updates = distributed_rounds(source, features, middle, start, reach, np.array([stats[c]["known"] for c in features]), stats[features[0]]["total"], opts.iterative_rounds)
        places = [features.index(c) for c in todo]

        @F.pandas_udf("array<double>")
        def fills(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype=float) for v in values]) - middle
            return pd.Series(list((replay(x, start, updates) + middle)[:, places]))

        filled = df.withColumn("_fills", fills(*[quoted(c).cast("double") for c in features]))
        return filled.select(*[F.coalesce(quoted(c).cast("double"), F.col("_fills")[todo.index(c)]).alias(c) if c in todo else quoted(c) for c in df.columns])
    maps = fit(pattern_moments(source, features, centre), start, reach, opts.iterative_rounds)
    index = {c: j for j, c in enumerate(features)}
    rows = [(p, [a[j].tolist() for j in range(len(features))]) for p, a in maps.items() if "0" in p]
    table = df.sparkSession.createDataFrame(rows or [("", [[0.0]])], "_p string, _a array<array<double>>")
    keyed = df.withColumn("_p", pattern).join(table, "_p", "left")
    known = [F.coalesce(quoted(c).cast("double") - centre[c], F.lit(0.0)) for c in features]

    def value(c):
        row = F.col("_a")[index[c]]
        out = row[0] + F.lit(centre[c])
        for i, k in enumerate(known):
            out = out + row[i + 1] * k
        return F.coalesce(quoted(c).cast("double"), out)

    return keyed.select(*[value(c).alias(c) if c in todo else quoted(c) for c in df.columns])
