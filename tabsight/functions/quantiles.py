"""Exact quantiles that never gather a group in one task.

Small inputs use Spark's ``percentile``. Larger ones are found by repeated histograms: every pass is one scan with a
map-side combined count per (key, bin), and narrows each wanted rank to one bin bounded by real data values.
"""

import math

from pyspark.sql import DataFrame, functions as F, types as T

from ..options import DEFAULTS, Options
from .partitions import held
from .text import quoted

COLLECT_VALUES = 50_000


def melt(df: DataFrame, columns, keys=(), name: str = "column", value: str = "value") -> DataFrame:
    """Numeric columns to long form, nulls dropped; no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), quoted(c).cast("double").alias(value)) for c in columns])
    return (df.select(*[quoted(k) for k in keys], F.explode(pairs).alias("_p"))
            .select(*[quoted(k) for k in keys], f"_p.{name}", f"_p.{value}")
            .where(F.col(value).isNotNull()))


def exact_quantiles(long: DataFrame, keys: list[str], value: str, probs: list[float],
                    opts: Options = DEFAULTS, bins: int = 512, rows: int | None = None) -> DataFrame:
    """One row per key with ``q``, the array of linear-interpolated quantiles.

    A key with few rows is a plain ``percentile`` over its group. Keys with more rows than that are few (at most the
    table size over the limit), so their histograms and the driver's part of the search stay small, however many keys
    there are. ``rows`` is an upper bound on the input size when the caller knows one.
    """
    clean = long.where(quoted(value).isNotNull())
    wanted = F.array(*[F.lit(float(p)) for p in probs])

    def direct(df):
        return df.groupBy(*keys).agg(F.percentile(quoted(value), wanted).alias("q"))

    if rows is None:
        rows = clean.count()
    if rows <= opts.in_memory_rows:
        return direct(clean)
    big = clean.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > opts.in_memory_rows).select(*keys).collect()
    if not big:
        return direct(clean)
    table = clean.sparkSession.createDataFrame([tuple(r) for r in big], T.StructType([
        T.StructField("_k_" + k, clean.schema[k].dataType) for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & quoted(k).eqNullSafe(quoted("_k_" + k))
    # One row per big key: at most rows / in_memory_rows of them.
    large = clean.join(F.broadcast(table), same, "left_semi")
    small = clean.join(F.broadcast(table), same, "left_anti")
    return _refine(large, keys, value, probs, bins).unionByName(direct(small))


def _refine(clean, keys, value, probs, bins):
    spark, v = clean.sparkSession, quoted(value)
    base = clean.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")).collect()
    found, open_brackets, inside = {}, {}, {}
    for i, r in enumerate(base):
        wanted = {f(p * (r["_n"] - 1)) for p in probs for f in (math.floor, math.ceil)}
        open_brackets[(i, r["_lo"], r["_hi"], 0)] = wanted
        inside[(i, r["_lo"], r["_hi"], 0)] = r["_n"]
    key_fields = [clean.schema[k] for k in keys]
    schema = T.StructType([T.StructField("_k_" + f.name, f.dataType) for f in key_fields] + [
        T.StructField("_b", T.IntegerType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])
    while True:
        for (i, lo, hi, below), ranks in list(open_brackets.items()):
            if lo == hi:
                found.update({(i, k): lo for k in ranks})
                del open_brackets[(i, lo, hi, below)]
        if not open_brackets:
            break
        order = list(open_brackets)
        last = sum(inside[b] for b in order) <= COLLECT_VALUES
        table = spark.createDataFrame(
            [tuple(base[i][k] for k in keys) + (b, float(lo), float(hi)) for b, (i, lo, hi, _) in enumerate(order)], schema)
        on = (v.cast("double") >= F.col("_lo")) & (v.cast("double") <= F.col("_hi"))
        for k in keys:
            on = on & quoted(k).eqNullSafe(quoted("_k_" + k))
        share = (v.cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        if last:  # few values are left inside the brackets: fetch and count them out
            rest = {}
            for r in clean.join(F.broadcast(table), on).groupBy("_b", v.cast("double").alias("x")).agg(F.count("*").alias("n")).collect():
                rest.setdefault(r["_b"], []).append((r["x"], r["n"]))
            for b, key in enumerate(order):
                seen = key[3]
                for x, n in sorted(rest[b]):
                    found.update({(key[0], k): x for k in open_brackets[key] if seen <= k < seen + n})
                    seen += n
            break
        # The bracket table has at most two rows per wanted quantile and key, so broadcasting it is bounded.
        counts = (clean.join(F.broadcast(table), on)
                  .groupBy("_b", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin"))
                  .agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect())
        by_bracket = {}
        for r in counts:
            by_bracket.setdefault(r["_b"], []).append(r)
        fresh = {}
        for b, key in enumerate(order):
            i, _, _, seen = key
            ranks = sorted(open_brackets[key])
            for r in sorted(by_bracket[b], key=lambda r: r["_bin"]):
                here = {k for k in ranks if seen <= k < seen + r["n"]}
                if here:
                    fresh.setdefault((i, r["lo"], r["hi"], seen), set()).update(here)
                    inside[(i, r["lo"], r["hi"], seen)] = r["n"]
                seen += r["n"]
        open_brackets = fresh
    rows = []
    for i, r in enumerate(base):
        q = []
        for p in probs:
            h = p * (r["_n"] - 1)
            a, b = found[(i, math.floor(h))], found[(i, math.ceil(h))]
            q.append(float(a) + (h - math.floor(h)) * (float(b) - float(a)))
        rows.append(tuple(r[k] for k in keys) + (q,))
    return spark.createDataFrame(rows, T.StructType(key_fields + [T.StructField("q", T.ArrayType(T.DoubleType()))]))


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], opts: Options = DEFAULTS,
                     rows: int | None = None) -> DataFrame:
    """``(column, q)`` for numeric columns of one table.

    On larger tables a sample guesses a narrow bracket for every quantile, one plain aggregate over all columns counts what
    lies below and inside, and only values inside the brackets are looked at again. A wrong guess costs another pass.
    """
    narrow = df.select(*[quoted(c) for c in columns])
    with held(narrow):
        rows = narrow.count() if rows is None else rows
        if rows * len(columns) > opts.in_memory_rows and rows > opts.in_memory_rows // 10:
            return _by_brackets(narrow, columns, probs, rows)
    return exact_quantiles(melt(df, columns), ["column"], "value", probs, opts, rows=rows)


SAMPLE_ROWS = 20_000


def _by_brackets(df, columns, probs, rows):
    spark = df.sparkSession
    v = [quoted(c).cast("double") for c in columns]
    # Six standard errors of a sample rank; the guess is checked below, so the sample never decides a result.
    margin = 6 * 0.5 / math.sqrt(SAMPLE_ROWS)
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + s))) for p in probs for s in (-margin, margin)])
    guess = df.sample(fraction=min(1.0, SAMPLE_ROWS / rows), seed=3).agg(
        *[F.percentile(x, edges).alias(f"g{i}") for i, x in enumerate(v)]).first()
    spans = {}
    for i in range(len(columns)):
        g = guess[i] or [0.0] * (2 * len(probs))
        for j in range(len(probs)):
            spans[(i, j)] = (g[2 * j], g[2 * j + 1])

    def inside(x, lo, hi):
        return (x >= F.lit(lo)) & (x <= F.lit(hi))

    seen = df.agg(
        *[e for i, x in enumerate(v) for e in (F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"))],
        *[e for (i, j), (lo, hi) in spans.items() for e in (
            F.count_if(v[i] < F.lit(lo)).alias(f"b{i}_{j}"), F.count_if(inside(v[i], lo, hi)).alias(f"m{i}_{j}"))]).first()
    found, todo = {}, {}
    for (i, j), (lo, hi) in spans.items():
        n, below, mid = seen[f"n{i}"], seen[f"b{i}_{j}"], seen[f"m{i}_{j}"]
        if not n:
            continue
        h = probs[j] * (n - 1)
        for k in {math.floor(h), math.ceil(h)}:
            if k < below:
                todo.setdefault((i, seen[f"lo{i}"], lo, 0), [below + mid, set()])[1].add(k)
            elif k < below + mid:
                todo.setdefault((i, lo, hi, below), [mid, set()])[1].add(k)
            else:
                todo.setdefault((i, hi, seen[f"hi{i}"], below + mid, "above"), [n - below - mid, set()])[1].add(k)
    while todo:
        for key in [k for k in todo if k[1] == k[2] and len(k) == 4]:
            found.update({(key[0], r): key[1] for r in todo.pop(key)[1]})
        if not todo:
            break
        order, fetch = list(todo), sum(m for m, _ in todo.values()) <= COLLECT_VALUES

        def belongs(key):
            x = v[key[0]]
            return (x > F.lit(key[1])) & (x <= F.lit(key[2])) if len(key) == 5 else inside(x, key[1], key[2])

        cells = F.array(*[F.when(belongs(key), F.struct(F.lit(b).alias("b"), v[key[0]].alias("x"))) for b, key in enumerate(order)])
        hits = df.select(F.explode(cells).alias("_c")).where("_c is not null").select("_c.*")
        if fetch:
            counted = hits.groupBy("b", "x").agg(F.count("*").alias("n")).select("b", F.col("x").alias("lo"), F.col("x").alias("hi"), "n")
        else:
            lows = F.array(*[F.lit(float(key[1])) for key in order])
            widths = F.array(*[F.lit(float(key[2]) - float(key[1]) or 1.0) for key in order])
            at = F.least(F.floor((F.col("x") - lows[F.col("b")]) / widths[F.col("b")] * 512), F.lit(511))
            counted = hits.groupBy("b", at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by_bracket = {}
        for r in counted.collect():
            by_bracket.setdefault(r["b"], []).append((r["lo"], r["hi"], r["n"]))
        fresh = {}
        for b, key in enumerate(order):
            below, ranks = key[3], todo[key][1]
            for lo, hi, n in sorted(by_bracket[b]):
                here = {k for k in ranks if below <= k < below + n}
                if here:
                    fresh.setdefault((key[0], lo, hi, below), [n, set()])[1].update(here)
                below += n
        todo = fresh
    out = []
    for i, c in enumerate(columns):
        if not seen[f"n{i}"]:
            continue
        q = []
        for p in probs:
            h = p * (seen[f"n{i}"] - 1)
            a, b = found[(i, math.floor(h))], found[(i, math.ceil(h))]
            q.append(float(a) + (h - math.floor(h)) * (float(b) - float(a)))
        out.append((c, q))
    return spark.createDataFrame(out, "column string, q array<double>")
