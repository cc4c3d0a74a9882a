"""Exact k-nearest-neighbour imputation without comparing every row with every other.

Rows are cut into cells by a tree of median splits; the number of cells grows with the rows. A cell keeps its complete rows and its rows with gaps apart, each with the bounds of
their values, and so do the nodes above it: a table with one row per node. A row to fill first looks into its own cell (or the smallest node around it with
enough donors), which bounds the distance of its k-th neighbour, and then goes down the tree level by level, leaving out every node that can't hold a
nearer row. Big cells and popular cells are split, so every task compares two bounded blocks. Samples shape the cells, never the result.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written
from ..functions.numbers import numeric_columns
from ..functions.text import quoted
from ..options import DEFAULTS, Options

CELL_ROWS, BLOCK_QUERIES = 4_000, 4_000
TOP_DEPTH, SAMPLE_EACH = 12, 24  # levels whose splits come from one sample, and its rows per cell; deeper levels are split node by node in a table
STEP = 4  # levels a search goes down at once


def build_tree(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Median splits in heap order: node i has children 2i+1 and 2i+2."""
    tree, blocks = [], [sample]
    for _ in range(depth):
        below = []
        for rows in blocks:
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(sample.shape[1])
            axis = int(spread.argmax())
            at = float(np.median(rows[:, axis])) if len(rows) else 0.0
            tree.append((axis, at))
            below += [rows[rows[:, axis] < at], rows[rows[:, axis] >= at]]
        blocks = below
    return tree


def cell_of(x: np.ndarray, tree: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    axes = np.array([a for a, _ in tree] or [0])
    cuts = np.array([c for _, c in tree] or [0.0])
    for _ in range(depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), axes[node]] >= cuts[node])
    return node - (2 ** depth - 1)


SLICE = 256


def nearest(queries: np.ndarray, donors: np.ndarray, k: int):
    """Per query the k nearest donors: squared distances (inf where unusable) and positions. Ties by position.

    Queries go in slices, so the distance matrix of a task stays small.
    """
    parts = [_nearest(queries[i:i + SLICE], donors, k) for i in range(0, len(queries), SLICE)]
    return np.concatenate([d for d, _ in parts]), np.concatenate([o for _, o in parts])


def _nearest(queries, donors, k):
    known_q, known_d = ~np.isnan(queries), ~np.isnan(donors)
    q, d = np.where(known_q, queries, 0.0), np.where(known_d, donors, 0.0)
    dist = np.zeros((len(q), len(d)))
    both = np.zeros((len(q), len(d)))
    for j in range(q.shape[1]):
        mask = known_q[:, j, None] & known_d[None, :, j]
        dist += np.where(mask, (q[:, j, None] - d[None, :, j]) ** 2, 0.0)
        both += mask
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.where(both > 0, dist * (q.shape[1] / both), np.inf)
    k = min(k, len(d))
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(dist, order, 1), order


def _cells(rows: DataFrame, names: list[str], n: int, cell_rows: int) -> tuple[DataFrame, int]:
    """Adds ``_cell``, the number of a row's leaf, and returns the depth of the tree. Gaps are dealt as if they were at the middle."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / cell_rows))) if n else 0
    top = min(depth, TOP_DEPTH)
    sample = rows.select(*names).sample(fraction=min(1.0, SAMPLE_EACH * 2 ** top / max(n, 1) + 0.001), seed=5).toPandas().to_numpy(dtype=float)
    middle = np.nan_to_num(np.nanmean(sample, axis=0)) if len(sample) and not np.isnan(sample).all() else np.zeros(len(names))
    tree = build_tree(np.where(np.isnan(sample), middle, sample), top)

    @F.pandas_udf("long")
    def cell(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        return pd.Series(cell_of(np.where(np.isnan(x), middle, x), tree, top))

    rows = written(rows.withColumn("_cell", cell(*names) if top else F.lit(0).cast("long")), "knn-cells")
    full = [F.coalesce(c, F.lit(float(m))) for c, m in zip(names, middle)]
    for _ in range(top, depth):  # one split per node, along its widest dimension at about its median
        spread = F.array(*[F.max(x) - F.min(x) for x in full])
        halves = rows.groupBy(F.col("_cell").alias("_node")).agg(spread.alias("_s"), F.array(*[F.percentile_approx(x, 0.5, 1000) for x in full]).alias("_m"))
        axis = F.array_position("_s", F.array_max("_s")).cast("int")
        splits = written(halves.select("_node", (axis - 1).alias("_axis"), F.element_at("_m", axis).alias("_cut")), "knn-splits")
        along = F.array(*full)[F.col("_axis")]
        split = rows.join(splits, F.col("_cell") == F.col("_node")).withColumn("_cell", 2 * F.col("_cell") + (along >= F.col("_cut")).cast("long"))
        rows = written(split.drop("_node", "_axis", "_cut"), "knn-cells")
    return rows, depth


def _node_columns(p: int, of) -> list[Column]:
    return [F.sum("_n").alias("_n"), *[e for j in range(p) for e in (F.min(of("lo", j)).alias(f"lo{j}"), F.max(of("hi", j)).alias(f"hi{j}"), F.sum(of("k", j)).alias(f"k{j}"))]]


def _least_distance(p: int) -> Column:
    """Smallest possible squared distance between a query (x0, x1, …) and any row of a node; null where they share no column.

    Columns that every row of the node knows count in any case; of those only some rows know, the ones that lower the scaled distance are taken, nearest first.
    """
    gap = [F.pow(F.greatest(F.col(f"lo{j}") - F.col(f"x{j}"), F.col(f"x{j}") - F.col(f"hi{j}"), F.lit(0.0)), F.lit(2.0)) for j in range(p)]
    asked = [F.col(f"x{j}").isNotNull() & (F.col(f"k{j}") > 0) for j in range(p)]
    always = [F.col(f"k{j}") == F.col("_n") for j in range(p)]
    total = sum((F.when(a & w, g).otherwise(0.0) for a, w, g in zip(asked, always, gap)), F.lit(0.0))
    count = sum((F.when(a & w, 1.0).otherwise(0.0) for a, w in zip(asked, always)), F.lit(0.0))
    some = F.array_sort(F.filter(F.array(*[F.when(a & ~w, g) for a, w, g in zip(asked, always, gap)]), lambda g: g.isNotNull()))
    add = lambda s, g: F.when((s["c"] == 0) | (g * s["c"] < s["t"]), F.struct((s["t"] + g).alias("t"), (s["c"] + 1.0).alias("c"))).otherwise(s)
    folded = F.aggregate(some, F.struct(total.alias("t"), count.alias("c")), add)
    mixed = F.try_divide(folded["t"], folded["c"])
    return p * F.when(F.col("_whole"), F.try_divide(total, count)).otherwise(mixed)


def knn_fills(df: DataFrame, targets: list[str], keys: list[str], features: list[str], opts: Options = DEFAULTS,
              cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(keys…, _t, _fill)``: the mean of the k nearest donors for every missing target value.

    Distance over the columns both rows know, scaled up to all columns. Ties are taken by ``keys``.
    """
    k, p = opts.knn_k, len(features)
    names = [f"x{j}" for j in range(p)]
    one = len(keys) == 1
    rows = df.select((quoted(keys[0]) if one else F.struct(*[quoted(c) for c in keys])).alias("_id"), *[quoted(c).cast("double").alias(x) for c, x in zip(features, names)])
    kind = rows.schema["_id"].dataType.simpleString()
    whole = sum((F.col(x).isNull().cast("int") for x in names), F.lit(0)) == 0
    donors, depth = _cells(rows.withColumn("_whole", whole), names, df.count(), cell_rows)
    index = {c: j for j, c in enumerate(features)}
    known = lambda t: F.element_at(F.array(*[F.col(f"k{j}") for j in range(p)]), F.col(t) + 1)

    # The tree as a table: its leaves, and for every level a search stops at the nodes above them.
    leaves = written(donors.withColumn("_n", F.lit(1)).groupBy("_cell", "_whole").agg(*_node_columns(
        p, lambda what, j: F.col(names[j]) if what != "k" else F.col(names[j]).isNotNull().cast("long"))), "knn-leaves")
    levels = sorted({0, depth, *range(0, depth, STEP)})
    nodes = {at: written(leaves.groupBy(F.shiftright("_cell", depth - at).alias("_node"), "_whole").agg(*_node_columns(p, lambda what, j: F.col(f"{what}{j}"))), "knn-nodes")
             if at < depth else leaves.withColumnRenamed("_cell", "_node") for at in levels}
    slot = F.col("_node") * 2 + F.col("_whole").cast("long")
    parts = leaves.withColumnRenamed("_cell", "_node").select(slot.alias("_slot"), F.ceil(F.col("_n") / (4 * cell_rows)).cast("int").alias("_parts"))

    missing = F.array(*[F.when(F.col(names[index[t]]).isNull(), F.lit(index[t])) for t in targets])
    queries = donors.select("_id", *names, F.col("_cell").alias("_home"), F.explode(F.filter(missing, lambda t: t.isNotNull())).alias("_t"))

    def starts():
        """Leaves each query sees first: those of the lowest node around it with k donors for its target, or of the whole tree."""
        left, found = queries, []
        for at in reversed(levels):
            around = nodes[at].groupBy(F.col("_node").alias("_near")).agg(*[F.sum(f"k{j}").alias(f"k{j}") for j in range(p)])
            met = left.join(around, F.shiftright("_home", depth - at) == F.col("_near"))
            enough = known("_t") >= k if at else F.lit(True)
            found.append(met.where(enough).select("_id", *names, "_t", "_near", F.lit(at).alias("_at")))
            left = met.where(~enough).select(*queries.columns)
        out = None
        for f, at in zip(found, reversed(levels)):
            under = nodes[depth].where(F.col("_n") > 0).select(F.shiftright("_node", depth - at).alias("_above"), slot.alias("_slot"))
            own = f.join(under, F.col("_near") == F.col("_above")).select("_id", *names, "_t", "_slot")
            out = own if out is None else out.unionByName(own)
        return out

    def descent(asked):
        """Leaves that can hold a donor within each query's reach, found level by level."""
        front = asked.withColumn("_from", F.lit(0).cast("long"))
        last = 0
        for at in levels:
            below = nodes[at].withColumnRenamed("_whole", "_w").select(F.shiftright("_node", at - last).alias("_parent"), F.col("_node"), F.col("_w").alias("_whole"), "_n", *[
                f"{what}{j}" for j in range(p) for what in ("lo", "hi", "k")])
            near = front.join(below, F.col("_from") == F.col("_parent")).withColumn("_low", _least_distance(p)).where(
                (known("_t") > 0) & F.col("_low").isNotNull() & (F.col("_low") <= F.col("_reach") * (1 + 1e-9)))
            if at == depth:
                return near.select("_id", *names, "_t", slot.alias("_slot"))
            front = near.select("_id", *names, "_t", "_reach", F.col("_node").alias("_from")).distinct()  # complete rows and others share their nodes
            last = at

    def search(visits: DataFrame) -> DataFrame:
        """k best donors of each visited block; popular blocks are copied for groups of queries."""
        visits = written(visits.join(parts, "_slot").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"), "knn-visits")
        load = visits.groupBy("_slot", "_part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_copies"))
        spread = visits.join(load, ["_slot", "_part"]).withColumn("_copy", F.pmod(F.xxhash64("_id", "_t"), F.col("_copies")).cast("int")).drop("_copies")
        mine = F.col("_cell") * 2 + F.col("_whole").cast("long")
        placed = donors.withColumn("_s", mine).join(parts, F.col("_s") == F.col("_slot")).withColumn("_p", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
        copied = load.select(F.col("_slot").alias("_ls"), F.col("_part").alias("_lp"), F.sequence(F.lit(0), F.col("_copies") - 1).alias("_all"))
        copies = placed.join(copied, (F.col("_s") == F.col("_ls")) & (F.col("_p") == F.col("_lp"))).select(
            F.col("_id").alias("_donor"), *[F.col(x).alias(f"d{j}") for j, x in enumerate(names)], F.col("_s").alias("_of"), F.col("_p").alias("_at"), F.explode("_all").alias("_for"))

        def compare(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            if q.empty or d.empty:
                return pd.DataFrame({"_id": [], "_t": [], "_d": [], "_v": [], "_donor": []})
            d = d.sort_values("_donor", kind="stable") if one else d.iloc[sorted(range(len(d)), key=lambda i, v=d["_donor"].tolist(): tuple(v[i].values()))]
            dx, t = d[[f"d{j}" for j in range(p)]].to_numpy(dtype=float), q["_t"].to_numpy()
            ids, out = d["_donor"].to_numpy(), []
            for target in np.unique(t):  # only rows that know the target are donors
                usable, asked = np.flatnonzero(~np.isnan(dx[:, target])), np.flatnonzero(t == target)
                if not len(usable):
                    continue
                dist, pos = nearest(q[names].to_numpy(dtype=float)[asked], dx[usable], k)
                who, pos = np.repeat(asked, pos.shape[1]), usable[pos.ravel()]
                out.append(pd.DataFrame({"_id": q["_id"].to_numpy()[who], "_t": t[who], "_d": dist.ravel(), "_v": dx[pos, target], "_donor": ids[pos]}))
            found = pd.concat(out) if out else pd.DataFrame({"_id": [], "_t": [], "_d": [], "_v": [], "_donor": []})
            return found[np.isfinite(found["_d"].astype(float))]

        return spread.groupBy("_slot", "_part", "_copy").cogroup(copies.groupBy("_of", "_at", "_for")).applyInPandas(
            compare, f"_id {kind}, _t int, _d double, _v double, _donor {kind}")

    best = Window.partitionBy("_id", "_t").orderBy("_d", "_donor")

    def fills(near):
        kept = near.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).groupBy("_id", "_t").agg(F.avg("_v").alias("_fill"))
        return kept.select(*([F.col("_id").alias(keys[0])] if one else ["_id.*"]), "_t", "_fill")

    if not depth:  # one cell holds all rows
        return fills(search(queries.drop("_home").withColumn("_slot", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")))))
    first = search(starts()).withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k)
    reach = first.groupBy(F.col("_id").alias("_i"), F.col("_t").alias("_j")).agg(F.when(F.count("*") >= k, F.max("_d")).alias("_reach"))
    asked = written(queries.drop("_home").join(reach, (F.col("_id") == F.col("_i")) & (F.col("_t") == F.col("_j")), "left").withColumn(
        "_reach", F.coalesce("_reach", F.lit(float("inf")))).drop("_i", "_j"), "knn-reach")
    return fills(search(descent(asked)))


def impute_knn(df: DataFrame, columns: list[str], keys: list[str], features: list[str] | None = None,
               opts: Options = DEFAULTS, source: DataFrame | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Fills ``columns``; a value without any comparable donor gets the column mean. ``keys`` identify a row."""
    source = df if source is None else source
    features = features or [c for c in numeric_columns(source) if c not in keys]
    columns = [c for c in columns if c in features]
    fills = knn_fills(source, columns, keys, features, opts, cell_rows)
    wide = fills.groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == features.index(c), F.col("_fill"))).alias(f"_fill_{i}")
                                      for i, c in enumerate(columns)])
    means = source.agg(*[F.avg(quoted(c)).alias(c) for c in columns]).first()
    joined = df.join(wide, keys, "left")
    return joined.select(*[
        F.coalesce(quoted(c).cast("double"), F.col(f"_fill_{columns.index(c)}"), F.lit(means[c])).alias(c)
        if c in columns else quoted(c) for c in df.columns])
