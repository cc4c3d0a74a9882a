"""Ordered operations over a whole table without a one-partition window.

Rows get a chunk number that follows the order. Chunk borders are values drawn from a small sample and put into the
plan as literals, so a recomputed task always gives the same chunk. Windows run inside chunks; what one chunk passes to
the next is a table with one row per chunk.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..options import DEFAULTS, Options
from .fingerprint import row_hash
from .text import quoted

CHUNK, TIE = "_chunk", "_tie"
JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def with_chunks(df: DataFrame, order_by: list[str], opts: Options = DEFAULTS) -> tuple[DataFrame, int]:
    """Adds the chunk number; returns the frame and the number of chunks."""
    n = df.count()
    chunks = min(opts.max_chunks, math.ceil(n / opts.chunk_rows)) if n else 1
    if chunks <= 1:
        return df.withColumn(CHUNK, F.lit(0)), 1
    order = df.select(*[quoted(c) for c in order_by])
    # Only the borders depend on the sample, never the result.
    sample = order.sample(fraction=min(1.0, 30.0 * chunks / n), seed=11).dropna().distinct()
    rows = [r[0] for r in sample.sort(*[quoted(c) for c in order_by]).select(
        F.to_json(F.struct("*"), JSON)).collect()]
    step = max(1, len(rows) // chunks)
    borders = rows[step::step]
    if not borders:
        return df.withColumn(CHUNK, F.lit(0)), 1
    width = math.ceil(math.sqrt(len(borders)))
    groups = [borders[i:i + width] for i in range(0, len(borders), width)]
    row_type = "struct<" + ",".join(f"`{c}`:{order.schema[c].dataType.simpleString()}" for c in order_by) + ">"
    nested = F.from_json(F.lit("[" + ",".join("[" + ",".join(g) + "]" for g in groups) + "]"),
                         f"array<array<{row_type}>>", JSON)
    heads = F.from_json(F.lit("[" + ",".join(g[0] for g in groups) + "]"), f"array<{row_type}>", JSON)
    key = F.struct(*[quoted(c) for c in order_by])
    group = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(group, F.lit(1))), lambda b: b <= key))
    chunk = F.when(group == 0, 0).otherwise((group - 1) * width + inside)
    return df.withColumn(CHUNK, chunk.cast("int")), len(borders) + 1


def _total_order(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds a hash of the whole row as the last key: ties come in the same order in every run and can be cut, all but equal rows."""
    return df.withColumn(TIE, row_hash(df.columns)), [*order_by, TIE]


def forward_fill(df: DataFrame, columns: list[str], order_by: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Last non-null value in the given order; rows that tie in it are ordered by a hash of the row."""
    keyed, order_by = _total_order(df, order_by)
    chunked, k = with_chunks(keyed, order_by, opts)
    order = [quoted(c) for c in order_by]
    inside = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = {c: F.last(quoted(c), ignorenulls=True).over(inside) for c in columns}
    if k == 1:
        return chunked.select(*[local[c].alias(c) if c in local else quoted(c) for c in df.columns])
    key = F.struct(*order)
    ends = chunked.groupBy(CHUNK).agg(*[
        F.max_by(quoted(c), F.when(quoted(c).isNotNull(), key)).alias(f"_carry_{i}") for i, c in enumerate(columns)])
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk, at most max_chunks
    carry = ends.select(CHUNK, *[
        F.last(f"_carry_{i}", ignorenulls=True).over(before).alias(f"_carry_{i}") for i in range(len(columns))])
    filled = chunked.select(*[quoted(c) for c in df.columns], CHUNK,
                            *[local[c].alias(f"_local_{i}") for i, c in enumerate(columns)])
    joined = filled.join(F.broadcast(carry), CHUNK, "left")
    index = {c: i for i, c in enumerate(columns)}
    return joined.select(*[
        F.coalesce(f"_local_{index[c]}", f"_carry_{index[c]}").alias(c) if c in index else quoted(c) for c in df.columns])


def row_index(df: DataFrame, order_by: list[str], name: str = "row_index", opts: Options = DEFAULTS) -> DataFrame:
    """0-based position of each row in the given order; rows that tie in it are ordered by a hash of the row."""
    keyed, order_by = _total_order(df, order_by)
    chunked, k = with_chunks(keyed, order_by, opts)
    inside = Window.partitionBy(CHUNK).orderBy(*[quoted(c) for c in order_by])
    numbered = chunked.withColumn("_pos", F.row_number().over(inside) - 1)
    if k == 1:
        return numbered.withColumn(name, F.col("_pos").cast("long")).drop("_pos", CHUNK, TIE)
    sizes = chunked.groupBy(CHUNK).agg(F.count("*").alias("_n"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (numbered.join(F.broadcast(offsets), CHUNK)
            .withColumn(name, (F.col("_pos") + F.col("_offset")).cast("long")).drop("_pos", "_offset", CHUNK, TIE))


def running_count(counts: DataFrame, key: str, value: str, n: str, opts: Options = DEFAULTS) -> DataFrame:
    """Adds ``_below``: the rows of the same key with a smaller value, from a (key, value, n) count table."""
    chunked, k = with_chunks(counts, [key, value], opts)
    inside = (Window.partitionBy(key, CHUNK).orderBy(quoted(value)).rowsBetween(Window.unboundedPreceding, -1))
    local = chunked.withColumn("_local", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    if k == 1:
        return local.withColumnRenamed("_local", "_below").drop(CHUNK)
    totals = chunked.groupBy(key, CHUNK).agg(F.sum(n).alias("_n"))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (local.join(F.broadcast(offsets), [key, CHUNK])
            .withColumn("_below", F.col("_local") + F.col("_offset")).drop("_local", "_offset", CHUNK))
