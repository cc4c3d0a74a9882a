"""Exact numbers of different values per column without moving a cell's text.

A sketch (one aggregate, nothing shuffled but its registers) says about how many values a column has, and where whole numbers lie. It decides how each column is
counted exactly: few values in a small table inside every task, whole numbers that lie close together as bits of their range, other numbers by
themselves and everything else by fingerprints of 128 bits, which are combined before they are shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .partitions import held
from .text import quoted

FEW = 1_000  # values by the sketch up to which a column is counted apart from larger ones
DENSE = 64  # a range of at most so many places per value is counted in bits; a fingerprint takes 128
PASS_CELLS = 50_000_000  # values that are counted in one pass: its shuffle lies on disk at once
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _whole(field: T.StructField) -> Column | None:
    """The value as a whole number, for types where that is the value."""
    c = quoted(field.name)
    if isinstance(field.dataType, WHOLE):
        return c.cast("long")
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(c)
    return None


def _prints(field: T.StructField) -> tuple[Column, Column]:
    """Two numbers that stand for a value."""
    whole, c = _whole(field), quoted(field.name)
    if whole is not None:
        return whole, F.lit(0).cast("long")
    if isinstance(field.dataType, T.BooleanType):
        return c.cast("long"), F.lit(0).cast("long")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # one zero
    return F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)


def _numbers(field: T.StructField) -> tuple[Column, ...]:
    """What is shuffled for a value of a column of many: the number itself, or two fingerprints."""
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (quoted(field.name).cast("double") + F.lit(0.0),)  # one zero; grouped, NaN is one value
    return _prints(field)[:1] if _whole(field) is not None else _prints(field)


def _passes(fields: list[T.StructField], seen: dict[str, dict]) -> list[list[T.StructField]]:
    """Columns that are counted in one scan: of one kind, and together of ``PASS_CELLS`` values unless one alone has more."""
    passes: dict[tuple, list] = {}
    room = {}
    for f in fields:
        kind = len(_numbers(f)), isinstance(f.dataType, (T.FloatType, T.DoubleType))
        if kind not in room or seen[f.name]["values"] > room[kind]:
            passes.setdefault(kind, []).append([])
            room[kind] = PASS_CELLS
        passes[kind][-1].append(f)
        room[kind] -= seen[f.name]["values"]
    return [p for own in passes.values() for p in own]


def sketch(df: DataFrame, more: dict[str, dict[str, Column]] | None = None) -> dict[str, dict]:
    """Per column rows, values (not null), about how many different ones, and the range of whole numbers. ``more`` aggregates of a column ride along
    in the same scan."""
    metrics = {}
    for f in df.schema:
        whole = _whole(f)
        metrics[f.name] = {"rows": F.count("*"), "values": F.count(quoted(f.name)), "about": F.approx_count_distinct(_prints(f)[0]),
                           **({"low": F.min(whole), "high": F.max(whole)} if whole is not None else {}), **(more or {}).get(f.name, {})}
    row = df.agg(*[e.alias(f"{i}_{m}") for i, own in enumerate(metrics.values()) for m, e in own.items()]).first()
    return {c: {m: row[f"{i}_{m}"] for m in own} for i, (c, own) in enumerate(metrics.items())}


def distinct_counts(df: DataFrame, seen: dict[str, dict]) -> dict[str, int]:
    """Different values of each column, null not counted, from what ``sketch`` saw."""
    few, dense, many = [], [], []
    for f in df.schema:
        s = seen[f.name]
        if s["about"] <= FEW:
            few.append(f)
        elif "low" in s and s["high"] - s["low"] < DENSE * s["about"]:
            dense.append(f)
        else:
            many.append(f)
    out = {}

    def prints(fields, of=_prints):
        cells = F.array(*[F.when(quoted(f.name).isNotNull(), F.struct(F.lit(i).alias("i"), *[p.alias(n) for p, n in zip(of(f), "ab")])) for i, f in enumerate(fields)])
        apart = df.select(F.explode(cells).alias("_c")).where("_c is not null").select("_c.*").distinct()
        return {fields[r["i"]].name: r["n"] for r in apart.groupBy("i").agg(F.count("*").alias("n")).collect()}

    if few:  # apart from columns of many values, which would push them out of the tasks' memory
        out |= prints(few)
    if dense:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.bitmap_bucket_number(v).alias("bucket"), F.bitmap_bit_position(v).alias("bit"))
                          for i, v in enumerate(_whole(f) for f in dense)])
        bits = df.select(F.explode(cells).alias("_c")).select("_c.*").where("bit is not null").groupBy("i", "bucket").agg(
            F.bitmap_count(F.bitmap_construct_agg("bit")).alias("n"))
        out |= {dense[r["i"]].name: r["n"] for r in bits.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    for fields in _passes(many, seen):
        out |= prints(fields, _numbers)
    return {f.name: out.get(f.name, 0) for f in df.schema}


def unique_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose values differ in all rows and are never null. The sketch turns away columns far from that before anything is counted."""
    if not columns:
        return []
    narrow = df.select(*[quoted(c) for c in columns])
    with held(narrow):
        seen = sketch(narrow)
        maybe = [c for c in columns if seen[c]["values"] == seen[c]["rows"] and seen[c]["about"] >= 0.7 * seen[c]["rows"]]
        if not maybe:
            return []
        counts = distinct_counts(narrow.select(*[quoted(c) for c in maybe]), seen)
    return [c for c in maybe if counts[c] == seen[c]["rows"]]
