"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document of source s should be copied ``target(s) / size(s)`` times. Whole copies are given at once; the fractions are
paired, and words move at random from one partner to the other until one of the two fractions is 0 or 1. A transfer
keeps the number of words of the pair, and each fraction stays right on average. The open partner meets the next one.
Documents are dealt by hash into groups of about ``fan_in``; the one fraction each group leaves open goes up a tree of
such groups, so no task ever holds a source, and the words taken from a source miss its target by at most half a document.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written
from .common import uniform, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, FAN_IN, SEED = 1.5, 2.0, 64, 17


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (_source, source_size) with ``target``: words to take from each source.

    Sources by code point, null last, have the weights in turn. Together they get ``share`` times all words; none gets more than
    ``cap`` times its own, and what it can't take is shared among the rest by weight. With sources sorted by cap over
    weight the full ones come first, so running sums replace the rounds. One row per source meets in one task.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(weights)
    weighted = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighted = weighted.withColumn("_most", cap * F.col("source_size")).withColumn("_ratio", F.col("_most") / F.col("_w"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = weighted.withColumn("_all", share * F.sum("source_size").over(everything)).withColumn(
        "_left", F.col("_all") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))).withColumn(
        "_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    full = level.withColumn("_level", F.col("_left") / F.col("_rest")).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    # the first source that isn't full has the level of all that aren't
    common = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return full.withColumn("target", F.when(F.col("_full"), F.col("_most")).otherwise(F.col("_w") * common)).select(
        "_source", "source_size", "target", *[c for c in sizes.columns if c not in ("_source", "source_size")])


def _pairing(level: int, seed: int):
    return lambda acc, x: _pair(acc, x, level, seed)


def _pair(acc: Column, x: Column, level: int, seed: int) -> Column:
    """One step of a group's fold: the open document meets the next one."""
    a = acc["open"]
    room_a, room_b = (1 - a["_p"]) * a["_size"], (1 - x["_p"]) * x["_size"]
    mass_a, mass_b = a["_p"] * a["_size"], x["_p"] * x["_size"]
    up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
    rises = uniform(a["_key"], x["_key"], F.lit(level), F.lit(seed)) * (up + down) < down
    a_ends = F.when(rises, room_a <= mass_b).otherwise(mass_a <= room_b)
    p_a = F.when(rises, F.when(a_ends, F.lit(1.0)).otherwise(a["_p"] + up / a["_size"])).otherwise(
        F.when(a_ends, F.lit(0.0)).otherwise(a["_p"] - down / a["_size"]))
    p_b = F.when(rises, F.when(a_ends, x["_p"] - up / x["_size"]).otherwise(F.lit(0.0))).otherwise(
        F.when(a_ends, x["_p"] + down / x["_size"]).otherwise(F.lit(1.0)))
    a, b = a.withField("_p", p_a), x.withField("_p", p_b)
    met = F.struct(F.when(a_ends, b).otherwise(a).alias("open"),
                   F.concat(acc["done"], F.array(F.when(a_ends, a).otherwise(b))).alias("done"))
    return F.when(acc["open"].isNull(), F.struct(x.alias("open"), acc["done"].alias("done"))).otherwise(met)


def copies(units: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, fan_in: int = FAN_IN,
           seed: int = SEED) -> DataFrame:
    """Gives each unit its copies.

    ``units`` has one row per distinct (_key, _source, _size) with ``_n``, the number of equal rows it stands for; ``_key`` tells
    units apart. Adds ``source_size``, ``target`` and ``_copies``, the copies of the _n rows together (at most _n times cap, rounded up).
    """
    sizes = units.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"),
                                         F.sum((F.col("_size") > 0).cast("long")).alias("_units"))
    goal = written(targets(sizes, weights, share, cap), "mix-targets")
    largest = goal.agg(F.max("_units")).first()[0] or 1
    expected = F.col("_n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(goal.withColumnRenamed("_source", "_goal"), F.col("_source").eqNullSafe(F.col("_goal"))).drop("_goal").withColumn(
        "_base", F.floor(expected)).withColumn("_p", expected - F.col("_base"))
    columns = ["_size", "_key", "_source", "_n", "_base", "source_size", "target", "_units", "_p"]
    open_rows, settled = rows.where("_size > 0").select(columns), [rows.where("_size = 0").select(columns)]
    levels = max(1, math.ceil(math.log(largest, fan_in) - 1e-9))
    for level in range(levels):
        groups = F.ceil(F.col("_units") / float(fan_in) ** (level + 1)) if level < levels - 1 else F.lit(1)
        group = F.pmod(F.xxhash64("_key", F.lit(seed + level)), groups)
        if level == 0 and levels > 1:  # a group of each source waits for the last level, so that what stays open there is seldom large
            reserve, open_rows = open_rows.where(group == 0), open_rows.where(group != 0)
        elif level == levels - 1 and levels > 1:
            open_rows = open_rows.unionByName(reserve)
        row = F.struct(*columns)
        kind = open_rows.select(row.alias("r")).schema["r"].dataType.simpleString()
        start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
        fold = F.aggregate(F.reverse(F.array_sort(F.collect_list(row))), start, _pairing(level, seed))
        met = written(open_rows.groupBy("_source", group.alias("_group")).agg(fold.alias("f")).select("f.*"), "mix-level")
        settled.append(met.select(F.inline("done")))
        open_rows = met.select("open.*")
    settled.append(open_rows)  # the one open fraction of each source goes to the nearer side
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.withColumn("_copies", (F.col("_base") + F.round("_p")).cast("long")).drop("_base", "_p", "_units")


def _row_copies() -> Column:
    """Copies of each of a unit's equal rows: as even as they go."""
    each, more = F.floor(F.col("_copies") / F.col("_n")), F.col("_copies") % F.col("_n")
    return F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("_n")), lambda i: each + (i <= more).cast("long")))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size (words), source_size, target (both of its source), taken (words the mix takes of it) and copies.

    Null texts have size 0 and nothing is taken of them. Null ids and sources are values like others; a null source comes last in the
    order of weights. Rows equal in id, source and size share their copies evenly. An empty table gives no rows; other columns are
    not read. Very long texts count whole; a document is taken at most ``cap`` times, rounded up.
    """
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"))
    units = sized.groupBy("_id", "_source", "_size").agg(F.count("*").alias("_n")).withColumn(
        "_key", F.struct("_id", "_source", "_size"))
    units = written(units.select("_key", "_source", "_size", "_n"), "mix-units")
    out = copies(units, **options).withColumn("copies", _row_copies())
    return out.select(F.col("_key._id").alias(id_col), F.col("_size").alias("size"), F.coalesce("source_size", F.lit(0)).alias("source_size"),
                      F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with the columns of ``docs``.

    Edge cases are those of ``mix_report``; rows equal in all columns are one unit. Documents without words are taken never.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(row.alias("_row"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"),
                        F.struct(F.xxhash64(row).alias("a"), F.md5(F.to_json(row)).alias("b")).alias("_key"))
    units = written(keyed.groupBy("_key", "_source", "_size").agg(F.count("*").alias("_n")), "mix-units")
    taken = copies(units, **options).where("_copies > 0 and _size > 0").select("_key", "_n", "_copies")
    one = keyed.select("_row", F.col("_key").alias("_k")).join(taken, F.col("_k") == F.col("_key"))
    # Equal rows are the same row, so the copies of all of them can be copies of one.
    many = one.where("_n > 1").groupBy("_k").agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies"))
    both = one.where("_n = 1").select("_row", "_copies").unionByName(many.select("_row", "_copies"))
    return both.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
