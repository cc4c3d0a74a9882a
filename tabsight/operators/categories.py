"""Merging rare spellings of a label into a frequent one.

Neighbours within edit distance three are found by their halves: of at most three edits one half of a label has at most one, so that half and some
beginning or end of the other label agree after at most one deletion each. Labels meet only on such strings, whose number is
linear in the length of a label; labels that can't be merged for their length or frequency are left out before they meet.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.reshape import text_cells
from ..options import DEFAULTS, Options

# Column name tokens of closed geographic vocabularies, where nothing is merged.
GEOGRAPHIC_WORDS = ["country", "countries", "nation", "state", "province"]


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, label, n)``, written once: the search for neighbours reads it several times."""
    return cut(text_cells(df, columns, keep_null=False).groupBy("column", F.col("value").alias("label"))
               .agg(F.count("*").alias("n")))


def mergeable_columns(columns: list[str], geographic: set[str] = frozenset()) -> list[str]:
    import re
    return [c for c in columns if c not in geographic
            and not set(re.split(r"[^a-z0-9]+", c.lower())) & set(GEOGRAPHIC_WORDS)]


MOST_DISTANCE = 3


def _shorter(text):
    """A text less one character, each in turn; an empty text gives itself."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _keys(strings, side: str, length):
    """Hashes of the strings that stand for a half, together with column, first letter and the length of the indexed label."""
    first = F.lower(F.substring("label", 1, 1))
    return F.transform(strings, lambda x: F.xxhash64(F.col("column"), first, F.lit(side), length, x))


def _index_keys():
    """Keys of a label's halves: each half, and it less one character."""
    n = F.length("label")
    middle = F.floor(n / 2).cast("int")
    head, tail = F.substring("label", F.lit(1), middle), F.substring("label", middle + 1, n)
    return F.array_distinct(F.concat(*[_keys(F.concat(F.array(half), _shorter(half)), side, n) for half, side in ((head, "head"), (tail, "tail"))]))


def _probe_keys(d: int):
    """Keys under which a label within ``d`` edits must be indexed, for each of its possible lengths."""
    n, out = F.length("label"), []
    for more in range(-d, d + 1):
        length = n + more
        middle = F.floor(length / 2).cast("int")
        for size, side in ((middle, "head"), (middle + 1, "head"), (length - middle, "tail"), (length - middle + 1, "tail")):
            part = F.substring("label", F.lit(1), size) if side == "head" else F.substring("label", F.greatest(n - size + 1, F.lit(1)), n)
            # less one character a beginning is also the one that is a character shorter; itself it counts where the label ends before
            out.append(F.when(length > 0, _keys(F.concat(F.array(part), _shorter(part)), side, length)))
    empty = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(*[F.coalesce(k, empty) for k in out]))


def near_labels(sources: DataFrame, targets: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """(column, label, n, other, other_n, distance): labels of ``sources`` with those of ``targets`` in the same column that differ from them, begin with the
    same letter and lie within a small edit distance."""
    d = opts.fuzzy_distance
    if d > MOST_DISTANCE:
        raise ValueError(f"labels are compared up to distance {MOST_DISTANCE}")
    probes = sources.where(F.length("label") > 0).select("column", "label", "n", F.explode(_probe_keys(d)).alias("_h"))
    index = targets.where(F.length("label") > 0).select(F.col("column").alias("_column"), F.col("label").alias("other"), F.col("n").alias("other_n"),
                                                        F.explode(_index_keys()).alias("_k"))
    pairs = probes.join(index, (F.col("_h") == F.col("_k")) & (F.col("column") == F.col("_column"))).where(F.col("label") != F.col("other"))
    return (pairs.select("column", "label", "n", "other", "other_n").distinct()
            .where(F.lower(F.substring("label", 1, 1)) == F.lower(F.substring("other", 1, 1)))
            .withColumn("distance", F.levenshtein("label", "other", d)).where(F.col("distance").between(0, d)))


def fuzzy_merges(labels: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """``(column, raw, canonical, row_count, distance)`` for every merged label.

    Labels are taken by falling frequency (ties: alphabet). A label joins the first kept label that may take it; a label
    that joined takes none. Whether a label is kept depends only on more frequent labels near it, so the rounds below end
    after the longest such chain, which is one or two in practice.
    """
    totals = labels.groupBy("column").agg(F.sum("n").alias("_total"), F.count("*").alias("_labels"))
    long = labels.where(F.length("label") >= opts.fuzzy_min_length)
    rare = long.join(totals, "column").where((F.col("_labels") > opts.fuzzy_off_labels) & (F.col("n") / F.col("_total") * 100 <= opts.fuzzy_rare_pct))
    # other = target, label = source; a target is more frequent than some source, so it occurs twice at least
    edges = near_labels(rare, long.where("n > 1"), opts).where(F.col("other_n") > F.col("n"))
    edges = cut(edges)
    moved = edges.select("column", F.col("label").alias("other")).distinct()
    # Targets that are no source themselves are kept; the rest are settled in rounds.
    state = edges.join(moved.withColumn("_open", F.lit(True)), ["column", "other"], "left").withColumn(
        "_target", F.when(F.col("_open"), "open").otherwise("kept")).drop("_open")
    while not state.where("_target = 'open'").isEmpty():
        settled = state.groupBy("column", "label").agg(
            F.bool_or(F.col("_target") == "kept").alias("_moves"), F.bool_and(F.col("_target") == "moved").alias("_stays"))
        verdict = settled.select("column", F.col("label").alias("other"),
                                 F.when(F.col("_moves"), "moved").when(F.col("_stays"), "kept").alias("_new"))
        state = cut(state.join(verdict, ["column", "other"], "left")
                    .withColumn("_target", F.coalesce("_new", "_target")).drop("_new"))
    w = Window.partitionBy("column", "label").orderBy(F.desc("other_n"), "other")
    return (state.where("_target = 'kept'").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("column", F.col("label").alias("raw"), F.col("other").alias("canonical"),
                    F.col("n").alias("row_count"), "distance"))


def fuzzy_flags(labels: DataFrame, merges: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Labels that stand alone but have a near neighbour too short to merge: nearest one, for review."""
    short = labels.where(F.length("label") < opts.fuzzy_min_length + opts.fuzzy_distance)
    near = near_labels(short, short, opts).where(F.least(F.length("label"), F.length("other")) < opts.fuzzy_min_length)
    used = merges.select("column", F.col("raw").alias("label")).unionAll(
        merges.select("column", F.col("canonical").alias("label"))).distinct()
    w = Window.partitionBy("column", "label").orderBy("distance", F.desc("other_n"), "other")
    return (near.join(used, ["column", "label"], "left_anti").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("column", "label", F.col("n").alias("row_count"), F.col("other").alias("near_candidate"), "distance"))


def apply_merges(df: DataFrame, merges: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces merged labels. The map holds only merged labels; its size decides how Spark joins it."""
    out = df
    for c in columns:
        table = merges.where(F.col("column") == c).select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical"))
        out = out.join(table, out[c] == F.col("_raw"), "left").withColumn(
            c, F.coalesce("_canonical", c)).drop("_raw", "_canonical")
    return out.select(*df.columns)


def fuzzy_category_merge(df: DataFrame, columns: list[str], geographic: set[str] = frozenset(),
                         opts: Options = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The rewritten table and the merges made."""
    columns = mergeable_columns(columns, geographic)
    merges = fuzzy_merges(label_counts(df, columns), opts)
    return apply_merges(df, merges, columns), merges
