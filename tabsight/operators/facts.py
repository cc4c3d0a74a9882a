"""Facts of a run: why the shape changed, what happened to nulls, the top results, grounding of numbers in texts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options
from .rules import COPY_SUFFIXES, FLAG_SUFFIXES
from .selection import DATE_PART_SUFFIXES

# ---- shape and nulls ----


def shape_explanation(raw_columns: DataFrame, clean_columns: DataFrame, accounting: DataFrame) -> DataFrame:
    """``(kind, cause, n, sources)``: columns added or dropped by cause, rows lost by cause."""
    c = F.col("column")
    added = clean_columns.select("column").join(raw_columns.select("column"), "column", "left_anti")
    dropped = raw_columns.select("column").join(clean_columns.select("column"), "column", "left_anti")
    parts = "(" + "|".join(sorted(DATE_PART_SUFFIXES, key=len, reverse=True)) + ")$"
    cause = (F.when(c.endswith("__ordinal"), "ordinal_encoding").when(c.contains("__"), "one_hot_encoding")
             .when(c.startswith("derived_"), "derived_metric").when(c.rlike(parts), "date_feature_extraction")
             .when(c.rlike("(" + "|".join(COPY_SUFFIXES) + ")$"), "audit_trail")
             .when(c.rlike("(" + "|".join(FLAG_SUFFIXES) + ")$"), "validation_flag").otherwise("other"))
    source = F.when(c.contains("__"), F.substring_index(c, "__", 1)).when(c.rlike(parts) & ~c.startswith("derived_"),
                                                                         F.regexp_replace(c, parts, ""))
    grouped = added.select(cause.alias("cause"), source.alias("source")).groupBy("cause").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    gone = dropped.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("sources"))
    rows = accounting.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("cause"), F.col(name).alias("n"))
        for name in ("exact_duplicates_removed", "canonical_duplicates_removed", "imputation_drops")])).alias("_r")).select("_r.*")
    return (grouped.select(F.lit("column_added").alias("kind"), "cause", "n", "sources")
            .unionByName(gone.select(F.lit("column_dropped").alias("kind"), F.lit("dropped").alias("cause"), "n", "sources"))
            .unionByName(rows.select(F.lit("rows_removed").alias("kind"), "cause", "n", F.lit("").alias("sources")))
            .where(F.col("n") > 0))


# Null-policy action -> what the report says.
ACTION_LABELS = {
    "impute_mean": "mean imputation", "impute_median": "median imputation", "impute_mode": "mode imputation",
    "impute_unknown_label": "constant value (Unknown)", "impute_forward_fill": "forward fill",
    "impute_knn": "model-based imputation (knn)", "impute_iterative": "model-based imputation (iterative)",
    "drop_rows": "rows dropped", "drop_column": "column dropped",
}


def missing_action(before: DataFrame, blueprint: DataFrame, after: DataFrame) -> DataFrame:
    """What really happened to the nulls of each column: the plan, unless money was kept or no null went away."""
    left = after.select("column", F.col("missing_count").alias("remaining"))
    both = before.where("missing_count > 0").join(blueprint.select("column", "semantic_tag", "null_action"), "column", "left").join(
        left, "column", "left")
    planned = F.coalesce("null_action", F.lit("none"))
    fill = planned.startswith("impute_")
    kept = fill & (F.coalesce(F.col("semantic_tag").isin("currency", "financial"), F.lit(False))
                   | F.coalesce(F.col("remaining") >= F.col("missing_count"), F.lit(False)))
    label = F.create_map(*[F.lit(x) for kv in ACTION_LABELS.items() for x in kv])[planned]
    return both.select("column", "missing_count", "missing_pct", F.when(kept, "left as null").otherwise(
        F.coalesce(label, F.lit("left as null"))).alias("action"))


# ---- top results ----

def top_pairs(pairs: DataFrame, kind: str = "strong", opts: Options = DEFAULTS) -> DataFrame:
    return pairs.where(F.col("kind") == kind).orderBy(F.abs("pearson_r").desc(), "col1", "col2").limit(opts.top_facts)


def top_trends(trends: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    return trends.where(F.col("significant") & (F.col("n") >= opts.trend_min_n)).orderBy(
        F.desc("r_squared"), "column").limit(opts.top_facts)


def latest_growth(growth: DataFrame, order: list[str]) -> DataFrame:
    return growth.agg(F.max_by(F.struct("label", "growth_pct"), F.struct(*order)).alias("_l")).select("_l.*")


def top_facts(pairs: DataFrame, trends: DataFrame, monthly: DataFrame, season: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """The facts a report starts with, long: ``(topic, subject, value)``."""
    def pair_rows(kind):
        return top_pairs(pairs, kind, opts).select(F.lit(kind).alias("topic"), F.concat_ws(" ~ ", "col1", "col2").alias("subject"),
                                                   F.col("pearson_r").alias("value"))
    parts = [pair_rows(k) for k in ("strong", "excluded", "formulaic")]
    parts.append(top_trends(trends, opts).select(F.lit("trend").alias("topic"), F.col("column").alias("subject"), F.col("r_squared").alias("value")))
    parts.append(latest_growth(monthly, ["year", "month"]).select(
        F.lit("latest_growth").alias("topic"), F.col("label").alias("subject"), F.col("growth_pct").alias("value")))
    for flag in ("is_best", "is_worst"):
        parts.append(season.where(flag).select(F.lit(flag[3:] + "_period").alias("topic"), F.col("label").alias("subject"),
                                               F.col("average").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rank_slices(ranked: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Best three labels, and the worst three (worst first) among the others."""
    n = opts.slice_rows
    top = ranked.where(F.col("rank_top") <= n).select("dimension", "value", "total", "total_categories", F.lit("top").alias("part"),
                                                      F.col("rank_top").alias("place"))
    rest = ranked.where(F.col("rank_bottom").isNotNull() & ~F.coalesce(F.col("rank_top") <= n, F.lit(False)))
    w = Window.partitionBy("dimension").orderBy("rank_bottom")
    low = rest.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(
        "dimension", "value", "total", "total_categories", F.lit("bottom").alias("part"), "place")
    return top.unionByName(low)


def normalization_facts(merges: DataFrame) -> DataFrame:
    return merges.select("column", "raw", "canonical", "row_count")


def required_cells(results: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``(result, field, empty)``: required cells of result tables that are null or blank."""
    parts = []
    for name, (df, fields) in results.items():
        empty = {f: {"empty": F.count_if(quoted(f).isNull() | (F.trim(quoted(f).cast("string")) == ""))} for f in fields}
        parts.append(long_agg(df, empty, "field").select(F.lit(name).alias("result"), "field", "empty"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- grounding ----

# Fixed value: what counts as a number in a text.
CLAIM = r"-?\d[\d,]*\.?\d*%?"
BIN_STEP = 0.1


def numeric_claims(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys…, claim)``: numbers worth checking; whole numbers below 10 count only with a percent sign."""
    found = texts.select(*[quoted(k) for k in keys], F.explode(F.regexp_extract_all(quoted(text), F.lit(CLAIM), 0)).alias("_m"))
    plain = F.translate(F.rtrim(F.col("_m"), F.lit("%")), ",", "")
    value = plain.try_cast("double")
    keep = F.col("_m").endswith("%") | plain.contains(".") | (F.abs(value) >= 10)
    return found.select(*[quoted(k) for k in keys], F.when(keep, value).alias("claim")).where("claim is not null")


def _bin(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) / BIN_STEP)).cast("int")


def grounded_values(claims: DataFrame, facts: DataFrame, scope: list[str] = (), opts: Options = DEFAULTS) -> DataFrame:
    """Different claims of a scope that lie near some fact. A fact is sown into the few bins its tolerance touches."""
    scope = list(scope)
    known = facts.select(*scope, F.round(F.col("fact").cast("double"), 2).alias("fact")).dropna().distinct()
    reach = F.greatest(F.lit(opts.claim_abs_tol), F.abs("fact") * opts.claim_rel_tol)
    sown = known.withColumn("_reach", reach).withColumn("_bin", F.explode(F.sequence(
        _bin(F.col("fact") - F.col("_reach")) - 1, _bin(F.col("fact") + F.col("_reach")) + 1)))
    asked = claims.select(*scope, "claim").distinct().withColumn("_bin", _bin(F.col("claim")))
    near = F.abs(asked["claim"] - sown["fact"]) <= sown["_reach"]
    on = asked["_bin"] == sown["_bin"]
    for k in scope:
        on = on & (asked[k] == sown[k])
    return asked.join(sown, on & near, "left_semi").drop("_bin")


def ground_claims(texts: DataFrame, facts: DataFrame, keys: list[str], text: str = "text", scope: list[str] = (),
                  opts: Options = DEFAULTS) -> DataFrame:
    """Per text: claims checked, claims grounded, their share (1 without claims)."""
    keys, scope = list(keys), list(scope)
    claims = numeric_claims(texts, keys + [s for s in scope if s not in keys], text)
    counted = cut(claims.groupBy(*claims.columns).agg(F.count("*").alias("_n")))  # the texts are searched once
    good = grounded_values(counted, facts, scope, opts).withColumn("_ok", F.lit(True))
    judged = counted.join(good, scope + ["claim"], "left").groupBy(*keys).agg(
        F.sum("_n").alias("claims_checked"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_n"))), F.lit(0)).alias("claims_grounded"))
    out = texts.select(*[quoted(k) for k in keys]).distinct().join(judged, keys, "left").fillna(0, ["claims_checked", "claims_grounded"])
    return out.withColumn("confidence", F.coalesce(F.round(F.try_divide(F.col("claims_grounded"), F.col("claims_checked")), 3), F.lit(1.0)))
