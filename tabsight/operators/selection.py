"""Which columns an analysis uses: selections and roles over blueprints of any number of tables."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import ratio
from ..functions.reshape import long_agg
from ..functions.text import has_token, name_tokens, quoted
from ..options import DEFAULTS, Options
from .rules import COPY_SUFFIXES, FLAG_SUFFIXES

DATE_PART_SUFFIXES = ("_year", "_month", "_quarter", "_day", "_day_of_week", "_is_weekend", "_week_of_year")


def _ends(suffixes) -> Column:
    return F.col("column").rlike("(" + "|".join(suffixes) + ")$")


def _usable() -> Column:
    tag = F.col("semantic_tag")
    return (F.coalesce("analysis_allowed", F.lit(True)) & ~F.coalesce("is_identifier", F.lit(False))
            & ~F.coalesce(tag.isin("datetime", "identifier"), F.lit(False)))


def _is_number() -> Column:
    return F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")


def select_numeric(blueprint: DataFrame, date_parts: bool = False) -> DataFrame:
    """Measures: numbers that are allowed, no keys, no dates, no flags or copies; date parts only on request."""
    off = FLAG_SUFFIXES + COPY_SUFFIXES + (() if date_parts else DATE_PART_SUFFIXES)
    return blueprint.where(_usable() & _is_number() & ~_ends(off))


def select_categorical(blueprint: DataFrame) -> DataFrame:
    label = (F.col("dtype") == "string") | F.col("semantic_tag").isin("categorical_label", "geographic")
    return blueprint.where(_usable() & label & ~_ends(FLAG_SUFFIXES))


def select_datetime(blueprint: DataFrame) -> DataFrame:
    return blueprint.where((F.col("semantic_tag") == "datetime") | (F.col("intended_type") == "datetime"))


# Token phrases per role, tried in this order.
NUMERIC_PHRASES = {
    "discount": ["discount percentage", "discount pct", "discount rate", "discount"],
    "margin": ["profit margin", "margin pct", "margin"],
    "shipping": ["shipping cost", "shipping"],
}
LABEL_PHRASES = {
    "category": ["product category", "category"], "representative": ["sales representative", "representative"],
    "segment": ["customer segment", "segment"], "region": ["region"],
}
FLAG_PHRASES = {"returned": ["returned", "is returned", "return flag"]}
REVENUE_WORDS = ["total_sales", "revenue", "net_sales", "total_amount", "sales"]


def find_roles(blueprint: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``(table_name, role, column)``: the first fitting column per role. ``overrides`` maps role to column."""
    name, tokens = F.lower("column"), name_tokens(F.col("column"))

    def all_tokens(phrase):
        return F.size(F.array_except(F.array(*[F.lit(t) for t in phrase.split()]), tokens)) == 0

    def word(w):
        return name.rlike(rf"\b{w}\b")

    off = FLAG_SUFFIXES + COPY_SUFFIXES + DATE_PART_SUFFIXES
    measure = _usable() & _is_number() & ~_ends(off)
    label = _usable() & ((F.col("dtype") == "string") | F.col("semantic_tag").isin("categorical_label", "geographic"))
    rules = [("revenue", 0, measure & (F.col("financial_role") == "revenue")),
             ("revenue", 1, measure & (F.col("column") == "derived_total_spend")),
             ("revenue", 2, measure & word("(" + "|".join(REVENUE_WORDS) + ")")),
             ("profit", 0, measure & (name == "profit")),
             ("profit", 1, measure & has_token(tokens, ["profit"]) & ~has_token(tokens, ["margin"]))]
    for role, phrases in NUMERIC_PHRASES.items():
        rules += [(role, i, measure & all_tokens(p)) for i, p in enumerate(phrases)]
    for role, phrases in LABEL_PHRASES.items():
        rules += [(role, i, label & (name == p)) for i, p in enumerate(phrases)]
        rules += [(role, 10 + i, label & all_tokens(p)) for i, p in enumerate(phrases)]
    for role, phrases in FLAG_PHRASES.items():
        rules += [(role, i, (F.col("dtype") == "boolean") & all_tokens(p)) for i, p in enumerate(phrases)]
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(r).alias("role"), F.lit(i).alias("rank"))) for r, i, t in rules]))
    found = (blueprint.select("table_name", "column", "position", F.explode(hits).alias("_h"))
             .groupBy("table_name", F.col("_h.role").alias("role"))
             .agg(F.min_by("column", F.struct("_h.rank", "position")).alias("column")))
    if not overrides:
        return found
    asked = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return found.withColumn("column", F.coalesce(asked[F.col("role")], "column"))


def meaningful_variation(df: DataFrame, columns: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """Whether the spread is at least a few percent of the mean."""
    stats = long_agg(df, {c: {"n": F.count(quoted(c)), "mean": F.avg(quoted(c)), "sd": F.stddev_samp(quoted(c))} for c in columns})
    cv = ratio(F.col("sd"), F.abs("mean"))
    return stats.select("column", "n", cv.alias("variation"), F.when(F.col("n") < 2, False).when(
        F.col("mean") == 0, F.col("sd") > 0).otherwise(F.coalesce(cv >= opts.min_variation, F.lit(False))).alias("varies"))
