"""How telling each result is, and the results worth showing."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..options import DEFAULTS, Options


def _scored(df: DataFrame, family: str, subject: Column, score: Column) -> DataFrame:
    bounded = F.round(F.least(F.lit(100.0), score), 1)
    return df.select(F.lit(family).alias("family"), subject.alias("subject"), bounded.alias("score")).where("score is not null")


def correlation_scores(pairs: DataFrame) -> DataFrame:
    """Largest \\|r\\|, if it is worth a look at all."""
    top = pairs.agg(F.max(F.abs("r")).alias("r")).where(F.col("r") >= 0.3)
    return _scored(top, "correlation", F.lit("all"), F.col("r") * 100)


def strongest_pair_score(strong: DataFrame) -> DataFrame:
    top = strong.where("kind = 'strong'").agg(F.max(F.struct(F.abs("pearson_r").alias("a"), "col1", "col2")).alias("p"))
    return _scored(top, "strongest_pair", F.concat_ws(" ~ ", "p.col1", "p.col2"), F.col("p.a") * 100)


def growth_scores(growth: DataFrame, family: str) -> DataFrame:
    return _scored(growth.agg(F.max(F.abs("growth_pct")).alias("g")), family, F.lit("revenue"), F.col("g"))


def ranking_scores(totals: DataFrame, family: str = "ranking") -> DataFrame:
    """Spread of the shares within each dimension."""
    s = totals.groupBy("dimension").agg(F.sum("total").alias("t"), F.max("total").alias("hi"), F.min("total").alias("lo"))
    return _scored(s, family, F.col("dimension"), F.try_divide(F.col("hi") - F.col("lo"), F.col("t")) * 100)


def season_scores(season: DataFrame, family: str) -> DataFrame:
    s = season.agg(F.max("average").alias("hi"), F.min("average").alias("lo"))
    return _scored(s, family, F.lit("revenue"), F.abs(F.col("hi") - F.col("lo")) / F.greatest(F.abs("lo"), F.lit(1e-9)) * 100)


def category_scores(distribution: DataFrame) -> DataFrame:
    """Distance of the largest share from an even split."""
    s = distribution.groupBy("column").agg(F.max("pct").alias("top"), F.count("*").alias("n"))
    return _scored(s, "category", F.col("column"), F.greatest(F.lit(15.0), F.col("top") - 100.0 / F.col("n")))


def trend_scores(trends: DataFrame) -> DataFrame:
    return _scored(trends.where("significant"), "trend", F.col("column"), F.col("r_squared") * 100)


def skew_scores(described: DataFrame) -> DataFrame:
    return _scored(described, "histogram", F.col("column"), F.abs("skewness") * 15 + 35)


def insight_ranking(scored: list[DataFrame], opts: Options = DEFAULTS) -> DataFrame:
    """The highest scores of all families together."""
    rows = reduce(lambda a, b: a.unionByName(b), scored)
    w = Window.orderBy(F.desc("score"), "family", "subject")
    # One row per result of a run: columns and dimensions, not data.
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= opts.keep_insights)
