"""Column tagging: rules over the column profiles of any number of tables.

Input rows are keyed by ``(table_name, column)`` as written by ``profile.full_profile``. Every rule is one expression, so
a catalog of many tables is tagged in one projection; table results are group-bys on ``table_name``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import has_token, name_tokens
from ..options import DEFAULTS, Options
from . import profile as P

# Name tokens per tag, tried in this order.
TAG_WORDS = {
    "identifier": ["id", "identifier", "uuid", "key", "code"],
    "currency": ["sales", "revenue", "profit", "cost", "price", "amount", "budget", "tax", "discount", "total"],
    "percentage": ["percent", "pct", "rate", "margin", "ratio"],
    "count": ["count", "qty", "quantity", "units", "number", "num"],
    "geographic": ["city", "state", "country", "region", "zip", "postal", "latitude", "longitude"],
    "categorical_label": ["status", "segment", "category", "type", "mode", "brand", "channel", "department"],
    "text": ["name", "email", "address", "description", "notes", "message", "password"],
}
TIME_WORDS = ["date", "time", "timestamp", "created", "updated"]
# Name tokens per financial role, tried in this order.
ROLE_WORDS = {
    "customer_income": ["income", "salary", "wage", "wages", "earnings"],
    "revenue": ["revenue", "turnover", "sales"],
    "cost": ["cost", "cogs", "expense", "expenditure"],
    "tax": ["tax", "vat", "gst", "duty"],
    "discount": ["discount", "rebate", "deduction"],
    "budget": ["budget", "target", "planned", "projected"],
    "price": ["price", "rate", "mrp"],
    "spend": ["spend", "spent", "purchase", "purchases"],
}
# Tag -> coarse types that fit it.
FITTING_TYPES = {
    "currency": ["numeric"], "datetime": ["datetime"], "identifier": ["string", "numeric"], "count": ["numeric"],
    "percentage": ["numeric"], "geographic": ["string"], "categorical_label": ["string"],
}
# Null-policy action -> imputation strategy.
ACTION_STRATEGY = {
    "none": "none", "flag_only": "none", "drop_rows": "drop", "drop_column": "drop_column", "impute_mean": "mean",
    "impute_median": "median", "impute_mode": "mode", "impute_unknown_label": "unknown_label",
    "impute_forward_fill": "forward_fill", "impute_knn": "knn", "impute_iterative": "iterative",
}
# Tags whose policy a caller cannot override.
GUARDED_TAGS = ["identifier", "currency", "financial", "datetime"]


def _chain(rules, default) -> Column:
    """First rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(default)


def infer_coarse_type(profile: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    t = F.col("dtype")
    text = t == "string"
    return profile.withColumn("inferred_type", _chain([
        (t.isin("tinyint", "smallint", "int", "bigint", "float", "double") | t.startswith("decimal"), F.lit("numeric")),
        (t == "boolean", F.lit("boolean")),
        (text & (F.col("numeric_pct") >= opts.parse_share), F.lit("numeric")),
        (text & (F.col("datetime_pct") >= opts.parse_share), F.lit("datetime")),
        (text, F.lit("string")),
        (t.startswith("timestamp") | (t == "date"), F.lit("datetime")),
    ], "unknown"))


def semantic_tag(profile: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Adds ``semantic_tag`` to rows that have ``inferred_type``."""
    tokens, kind = name_tokens(F.col("column")), F.col("inferred_type")
    money = F.col("currency_like")
    numeric = (kind == "numeric") | (F.col("numeric_pct") >= opts.parse_share) | money
    named = {tag: has_token(tokens, words) for tag, words in TAG_WORDS.items()}
    few = (F.col("unique_count") < 20) | (F.col("cardinality_ratio") <= 0.2)
    rules = [
        ((kind == "datetime") | (F.col("datetime_pct") >= opts.parse_share) | has_token(tokens, TIME_WORDS), "datetime"),
        (numeric & (named["currency"] | money), "currency"),
        (numeric & named["percentage"], "percentage"),
        (numeric & named["count"], "count"),
        (F.col("candidate_key_hint") | F.col("identifier_like"), "identifier"),
    ]
    rules += [(hit & (kind == "string") if tag == "text" else hit, tag) for tag, hit in named.items()]
    rules += [
        (money & kind.isin("numeric", "string"), "currency"),
        (money | F.col("at_like"), "text"),
        (F.col("date_like") | F.col("iso_like"), "datetime"),
        ((kind == "string") & few, "categorical_label"),
        (kind == "string", "text"),
    ]
    return profile.withColumn("semantic_tag", _chain([(t, F.lit(v)) for t, v in rules], "unknown"))


def intended_type(profile: DataFrame) -> DataFrame:
    kind = F.col("inferred_type")
    return profile.withColumn("intended_type", F.when(kind == "numeric", "float")
                              .when(kind.isin("datetime", "string", "boolean"), kind).otherwise("string"))


def financial_role(profile: DataFrame) -> DataFrame:
    tokens, tag = name_tokens(F.col("column")), F.col("semantic_tag")
    off = (tag == "identifier") | ((F.col("inferred_type") != "numeric") & (tag != "currency"))
    rules = [(off, F.lit(None).cast("string"))]
    rules += [(has_token(tokens, words), F.lit(role)) for role, words in ROLE_WORDS.items()]
    rules += [(F.lower("column").startswith("mnt"), F.lit("spend")), (tag == "currency", F.lit("unknown_financial"))]
    return profile.withColumn("financial_role", _chain(rules, None))


def semantic_confidence(profile: DataFrame) -> DataFrame:
    """Score 0-100 from name, type fit, format hints, cardinality, minus penalties; and its level."""
    tokens, tag, kind = name_tokens(F.col("column")), F.col("semantic_tag"), F.col("inferred_type")

    def points(test, n):
        return F.when(test, float(n)).otherwise(0.0)

    by_name = reduce(lambda a, b: a | b, [(tag == t) & has_token(tokens, w) for t, w in TAG_WORDS.items()])
    fits = reduce(lambda a, b: a | b, [(tag == t) & kind.isin(k) for t, k in FITTING_TYPES.items()])
    score = (
        50.0 + points(by_name, 20)
        + F.when(fits, 15.0).when(tag.isin(list(FITTING_TYPES)), -10.0).otherwise(0.0)
        + points((tag == "currency") & F.col("currency_like"), 15)
        + points((tag == "datetime") & F.col("date_like"), 15)
        + points((tag == "identifier") & F.col("identifier_like"), 10)
        + points((tag == "identifier") & (F.col("missing_pct") == 0), 10)
        + points((tag == "identifier") & F.col("candidate_key_hint"), 5)
        + points((tag == "categorical_label") & (F.col("unique_count") > 1) & (F.col("unique_count") < 20), 10)
        - points(F.col("missing_pct") > 50, 10) - points(F.col("has_outliers"), 5))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 2)))
    return profile.withColumn("confidence_score", bounded).withColumn(
        "confidence_level", F.when(F.col("confidence_score") >= 80, "high")
        .when(F.col("confidence_score") >= 60, "medium").otherwise("low"))


def table_signals(df: DataFrame, table_name: str, opts: Options = DEFAULTS) -> DataFrame:
    """The table-level numbers that ``quality_signals`` judges."""
    shape = P.profile_shape(df).select("missing_pct", "duplicate_pct", F.col("column_count").alias("columns"))
    hidden = P.implicit_missing(df, opts).agg(F.count_distinct("column").alias("implicit_columns"))
    outliers = P.outlier_iqr(df, opts=opts).agg(F.count_if("has_outliers").alias("outlier_columns"))
    return shape.join(hidden).join(outliers).select(F.lit(table_name).alias("table_name"), "*")  # one row each


def quality_signals(signals: DataFrame) -> DataFrame:
    m, d = F.col("missing_pct"), F.col("duplicate_pct")
    hidden, out = F.col("implicit_columns"), F.col("outlier_columns")
    critical = (m >= 30) | (d >= 8) | (hidden >= 4)
    high = (m >= 15) | (d >= 3) | (out >= F.greatest(F.lit(1), F.floor(F.col("columns") / 3)))

    def left(x):
        return F.round(F.greatest(F.lit(0.0), 100.0 - x), 2)

    return signals.select(
        "*",
        F.when(critical, "critical").when(high, "high").when((m >= 5) | (out > 0), "moderate").otherwise("low")
        .alias("risk_assessment"),
        F.when(critical | high, "strict").when((m >= 5) | (out > 0), "balanced").otherwise("lenient")
        .alias("recommendation"),
        left(m).alias("completeness"), left(d).alias("duplication"), left(hidden * 12.5).alias("implicit_missingness"),
        left(out * 12.5).alias("distribution_health"))


def column_suitability(profile: DataFrame) -> DataFrame:
    tag, m = F.col("semantic_tag"), F.col("missing_pct")
    pressure = F.round((1 - F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1))) * 100, 2)
    label = tag.isin("categorical_label", "geographic", "text")
    number = tag.isin("currency", "percentage", "count") | F.col("intended_type").isin("float", "int")
    fit = (F.when(tag == "identifier", (m <= 5) & (pressure <= 5))
           .when(label, (m <= 30) & (F.col("unique_count") > 0)).when(tag == "datetime", m <= 25)
           .when(number, m <= 35).otherwise((m <= 20) & (pressure <= 95)))
    # The names of the reasons.
    reason = (F.when(tag == "identifier", F.when(pressure > 5, "identifier_duplicates").otherwise("identifier_clean"))
              .when(label, F.when(F.col("unique_count") < 20, "low_cardinality_category").otherwise("text_or_label"))
              .when(tag == "datetime", "datetime_missingness").when(number, "numeric_missingness")
              .otherwise("unknown_semantics"))
    return profile.withColumn("duplicate_pressure_pct", pressure).withColumn("is_suitable", fit).withColumn(
        "reason_category", F.when(~F.col("is_suitable") & (m > 60), "too_sparse").otherwise(reason))


def _numeric_policy(limit: float) -> list:
    m, r = F.col("missing_pct"), F.col("max_abs_r")
    calm = F.col("is_normal") & ~F.col("has_outliers") & (m <= 20)
    return [
        ((F.col("partners") >= 2) & (r >= 0.9) & m.between(10, 35), "impute_iterative", 35.0),
        ((r >= 0.85) & m.between(10, 30), "impute_knn", 30.0),
        (F.lit(limit == 30.0) & (m <= 10) & F.col("has_datetime"), "impute_forward_fill", 10.0),
        (m >= limit, "flag_only", limit),
        (calm, "impute_mean", 20.0),
        (F.lit(True), "impute_median", limit),
    ]


def null_policy(profile: DataFrame) -> DataFrame:
    """Adds the action for missing values and the missing share it is meant for."""
    m, n, tag, kind = F.col("missing_pct"), F.col("unique_count"), F.col("semantic_tag"), F.col("intended_type")
    diversity = n - (F.col("missing_count") > 0).cast("int")  # the distinct count takes null as a value
    time, label = (tag == "datetime") | (kind == "datetime"), tag == "categorical_label"
    measured = tag.isin("percentage", "count", "physical_measurement")
    rules = [
        (m <= 0, "none", 0.0),
        (tag == "identifier", "drop_rows", 0.0),
        (tag.isin("currency", "financial"), "flag_only", 0.0),
        (time & (m >= 25), "flag_only", 25.0),
        (time, "none", 25.0),
        (tag.isin("geographic", "text"), "flag_only", 20.0),
        ((tag == "unknown") & ~kind.isin("float", "int", "boolean"), "flag_only", 0.0),
        (m >= 60, "drop_column", 60.0),
        (label & (m >= 40), "flag_only", 40.0),
        (label & n.between(1, 5) & (m <= 15) & (diversity <= 2), "impute_mode", 15.0),
        (label & n.between(1, 20) & (m <= 25), "impute_unknown_label", 25.0),
        (label, "flag_only", 30.0),
    ]
    rules += [(measured & test, action, limit) for test, action, limit in _numeric_policy(30.0)]
    rules += [
        ((kind == "boolean") & (m <= 10), "impute_mode", 10.0),
        (kind == "boolean", "flag_only", 10.0),
        ((kind == "string") & n.between(1, 20) & (m <= 20), "impute_mode", 20.0),
        (kind == "string", "flag_only", 20.0),
    ]
    rules += [(kind.isin("float", "int") & test, action, limit) for test, action, limit in _numeric_policy(35.0)]
    return profile.withColumn("null_action", _chain([(t, F.lit(a)) for t, a, _ in rules], "flag_only")).withColumn(
        "null_threshold_pct", _chain([(t, F.lit(x)) for t, _, x in rules], 20.0))


def _strategy(action: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ACTION_STRATEGY.items() for x in kv])[action], F.lit("none"))


def null_policy_resolve(policy: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Caller overrides ``(table_name, column, null_action, imputation_strategy)`` win, but never on guarded tags.

    An override action counts only when it is known and its strategy is empty or agrees; else a known strategy alone.
    """
    if overrides is None:
        return policy.withColumn("imputation_strategy", _strategy(F.col("null_action")))
    asked = overrides.select("table_name", "column", F.lower("null_action").alias("_a"),
                             F.lower("imputation_strategy").alias("_s"))
    known = F.col("_a").isin(list(ACTION_STRATEGY))
    agrees = F.coalesce("_s", F.lit("")).isin("", "none") & (_strategy(F.col("_a")) == "none") | (
        F.coalesce("_s", F.lit("")) == "") | (F.col("_s") == _strategy(F.col("_a")))
    back = {s: a for a, s in ACTION_STRATEGY.items() if a != "flag_only"}
    from_strategy = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])[
        F.when(~F.col("_s").isin("", "none"), F.col("_s"))]
    free = ~F.col("semantic_tag").isin(GUARDED_TAGS)
    chosen = F.when(free & known & agrees, F.col("_a")).when(free, from_strategy)
    return (policy.join(asked, ["table_name", "column"], "left")
            .withColumn("null_action", F.coalesce(chosen, "null_action"))
            .withColumn("imputation_strategy", _strategy(F.col("null_action"))).drop("_a", "_s"))


def encoding_strategy(profile: DataFrame, overrides: DataFrame | None = None, opts: Options = DEFAULTS) -> DataFrame:
    """``one_hot`` for labels of 2-20 values; overrides ``(table_name, column, encoding)`` win."""
    tag, kind, n = F.col("semantic_tag"), F.col("intended_type"), F.col("unique_count")
    off = (tag == "identifier") | tag.isin("datetime", "text") | kind.isin("datetime", "boolean")
    label = (tag == "categorical_label") | kind.isin("string", "category")
    derived = F.when(off, "none").when(label & n.between(2, opts.one_hot_max), "one_hot").otherwise("none")
    if overrides is None:
        return profile.withColumn("encoding", derived)
    asked = overrides.select("table_name", "column", F.lower("encoding").alias("_e"))
    return (profile.join(asked, ["table_name", "column"], "left")
            .withColumn("encoding", F.when(F.col("_e").isin("one_hot", "ordinal", "none"), F.col("_e")).otherwise(derived))
            .drop("_e"))


def unit_scale(profile: DataFrame) -> DataFrame:
    share, count = F.col("semantic_tag") == "percentage", F.col("semantic_tag") == "count"
    ratio = share & (F.col("p95") <= 1.0)
    return (profile.withColumn("unit_scale", F.when(ratio, "ratio").when(share, "percent").when(count, "items"))
            .withColumn("lower_bound", F.when(share | count, 0.0))
            .withColumn("upper_bound", F.when(ratio, 1.0).when(share, 100.0))
            .withColumn("whole_numbers", count))


def analysis_allowed(profile: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    return profile.withColumn("analysis_allowed",
                              F.col("is_suitable") & (F.col("missing_pct") <= opts.analysis_missing_pct))


def correlation_partners(correlations: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Per column the largest \\|r\\| and its three strongest partners."""
    both = correlations.select(F.col("col1").alias("column"), F.col("col2").alias("partner"), "r").unionAll(
        correlations.select(F.col("col2").alias("column"), F.col("col1").alias("partner"), "r"))
    w = Window.partitionBy("column").orderBy(F.abs("r").desc(), "partner")
    return (both.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
            .withColumn("max_abs_r", F.max(F.abs("r")).over(Window.partitionBy("column"))))


def fallback_blueprint(profile: DataFrame) -> DataFrame:
    """Defaults before any rule: unknown tag, nothing filled, numbers may be scaled."""
    return intended_type(profile).select(
        "table_name", "column", "intended_type", F.lit("unknown").alias("semantic_tag"), F.lit(False).alias("is_identifier"),
        (F.col("inferred_type") == "numeric").alias("scaling_allowed"), F.lit("none").alias("imputation_strategy"),
        F.lit("flag_only").alias("null_action"), F.lit(20.0).alias("null_threshold_pct"),
        F.lit(True).alias("analysis_allowed"))


def blueprint(profile: DataFrame, overrides: DataFrame | None = None, opts: Options = DEFAULTS) -> DataFrame:
    """All rules in order. Overrides may hold null_action, imputation_strategy and encoding per column."""
    out = intended_type(semantic_tag(infer_coarse_type(profile, opts), opts))
    out = unit_scale(financial_role(out))
    out = null_policy_resolve(null_policy(column_suitability(out)), overrides)
    out = analysis_allowed(encoding_strategy(out, overrides, opts), opts)
    out = out.withColumn("is_identifier", F.col("semantic_tag") == "identifier").withColumn(
        "scaling_allowed", F.col("inferred_type") == "numeric")
    return semantic_confidence(out)


# Name parts that mark a finance table.
FINANCE_PARTS = ["amount", "revenue", "cost", "tax", "price", "discount", "sales", "profit", "margin", "invoice"]


def domain_detect(blueprint: DataFrame) -> DataFrame:
    """Per table: finance or generic, and the rule profile that follows from it."""
    named = F.lower("column").rlike("|".join(FINANCE_PARTS))
    finance = (F.col("names") >= 3) | (F.col("tags") >= 2)
    return blueprint.groupBy("table_name").agg(
        F.count_if(named).alias("names"), F.count_if(F.col("semantic_tag").isin("currency", "percentage")).alias("tags")
    ).select("*", F.when(finance, "finance_sales").otherwise("generic").alias("domain"),
             F.when(finance, "strict").otherwise("balanced").alias("rule_profile"))
