"""Validation rules, structural issues, reconciliation of derived columns, quality score."""

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import numeric_columns, pct, pearson_agg
from ..functions.reshape import long_agg
from ..functions.text import quoted
from ..options import DEFAULTS, Options
from .cleaning import find_column, is_count_name

# Endings of flag and helper columns.
FLAG_SUFFIXES = ("_parse_failed", "_range_failed", "_rate_failed", "_reconciliation_failed")
COPY_SUFFIXES = ("_raw", "_scaled", "_was_clipped")
# Whole-word column names the money rules look for.
RULE_NAMES = {
    "amount": ["amount", "revenue", "sales", "subtotal"],
    "tax": ["tax_amount", "tax", "vat", "gst"],
    "discount": ["discount_amount", "discount", "rebate", "deduction"],
    "total": ["total_amount", "grand_total", "invoice_total"],
    "margin": ["profit_margin", "derived_profit_margin_pct"],
}


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _number(df: DataFrame, c: str) -> Column:
    return quoted(c).cast("double") if c in set(numeric_columns(df)) else quoted(c).try_cast("double")


def validate_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts are whole and not negative; ``<column>_range_failed`` marks the others."""
    flags = {f"{c}_range_failed": _flag((_number(df, c) < 0) | (F.floor(_number(df, c)) != _number(df, c))) for c in columns}
    return df.select("*", *[e.alias(n) for n, e in flags.items()])


def validate_tax_rate(df: DataFrame, tax: str, amount: str, opts: Options = DEFAULTS) -> DataFrame:
    t, a = _number(df, tax), _number(df, amount)
    return df.withColumn(f"{tax}_rate_failed", _flag((a != 0) & (t > F.abs(a) * opts.rules["max_tax_rate"])))


def validate_total(df: DataFrame, total: str, amount: str, tax: str | None = None, discount: str | None = None,
                   opts: Options = DEFAULTS) -> DataFrame:
    expected = _number(df, amount)
    expected = expected + _number(df, tax) if tax else expected
    expected = expected - _number(df, discount) if discount else expected
    slack = F.greatest(F.lit(opts.rules["abs_tol"]), F.abs(expected) * opts.rules["rel_tol"])
    test = expected.isNotNull() & (F.abs(_number(df, total) - expected) > slack)
    return df.withColumn(f"{total}_reconciliation_failed", _flag(test))


def validate_margin(df: DataFrame, margin: str) -> DataFrame:
    limit = 100.0 if margin.endswith("_pct") else 1.0
    return df.withColumn(f"{margin}_range_failed", _flag(F.abs(_number(df, margin)) > limit))


def rule_columns(columns: list[str]) -> dict[str, str | None]:
    return {role: find_column(columns, words) for role, words in RULE_NAMES.items()}


def validate_all(df: DataFrame, count_columns: list[str], opts: Options = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Every rule that finds its columns; and one row per rule with checks and failures."""
    m = rule_columns(df.columns)
    out, checks = validate_counts(df, count_columns), {}
    for c in count_columns:
        checks[f"{c}_range_failed"] = _number(df, c).isNotNull()
    if m["amount"] and m["tax"]:
        out = validate_tax_rate(out, m["tax"], m["amount"], opts)
        a = _number(df, m["amount"])
        checks[f"{m['tax']}_rate_failed"] = a.isNotNull() & _number(df, m["tax"]).isNotNull() & (a != 0)
    if m["amount"] and m["total"]:
        out = validate_total(out, m["total"], m["amount"], m["tax"], m["discount"], opts)
        parts = [m["amount"], m["total"]] + [c for c in (m["tax"], m["discount"]) if c]
        valid = F.lit(True)
        for c in parts:
            valid = valid & _number(df, c).isNotNull()
        checks[f"{m['total']}_reconciliation_failed"] = valid
    if m["margin"]:
        out = validate_margin(out, m["margin"])
        checks[f"{m['margin']}_range_failed"] = _number(df, m["margin"]).isNotNull()
    return out, rule_totals(out, checks)


def rule_totals(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(rule, checks, failed, fail_pct)`` in one aggregate; ``checks`` says which rows a rule could judge."""
    if not checks:
        return df.sparkSession.createDataFrame([], "rule string, checks long, failed long, fail_pct double")
    return long_agg(df, {r: {
        "checks": F.count_if(valid), "failed": F.coalesce(F.sum(quoted(r)), F.lit(0)),
        "fail_pct": pct(F.coalesce(F.sum(quoted(r)), F.lit(0)), F.count("*"))} for r, valid in checks.items()}, "rule")


# ---- reconciliation of derived columns ----

# Name tokens that carry no concept.
STOP_TOKENS = {"derived", "pct", "percent", "percentage", "per", "with", "to", "of", "the", "a", "amount"}


def concept(name: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", name.lower())) - STOP_TOKENS


def reconciliation_pairs(df: DataFrame, sources: dict[str, list[str]]) -> dict[str, str]:
    """Derived column -> existing numeric column whose name covers its concept."""
    numeric = numeric_columns(df)
    present = {r["column"]: r["share"] for r in long_agg(df, {c: {
        "share": F.coalesce(F.try_divide(F.count(quoted(c)).cast("double"), F.count("*")), F.lit(0.0))} for c in numeric}).collect()}
    out = {}
    for derived, used in sources.items():
        if derived not in numeric or not concept(derived):
            continue
        fits = [c for c in numeric if c not in used and not c.startswith("derived_")
                and not c.endswith(FLAG_SUFFIXES + COPY_SUFFIXES) and present[c] >= 0.8 and concept(derived) <= concept(c)]
        if fits:
            out[derived] = fits[0]
    return out


def reconcile_derived(df: DataFrame, sources: dict[str, list[str]], opts: Options = DEFAULTS) -> DataFrame:
    """Whether a derived column agrees with the column that already holds the concept (r and mean relative error)."""
    pairs = reconciliation_pairs(df, sources)
    schema = "derived_column string, matched_column string, n long, correlation double, mape_pct double, diverged boolean"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    metrics = {}
    for derived, match in pairs.items():
        x, y = quoted(derived).cast("double"), quoted(match).cast("double")
        both = x.isNotNull() & y.isNotNull()
        usable = both & (F.abs(y) > 1e-9)
        error = F.when(usable, F.try_divide(F.abs(x - y), F.abs(y)))
        metrics[derived] = {
            "n": F.count_if(both), "r": pearson_agg(x, y),
            "mape": F.when(F.count_if(usable) >= opts.reconcile_pairs, F.avg(error) * 100)}
    names = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    off = F.coalesce(F.col("r") < opts.reconcile_r, F.lit(False)) | F.coalesce(F.col("mape") > opts.reconcile_mape_pct, F.lit(False))
    return long_agg(df, metrics, "derived_column").where(F.col("n") >= opts.reconcile_pairs).select(
        "derived_column", names[F.col("derived_column")].alias("matched_column"), "n", F.round("r", 4).alias("correlation"),
        F.round("mape", 2).alias("mape_pct"), off.alias("diverged"))


# ---- structural issues ----

def _tokens(c: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", c.lower()))


def structural_rules(df: DataFrame, tags: dict[str, str] | None = None, scales: dict[str, str] | None = None) -> dict[str, Column]:
    """Rule name -> rows that break it, from flags, count columns, percentages, discounts and returns."""
    tags, scales, rules = tags or {}, scales or {}, {}

    def bounds(c):
        return (0.0, 1.0) if scales.get(c) == "ratio" else (0.0, 100.0)

    def outside(c):
        lo, hi = bounds(c)
        return f"{c} out of [{lo:g}, {hi:g}]", (_number(df, c) < lo) | (_number(df, c) > hi)

    for c in df.columns:
        if c.endswith(FLAG_SUFFIXES[1:]):
            rules[c] = _number(df, c) > 0
    for c in df.columns:
        if (tags.get(c) == "count" or c in tags and is_count_name(c)) and f"{c}_range_failed" not in df.columns:
            rules[f"{c} < 0"] = _number(df, c) < 0
    for c in df.columns:
        if tags.get(c) == "percentage":
            rules.__setitem__(*outside(c))
        elif "discount" in _tokens(c):
            if "amount" in _tokens(c):
                rules[f"{c} < 0"] = _number(df, c) < 0
            else:
                rules.__setitem__(*outside(c))
    # Words of return and quantity columns.
    back = {"return", "returns", "returned"}
    amounts = {"quantity", "qty", "count", "units"}
    returned = next((c for c in df.columns if back & _tokens(c) and (amounts & _tokens(c) or _tokens(c) <= back)), None)
    ordered = next((c for c in df.columns if {"order", "ordered"} & _tokens(c) and {"quantity", "qty", "units"} & _tokens(c)), None)
    if returned and dict(df.dtypes)[returned] != "boolean":
        rules[f"{returned} < 0"] = _number(df, returned) < 0
        if ordered and ordered != returned:
            rules[f"{returned} > {ordered}"] = _number(df, returned) > _number(df, ordered)
    return rules


def structural_issues(df: DataFrame, tags: dict[str, str] | None = None, scales: dict[str, str] | None = None,
                      opts: Options = DEFAULTS) -> DataFrame:
    """``(rule, count, pct, review_required)`` for every broken rule, counted in one aggregate."""
    rules = structural_rules(df, tags, scales)
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, count long, pct double, review_required boolean")
    found = long_agg(df, {r: {"count": F.count_if(test), "pct": pct(F.count_if(test), F.count("*"))}
                          for r, test in rules.items()}, "rule")
    return found.where(F.col("count") > 0).withColumn("review_required", F.col("pct") > opts.review_pct)


def structural_summary(df: DataFrame, tags: dict[str, str] | None = None, scales: dict[str, str] | None = None,
                       opts: Options = DEFAULTS) -> DataFrame:
    """Rows that break any rule, and rows that break none of the rules up for review."""
    rules = structural_rules(df, tags, scales)
    names = list(rules)
    hits = df.select(F.array_compact(F.array(*[F.when(rules[r], F.lit(i)) for i, r in enumerate(names)]))
                     .alias("_hit") if names else F.array().cast("array<int>").alias("_hit"))
    review = [names.index(r["rule"]) for r in structural_issues(df, tags, scales, opts).where("review_required").collect()]
    sure = F.size("_hit") > 0
    if review:  # a row with any rule under review does not count as a sure issue
        sure = sure & ~F.arrays_overlap("_hit", F.array(*[F.lit(i) for i in review]))
    any_hit = F.count_if(F.size("_hit") > 0)
    return hits.agg(any_hit.alias("issue_rows"), pct(any_hit, F.count("*")).alias("issue_pct"),
                    F.count_if(sure).alias("confident_rows"), pct(F.count_if(sure), F.count("*")).alias("confident_pct")
                    ).withColumn("review_required", F.lit(bool(review)))


def structural_examples(df: DataFrame, order_by: list[str], tags: dict[str, str] | None = None,
                        scales: dict[str, str] | None = None, opts: Options = DEFAULTS) -> DataFrame:
    """The first rows that break each rule, as JSON."""
    from pyspark.sql import Window
    rules = structural_rules(df, tags, scales)
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, rank int, row string")
    broken = F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t in rules.items()]))
    rows = df.select(*[quoted(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
                     F.to_json(F.struct(*[quoted(c) for c in df.columns])).alias("row"), F.explode(broken).alias("rule"))
    w = Window.partitionBy("rule").orderBy(*[f"_o{i}" for i in range(len(order_by))], "row")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= opts.example_rows).select("rule", "rank", "row")


# ---- score ----

def quality_score(raw_shape: DataFrame, clean: DataFrame, totals: DataFrame, risk: str = "low",
                  opts: Options = DEFAULTS) -> DataFrame:
    """Weighted completeness, consistency and deduplication. ``raw_shape`` is ``profile_shape`` of the raw table."""
    cells = [F.count("*") - F.count(quoted(c)) for c in clean.columns]
    nulls = clean.agg(F.count("*").alias("rows_after"), sum(cells, F.lit(0)).alias("_nulls"))
    rules = totals.agg(F.coalesce(F.sum("checks"), F.lit(0)).alias("_checks"), F.coalesce(F.sum("failed"), F.lit(0)).alias("_failed"))
    one = raw_shape.join(nulls).join(rules)  # one row each
    w = opts.rules
    left = pct(F.col("_nulls"), F.col("rows_after") * len(clean.columns))
    one = one.withColumn("remaining_null_pct", left).withColumn(
        "validation_fail_pct", pct(F.col("_failed"), F.greatest("_checks", F.lit(1))))

    def rest(c):
        return F.round(F.greatest(F.lit(0.0), 100.0 - c), 2)

    one = (one.withColumn("completeness", rest(F.greatest("missing_pct", "remaining_null_pct")))
           .withColumn("consistency", rest(F.col("validation_fail_pct"))).withColumn("deduplication", rest(F.col("duplicate_pct"))))
    score = (w["w_complete"] * F.col("completeness") + w["w_consistent"] * F.col("consistency")
             + w["w_dedup"] * F.col("deduplication") - {"critical": 5.0, "high": 2.5}.get(risk, 0.0))
    return one.select(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 2))).alias("overall_quality_score"),
        F.col("missing_pct").alias("raw_missing_pct"), "remaining_null_pct",
        F.greatest(F.lit(0.0), F.round(F.col("missing_pct") - F.col("remaining_null_pct"), 2)).alias("imputation_burden_pct"),
        "duplicate_pct", "validation_fail_pct", "completeness", "consistency", "deduplication",
        pct(F.col("rows_after"), F.col("row_count")).alias("structure"), F.col("row_count").alias("rows_before"), "rows_after",
        F.lit(risk).alias("risk_assessment"))


def quality_penalty(score: DataFrame, outlier_pct: Column, issue_pct: Column) -> DataFrame:
    """Takes off a little for statistical outliers and a lot for broken rules."""
    soft = F.least(F.lit(5.0), F.greatest(F.lit(0.0), outlier_pct - 3.0) * 0.1)
    hard = F.least(F.lit(40.0), issue_pct * 1.5)
    total = F.round(soft + hard, 2)
    return score.select(
        F.col("overall_quality_score").alias("score_before"), F.round(soft, 2).alias("outlier_penalty"),
        F.round(hard, 2).alias("issue_penalty"), total.alias("total_penalty"),
        F.greatest(F.lit(0.0), F.round(F.col("overall_quality_score") - total, 2)).alias("overall_quality_score"))
