"""A whole run over one table: profile, tag, clean, analyse, check, facts. Every result is a DataFrame."""

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from ..functions.numbers import datetime_columns, nan_to_null, numeric_columns, string_columns
from ..operators import (anomalies, blueprint as tagging, categories, cleaning, correlation, dedup, facts, imputation, profile, rankings,
                         rules, selection, stats, timeseries, validate)
from ..options import DEFAULTS, Options


@dataclass
class Results:
    """What a run leaves behind. ``tables`` holds the small result frames by name."""
    raw: DataFrame
    cleaned: DataFrame
    blueprint: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def tag_table(df: DataFrame, table_name: str, order_by=None, overrides=None, opts: Options = DEFAULTS) -> DataFrame:
    """Profile and blueprint, one row per column, computed once: every later step reads these few rows."""
    spark, measured = df.sparkSession, profile.full_profile(df, table_name, order_by, opts)
    plan = tagging.blueprint(spark.createDataFrame(measured.collect(), measured.schema), overrides, opts)
    return spark.createDataFrame(plan.orderBy("position").collect(), plan.schema)


def _columns(rows, test) -> list[str]:
    return [r["column"] for r in rows if test(r)]


def clean_table(df: DataFrame, rows: list, keys=None, order_by=None, risk: str = "low", ordinal: dict[str, list[str]] | None = None,
                opts: Options = DEFAULTS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All cleaning steps in their fixed order. ``rows`` are the blueprint rows; returns the table and the step results."""
    out = {}
    text = set(string_columns(df))
    money = _columns(rows, lambda r: r["semantic_tag"] == "currency" and r["column"] in text and r["numeric_pct"] + r["currency_like"] > 0)
    types = {r["column"]: r["intended_type"] for r in rows if r["column"] not in money}
    labels = _columns(rows, lambda r: r["column"] in text and r["column"] not in money and not r["is_identifier"]
                      and (r["semantic_tag"] in ("categorical_label", "geographic") or r["encoding"] in ("one_hot", "ordinal")))
    geographic = set(_columns(rows, lambda r: r["semantic_tag"] == "geographic"))

    exact = dedup.dedup_exact(df)
    table = cleaning.coerce_types(cleaning.clean_currency(exact, money), types)
    if money:
        out["currency_checks"] = cleaning.currency_checks(table, money, opts)
    table = cleaning.canonical_text(table, labels)
    merged, out["merges"] = categories.fuzzy_category_merge(table, labels, geographic, opts)
    # Everything below reads the table several times for its statistics; the long plan ends here.
    canonical = written(dedup.distinct_rows(merged), "canonical")

    roles = {r["column"]: r["financial_role"] for r in rows if r["financial_role"]}
    table, sources = cleaning.derive_metrics(canonical, roles)
    out["derivations"] = cleaning.derivation_table(df.sparkSession, sources)
    out["reconciliation"] = rules.reconcile_derived(table, sources, opts)
    counts = _columns(rows, lambda r: r["column"] in numeric_columns(table) and (
        r["semantic_tag"] == "count" or cleaning.is_count_name(r["column"])))
    table, out["rule_totals"] = rules.validate_all(table, counts, opts)

    actions = {r["column"]: r["null_action"] for r in rows if r["null_action"] not in ("none", "flag_only")}
    tags = {r["column"]: r["semantic_tag"] for r in rows}
    needed = {"impute_knn": keys, "impute_forward_fill": order_by}
    for action, given in needed.items():
        if action in actions.values() and not given:
            raise ValueError(f"{action} needs {'keys' if action == 'impute_knn' else 'order_by'}")
    features = _columns(rows, lambda r: r["column"] in numeric_columns(table)
                        and r["semantic_tag"] not in ("identifier", "datetime", "currency", "financial"))
    filled = imputation.impute_plan(table, actions, tags, keys, order_by, features, opts)

    allowed = {r["column"]: r for r in rows if r["analysis_allowed"] and r["column"] in filled.columns}
    for c, r in allowed.items():
        if r["encoding"] == "one_hot" and c in labels:
            filled = cleaning.encode_one_hot(filled, c, opts)
        elif r["encoding"] == "ordinal" and (ordinal or {}).get(c):
            filled = cleaning.encode_ordinal(filled, c, ordinal[c])
    scalable = _columns(rows, lambda r: r["scaling_allowed"] and not r["is_identifier"] and r["column"] in numeric_columns(filled)
                        and r["semantic_tag"] not in ("currency", "financial", "datetime", "identifier"))
    skewed = set(_columns(rows, lambda r: r["has_outliers"] or r["distribution_type"] in ("right_skewed", "left_skewed")))
    clipped = cleaning.clip_outliers(filled, scalable, risk, skewed, opts) if scalable else filled
    to_scale = [c for c in scalable if not cleaning.is_count_name(c) and tags.get(c) != "count"]
    scaled = clipped
    if to_scale:
        scaled, out["scaling"] = cleaning.scale_minmax(clipped, to_scale)
    dates = _columns(rows, lambda r: r["semantic_tag"] == "datetime" and r["column"] in scaled.columns)
    final = cleaning.date_features(scaled, dates)
    out["row_accounting"] = dedup.row_accounting(df, exact, canonical, filled)
    return final, out


def analyse_table(clean: DataFrame, plan: DataFrame, rows: list, derivations: DataFrame, opts: Options = DEFAULTS) -> dict[str, DataFrame]:
    """Statistics off the cleaned table; an analysis without its columns is left out."""
    kinds = F.create_map(*[F.lit(x) for kv in clean.dtypes for x in kv])
    plan = plan.where(F.col("column").isin(clean.columns)).withColumn("dtype", kinds[F.col("column")])
    measures = [r["column"] for r in selection.select_numeric(plan).orderBy("position").collect()]
    derived = [c for c in numeric_columns(clean) if c.startswith("derived_") and not c.endswith(rules.FLAG_SUFFIXES)]
    numeric = measures + derived
    labels = [r["column"] for r in selection.select_categorical(plan).orderBy("position").collect()]
    dates = [r["column"] for r in selection.select_datetime(plan).orderBy("position").collect() if r["column"] in datetime_columns(clean)]
    roles = {r["role"]: r["column"] for r in selection.find_roles(plan).collect()}
    sources = {}
    for r in derivations.collect():
        sources.setdefault(r["derived"], []).append(r["source"])
    tags = {r["column"]: r["semantic_tag"] for r in rows}
    scales = {r["column"]: r["unit_scale"] for r in rows if r["unit_scale"]}
    out = {"structural_issues": rules.structural_issues(clean, tags, scales, opts),
           "structural_summary": rules.structural_summary(clean, tags, scales, opts)}
    if numeric:
        out["describe"] = stats.describe_numeric(clean, numeric, opts)
        found = anomalies.anomaly_rules(clean, numeric, opts)
        out["anomalies"] = anomalies.anomalies(clean, numeric, opts, found)
        out["anomaly_impact"] = anomalies.anomaly_impact(clean, numeric, opts, found)
        out["anomaly_summary"] = anomalies.anomaly_summary(clean, numeric, opts, found)
    if len(numeric) >= 2:
        out["pearson"] = correlation.corr_pearson(clean, numeric)
        out["spearman"] = correlation.corr_spearman(clean, numeric, opts)
        out["strong_pairs"] = correlation.strong_pairs(
            out["pearson"], correlation.formulaic_pairs(clean, numeric, sources), correlation.leakage_columns(clean, out["pearson"]), opts)
    if labels:
        out["categories"] = stats.category_distribution(clean, labels)
    if dates and numeric:
        out["trends"] = timeseries.trend_regression(clean, numeric, dates[0], opts=opts)
    revenue, profit = roles.get("revenue"), roles.get("profit") or ("derived_profit" if "derived_profit" in numeric else None)
    if revenue and dates:
        out["growth_monthly"] = timeseries.growth_monthly(clean, dates[0], revenue)
        out["growth_quarterly"] = timeseries.growth_quarterly(clean, dates[0], revenue)
        out["seasonality_month"] = timeseries.seasonality_month(clean, dates[0], revenue)
        out["seasonality_quarter"] = timeseries.seasonality_quarter(clean, dates[0], revenue)
        out["seasonality_weekday"] = timeseries.seasonality_weekday(clean, dates[0], revenue)
    if revenue and labels:
        totals = rankings.dimension_totals(clean, revenue, labels)
        out["dimensions"] = rankings.select_dimensions(totals, labels, opts)
        out["rankings"] = rankings.ranked(totals.join(out["dimensions"].select("dimension"), "dimension", "left_semi"), opts)
    if profit and labels:
        out["profit_breakdown"] = rankings.profit_breakdown(clean, profit, labels, opts)
    if "discount" in roles and "returned" in roles:
        out["discount_return_rate"] = stats.discount_return_rate(clean, roles["discount"], roles["returned"], opts=opts)
    if "segment" in roles and revenue:
        out["order_value_by_segment"] = stats.order_value_by_segment(clean, roles["segment"], revenue)
    if "region" in roles and "shipping" in roles:
        out["shipping_cost_by_region"] = stats.shipping_cost_by_region(clean, roles["region"], roles["shipping"])
    if "representative" in roles and "discount" in roles and "margin" in roles:
        out["discount_margin_by_rep"] = stats.discount_margin_by_rep(clean, roles["representative"], roles["discount"], roles["margin"])
    if "category" in roles and "margin" in roles and dates:
        out["margin_by_category_month"] = stats.margin_by_category_month(clean, roles["category"], f"{dates[0]}_month", roles["margin"])
    if "derived_days_to_ship" in clean.columns:
        out["lead_time"] = stats.lead_time(clean, "derived_days_to_ship", opts)
        if labels:
            out["lead_time_by"] = stats.lead_time_by(clean, "derived_days_to_ship", labels, opts=opts)
    return out


def check_run(results: Results, table_name: str, run_id: int = 1, opts: Options = DEFAULTS) -> dict[str, DataFrame]:
    """The output checks of one run; frames of many runs can be unioned and checked the same way."""
    t, tag = results.tables, {"table_name": F.lit(table_name), "run_id": F.lit(run_id)}
    after = profile.null_counts(results.cleaned).withColumns(tag)
    plan = results.blueprint.withColumn("run_id", F.lit(run_id)).withColumn("dropped", F.col("null_action") == "drop_column")
    checks = [
        validate.check_rows(results.cleaned.agg(F.count("*").alias("rows")).withColumns(tag),
                            t["row_accounting"].select("final_rows").withColumns(tag)),
        validate.check_schema(plan, after)]
    if "describe" in t and "pearson" in t:
        long = t["describe"].select(F.explode(F.array("mean", "median", "std", "min", "max")).alias("value")).withColumns(tag)
        checks.append(validate.check_bounds(t["quality"].select(F.col("overall_quality_score").alias("score")).withColumns(tag), long,
                                            t["pearson"].select("r").withColumns(tag)))
    if "trends" in t:
        checks.append(validate.check_trend_n(t["trends"].withColumns(tag), opts))
    checks.append(validate.check_rules(t["rule_totals"].withColumns(tag), opts))
    columns = [c for c in string_columns(results.raw) if c in results.cleaned.columns]
    if columns:
        counts = categories.label_counts(cleaning.canonical_text(results.raw, columns), columns).withColumnRenamed("label", "value")
        merges = validate.check_merges(t["merges"].withColumns(tag), counts.withColumns(tag), opts)
        checks.append(validate.merges_verdict(merges))
    review = t["structural_summary"].select("review_required").withColumns(tag)
    return {"validation": validate.validation_score(checks, review)}


def run(df: DataFrame, table_name: str, keys: list[str] | None = None, order_by: list[str] | None = None, overrides: DataFrame | None = None,
        ordinal: dict[str, list[str]] | None = None, opts: Options = DEFAULTS, rule_profile: str | None = None) -> Results:
    """Profile, tag, clean, analyse and check one table.

    ``keys`` name a row, ``order_by`` gives the row order, ``overrides`` are per-column choices of the caller. The raw
    table is kept at hand and the cleaned one is written, because many aggregates read them; the driver sees only rows per
    column.
    """
    raw = nan_to_null(df).persist(StorageLevel.MEMORY_AND_DISK)
    plan = tag_table(raw, table_name, order_by, overrides, opts)
    rows = plan.collect()
    domain = tagging.domain_detect(plan).first()
    opts = replace(opts, rule_profile=rule_profile or domain["rule_profile"])
    signals = tagging.quality_signals(tagging.table_signals(raw, table_name, opts))
    risk = signals.first()["risk_assessment"]
    clean, tables = clean_table(raw, rows, keys, order_by, risk, ordinal, opts)
    clean = written(clean, "cleaned")
    results = Results(raw, clean, plan, tables)
    tables["shape"], tables["signals"] = profile.profile_shape(raw), signals
    tables.update(analyse_table(clean, plan, rows, tables["derivations"], opts))
    tables["quality"] = rules.quality_score(tables["shape"], clean, tables["rule_totals"], risk, opts)
    if "anomaly_summary" in tables:
        joined = tables["quality"].join(tables["anomaly_summary"].select("flagged_row_pct")).join(
            tables["structural_summary"].select("confident_pct"))  # one row each
        tables["quality_adjusted"] = rules.quality_penalty(joined, F.col("flagged_row_pct"), F.col("confident_pct"))
    tables["shape_explanation"] = facts.shape_explanation(profile.null_counts(raw), profile.null_counts(clean), tables["row_accounting"])
    tables["missing_action"] = facts.missing_action(
        profile.null_counts(raw).withColumn("missing_pct", F.round(F.col("missing_count") * 100.0 / F.greatest("rows", F.lit(1)), 2)),
        plan, profile.null_counts(clean))
    tables["normalization"] = facts.normalization_facts(tables["merges"])
    if "rankings" in tables:
        tables["rank_slices"] = facts.rank_slices(tables["rankings"], opts)
    tables.update(check_run(results, table_name, opts=opts))
    return results
