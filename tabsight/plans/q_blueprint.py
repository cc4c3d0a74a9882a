"""Queries of the tagging rules, over the profiles of several tables."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import blueprint as B, profile as P
from .registry import query
from .views import MESSY_SQL, SALES_SQL, messy_sales, sales, table

CATALOG = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                 "c_mktsegment": "string"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"},
    "messy_sales": {"order_id": "bigint", "amount": "string", "status": "string", "priority": "string",
                    "segment": "string", "order_date": "string", "quantity": "double", "unit_price": "double",
                    "discount_rate": "double", "tax": "double", "sales": "double", "active": "string"},
    "sales": {"order_id": "bigint", "region": "string", "customer_segment": "string", "product_category": "string",
              "sales_representative": "string", "units_sold": "double", "net_sales": "double", "profit": "double",
              "profit_margin": "double", "discount_percentage": "double", "shipping_cost": "double", "returned": "boolean"},
}

FILES = ("lineitem", "orders", "customer", "nation", "region", "part", *(t for t in CATALOG if t not in ("sales", "messy_sales")))
JOINED_ON = {"messy_sales": "order_id", "sales": "order_id"}
_profiles = {}


def _load(spark, d, name):
    if name == "messy_sales":
        return messy_sales(spark, d, *CATALOG[name])
    return sales(spark, d, *CATALOG[name]) if name == "sales" else table(spark, d, name)


def catalog_profile(spark, d):
    """The profile of all tables, written once for a state of their files and then read by every rule.

    The state is the path, size and time of every file, so changed data is profiled anew.
    """
    files = [table(spark, d, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for t in FILES]
    state = tuple(sorted(tuple(map(str, r)) for f in files for r in f.collect()))
    key = (spark.sparkContext.applicationId, state)
    if key not in _profiles:
        _profiles[key] = written(reduce(lambda a, b: a.unionByName(b), [P.full_profile(_load(spark, d, t), t, join_key=JOINED_ON.get(t)) for t in CATALOG]), "profile")
    return _profiles[key]


def _profile_sql(t, schema):
    numbers = [c for c, k in schema.items() if k in ("bigint", "int", "double")]
    order = ", ".join(f'"{o}" NULLS FIRST' for o in schema)
    dated = "true" if "timestamp_ntz" in schema.values() else "false"
    parts = []
    for c, k in schema.items():
        if k == "string":
            often = lambda test: f"""count("{c}") > 0 AND count(*) FILTER ({test.format(v=f'"{c}"')}) >= 0.1 * count("{c}")"""
            shares = f"""{often("regexp_matches({v}, '[$€£¥₹]')")} AS money, {often("contains(trim({v}), '-') AND length(trim({v})) >= 8")} AS dashed,
              {often("contains({v}, '@')")} AS at_like, {often("regexp_matches({v}, '^\\s*[0-9][0-9][0-9][0-9]') AND contains({v}, '-')")} AS iso_like"""
            dates = f"""coalesce(round(count(*) FILTER (regexp_matches("{c}", '^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}$|^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$|^[0-9]{{2}} [A-Z][a-z]{{2}} [0-9]{{4}}$')) * 100.0 / count("{c}"), 2), 0)"""
            nums = f"""coalesce(round(count(*) FILTER (regexp_matches("{c}", '^\\s*[0-9]+\\s*$')) * 100.0 / count("{c}"), 2), 0)"""
        else:
            nums = "0.0"
            shares = f"false AS money, {str(k == 'timestamp_ntz').lower()} AS dashed, false AS at_like, {str(k == 'timestamp_ntz').lower()} AS iso_like"
            dates = "100.0" if k == "timestamp_ntz" else "0.0"
        if c in numbers:
            rs = ", ".join(f'abs(corr("{c}", "{o}"))' for o in numbers if o != c) or "NULL"
            strong = f"(SELECT {{}} FROM (SELECT round(unnest([{rs}]), 4) AS r FROM {t}) WHERE r >= 0.5 AND NOT isnan(r))"
            q = f'(SELECT quantile_cont(CAST("{c}" AS DOUBLE), [0.25, 0.75, 0.95]) FROM {t})'
            fence = f"""max(q) AS q, count(*) FILTER ("{c}" < q[1] - 1.5 * (q[2] - q[1]) OR "{c}" > q[2] + 1.5 * (q[2] - q[1])) > 0"""
            extra = (f"""(SELECT o FROM (SELECT {fence} AS o FROM {t}, (SELECT {q} AS q))) AS has_outliers,
              coalesce(skewness("{c}"), 0) AS s, coalesce(kurtosis("{c}"), 0) AS ku,
              coalesce({strong.format('max(r)')}, 0) AS max_abs_r, coalesce({strong.format('count(*)')}, 0) AS partners,
              {q}[3] AS p95""")
        else:
            extra = "false AS has_outliers, NULL AS s, NULL AS ku, 0.0 AS max_abs_r, 0 AS partners, NULL AS p95"
        hint = "false" if c in numbers or k == "boolean" else "true"
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS "column", '{k}' AS dtype, count(*) AS "rows",
            count(*) - count("{c}") AS missing_count, round((count(*) - count("{c}")) * 100.0 / count(*), 2) AS missing_pct,
            count(DISTINCT "{c}") + max(CAST("{c}" IS NULL AS INT)) AS unique_count, {shares},
            {dates} AS datetime_pct, {nums} AS numeric_pct, {hint} AS hinted, {extra}, {dated} AS has_datetime FROM {t}""")
    return " UNION ALL ".join(parts)


def _words(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TAGS = {
    "identifier": "id identifier uuid key code", "currency": "sales revenue profit cost price amount budget tax discount total",
    "percentage": "percent pct rate margin ratio", "count": "count qty quantity units number num",
    "geographic": "city state country region zip postal latitude longitude",
    "categorical_label": "status segment category type mode brand channel department",
    "text": "name email address description notes message password",
}
ROLES = {
    "customer_income": "income salary wage wages earnings", "revenue": "revenue turnover sales",
    "cost": "cost cogs expense expenditure", "tax": "tax vat gst duty", "discount": "discount rebate deduction",
    "budget": "budget target planned projected", "price": "price rate mrp", "spend": "spend spent purchase purchases",
}


def _has(words):
    return f"list_has_any(tokens, {_words(words.split())})"


PROFILE_SQL = f"""WITH {MESSY_SQL}, {SALES_SQL}, raw AS ({' UNION ALL '.join(_profile_sql(t, s) for t, s in CATALOG.items())}),
prof AS (SELECT *, unique_count / "rows" AS cardinality_ratio,
    unique_count / "rows" >= 0.95 AND missing_count = 0 AND "rows" > 1 AS candidate_key_hint,
    regexp_extract_all(lower("column"), '[a-z0-9]+') AS tokens, hinted AND money AS currency_like,
    hinted AND ("column" LIKE '%date%' OR "column" LIKE '%time%'
      OR (dtype = 'timestamp_ntz') OR dashed) AS date_like,
    hinted AND ("column" = 'id' OR ends_with("column", '_id') OR starts_with("column", 'id_')) AS identifier_like,
    coalesce(abs(s) <= 0.5 AND abs(ku) <= 1, false) AS is_normal FROM raw),
typed AS (SELECT *, CASE WHEN dtype IN ('bigint', 'int', 'double') THEN 'numeric' WHEN dtype = 'timestamp_ntz' THEN 'datetime'
    WHEN dtype = 'boolean' THEN 'boolean' WHEN numeric_pct >= 80 THEN 'numeric' WHEN datetime_pct >= 80 THEN 'datetime' ELSE 'string' END AS inferred_type FROM prof),
tagged AS (SELECT *, CASE WHEN inferred_type = 'numeric' THEN 'float' ELSE inferred_type END AS intended_type, CASE
    WHEN inferred_type = 'datetime' OR datetime_pct >= 80 OR {_has('date time timestamp created updated')} THEN 'datetime'
    WHEN (inferred_type = 'numeric' OR currency_like) AND ({_has(TAGS['currency'])} OR currency_like) THEN 'currency'
    WHEN (inferred_type = 'numeric' OR currency_like) AND {_has(TAGS['percentage'])} THEN 'percentage'
    WHEN (inferred_type = 'numeric' OR currency_like) AND {_has(TAGS['count'])} THEN 'count'
    WHEN candidate_key_hint OR identifier_like THEN 'identifier'
    {' '.join(f"WHEN {_has(w)}{' AND inferred_type = ' + chr(39) + 'string' + chr(39) if t == 'text' else ''} THEN '{t}'" for t, w in TAGS.items())}
    WHEN at_like THEN 'text'
    WHEN date_like OR iso_like THEN 'datetime'
    WHEN inferred_type = 'string' AND (unique_count < 20 OR cardinality_ratio <= 0.2) THEN 'categorical_label'
    WHEN inferred_type = 'string' THEN 'text' ELSE 'unknown' END AS semantic_tag FROM typed),
suited AS (SELECT *, round((1 - unique_count / "rows") * 100, 2) AS duplicate_pressure_pct, CASE
    WHEN semantic_tag = 'identifier' THEN missing_pct <= 5 AND round((1 - unique_count / "rows") * 100, 2) <= 5
    WHEN semantic_tag IN ('categorical_label', 'geographic', 'text') THEN missing_pct <= 30
    WHEN semantic_tag = 'datetime' THEN missing_pct <= 25
    WHEN semantic_tag IN ('currency', 'percentage', 'count') OR intended_type = 'float' THEN missing_pct <= 35
    ELSE missing_pct <= 20 AND round((1 - unique_count / "rows") * 100, 2) <= 95 END AS is_suitable FROM tagged),
policy AS (SELECT *, CASE WHEN missing_pct <= 0 THEN 'none' WHEN semantic_tag = 'identifier' THEN 'drop_rows'
    WHEN semantic_tag = 'currency' THEN 'flag_only'
    WHEN semantic_tag = 'datetime' THEN CASE WHEN missing_pct >= 25 THEN 'flag_only' ELSE 'none' END
    WHEN semantic_tag IN ('geographic', 'text') THEN 'flag_only' WHEN semantic_tag = 'unknown' AND intended_type NOT IN ('float', 'boolean') THEN 'flag_only' WHEN missing_pct >= 60 THEN 'drop_column'
    WHEN semantic_tag = 'categorical_label' THEN CASE WHEN missing_pct >= 40 THEN 'flag_only'
      WHEN unique_count <= 5 AND missing_pct <= 15 AND unique_count - CAST(missing_count > 0 AS INT) <= 2 THEN 'impute_mode'
      WHEN unique_count <= 20 AND missing_pct <= 25 THEN 'impute_unknown_label' ELSE 'flag_only' END
    WHEN semantic_tag IN ('percentage', 'count') AND missing_pct <= 10 AND has_datetime
      AND NOT (max_abs_r >= 0.85 AND missing_pct >= 10) THEN 'impute_forward_fill'
    WHEN intended_type = 'float' THEN CASE
      WHEN partners >= 2 AND max_abs_r >= 0.9 AND missing_pct BETWEEN 10 AND 35 THEN 'impute_iterative'
      WHEN max_abs_r >= 0.85 AND missing_pct BETWEEN 10 AND 30 THEN 'impute_knn'
      WHEN missing_pct >= CASE WHEN semantic_tag IN ('percentage', 'count') THEN 30 ELSE 35 END THEN 'flag_only'
      WHEN is_normal AND NOT has_outliers AND missing_pct <= 20 THEN 'impute_mean' ELSE 'impute_median' END
    WHEN unique_count <= 20 AND missing_pct <= 20 THEN 'impute_mode' ELSE 'flag_only' END AS null_action FROM suited)"""
KEYS = 'SELECT table_name, "column"'


def _typed(spark, d):
    return B.intended_type(B.infer_coarse_type(catalog_profile(spark, d)))


def _tagged(spark, d):
    return B.semantic_tag(_typed(spark, d))


@query("infer_coarse_type", f"{PROFILE_SQL} {KEYS}, inferred_type FROM typed")
def _(spark, d):
    return _typed(spark, d).select("table_name", "column", "inferred_type")


@query("semantic_tag", f"{PROFILE_SQL} {KEYS}, semantic_tag FROM tagged")
def _(spark, d):
    return _tagged(spark, d).select("table_name", "column", "semantic_tag")


@query("financial_role", f"""{PROFILE_SQL} {KEYS}, CASE WHEN semantic_tag = 'identifier'
    OR (inferred_type <> 'numeric' AND semantic_tag <> 'currency') THEN NULL
  {' '.join(f"WHEN {_has(w)} THEN '{r}'" for r, w in ROLES.items())} WHEN starts_with("column", 'mnt') THEN 'spend'
  WHEN semantic_tag = 'currency' THEN 'unknown_financial' END AS financial_role FROM tagged""")
def _(spark, d):
    return B.financial_role(_tagged(spark, d)).select("table_name", "column", "financial_role")


@query("semantic_confidence", f"""{PROFILE_SQL}, scored AS (SELECT *, 50.0
  + CASE WHEN {' OR '.join(f"(semantic_tag = '{t}' AND {_has(w)})" for t, w in TAGS.items())} THEN 20 ELSE 0 END
  + CASE WHEN semantic_tag IN ('currency', 'count', 'percentage') THEN CASE WHEN inferred_type = 'numeric' THEN 15 ELSE -10 END
      WHEN semantic_tag = 'datetime' THEN CASE WHEN inferred_type = 'datetime' THEN 15 ELSE -10 END
      WHEN semantic_tag = 'identifier' THEN CASE WHEN inferred_type IN ('string', 'numeric') THEN 15 ELSE -10 END
      WHEN semantic_tag IN ('geographic', 'categorical_label') THEN CASE WHEN inferred_type = 'string' THEN 15 ELSE -10 END
      ELSE 0 END
  + CASE WHEN (semantic_tag = 'currency' AND currency_like) OR (semantic_tag = 'datetime' AND date_like) THEN 15 ELSE 0 END
  + CASE WHEN semantic_tag = 'identifier' THEN CASE WHEN identifier_like THEN 10 ELSE 0 END
      + CASE WHEN missing_pct = 0 THEN 10 ELSE 0 END + CASE WHEN candidate_key_hint THEN 5 ELSE 0 END ELSE 0 END
  + CASE WHEN semantic_tag = 'categorical_label' AND unique_count BETWEEN 2 AND 19 THEN 10 ELSE 0 END
  - CASE WHEN missing_pct > 50 THEN 10 ELSE 0 END - CASE WHEN has_outliers THEN 5 ELSE 0 END AS score FROM tagged)
{KEYS}, CAST(least(100.0, score) AS DOUBLE) AS confidence_score,
  CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS confidence_level FROM scored""")
def _(spark, d):
    return B.semantic_confidence(_tagged(spark, d)).select("table_name", "column", "confidence_score", "confidence_level")


@query("column_suitability", f"""{PROFILE_SQL} {KEYS}, duplicate_pressure_pct, is_suitable,
  CASE WHEN NOT is_suitable AND missing_pct > 60 THEN 'too_sparse'
    WHEN semantic_tag = 'identifier' THEN CASE WHEN duplicate_pressure_pct > 5 THEN 'identifier_duplicates' ELSE 'identifier_clean' END
    WHEN semantic_tag IN ('categorical_label', 'geographic', 'text')
      THEN CASE WHEN unique_count < 20 THEN 'low_cardinality_category' ELSE 'text_or_label' END
    WHEN semantic_tag = 'datetime' THEN 'datetime_missingness'
    WHEN semantic_tag IN ('currency', 'percentage', 'count') OR intended_type = 'float' THEN 'numeric_missingness'
    ELSE 'unknown_semantics' END AS reason_category FROM suited""")
def _(spark, d):
    return B.column_suitability(_tagged(spark, d)).select(
        "table_name", "column", "duplicate_pressure_pct", "is_suitable", "reason_category")


@query("analysis_allowed", f"{PROFILE_SQL} {KEYS}, is_suitable AND missing_pct <= 20 AS analysis_allowed FROM suited")
def _(spark, d):
    return B.analysis_allowed(B.column_suitability(_tagged(spark, d))).select("table_name", "column", "analysis_allowed")


@query("null_policy", f"{PROFILE_SQL} {KEYS}, null_action FROM policy")
def _(spark, d):
    return B.null_policy(_tagged(spark, d)).select("table_name", "column", "null_action")


STRATEGY_SQL = """CASE null_action WHEN 'drop_rows' THEN 'drop' WHEN 'drop_column' THEN 'drop_column' WHEN 'flag_only' THEN 'none'
  ELSE regexp_replace(null_action, '^impute_', '') END"""


@query("null_policy_resolve", f"""{PROFILE_SQL}, resolved AS (SELECT table_name, "column",
  CASE WHEN semantic_tag IN ('identifier', 'currency', 'datetime') THEN null_action
    WHEN "column" = 'segment' THEN 'impute_mode' WHEN "column" = 'discount_rate' THEN 'impute_knn' ELSE null_action END AS null_action
  FROM policy) {KEYS}, null_action, {STRATEGY_SQL} AS imputation_strategy FROM resolved""")
def _(spark, d):
    asked = spark.createDataFrame([
        ("messy_sales", "segment", "impute_mode", "mode"), ("messy_sales", "unit_price", "impute_mean", "mean"),
        ("messy_sales", "discount_rate", None, "knn"), ("messy_sales", "quantity", "impute_mean", "median_of_days")],
        "table_name string, column string, null_action string, imputation_strategy string")
    return B.null_policy_resolve(B.null_policy(_tagged(spark, d)), asked).select(
        "table_name", "column", "null_action", "imputation_strategy")


@query("encoding_strategy", f"""{PROFILE_SQL} {KEYS}, CASE WHEN semantic_tag IN ('identifier', 'datetime', 'text') OR intended_type = 'datetime'
    THEN 'none' WHEN (semantic_tag = 'categorical_label' OR intended_type = 'string') AND unique_count BETWEEN 2 AND 20
    THEN 'one_hot' ELSE 'none' END AS encoding FROM tagged""")
def _(spark, d):
    return B.encoding_strategy(_tagged(spark, d)).select("table_name", "column", "encoding")


@query("unit_scale", f"""{PROFILE_SQL} {KEYS}, CASE WHEN semantic_tag = 'percentage' THEN CASE WHEN p95 <= 1 THEN 'ratio' ELSE 'percent' END
    WHEN semantic_tag = 'count' THEN 'items' END AS unit_scale,
  CASE WHEN semantic_tag IN ('percentage', 'count') THEN 0.0 END AS lower_bound,
  CASE WHEN semantic_tag = 'percentage' THEN CASE WHEN p95 <= 1 THEN 1.0 ELSE 100.0 END END AS upper_bound,
  semantic_tag = 'count' AS whole_numbers FROM tagged""")
def _(spark, d):
    return B.unit_scale(_tagged(spark, d)).select(
        "table_name", "column", "unit_scale", "lower_bound", "upper_bound", "whole_numbers")


@query("fallback_blueprint", f"""{PROFILE_SQL} {KEYS}, intended_type, 'unknown' AS semantic_tag, false AS is_identifier,
  inferred_type = 'numeric' AS scaling_allowed, 'none' AS imputation_strategy, 'flag_only' AS null_action,
  20.0 AS null_threshold_pct, true AS analysis_allowed
FROM (SELECT *, CASE WHEN inferred_type = 'numeric' THEN 'float' ELSE inferred_type END AS intended_type FROM typed)""")
def _(spark, d):
    return B.fallback_blueprint(B.infer_coarse_type(catalog_profile(spark, d)))


@query("domain_detect", f"""{PROFILE_SQL}, t AS (SELECT table_name,
  count(*) FILTER (regexp_matches(lower("column"), 'amount|revenue|cost|tax|price|discount|sales|profit|margin|invoice')) AS names,
  count(*) FILTER (semantic_tag IN ('currency', 'percentage')) AS tags FROM tagged GROUP BY 1)
SELECT table_name, names, tags, CASE WHEN names >= 3 OR tags >= 2 THEN 'finance_sales' ELSE 'generic' END AS domain,
  CASE WHEN names >= 3 OR tags >= 2 THEN 'strict' ELSE 'balanced' END AS rule_profile FROM t""")
def _(spark, d):
    return B.domain_detect(_tagged(spark, d))


@query("quality_signals", f"""WITH {MESSY_SQL}, cells AS (
  SELECT order_id, status, quantity, unit_price, discount_rate FROM messy_sales),
s AS (SELECT 'messy' AS table_name,
  round(sum(CAST(quantity IS NULL AS INT) + CAST(unit_price IS NULL AS INT) + CAST(discount_rate IS NULL AS INT)) * 100.0 / (count(*) * 5), 2) AS missing_pct,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cells))) * 100.0 / count(*), 2) AS duplicate_pct,
  5 AS "columns",
  max(CAST(quantity = -999 AS INT)) + max(CAST(order_id IN (999, 9999, 99999) AS INT)) + max(CAST(unit_price IN (999, 9999, 99999) AS INT))
   + max(CAST(discount_rate = 0 AS INT)) * CAST(count(*) FILTER (discount_rate = 0) >= 0.25 * count(*) AS INT) AS implicit_columns,
  {' + '.join(f'''CAST(count(*) FILTER ({c} < (SELECT q[1] - 1.5 * (q[2] - q[1]) FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q FROM cells))
      OR {c} > (SELECT q[2] + 1.5 * (q[2] - q[1]) FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q FROM cells))) > 0 AS INT)'''
      for c in ('order_id', 'quantity', 'unit_price', 'discount_rate'))} AS outlier_columns FROM cells)
SELECT *, CASE WHEN missing_pct >= 30 OR duplicate_pct >= 8 OR implicit_columns >= 4 THEN 'critical'
    WHEN missing_pct >= 15 OR duplicate_pct >= 3 OR outlier_columns >= 1 THEN 'high' WHEN missing_pct >= 5 THEN 'moderate' ELSE 'low' END AS risk_assessment,
  CASE WHEN missing_pct >= 15 OR duplicate_pct >= 3 OR implicit_columns >= 4 OR outlier_columns >= 1 THEN 'strict'
    WHEN missing_pct >= 5 THEN 'balanced' ELSE 'lenient' END AS recommendation,
  round(100 - missing_pct, 2) AS completeness, round(100 - duplicate_pct, 2) AS duplication,
  100 - implicit_columns * 12.5 AS implicit_missingness, 100 - outlier_columns * 12.5 AS distribution_health FROM s""")
def _(spark, d):
    return B.quality_signals(B.table_signals(
        messy_sales(spark, d, "order_id", "status", "quantity", "unit_price", "discount_rate"), "messy"))


NUMERIC = ["units_sold", "unit_price", "net_sales", "cost", "tax_amount", "shipping_cost"]


@query("correlation_partners", f"""WITH {SALES_SQL}, c AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 4) AS r FROM sales" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])}),
strong AS (SELECT * FROM c WHERE abs(r) >= 0.5),
both_ways AS (SELECT col1 AS "column", col2 AS partner, r FROM strong UNION ALL SELECT col2, col1, r FROM strong),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY abs(r) DESC, partner) AS "rank",
  max(abs(r)) OVER (PARTITION BY "column") AS max_abs_r FROM both_ways)
SELECT * FROM ranked WHERE "rank" <= 3""")
def _(spark, d):
    return B.correlation_partners(P.raw_correlations(sales(spark, d, *NUMERIC)))
