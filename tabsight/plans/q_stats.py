"""Queries of the rules, statistics and analyses."""

from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import (anomalies as A, blueprint as B, correlation as C, insights as N, profile as P, rankings as R,
                         rules as V, selection as S, stats as T, timeseries as M)
from ..operators.cleaning import date_features, derive_metrics
from .q_blueprint import PROFILE_SQL, catalog_profile
from .registry import query
from .views import MESSY_SQL, SALES_SQL, messy_sales, sales, table


def _union(parts):
    return " UNION ALL ".join(parts)


# ---- validation rules ----

@query("validate_counts", f"""WITH {MESSY_SQL}
SELECT line, count(*) AS n, count(*) FILTER (quantity < 0 OR floor(quantity) <> quantity) AS failed FROM messy_sales GROUP BY 1""")
def _(spark, d):
    return V.validate_counts(messy_sales(spark, d, "line", "quantity"), ["quantity"]).groupBy("line").agg(
        F.count("*").alias("n"), F.sum("quantity_range_failed").alias("failed"))


@query("validate_tax_rate", f"""WITH {SALES_SQL}
SELECT region, count(*) AS n, count(*) FILTER (net_sales <> 0 AND tax_amount * 5 > abs(net_sales) * 0.4) AS failed FROM sales GROUP BY 1""")
def _(spark, d):
    s = sales(spark, d, "region", "net_sales", "tax_amount").withColumn("tax_amount", F.col("tax_amount") * 5)
    return V.validate_tax_rate(s, "tax_amount", "net_sales").groupBy("region").agg(
        F.count("*").alias("n"), F.sum("tax_amount_rate_failed").alias("failed"))


def _totals(spark, d):
    """An invoice total that is off by 3 % where the order key ends in 5."""
    s = sales(spark, d, "order_id", "net_sales", "tax_amount", "discount_percentage", "product_category")
    return s.select("product_category", F.col("net_sales").alias("amount"), F.col("tax_amount").alias("tax"),
                    F.col("discount_percentage").alias("discount"),
                    ((F.col("net_sales") + F.col("tax_amount") - F.col("discount_percentage"))
                     * F.when(F.col("order_id") % 10 == 5, 1.03).otherwise(1.0)).alias("grand_total"))


TOTAL_SQL = """t AS (SELECT product_category, net_sales AS amount, tax_amount AS tax, discount_percentage AS discount,
  (net_sales + tax_amount - discount_percentage) * CASE WHEN order_id % 10 = 5 THEN CAST(1.03 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS grand_total FROM sales)"""


@query("validate_total", f"""WITH {SALES_SQL}, {TOTAL_SQL}
SELECT product_category, count(*) AS n, count(*) FILTER (abs(grand_total - (amount + tax - discount))
  > greatest(1.0, abs(amount + tax - discount) * 0.02)) AS failed FROM t GROUP BY 1""")
def _(spark, d):
    return V.validate_total(_totals(spark, d), "grand_total", "amount", "tax", "discount").groupBy("product_category").agg(
        F.count("*").alias("n"), F.sum("grand_total_reconciliation_failed").alias("failed"))


@query("validate_margin", f"""WITH {SALES_SQL}
SELECT region, count(*) AS n, count(*) FILTER (abs(profit_margin) > 1) AS failed FROM sales GROUP BY 1""")
def _(spark, d):
    return V.validate_margin(sales(spark, d, "region", "profit_margin"), "profit_margin").groupBy("region").agg(
        F.count("*").alias("n"), F.sum("profit_margin_range_failed").alias("failed"))


@query("validation_totals", f"""WITH {SALES_SQL}, {TOTAL_SQL}, f AS (SELECT count(*) AS n, count(*) FILTER (amount <> 0) AS taxed,
  count(*) FILTER (amount <> 0 AND tax > abs(amount) * 0.4) AS tax_failed,
  count(*) FILTER (abs(grand_total - (amount + tax - discount)) > greatest(1.0, abs(amount + tax - discount) * 0.02)) AS total_failed FROM t)
SELECT 'tax_rate_failed' AS rule, taxed AS checks, tax_failed AS failed, round(tax_failed * 100.0 / n, 2) AS fail_pct FROM f
UNION ALL SELECT 'grand_total_reconciliation_failed', n, total_failed, round(total_failed * 100.0 / n, 2) FROM f""")
def _(spark, d):
    return V.validate_all(_totals(spark, d), [])[1]


@query("reconcile_derived", f"""WITH {SALES_SQL}, x AS (SELECT net_sales - cost AS d, CASE WHEN order_id % 3 = 0 THEN profit * 1.5 ELSE profit END AS m,
  (net_sales - cost) / net_sales * 100 AS pm, profit_margin AS pq FROM sales)
SELECT 'derived_profit' AS derived_column, 'profit' AS matched_column, count(*) AS n, round(corr(d, m), 4) AS correlation,
  round(avg(CASE WHEN abs(m) > 1e-9 THEN abs(d - m) / abs(m) END) * 100, 2) AS mape_pct,
  corr(d, m) < 0.99 OR avg(CASE WHEN abs(m) > 1e-9 THEN abs(d - m) / abs(m) END) * 100 > 1 AS diverged FROM x
UNION ALL SELECT 'derived_profit_margin_pct', 'profit_margin', count(*), round(corr(pm, pq), 4),
  round(avg(CASE WHEN abs(pq) > 1e-9 THEN abs(pm - pq) / abs(pq) END) * 100, 2), true FROM x""")
def _(spark, d):
    s = sales(spark, d, "order_id", "net_sales", "cost", "profit", "profit_margin").withColumn(
        "profit", F.when(F.col("order_id") % 3 == 0, F.col("profit") * 1.5).otherwise(F.col("profit")))
    out, sources = derive_metrics(s, {"net_sales": "revenue"})
    return V.reconcile_derived(out, sources)


TAGS = {"quantity": "count", "discount_rate": "percentage"}
ISSUES_SQL = """checked AS (SELECT order_id, line, quantity, discount_rate * CASE WHEN order_id % 31 = 0 THEN 20 ELSE 1 END AS discount_rate,
    CAST(order_id % 13 AS INT) AS returned_units, CAST(line + 9 AS INT) AS ordered_units FROM messy_sales),
hits AS (SELECT quantity < 0 AS a, discount_rate < 0 OR discount_rate > 1 AS b, returned_units > ordered_units AS c FROM checked)"""


def _checked(spark, d):
    m = messy_sales(spark, d, "order_id", "line", "quantity", "discount_rate")
    return m.select(
        "order_id", "line", "quantity",
        (F.col("discount_rate") * F.when(F.col("order_id") % 31 == 0, 20).otherwise(1)).alias("discount_rate"),
        (F.col("order_id") % 13).cast("int").alias("returned_units"), (F.col("line") + 9).cast("int").alias("ordered_units"))


@query("structural_issues", f"""WITH {MESSY_SQL}, {ISSUES_SQL}, r AS ({_union(
    f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS count, round(count(*) FILTER ({c}) * 100.0 / count(*), 2) AS pct FROM hits"
    for c, n in (('a', 'quantity < 0'), ('b', 'discount_rate out of [0, 1]'), ('c', 'returned_units > ordered_units')))})
SELECT *, pct > 90 AS review_required FROM r WHERE count > 0""")
def _(spark, d):
    return V.structural_issues(_checked(spark, d), TAGS, {"discount_rate": "ratio"})


@query("structural_summary", f"""WITH {MESSY_SQL}, {ISSUES_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (coalesce(a, false) OR coalesce(b, false) OR c) AS k FROM hits)
SELECT k AS issue_rows, round(k * 100.0 / n, 2) AS issue_pct, k AS confident_rows, round(k * 100.0 / n, 2) AS confident_pct, false AS review_required FROM s""")
def _(spark, d):
    return V.structural_summary(_checked(spark, d), TAGS, {"discount_rate": "ratio"})


@query("structural_examples", f"""WITH {MESSY_SQL}, {ISSUES_SQL}, e AS ({_union(
    f"SELECT '{n}' AS rule, order_id, row_number() OVER (ORDER BY order_id, line) AS rank FROM checked WHERE {c}"
    for c, n in (('quantity < 0', 'quantity < 0'), ('discount_rate < 0 OR discount_rate > 1', 'discount_rate out of [0, 1]'),
                 ('returned_units > ordered_units', 'returned_units > ordered_units')))})
SELECT rule, CAST(rank AS INT) AS rank, order_id FROM e WHERE rank <= 5""")
def _(spark, d):
    return V.structural_examples(_checked(spark, d), ["order_id", "line"], TAGS, {"discount_rate": "ratio"}).select(
        "rule", "rank", F.get_json_object("row", "$.order_id").cast("long").alias("order_id"))


SCORED = ("order_id", "line", "segment", "quantity", "unit_price", "sales")
SCORE_SQL = f"""raw AS (SELECT {', '.join(SCORED)} FROM messy_sales), clean AS (SELECT DISTINCT order_id, line,
    coalesce(segment, 'Unknown') AS segment, quantity, unit_price, sales FROM messy_sales),
p AS (SELECT (SELECT round((count(*) * 3 - count(segment) - count(quantity) - count(unit_price)) * 100.0 / (count(*) * 6), 2) FROM raw) AS raw_missing_pct,
  (SELECT round((count(*) * 2 - count(quantity) - count(unit_price)) * 100.0 / (count(*) * 6), 2) FROM clean) AS remaining_null_pct,
  (SELECT round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw))) * 100.0 / count(*), 2) FROM raw) AS duplicate_pct,
  (SELECT round(count(*) FILTER (quantity < 0) * 100.0 / count(quantity), 2) FROM clean) AS validation_fail_pct,
  (SELECT count(*) FROM raw) AS rows_before, (SELECT count(*) FROM clean) AS rows_after),
s AS (SELECT round(0.5 * (100 - greatest(raw_missing_pct, remaining_null_pct)) + 0.4 * (100 - validation_fail_pct) + 0.1 * (100 - duplicate_pct) - 2.5, 2) AS score, * FROM p)"""


def _score(spark, d):
    raw = messy_sales(spark, d, *SCORED)
    clean = raw.dropDuplicates().fillna("Unknown", subset=["segment"])
    flagged, totals = V.validate_all(clean, ["quantity"])
    return V.quality_score(P.profile_shape(raw), clean, totals.where("rule = 'quantity_range_failed'"), risk="high")


@query("quality_score", f"""WITH {MESSY_SQL}, {SCORE_SQL}
SELECT score AS overall_quality_score, raw_missing_pct, remaining_null_pct, greatest(0, round(raw_missing_pct - remaining_null_pct, 2)) AS imputation_burden_pct,
  duplicate_pct, validation_fail_pct, round(100 - greatest(raw_missing_pct, remaining_null_pct), 2) AS completeness,
  round(100 - validation_fail_pct, 2) AS consistency, round(100 - duplicate_pct, 2) AS deduplication,
  round(rows_after * 100.0 / rows_before, 2) AS structure, rows_before, rows_after, 'high' AS risk_assessment FROM s""")
def _(spark, d):
    return _score(spark, d)


@query("quality_penalty", f"""WITH {MESSY_SQL}, {SCORE_SQL}, q AS (SELECT score,
  least(5, greatest(0, duplicate_pct * 3 - 3) * 0.1) AS soft, least(40, validation_fail_pct * 1.5) AS hard FROM s)
SELECT score AS score_before, round(soft, 2) AS outlier_penalty, round(hard, 2) AS issue_penalty, round(soft + hard, 2) AS total_penalty,
  round(score - round(soft + hard, 2), 2) AS overall_quality_score FROM q""")
def _(spark, d):
    return V.quality_penalty(_score(spark, d), F.col("duplicate_pct") * 3, F.col("validation_fail_pct"))


# ---- selections and roles over the catalog ----

OK_SQL = "is_suitable AND missing_pct <= 20 AND semantic_tag NOT IN ('identifier', 'datetime')"


def _blueprint(spark, d):
    return B.blueprint(catalog_profile(spark, d))


@query("select_numeric", f"""{PROFILE_SQL} SELECT table_name, "column" FROM suited
WHERE {OK_SQL} AND dtype IN ('bigint', 'int', 'double')""")
def _(spark, d):
    return S.select_numeric(_blueprint(spark, d)).select("table_name", "column")


@query("select_categorical", f"""{PROFILE_SQL} SELECT table_name, "column" FROM suited
WHERE {OK_SQL} AND (dtype = 'string' OR semantic_tag IN ('categorical_label', 'geographic'))""")
def _(spark, d):
    return S.select_categorical(_blueprint(spark, d)).select("table_name", "column")


@query("select_datetime", f"""{PROFILE_SQL} SELECT table_name, "column" FROM suited WHERE semantic_tag = 'datetime' OR intended_type = 'datetime'""")
def _(spark, d):
    return S.select_datetime(_blueprint(spark, d)).select("table_name", "column")


@query("find_roles", f"""{PROFILE_SQL}, u AS (SELECT * FROM suited WHERE {OK_SQL}),
num AS (SELECT * FROM u WHERE dtype IN ('bigint', 'int', 'double')),
lab AS (SELECT * FROM u WHERE dtype = 'string' OR semantic_tag IN ('categorical_label', 'geographic')),
c AS (SELECT table_name, 'revenue' AS role, "column", CASE WHEN list_has_any(tokens, ['revenue', 'turnover', 'sales']) AND NOT
    list_has_any(tokens, ['income', 'salary', 'wage', 'wages', 'earnings']) THEN 0 ELSE 1 END AS k FROM num
  WHERE list_has_any(tokens, ['revenue', 'turnover', 'sales']) OR "column" IN ('total_sales', 'revenue', 'net_sales', 'total_amount', 'sales')
  UNION ALL SELECT table_name, 'profit', "column", CASE WHEN "column" = 'profit' THEN 0 ELSE 1 END FROM num
    WHERE list_contains(tokens, 'profit') AND NOT list_contains(tokens, 'margin')
  UNION ALL SELECT table_name, 'discount', "column", CASE WHEN list_contains(tokens, 'percentage') THEN 0 WHEN list_contains(tokens, 'pct') THEN 1
    WHEN list_contains(tokens, 'rate') THEN 2 ELSE 3 END FROM num WHERE list_contains(tokens, 'discount')
  UNION ALL SELECT table_name, 'margin', "column", CASE WHEN list_contains(tokens, 'profit') THEN 0 WHEN list_contains(tokens, 'pct') THEN 1 ELSE 2 END
    FROM num WHERE list_contains(tokens, 'margin')
  UNION ALL SELECT table_name, 'shipping', "column", CASE WHEN list_contains(tokens, 'cost') THEN 0 ELSE 1 END FROM num WHERE list_contains(tokens, 'shipping')
  UNION ALL SELECT table_name, 'category', "column", CASE WHEN list_contains(tokens, 'product') THEN 10 ELSE 11 END FROM lab WHERE list_contains(tokens, 'category')
  UNION ALL SELECT table_name, 'representative', "column", CASE WHEN list_contains(tokens, 'sales') THEN 10 ELSE 11 END FROM lab WHERE list_contains(tokens, 'representative')
  UNION ALL SELECT table_name, 'segment', "column", CASE WHEN "column" = 'segment' THEN 1 WHEN list_contains(tokens, 'customer') THEN 10 ELSE 11 END FROM lab WHERE list_contains(tokens, 'segment')
  UNION ALL SELECT table_name, 'region', "column", CASE WHEN "column" = 'region' THEN 0 ELSE 10 END FROM lab WHERE list_contains(tokens, 'region')
  UNION ALL SELECT table_name, 'returned', "column", 0 FROM suited WHERE dtype = 'boolean' AND list_contains(tokens, 'returned'))
SELECT table_name, role, "column" FROM c QUALIFY row_number() OVER (PARTITION BY table_name, role ORDER BY k) = 1""")
def _(spark, d):
    return S.find_roles(_blueprint(spark, d))


VARIED = ["units_sold", "unit_price", "net_sales", "discount_percentage", "profit_margin"]


@query("meaningful_variation", f"""WITH {SALES_SQL}, v AS ({_union(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, stddev_samp({c}) / abs(avg({c})) AS v FROM sales" for c in VARIED)})
SELECT "column", n, round(v, 6) AS variation, v >= 0.03 AS varies FROM v""")
def _(spark, d):
    return S.meaningful_variation(sales(spark, d, *VARIED), VARIED).withColumn("variation", F.round("variation", 6))


# ---- descriptive statistics and correlations ----

MEASURES = ["units_sold", "unit_price", "net_sales", "cost", "discount_percentage", "profit_margin"]


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("describe_numeric", f"""WITH {SALES_SQL}, s AS ({_union(
    f'''SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 3) AS mean, round(median({c}), 3) AS median, round(stddev_samp({c}), 3) AS std,
    round(var_samp({c}), 1) AS variance, round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(quantile_cont({c}, 0.25), 3) AS q1,
    round(quantile_cont({c}, 0.75), 3) AS q3, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis FROM sales''' for c in MEASURES)})
SELECT * FROM s""")
def _(spark, d):
    out = T.describe_numeric(sales(spark, d, *MEASURES), MEASURES)
    out = _rounded(out, 3, "mean", "median", "std", "min", "max", "q1", "q3")
    return _rounded(_rounded(out, 1, "variance"), 4, "skewness", "kurtosis")


def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


LISTED = ["quantity", "unit_price", "discount_rate", "sales"]
LISTED_SQL = f"l AS (SELECT {', '.join(LISTED)} FROM messy_sales WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LISTED) + ")"


@query("corr_pearson", f"""WITH {MESSY_SQL}, {LISTED_SQL} {_union(
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 6) AS r FROM l" for a, b in _pairs(LISTED))}""")
def _(spark, d):
    return _rounded(C.corr_pearson(messy_sales(spark, d, *LISTED), LISTED), 6, "r")


@query("corr_spearman", f"""WITH {MESSY_SQL}, {LISTED_SQL}, k AS (SELECT {', '.join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LISTED)} FROM l) {_union(
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 6) AS r FROM k" for a, b in _pairs(LISTED))}""")
def _(spark, d):
    return _rounded(C.corr_spearman(messy_sales(spark, d, *LISTED), LISTED), 6, "r")


PAIRED = ["units_sold", "unit_price", "net_sales", "cost", "tax_amount", "shipping_cost", "derived_profit", "line_index"]


def _paired(spark, d):
    s = sales(spark, d, "line", "units_sold", "unit_price", "net_sales", "cost", "tax_amount", "shipping_cost")
    out, sources = derive_metrics(s.withColumn("line_index", F.col("line") * F.col("unit_price")).drop("line"), {"net_sales": "revenue"})
    return written(out.select(*PAIRED), "paired"), {k: v for k, v in sources.items() if k in PAIRED}


PAIRED_SQL = f"""x AS (SELECT *, net_sales - cost AS derived_profit, line * unit_price AS line_index FROM sales),
pr AS ({_union(f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM x" for a, b in _pairs(PAIRED))}),
twins AS (SELECT c FROM (SELECT col1 AS c, r FROM pr UNION ALL SELECT col2, r FROM pr) GROUP BY c
  HAVING count(*) FILTER (abs(r) > 0.98) = 1 AND count(*) FILTER (abs(r) < 0.1) >= count(*) - 2)"""


@query("strong_pairs", f"""WITH {SALES_SQL}, {PAIRED_SQL}
SELECT col1, col2, round(r, 4) AS pearson_r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN abs(round(r, 4)) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
  CASE WHEN col2 = 'derived_profit' AND col1 IN ('net_sales', 'cost') THEN 'formulaic'
    WHEN 'line_index' IN (col1, col2) OR col1 IN (SELECT c FROM twins) OR col2 IN (SELECT c FROM twins) THEN 'excluded' ELSE 'strong' END AS kind FROM pr WHERE abs(round(r, 4)) >= 0.5""")
def _(spark, d):
    df, sources = _paired(spark, d)
    pairs = C.corr_pearson(df, PAIRED)
    return C.strong_pairs(pairs, C.formulaic_pairs(df, PAIRED, sources), C.leakage_columns(df, pairs))


@query("leakage_columns", """WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS label, o_totalprice * 2 + 1 AS twin_price, o_orderkey % 11 AS noise_a,
  o_orderkey % 7 AS noise_b FROM orders), u AS (SELECT
  abs(corr(o_totalprice, twin_price)) > 0.98 AND abs(corr(o_totalprice, noise_a)) < 0.1 AND abs(corr(o_totalprice, noise_b)) < 0.1 AS twin FROM o)
SELECT 'predicted_status' AS "column", 'name' AS reason UNION ALL SELECT 'row_index', 'name'
UNION ALL SELECT unnest(['total_price', 'twin_price']), 'twin' FROM u WHERE twin
UNION ALL SELECT 'label', 'unique' FROM o HAVING count(DISTINCT label) = count(*)
UNION ALL SELECT 'row_index', 'unique' FROM o HAVING count(DISTINCT o_orderkey) = count(*)""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderkey").alias("row_index"),
        F.col("o_orderstatus").alias("predicted_status"), F.col("o_totalprice").alias("total_price"),
        (F.col("o_totalprice") * 2 + 1).alias("twin_price"), (F.col("o_orderkey") % 11).cast("int").alias("noise_a"),
        (F.col("o_orderkey") % 7).cast("int").alias("noise_b"))
    return C.leakage_columns(o, P.pair_correlations(o, ["total_price", "twin_price", "noise_a", "noise_b"]))


@query("formulaic_pairs", """SELECT 'net_sales' AS col1, 'derived_revenue_per_unit' AS col2, 'derivation' AS reason
UNION ALL SELECT 'units', 'derived_revenue_per_unit', 'derivation'
UNION ALL SELECT 'unit_price', 'derived_revenue_per_unit', 'equal' FROM lineitem JOIN part ON l_partkey = p_partkey
HAVING bool_and(abs(p_retailprice - p_retailprice * l_quantity / l_quantity) <= 1e-9 + 1e-9 * p_retailprice)""")
def _(spark, d):
    s = sales(spark, d, "units_sold", "unit_price", "cost").select(
        F.col("cost").alias("net_sales"), F.col("units_sold").alias("units"), "unit_price")
    out, sources = derive_metrics(s, {"net_sales": "revenue"})
    return C.formulaic_pairs(out, ["net_sales", "units", "unit_price", "derived_revenue_per_unit"], sources)


# ---- time ----

def _dated(spark, d):
    return sales(spark, d, "order_date", "net_sales")


def _growth_sql(parts, label):
    keys = ", ".join(f"{e} AS {n}" for n, e in parts.items())
    order = ", ".join(f'"{n}"' for n in parts)
    return f"""WITH {SALES_SQL}, t AS (SELECT {keys}, sum(net_sales) AS total FROM sales GROUP BY ALL),
g AS (SELECT *, (total - lag(total) OVER (ORDER BY {order})) / lag(total) OVER (ORDER BY {order}) * 100 AS g FROM t)
SELECT {order}, round(total, 4) AS total, round(g, 4) AS growth_pct{label} FROM g WHERE g IS NOT NULL"""


@query("growth_monthly", _growth_sql({"year": "year(order_date)", "month": "month(order_date)"}, """, "year" || '-M' || lpad(CAST("month" AS VARCHAR), 2, '0') AS label"""))
def _(spark, d):
    return _rounded(_rounded(M.growth_monthly(_dated(spark, d), "order_date", "net_sales"), 4, "total"), 4, "growth_pct")


@query("growth_quarterly", _growth_sql({"year": "year(order_date)", "quarter": "quarter(order_date)"}, """, "year" || '-Q' || "quarter" AS label"""))
def _(spark, d):
    return _rounded(_rounded(M.growth_quarterly(_dated(spark, d), "order_date", "net_sales"), 4, "total"), 4, "growth_pct")


@query("growth_yearly", f"""WITH {SALES_SQL}, t AS (SELECT year(order_date) AS "year", sum(net_sales) AS total, count(DISTINCT month(order_date)) AS months FROM sales GROUP BY 1)
SELECT "year", round(total, 4) AS total, months, round((total - lag(total) OVER (ORDER BY "year")) / lag(total) OVER (ORDER BY "year") * 100, 4) AS growth_pct
FROM t""")
def _(spark, d):
    return _rounded(_rounded(M.growth_yearly(_dated(spark, d), "order_date", "net_sales"), 4, "total"), 4, "growth_pct")


def _season_sql(expr, label):
    return f"""WITH {SALES_SQL}, m AS (SELECT {expr} AS period, avg(net_sales) AS average FROM sales GROUP BY 1)
SELECT period, {label} AS label, round(average, 3) AS average, average = (SELECT max(average) FROM m) AS is_best, average = (SELECT min(average) FROM m) AS is_worst FROM m"""


@query("seasonality_month", _season_sql("month(order_date)", "strftime(make_date(2000, CAST(period AS INT), 1), '%b')"))
def _(spark, d):
    return _rounded(M.seasonality_month(_dated(spark, d), "order_date", "net_sales"), 3, "average")


@query("seasonality_quarter", _season_sql("quarter(order_date)", "'Q' || period"))
def _(spark, d):
    return _rounded(M.seasonality_quarter(_dated(spark, d), "order_date", "net_sales"), 3, "average")


@query("seasonality_weekday", _season_sql("isodow(order_date) - 1", "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][period + 1]"))
def _(spark, d):
    return _rounded(M.seasonality_weekday(_dated(spark, d), "order_date", "net_sales"), 3, "average")


TREND = ["net_sales", "units_sold", "unit_price", "discount_percentage"]


def _trend_sql(rel, x, axis, columns):
    return _union(f"""SELECT "column", round(sxy / sxx, 6) AS slope, round(my - sxy / sxx * mx, 4) AS intercept, round(sxy * sxy / (sxx * syy), 4) AS r_squared,
      round(sqrt((1 - sxy * sxy / (sxx * syy)) * syy / (sxx * (n - 2))), 6) AS std_err, CASE WHEN sxy > 0 THEN 'upward' ELSE 'downward' END AS trend,
      abs(sxy / sxx) / sqrt((1 - sxy * sxy / (sxx * syy)) * syy / (sxx * (n - 2))) > 1.96 AS significant, '{axis}' AS x_axis, n
    FROM (SELECT '{c}' AS "column", regr_sxx({c}, {x}) AS sxx, regr_syy({c}, {x}) AS syy, regr_sxy({c}, {x}) AS sxy, avg({x}) AS mx, avg({c}) AS my, count(*) AS n FROM {rel})"""
                  for c in columns)


@query("trend_regression", f"""WITH {SALES_SQL}, x AS (SELECT *, CAST(year(order_date) * 12 + month(order_date) AS DOUBLE) AS t FROM sales)
{_trend_sql('x', 't', 'order_date_year_month_index', TREND)}""")
def _(spark, d):
    return M.trend_regression(sales(spark, d, "order_date", *TREND), TREND, "order_date").drop("p_value")


@query("trend_row_index", f"""WITH x AS (SELECT o_totalprice, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS DOUBLE) AS t FROM orders)
{_trend_sql('x', 't', 'row_index', ['o_totalprice'])}""")
def _(spark, d):
    return M.trend_regression(table(spark, d, "orders"), ["o_totalprice"], order_by=["o_orderdate", "o_orderkey"]).drop("p_value")


# ---- rankings ----

DIMS = ["region", "customer_segment", "product_category", "sales_representative", "order_status"]


def _ranked_sql(metric, dims=DIMS, where=""):
    return f"""WITH {SALES_SQL}, t AS ({_union(f"SELECT '{c}' AS dimension, {c} AS value, sum({metric}) AS total, avg({metric}) AS mean, count({metric}) AS records FROM sales GROUP BY ALL" for c in dims)}),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, value) AS a, row_number() OVER (PARTITION BY dimension ORDER BY total, value DESC) AS b,
  sum(total) OVER (PARTITION BY dimension) AS s, count(*) OVER (PARTITION BY dimension) AS n FROM t)
SELECT dimension, value, round(total, 4) AS total, round(mean, 3) AS mean, records, round(total / s * 100, 2) AS share_pct, CASE WHEN a <= 5 THEN a END AS rank_top,
  CASE WHEN b <= 5 THEN b END AS rank_bottom, n AS total_categories FROM r WHERE (a <= 5 OR b <= 5) {where}"""


def _ranking(df):
    return _rounded(_rounded(df, 4, "total"), 3, "mean")


@query("rank_dimension", _ranked_sql("net_sales"))
def _(spark, d):
    return _ranking(R.rank_dimension(sales(spark, d, *DIMS, "net_sales"), "net_sales", DIMS))


@query("select_dimensions", f"""WITH {SALES_SQL}, t AS ({_union(f"SELECT '{c}' AS dimension, {i} AS place, sum(net_sales) AS total FROM sales GROUP BY {c}" for i, c in enumerate(DIMS))}),
s AS (SELECT dimension, place, count(*) AS labels, (max(total) - min(total)) / sum(total) * 100 AS spread,
  regexp_matches(dimension, 'region|category|segment|representative') AS priority FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT dimension, labels, round(spread, 6) AS spread, priority, row_number() OVER (ORDER BY priority DESC, CASE WHEN priority THEN 0 ELSE -spread END, place) AS rank FROM s""")
def _(spark, d):
    totals = R.dimension_totals(sales(spark, d, *DIMS, "net_sales"), "net_sales", DIMS)
    return _rounded(R.select_dimensions(totals, DIMS), 6, "spread")


@query("profit_breakdown", _ranked_sql("profit", where="AND n > 1"))
def _(spark, d):
    return _ranking(R.profit_breakdown(sales(spark, d, *DIMS, "profit"), "profit", DIMS))


# ---- anomalies ----

EVENT_SQL = """s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, skewness(value) AS sk, min(value) AS lo, avg(ln(1 + value)) AS lm, stddev_samp(ln(1 + value)) AS ls,
  quantile_cont(value, [0.25, 0.75]) AS q FROM events),
flagged AS (SELECT events.*, CASE WHEN abs(sk) <= 1 THEN 'zscore' WHEN lo > 0 THEN 'log_zscore' ELSE 'iqr' END AS method, sk, lm, ls, m, sd,
  CASE WHEN abs(sk) <= 1 THEN abs((value - m) / sd) > 3.5 WHEN lo > 0 THEN abs((ln(1 + value) - lm) / ls) > 3.5
    ELSE value < q[1] - 3 * (q[2] - q[1]) OR value > q[2] + 3 * (q[2] - q[1]) END AS hit FROM events, s)"""
SPIKED_SQL = f"""spiked AS (SELECT *, CASE WHEN order_id % 500 = 1 THEN profit * 30 ELSE profit END AS spiked_profit FROM sales),
b AS (SELECT quantile_cont(spiked_profit, [0.25, 0.75]) AS q, skewness(spiked_profit) AS sk, avg(spiked_profit) AS m, stddev_samp(spiked_profit) AS sd, avg(units_sold) AS um, stddev_samp(units_sold) AS us FROM spiked),
h AS (SELECT *, CASE WHEN abs(sk) > 1 THEN spiked_profit < q[1] - 3 * (q[2] - q[1]) OR spiked_profit > q[2] + 3 * (q[2] - q[1])
    ELSE abs((spiked_profit - m) / sd) > 3.5 END AS hit, abs((units_sold - um) / us) > 3.5 AS units_hit FROM spiked, b)"""
SPIKED = ["spiked_profit", "units_sold"]


def _spiked(spark, d):
    s = sales(spark, d, "order_id", "profit", "units_sold", "net_sales", "unit_price")
    return s.withColumn("spiked_profit", F.when(F.col("order_id") % 500 == 1, F.col("profit") * 30).otherwise(F.col("profit")))


@query("anomalies", f"""WITH {EVENT_SQL}
SELECT 'value' AS "column", max(method) AS method, count(*) FILTER (hit) AS "count", round(max(sk), 3) AS skewness,
  round(max(CASE WHEN method = 'log_zscore' THEN lm ELSE m END), 3) AS col_mean, round(max(CASE WHEN method = 'log_zscore' THEN ls ELSE sd END), 3) AS col_std
FROM flagged HAVING count(*) FILTER (hit) > 0""")
def _(spark, d):
    return _rounded(A.anomalies(table(spark, d, "events"), ["value"]), 3, "skewness", "col_mean", "col_std")


@query("anomaly_rows", f"""WITH {SALES_SQL}, {SPIKED_SQL}
SELECT order_id, 'spiked_profit' AS "column", round(spiked_profit, 5) AS value FROM h WHERE hit
UNION ALL SELECT order_id, 'units_sold', units_sold FROM h WHERE units_hit""")
def _(spark, d):
    return _rounded(A.anomaly_rows(_spiked(spark, d), SPIKED, ["order_id"]), 5, "value")


@query("anomaly_impact", f"""WITH {SALES_SQL}, {SPIKED_SQL}
SELECT 'spiked_profit' AS "column", CASE WHEN max(abs(sk)) > 1 THEN 'iqr' ELSE 'zscore' END AS method, count(*) FILTER (hit) AS "count",
  round(sum(CASE WHEN hit THEN abs(net_sales) + abs(unit_price) END), 4) AS business_impact FROM h HAVING count(*) FILTER (hit) > 0""")
def _(spark, d):
    return _rounded(A.anomaly_impact(_spiked(spark, d), ["spiked_profit"]), 4, "business_impact")


@query("anomaly_summary", f"""WITH {SALES_SQL}, {SPIKED_SQL}
SELECT CAST(max(CAST(hit AS INT)) + max(CAST(units_hit AS INT)) AS INT) AS flagged_columns, count(*) FILTER (hit) + count(*) FILTER (units_hit) AS flagged_values,
  count(*) FILTER (hit OR units_hit) AS flagged_rows, round(count(*) FILTER (hit OR units_hit) * 100.0 / count(*), 2) AS flagged_row_pct FROM h""")
def _(spark, d):
    return A.anomaly_summary(_spiked(spark, d), SPIKED)


# ---- distributions ----

@query("category_distribution", f"""WITH {MESSY_SQL} {_union(
    f'''SELECT '{c}' AS "column", {c} AS value, count(*) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM messy_sales), 2) AS pct FROM messy_sales GROUP BY 2'''
    for c in ('segment', 'status', 'priority'))}""")
def _(spark, d):
    return T.category_distribution(messy_sales(spark, d, "segment", "status", "priority"), ["segment", "status", "priority"])


@query("category_top_other", f"""WITH {SALES_SQL}, c AS (SELECT sales_representative AS v, count(*) AS n FROM sales GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn, count(*) OVER () AS k FROM c),
g AS (SELECT CASE WHEN k <= 15 OR rn <= 14 THEN v ELSE 'Other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1)
SELECT 'sales_representative' AS "column", value, n AS "count", round(n * 100.0 / (SELECT sum(n) FROM c), 2) AS pct FROM g
UNION ALL SELECT 'region', region, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM sales), 2) FROM sales GROUP BY region""")
def _(spark, d):
    dims = ["sales_representative", "region"]
    return T.category_top_other(sales(spark, d, *dims), dims)


@query("standardize", f"""WITH {SALES_SQL}, m AS (SELECT avg(units_sold) AS a, stddev_samp(units_sold) AS b, avg(net_sales) AS c, stddev_samp(net_sales) AS e FROM sales)
SELECT product_category, count(*) AS n, round(avg((units_sold - a) / b), 6) AS units_sold_z, round(avg((net_sales - c) / e), 6) AS net_sales_z FROM sales, m GROUP BY 1""")
def _(spark, d):
    z = T.standardize(sales(spark, d, "product_category", "units_sold", "net_sales"), ["units_sold", "net_sales"])
    return z.groupBy("product_category").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("units_sold_z", "net_sales_z")])


@query("box_stats", f"""WITH {SALES_SQL}, q AS (SELECT region, quantile_cont(net_sales, [0.25, 0.5, 0.75]) AS q FROM sales GROUP BY 1),
b AS (SELECT s.region, net_sales, q, net_sales BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS inside FROM sales s JOIN q ON s.region = q.region)
SELECT region AS label, round(q[1], 3) AS q1, round(q[2], 3) AS median, round(q[3], 3) AS q3, count(*) AS n, round(min(net_sales) FILTER (inside), 3) AS whisker_low,
  round(max(net_sales) FILTER (inside), 3) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM b GROUP BY region, q""")
def _(spark, d):
    return _rounded(T.box_stats(sales(spark, d, "region", "net_sales"), "net_sales", "region"), 3, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("histogram", f"""WITH {SALES_SQL}, r AS (SELECT min(net_sales) AS lo, max(net_sales) AS hi FROM sales),
c AS (SELECT CAST(least(floor((net_sales - lo) / (hi - lo) * 20) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM sales, r GROUP BY 1)
SELECT b AS bin, round(lo + (b - 1) * (hi - lo) / 20, 3) AS lower, round(lo + b * (hi - lo) / 20, 3) AS upper, coalesce(n, 0) AS "count"
FROM range(1, 21) t(b) CROSS JOIN r LEFT JOIN c ON bin = b""")
def _(spark, d):
    return _rounded(T.histogram(sales(spark, d, "net_sales"), "net_sales"), 3, "lower", "upper")


@query("derived_summary", f"""WITH {SALES_SQL} SELECT 'derived_profit' AS "column", round(avg(net_sales - cost), 3) AS mean FROM sales
UNION ALL SELECT 'derived_profit_margin_pct', round(avg((net_sales - cost) / net_sales * 100), 3) FROM sales
UNION ALL SELECT 'derived_revenue_per_unit', round(avg(net_sales / units_sold), 3) FROM sales""")
def _(spark, d):
    out, _ = derive_metrics(sales(spark, d, "net_sales", "cost", "units_sold"), {"net_sales": "revenue"})
    return _rounded(T.derived_summary(out), 3, "mean")


@query("margin_by_month", f"""WITH {SALES_SQL} SELECT month(order_date) AS month, round(avg(profit_margin), 6) AS avg_margin FROM sales GROUP BY 1""")
def _(spark, d):
    s = date_features(sales(spark, d, "order_date", "profit_margin"), ["order_date"])
    return _rounded(T.margin_by_month(s, "order_date_month", "profit_margin"), 6, "avg_margin")


@query("discount_return_rate", f"""WITH {SALES_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(discount_percentage, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS c FROM sales),
b AS (SELECT returned, c, greatest(1, len(list_filter(c, lambda x: x < discount_percentage))) AS bucket FROM sales, e)
SELECT CAST(bucket AS INT) AS bucket, c[bucket] AS lower, c[bucket + 1] AS upper, round(avg(CAST(returned AS INT)) * 100, 2) AS return_rate_pct, count(*) AS records FROM b GROUP BY bucket, c""")
def _(spark, d):
    return T.discount_return_rate(sales(spark, d, "discount_percentage", "returned"), "discount_percentage", "returned")


@query("margin_by_category_month", f"""WITH {SALES_SQL} SELECT product_category AS category, month(order_date) AS month, round(avg(profit_margin), 2) AS avg_margin FROM sales GROUP BY 1, 2""")
def _(spark, d):
    s = date_features(sales(spark, d, "order_date", "product_category", "profit_margin"), ["order_date"])
    return T.margin_by_category_month(s, "product_category", "order_date_month", "profit_margin")


@query("discount_margin_by_rep", f"""WITH {SALES_SQL} SELECT sales_representative AS label, round(avg(discount_percentage), 2) AS avg_discount, round(avg(profit_margin), 2) AS avg_margin FROM sales GROUP BY 1""")
def _(spark, d):
    s = sales(spark, d, "sales_representative", "discount_percentage", "profit_margin")
    return T.discount_margin_by_rep(s, "sales_representative", "discount_percentage", "profit_margin")


@query("order_value_by_segment", f"""WITH {SALES_SQL} SELECT customer_segment AS label, round(avg(net_sales), 2) AS avg_order_value FROM sales GROUP BY 1""")
def _(spark, d):
    return T.order_value_by_segment(sales(spark, d, "customer_segment", "net_sales"), "customer_segment", "net_sales")


@query("shipping_cost_by_region", f"""WITH {SALES_SQL} SELECT region AS label, round(avg(shipping_cost), 2) AS avg_shipping_cost FROM sales GROUP BY 1""")
def _(spark, d):
    return T.shipping_cost_by_region(sales(spark, d, "region", "shipping_cost"), "region", "shipping_cost")


DAYS = "(epoch_us(ship_date) - epoch_us(order_date)) / 1e6 / 86400"


def _days(spark, d, *dims):
    return derive_metrics(sales(spark, d, "order_date", "ship_date", *dims))[0]


@query("lead_time", f"""WITH {SALES_SQL}, t AS (SELECT {DAYS} AS x FROM sales)
SELECT 'derived_days_to_ship' AS "column", count(x) AS n, round(avg(x), 2) AS mean_days, round(median(x), 2) AS median_days, min(x) AS min_days, max(x) AS max_days FROM t""")
def _(spark, d):
    return T.lead_time(_days(spark, d), "derived_days_to_ship")


LEAD_DIMS = ["region", "product_category", "order_status", "sales_representative"]


@query("lead_time_by", f"""WITH {SALES_SQL}, g AS ({_union(f"SELECT '{c}' AS dimension, {c} AS value, avg({DAYS}) AS m, median({DAYS}) AS md, count(*) AS orders FROM sales GROUP BY {c}" for c in LEAD_DIMS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY m DESC, value) AS a, row_number() OVER (PARTITION BY dimension ORDER BY m, value DESC) AS b, count(*) OVER (PARTITION BY dimension) AS k FROM g)
SELECT dimension, value, round(m, 4) AS mean_days, round(md, 4) AS median_days, orders, a AS rank_slow, b AS rank_fast FROM r WHERE k > 1 AND (a <= 5 OR b <= 5)""")
def _(spark, d):
    return _rounded(T.lead_time_by(_days(spark, d, *LEAD_DIMS), "derived_days_to_ship", LEAD_DIMS), 4, "mean_days", "median_days")


INSIGHT_DIMS = ["region", "customer_segment", "product_category", "order_status"]


@query("insight_ranking", f"""WITH {SALES_SQL}, m AS (SELECT year(order_date) AS y, month(order_date) AS mo, sum(net_sales) AS t FROM sales GROUP BY ALL),
mg AS (SELECT (t - lag(t) OVER (ORDER BY y, mo)) / lag(t) OVER (ORDER BY y, mo) * 100 AS g FROM m),
q AS (SELECT year(order_date) AS y, quarter(order_date) AS mo, sum(net_sales) AS t FROM sales GROUP BY ALL),
qg AS (SELECT (t - lag(t) OVER (ORDER BY y, mo)) / lag(t) OVER (ORDER BY y, mo) * 100 AS g FROM q),
sm AS (SELECT avg(net_sales) AS a FROM sales GROUP BY month(order_date)), sq AS (SELECT avg(net_sales) AS a FROM sales GROUP BY quarter(order_date)),
all_scores AS (
  SELECT 'correlation' AS family, 'all' AS subject, max(abs(r)) * 100 AS s FROM ({_union(f"SELECT corr({a}, {b}) AS r FROM sales" for a, b in _pairs(MEASURES))}) HAVING max(abs(r)) >= 0.3
  UNION ALL SELECT 'growth_monthly', 'revenue', max(abs(g)) FROM mg UNION ALL SELECT 'growth_quarterly', 'revenue', max(abs(g)) FROM qg
  UNION ALL SELECT 'seasonality_month', 'revenue', (max(a) - min(a)) / min(a) * 100 FROM sm UNION ALL SELECT 'seasonality_quarter', 'revenue', (max(a) - min(a)) / min(a) * 100 FROM sq
  {' '.join(f"UNION ALL SELECT 'ranking', '{c}', (max(t) - min(t)) / sum(t) * 100 FROM (SELECT sum(net_sales) AS t FROM sales GROUP BY {c})" for c in INSIGHT_DIMS)}
  {' '.join(f"UNION ALL SELECT 'category', '{c}', greatest(15, max(round(n * 100.0 / (SELECT count(*) FROM sales), 2)) - 100.0 / count(*)) FROM (SELECT count(*) AS n FROM sales GROUP BY {c})" for c in INSIGHT_DIMS)}
  {' '.join(f"UNION ALL SELECT 'histogram', '{c}', abs(skewness({c})) * 15 + 35 FROM sales" for c in MEASURES)}),
bounded AS (SELECT family, subject, round(least(100, s), 1) AS score FROM all_scores)
SELECT *, row_number() OVER (ORDER BY score DESC, family, subject) AS rank FROM bounded QUALIFY rank <= 16""")
def _(spark, d):
    s = written(sales(spark, d, "order_date", *INSIGHT_DIMS, *MEASURES), "insights")  # joined once, read by eight analyses
    totals = R.dimension_totals(s, "net_sales", INSIGHT_DIMS)
    return N.insight_ranking([
        N.correlation_scores(C.corr_pearson(s, MEASURES)),
        N.growth_scores(M.growth_monthly(s, "order_date", "net_sales"), "growth_monthly"),
        N.growth_scores(M.growth_quarterly(s, "order_date", "net_sales"), "growth_quarterly"),
        N.season_scores(M.seasonality_month(s, "order_date", "net_sales"), "seasonality_month"),
        N.season_scores(M.seasonality_quarter(s, "order_date", "net_sales"), "seasonality_quarter"),
        N.ranking_scores(totals), N.category_scores(T.category_distribution(s, INSIGHT_DIMS)),
        N.skew_scores(T.describe_numeric(s, MEASURES))])
