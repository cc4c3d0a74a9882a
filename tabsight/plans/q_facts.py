"""Queries of the output checks, facts, documents, retrieval and charts."""

from pyspark.sql import functions as F

from ..functions.lineage import scratch_path
from ..operators import (categories as C, charts as H, cleaning as K, correlation as R, dedup as D, facts as X, imputation as I,
                         profile as P, rankings as G, retrieval as E, stats as T, timeseries as M, validate as V)
from ..sources import replace_scope
from .q_cleaning import MERGES_SQL, _merges, _status
from .q_stats import PAIRED, PAIRED_SQL, TREND, _paired, _ranked_sql, _trend_sql
from .registry import query
from .views import MESSY_SQL, SALES_SQL, messy_sales, sales, table

# ---- output checks: every region of the sales view is one run ----


def _run(df):
    return df.withColumnRenamed("region", "table_name").withColumn("run_id", F.lit(1))


@query("check_rows", f"""WITH {SALES_SQL}
SELECT region AS table_name, 1 AS run_id, 'row_reconciliation' AS "check", CASE WHEN region = 'ASIA' THEN 'fail' ELSE 'pass' END AS status,
  CAST(region = 'ASIA' AS INT) AS findings FROM sales GROUP BY region""")
def _(spark, d):
    counts = _run(sales(spark, d, "region").groupBy("region").agg(F.count("*").alias("rows")))
    ledger = counts.select("table_name", "run_id", (F.col("rows") + F.when(F.col("table_name") == "ASIA", 1).otherwise(0)).alias("final_rows"))
    return V.check_rows(counts, ledger)


@query("check_schema", """SELECT 'lineitem' AS table_name, 1 AS run_id, 'schema_consistency' AS "check", 'pass' AS status, 0 AS findings
UNION ALL SELECT 'orders', 1, 'schema_consistency', 'fail', 1""")
def _(spark, d):
    plan, have = [], []
    for name in ("orders", "lineitem"):
        df = table(spark, d, name)
        p = P.null_counts(df).select(F.lit(name).alias("table_name"), F.lit(1).alias("run_id"), "column")
        plan.append(p.withColumn("dropped", F.col("column") == "o_custkey"))
        have.append(p.where(~F.col("column").isin("o_custkey", "o_orderdate")))
    return V.check_schema(plan[0].unionAll(plan[1]), have[0].unionAll(have[1]))


@query("check_bounds", f"""WITH {SALES_SQL}, s AS (SELECT region, sum(profit) * 100.0 / sum(net_sales) AS score FROM sales GROUP BY region)
SELECT region AS table_name, 1 AS run_id, 'score_bounds' AS "check", CASE WHEN score BETWEEN 0 AND 100 THEN 'pass' ELSE 'fail' END AS status,
  CAST(NOT score BETWEEN 0 AND 100 AS INT) AS findings FROM s
UNION ALL SELECT DISTINCT region, 1, 'stats_finite', 'pass', 0 FROM sales
UNION ALL SELECT DISTINCT region, 1, 'correlation_bounds', 'pass', 0 FROM sales""")
def _(spark, d):
    s = sales(spark, d, "region", "net_sales", "profit", "cost")
    by = s.groupBy("region").agg(
        (F.sum("profit") * 100 / F.sum("net_sales")).alias("score"), F.avg("cost").alias("mean"), F.stddev_samp("cost").alias("std"),
        F.try_divide(F.covar_samp("net_sales", "cost"), F.stddev_samp("net_sales") * F.stddev_samp("cost")).alias("r"))
    runs = _run(by)
    stats = runs.select("table_name", "run_id", F.explode(F.array("mean", "std")).alias("value"))
    return V.check_bounds(runs.select("table_name", "run_id", "score"), stats, runs.select("table_name", "run_id", "r"))


@query("check_trend_n", f"""WITH {SALES_SQL}, t AS (SELECT region, year(order_date) AS y, sum(net_sales) AS v FROM sales GROUP BY ALL)
SELECT region AS table_name, 1 AS run_id, 'trend_sample' AS "check", CASE WHEN count(*) < 10 THEN 'warn' ELSE 'pass' END AS status,
  CAST(count(*) < 10 AS INT) AS findings FROM t GROUP BY region""")
def _(spark, d):
    years = sales(spark, d, "region", "order_date", "net_sales").groupBy("region", F.year("order_date").alias("y")).agg(F.sum("net_sales").alias("v"))
    return V.check_trend_n(_run(years.groupBy("region").agg(F.count("*").alias("n"))).withColumn("significant", F.lit(True)))


RULE_SQL = f"""{SALES_SQL}, r AS (SELECT region, 'low_margin' AS rule, round(avg(CAST(profit_margin < 0.5 AS INT)) * 100, 4) AS fail_pct FROM sales GROUP BY 1
  UNION ALL SELECT region, 'high_tax', round(avg(CAST(tax_amount > net_sales * 0.075 AS INT)) * 100, 4) FROM sales GROUP BY 1)"""


def _rule_totals(spark, d):
    s = sales(spark, d, "region", "profit_margin", "tax_amount", "net_sales")
    wide = s.groupBy("region").agg(
        F.round(F.avg((F.col("profit_margin") < 0.5).cast("int")) * 100, 4).alias("low_margin"),
        F.round(F.avg((F.col("tax_amount") > F.col("net_sales") * 0.075).cast("int")) * 100, 4).alias("high_tax"))
    return _run(wide.unpivot("region", ["low_margin", "high_tax"], "rule", "fail_pct"))


@query("check_rules", f"""WITH {RULE_SQL}
SELECT region AS table_name, 1 AS run_id, 'business_rules' AS "check", CASE WHEN max(fail_pct) <= 15 THEN 'pass' ELSE 'warn' END AS status,
  arg_max(rule, fail_pct) AS worst_rule, max(fail_pct) AS worst_pct FROM r GROUP BY region""")
def _(spark, d):
    return V.check_rules(_rule_totals(spark, d))


@query("check_merges", f"""WITH {MERGES_SQL}
SELECT 'messy' AS table_name, 1 AS run_id, 'status' AS "column", raw, canonical, round(row_count * 100.0 / (SELECT sum(n) FROM labels), 2) AS changed_pct, false AS unsafe FROM merges
UNION ALL SELECT 'messy', 1, 'status', 'Shipped', 'Pending', round(n * 100.0 / (SELECT sum(n) FROM labels), 2), true FROM labels WHERE label = 'Shipped'""")
def _(spark, d):
    labels = C.label_counts(_status(spark, d), ["status"])
    forced = labels.where("label = 'Shipped'").select("column", F.col("label").alias("raw"), F.lit("Pending").alias("canonical"), F.col("n").alias("row_count"))
    merges = C.fuzzy_merges(labels).drop("distance").unionByName(forced)
    tag = {"table_name": F.lit("messy"), "run_id": F.lit(1)}
    return V.check_merges(merges.withColumns(tag), labels.withColumnRenamed("label", "value").withColumns(tag))


@query("cohen_kappa", """WITH n AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS o, avg(quality) AS qa, avg(toxic) AS ta FROM labels)
SELECT n, round(o, 6) AS observed, round(qa * ta + (1 - qa) * (1 - ta), 6) AS expected,
  round((o - (qa * ta + (1 - qa) * (1 - ta))) / (1 - (qa * ta + (1 - qa) * (1 - ta))), 6) AS kappa FROM n""")
def _(spark, d):
    k = V.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("validation_score", f"""WITH {RULE_SQL}, w AS (SELECT region, max(fail_pct) > 15 AS warn FROM r GROUP BY 1),
c AS (SELECT region, 3 AS checks, CAST(region = 'ASIA' AS INT) AS failed, 1 + CAST(warn AS INT) AS warned FROM w),
s AS (SELECT *, round(100.0 * (checks - failed - warned * 0.5) / checks, 2) AS v FROM c)
SELECT region AS table_name, 1 AS run_id, checks, failed, warned, v AS validation_score, failed = 0 AS passed,
  round(greatest(0, v / 100 * CASE WHEN region = 'AFRICA' THEN 0.5 ELSE 1 END - 0.05), 3) AS confidence FROM s""")
def _(spark, d):
    counts = _run(sales(spark, d, "region").groupBy("region").agg(F.count("*").alias("rows")))
    runs = counts.select("table_name", "run_id")
    ledger = counts.select("table_name", "run_id", (F.col("rows") + F.when(F.col("table_name") == "ASIA", 1).otherwise(0)).alias("final_rows"))
    trends = runs.withColumns({"n": F.lit(7), "significant": F.lit(True)})
    return V.validation_score(
        [V.check_rows(counts, ledger), V.check_rules(_rule_totals(spark, d)), V.check_trend_n(trends)],
        runs.withColumn("review_required", F.col("table_name") == "AFRICA"), runs.withColumn("n", F.lit(1)))


# ---- facts ----

@query("shape_explanation", f"""WITH {MESSY_SQL}, raw AS (SELECT order_id, status, amount, order_date, quantity, segment FROM messy_sales),
seg AS (SELECT count(DISTINCT segment) AS k FROM raw)
SELECT 'column_added' AS kind, 'one_hot_encoding' AS cause, k AS n, 'segment' AS sources FROM seg
UNION ALL SELECT 'column_added', 'date_feature_extraction', 7, 'order_date' UNION ALL SELECT 'column_added', 'validation_flag', 2, ''
UNION ALL SELECT 'column_dropped', 'dropped', 1, 'status'
UNION ALL SELECT 'rows_removed', 'exact_duplicates_removed', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)), '' FROM raw""")
def _(spark, d):
    raw = messy_sales(spark, d, "order_id", "status", "amount", "order_date", "quantity", "segment")
    exact = D.dedup_exact(raw)
    clean = K.encode_one_hot(K.date_features(K.clean_currency(exact, ["amount"]), ["order_date"]), "segment")
    clean = clean.withColumn("quantity_range_failed", F.lit(0)).drop("status")
    return X.shape_explanation(P.null_counts(raw), P.null_counts(clean), D.row_accounting(raw, exact, exact, exact))


@query("missing_action", f"""WITH {MESSY_SQL}, n AS (SELECT count(*) AS k, count(*) - count(quantity) AS q, count(*) - count(unit_price) AS u,
  count(*) - count(segment) AS s, count(*) - count(discount_rate) AS r FROM messy_sales)
SELECT 'quantity' AS "column", q AS missing_count, round(q * 100.0 / k, 2) AS missing_pct, 'median imputation' AS action FROM n
UNION ALL SELECT 'unit_price', u, round(u * 100.0 / k, 2), 'left as null' FROM n
UNION ALL SELECT 'segment', s, round(s * 100.0 / k, 2), 'constant value (Unknown)' FROM n
UNION ALL SELECT 'discount_rate', r, round(r * 100.0 / k, 2), 'left as null' FROM n""")
def _(spark, d):
    raw = messy_sales(spark, d, "quantity", "unit_price", "segment", "discount_rate", "sales")
    clean = I.impute_label(I.impute_median(raw, ["quantity"]), ["segment"])
    before = P.null_counts(raw).withColumn("missing_pct", F.round(F.col("missing_count") * 100.0 / F.col("rows"), 2))
    plan = spark.createDataFrame([("quantity", "count", "impute_median"), ("unit_price", "currency", "impute_mean"),
                                  ("segment", "categorical_label", "impute_unknown_label"), ("discount_rate", "percentage", "impute_mean")],
                                 "column string, semantic_tag string, null_action string")
    return X.missing_action(before, plan, P.null_counts(clean))


@query("top_facts", f"""WITH {SALES_SQL}, {PAIRED_SQL}, sp AS (SELECT col1 || ' ~ ' || col2 AS subject, round(r, 4) AS value, CASE WHEN col2 = 'derived_profit' AND col1 IN ('net_sales', 'cost') THEN 'formulaic'
    WHEN 'line_index' IN (col1, col2) OR col1 IN (SELECT c FROM twins) OR col2 IN (SELECT c FROM twins) THEN 'excluded' ELSE 'strong' END AS kind FROM pr WHERE abs(round(r, 4)) >= 0.5),
t AS (SELECT *, CAST(year(order_date) * 12 + month(order_date) AS DOUBLE) AS tt FROM sales), tr AS ({_trend_sql('t', 'tt', 'x', TREND)}),
g AS (SELECT year(order_date) AS y, month(order_date) AS m, sum(net_sales) AS v FROM sales GROUP BY ALL),
gl AS (SELECT y || '-M' || lpad(CAST(m AS VARCHAR), 2, '0') AS subject, (v - lag(v) OVER (ORDER BY y, m)) / lag(v) OVER (ORDER BY y, m) * 100 AS value FROM g ORDER BY y DESC, m DESC LIMIT 1),
sm AS (SELECT strftime(make_date(2000, CAST(month(order_date) AS INT), 1), '%b') AS subject, avg(net_sales) AS value FROM sales GROUP BY 1)
SELECT kind AS topic, subject, value FROM sp QUALIFY row_number() OVER (PARTITION BY kind ORDER BY abs(value) DESC, subject) <= 5
UNION ALL SELECT * FROM (SELECT 'trend', "column", round(r_squared, 4) FROM tr WHERE significant ORDER BY r_squared DESC, "column" LIMIT 5)
UNION ALL SELECT 'latest_growth', subject, round(value, 4) FROM gl
UNION ALL SELECT 'best_period', subject, round(value, 4) FROM sm WHERE value = (SELECT max(value) FROM sm)
UNION ALL SELECT 'worst_period', subject, round(value, 4) FROM sm WHERE value = (SELECT min(value) FROM sm)""")
def _(spark, d):
    df, sources = _paired(spark, d)
    pairs = R.corr_pearson(df, PAIRED)
    strong = R.strong_pairs(pairs, R.formulaic_pairs(df, PAIRED, sources), R.leakage_columns(df, pairs))
    s = sales(spark, d, "order_date", *TREND)
    return X.top_facts(strong, M.trend_regression(s, TREND, "order_date"), M.growth_monthly(s, "order_date", "net_sales"),
                       M.seasonality_month(s, "order_date", "net_sales")).withColumn("value", F.round("value", 4))


@query("rank_slices", f"""{_ranked_sql('net_sales', ['region', 'product_category', 'sales_representative']).split('SELECT dimension, value, round')[0]}
SELECT dimension, value, round(total, 4) AS total, n AS total_categories, 'top' AS part, a AS place FROM r WHERE a <= 3
UNION ALL SELECT dimension, value, round(total, 4), n, 'bottom', row_number() OVER (PARTITION BY dimension ORDER BY b) FROM r WHERE a > 3 AND b <= 5
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY b) <= 3""")
def _(spark, d):
    dims = ["region", "product_category", "sales_representative"]
    ranked = G.rank_dimension(sales(spark, d, *dims, "net_sales"), "net_sales", dims)
    return X.rank_slices(ranked).withColumn("total", F.round("total", 4))


@query("normalization_facts", f'WITH {MERGES_SQL} SELECT "column", raw, canonical, row_count FROM merges')
def _(spark, d):
    return X.normalization_facts(_merges(spark, d))


@query("required_cells", f"""WITH {MESSY_SQL}
SELECT 'segments' AS result, 'segment' AS field, 1 AS empty UNION ALL SELECT 'segments', 'n', 0
UNION ALL SELECT 'priorities', 'priority', count(DISTINCT priority) FILTER (trim(priority) = '') FROM messy_sales""")
def _(spark, d):
    m = messy_sales(spark, d, "segment", "priority")
    return X.required_cells({"segments": (m.groupBy("segment").agg(F.count("*").alias("n")), ["segment", "n"]),
                             "priorities": (m.groupBy("priority").agg(F.count("*").alias("n")), ["priority"])})


FACT_SQL = """facts AS (SELECT DISTINCT round(v, 2) AS fact FROM (
  SELECT unnest([count(*), avg(n_chars), min(n_chars), max(n_chars)]) AS v FROM documents GROUP BY source))"""


def _facts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array(
        F.count("*").cast("double"), F.avg("n_chars"), F.min("n_chars").cast("double"), F.max("n_chars").cast("double")).alias("v")).select(
        F.explode("v").alias("fact"))


def _ground_sql(rel, keys):
    k = ", ".join(keys)
    return f"""WITH {FACT_SQL}, m AS (SELECT {k}, unnest(regexp_extract_all(text, '-?[0-9][0-9,]*\\.?[0-9]*%?')) AS t FROM {rel}),
p AS (SELECT {k}, ends_with(t, '%') AS pc, replace(rtrim(t, '%'), ',', '') AS s FROM m),
c AS (SELECT {k}, TRY_CAST(s AS DOUBLE) AS v FROM p WHERE pc OR contains(s, '.') OR abs(TRY_CAST(s AS DOUBLE)) >= 10),
g AS (SELECT {k}, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM facts WHERE abs(v - fact) <= greatest(1.0, abs(fact) * 0.05))) AS ok FROM c WHERE v IS NOT NULL GROUP BY {k})
SELECT {', '.join('b.' + x for x in keys)}, coalesce(n, 0) AS claims_checked, coalesce(ok, 0) AS claims_grounded, coalesce(round(ok / n, 3), 1.0) AS confidence
FROM (SELECT DISTINCT {k} FROM {rel}) b LEFT JOIN g USING ({k})"""


@query("ground_claims", _ground_sql("conversations", ["conv_id", "turn"]))
def _(spark, d):
    return X.ground_claims(table(spark, d, "conversations"), _facts(spark, d), ["conv_id", "turn"])


@query("ground_claims_documents", _ground_sql("documents", ["doc_id"]))
def _(spark, d):
    return X.ground_claims(table(spark, d, "documents"), _facts(spark, d), ["doc_id"])


# ---- documents and retrieval ----

@query("row_documents", """WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer)
SELECT row_index, 'Row ' || row_index || ': c_custkey=' || c_custkey || ' | c_name=' || c_name ||
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '' ELSE ' | segment=' || c_mktsegment END || ' | c_nationkey=' || c_nationkey AS text FROM c""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 1, "NaN").when(
        F.col("c_custkey") % 5 > 1, F.col("c_mktsegment")).alias("segment"), "c_nationkey")
    return E.row_documents(c, ["c_custkey"])


@query("sample_rows", """SELECT * FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 5000""")
def _(spark, d):
    return E.sample_rows(table(spark, d, "orders"), ["o_orderkey"], 5_000)


@query("fact_documents", f"""WITH {SALES_SQL}, r AS (SELECT region, sum(net_sales) AS t FROM sales GROUP BY 1)
SELECT 'run1' AS scope_id, 'ranking' AS doc_type, count(*) AS n, count(*) FILTER (regexp_matches(region, '^[A-Z ]+$')) AS named FROM r
UNION ALL SELECT 'run1', 'descriptive_stat', 2, 0 UNION ALL SELECT 'run1', 'dataset_summary', 1, 0
UNION ALL SELECT 'run1', 'correlation', 1, 0 FROM sales HAVING abs(corr(units_sold, cost)) >= 0.5""")
def _(spark, d):
    s = sales(spark, d, "region", "net_sales", "units_sold", "cost")
    pairs = R.corr_pearson(s, ["units_sold", "cost"])
    none = spark.createDataFrame([], "col1 string, col2 string, column string")
    docs = E.fact_documents(
        "run1", dataset=P.profile_shape(s), described=T.describe_numeric(s, ["units_sold", "cost"]),
        pairs=R.strong_pairs(pairs, none, none), ranked=G.rank_dimension(s, "net_sales", ["region"]))
    return docs.groupBy("scope_id", "doc_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").rlike("^region [A-Z ]+ has a total of")).alias("named"))


DIM = 64


def _documents(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("_first"))
    kind = F.when(F.col("vec_id") == F.col("_first"), "dataset_summary").when(F.col("vec_id") % 5 == 0, "descriptive_stat").otherwise("row")
    return e.join(first, "label").select(F.col("label").alias("scope_id"), F.col("vec_id").alias("doc_id"), kind.alias("doc_type"), "embedding")


VECTOR_SQL = """docs AS (SELECT label AS scope_id, vec_id AS doc_id, CASE WHEN vec_id = min(vec_id) OVER (PARTITION BY label) THEN 'dataset_summary'
    WHEN vec_id % 5 = 0 THEN 'descriptive_stat' ELSE 'row' END AS doc_type, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT scope_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM docs),
a AS (SELECT scope_id, i, avg(x) AS x FROM u GROUP BY ALL), q AS (SELECT scope_id, list(x ORDER BY i) AS c FROM a GROUP BY 1),
s AS (SELECT docs.scope_id, doc_id, doc_type, 1 - list_cosine_similarity(e, c) AS distance, CASE WHEN doc_type = 'row' THEN 'row' ELSE 'fact' END AS kind FROM docs JOIN q ON docs.scope_id = q.scope_id),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, kind ORDER BY distance, doc_id) AS rank FROM s)"""


@query("vector_topk", f"""WITH {VECTOR_SQL}, k AS (SELECT * FROM r WHERE rank <= CASE WHEN kind = 'row' THEN 8 ELSE 6 END)
SELECT scope_id, 0 AS question_id, doc_id, doc_type, round(distance, 6) AS distance, kind, rank FROM k
UNION ALL SELECT scope_id, 0, doc_id, doc_type, round(distance, 6), kind, 0 FROM s WHERE doc_type = 'dataset_summary'
  AND scope_id NOT IN (SELECT scope_id FROM k WHERE doc_type = 'dataset_summary')""")
def _(spark, d):
    docs = _documents(spark, d)
    centres = docs.groupBy("scope_id").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(DIM)]).alias("embedding"))
    return E.vector_topk(docs, centres.withColumn("question_id", F.lit(0))).withColumn("distance", F.round("distance", 6))


@query("replace_scope", """SELECT label AS scope_id, count(*) * CASE WHEN label = 1 THEN 1 ELSE 2 END AS n,
  CASE WHEN label = 1 THEN 0 ELSE count(*) END AS old FROM embeddings GROUP BY label""")
def _(spark, d):
    path = scratch_path(spark, "scopes")
    e = table(spark, d, "embeddings").select(F.col("label").alias("scope_id"), "vec_id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("version"))
    replace_scope(e, path)
    replace_scope(e.where("scope_id = 1 and version = 'new'"), path)
    return spark.read.parquet(path).groupBy("scope_id").agg(F.count("*").alias("n"), F.count_if(F.col("version") == "old").alias("old"))


# ---- charts ----

@query("chart_query", f"""WITH {SALES_SQL}
SELECT sales_representative AS label, round(avg(net_sales), 4) AS value FROM sales GROUP BY 1 ORDER BY avg(net_sales) DESC, label LIMIT 15""")
def _(spark, d):
    return H.chart_query(sales(spark, d, "sales_representative", "net_sales"), "bar", "sales_representative", "net_sales", agg="mean").withColumn(
        "value", F.round("value", 4))


@query("chart_median", f"""WITH {SALES_SQL}
SELECT region AS label, round(median(net_sales), 4) AS value FROM sales GROUP BY 1""")
def _(spark, d):
    return H.chart_query(sales(spark, d, "region", "net_sales"), "line", "region", "net_sales", agg="median").withColumn("value", F.round("value", 4))


@query("chart_line", f"""WITH {SALES_SQL}
SELECT strftime(order_date, '%Y-%m') AS label, round(sum(net_sales), 4) AS value FROM sales GROUP BY 1""")
def _(spark, d):
    months = sales(spark, d, "order_date", "net_sales").withColumn("month", F.date_format("order_date", "yyyy-MM"))
    return H.chart_query(months, "line", "month", "net_sales").withColumn("value", F.round("value", 4))


@query("chart_scatter", """SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def _(spark, d):
    return H.chart_query(table(spark, d, "lineitem"), "scatter", "l_quantity", "l_extendedprice")


@query("chart_histogram", f"""WITH {SALES_SQL}, r AS (SELECT min(tax_amount) AS lo, max(tax_amount) AS hi FROM sales),
c AS (SELECT CAST(least(floor((tax_amount - lo) / (hi - lo) * 20) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM sales, r GROUP BY 1)
SELECT b AS bin, round(lo + (b - 1) * (hi - lo) / 20, 3) AS lower, round(lo + b * (hi - lo) / 20, 3) AS upper, coalesce(n, 0) AS "count"
FROM range(1, 21) t(b) CROSS JOIN r LEFT JOIN c ON bin = b""")
def _(spark, d):
    out = H.chart_query(sales(spark, d, "tax_amount"), "histogram", "tax_amount")
    return out.withColumns({c: F.round(c, 3) for c in ("lower", "upper")})


@query("chart_box", f"""WITH {SALES_SQL}, q AS (SELECT customer_segment, quantile_cont(shipping_cost, [0.25, 0.5, 0.75]) AS q FROM sales GROUP BY 1),
b AS (SELECT s.customer_segment, shipping_cost, q, shipping_cost BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS inside
  FROM sales s JOIN q ON s.customer_segment = q.customer_segment)
SELECT customer_segment AS label, round(q[1], 3) AS q1, round(q[2], 3) AS median, round(q[3], 3) AS q3, count(*) AS n, round(min(shipping_cost) FILTER (inside), 3) AS whisker_low,
  round(max(shipping_cost) FILTER (inside), 3) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM b GROUP BY customer_segment, q""")
def _(spark, d):
    out = H.chart_query(sales(spark, d, "customer_segment", "shipping_cost"), "box", "shipping_cost", group_by="customer_segment")
    return out.withColumns({c: F.round(c, 3) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})
