"""Queries of the cleaning steps, deduplication and imputation."""

from pyspark.sql import functions as F

from ..functions.text import quoted
from ..operators import categories as C, cleaning as K, dedup as D, imputation as I
from .registry import query
from .views import MESSY_SQL, SALES_SQL, messy_sales, sales, table


def _messy(spark, d, *columns):
    return messy_sales(spark, d, *columns)


# ---- money, types, text ----

@query("clean_currency", f"""WITH {MESSY_SQL}
SELECT substr(amount, 1, 1) AS first_char, count(*) AS n, CAST(count(*) FILTER (amount = 'abc') AS BIGINT) AS failed,
  round(sum(CASE line % 4 WHEN 1 THEN true_amount WHEN 2 THEN true_amount WHEN 3 THEN -true_amount END), 4) AS total,
  min(CASE line % 4 WHEN 1 THEN true_amount WHEN 2 THEN true_amount WHEN 3 THEN -true_amount END) AS lowest,
  max(CASE line % 4 WHEN 1 THEN true_amount WHEN 2 THEN true_amount WHEN 3 THEN -true_amount END) AS highest
FROM messy_sales GROUP BY 1""")
def _(spark, d):
    m = _messy(spark, d, "amount").withColumn("first_char", F.substring("amount", 1, 1))
    return K.clean_currency(m, ["amount"]).groupBy("first_char").agg(
        F.count("*").alias("n"), F.sum("amount_parse_failed").alias("failed"), F.round(F.sum("amount"), 4).alias("total"),
        F.min("amount").alias("lowest"), F.max("amount").alias("highest"))


@query("currency_checks", f"""WITH {MESSY_SQL}
SELECT 'amount' AS "column", count(*) FILTER (amount = 'abc') AS nulls, count(*) FILTER (amount = 'abc') AS failed,
  count(*) FILTER (amount <> 'abc') AS parsed, max(CASE WHEN amount <> 'abc' THEN true_amount END) AS max_abs, false AS critical
FROM messy_sales""")
def _(spark, d):
    return K.currency_checks(K.clean_currency(_messy(spark, d, "amount"), ["amount"]), ["amount"])


@query("coerce_types", f"""WITH {MESSY_SQL}
SELECT true_date AS order_date, count(*) AS n, count(*) FILTER (active IN ('yes', '1')) AS active_yes,
  count(*) FILTER (active IN ('no', 'FALSE')) AS active_no, count(segment) AS segments,
  CAST(sum(order_id) AS BIGINT) AS keys FROM messy_sales GROUP BY 1""")
def _(spark, d):
    m = _messy(spark, d, "order_id", "order_date", "active", "segment").withColumn("order_id", F.col("order_id").cast("string"))
    typed = K.coerce_types(m, {"order_id": "int", "order_date": "datetime", "active": "boolean", "segment": "category"})
    return typed.groupBy("order_date").agg(
        F.count("*").alias("n"), F.count_if("active").alias("active_yes"), F.count_if(~F.col("active")).alias("active_no"),
        F.count("segment").alias("segments"), F.sum("order_id").alias("keys"))


DATE_TEXTS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss'+00:00'", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "d MMMM yyyy", "MMMM d, yyyy",
              "MMM d yyyy", "dd-MMM-yyyy", "yyyy.MM.dd", "M/d/yy"]


@query("coerce_dates", """SELECT o_orderkey % 12 AS shape, count(*) AS n, count(*) FILTER (o_orderkey % 12 = 11) AS failed,
  min(CASE WHEN o_orderkey % 12 < 11 THEN o_orderdate END) AS first_day, max(CASE WHEN o_orderkey % 12 < 11 THEN o_orderdate END) AS last_day,
  CAST(sum(CASE WHEN o_orderkey % 12 < 11 THEN epoch(o_orderdate) // 86400 END) AS BIGINT) AS days FROM orders GROUP BY 1""")
def _(spark, d):
    shape = F.col("o_orderkey") % 12
    text = F.lit("no date")
    for i, pattern in enumerate(DATE_TEXTS):
        text = F.when(shape == i, F.date_format("o_orderdate", pattern)).otherwise(text)
    typed = K.coerce_types(table(spark, d, "orders").select(shape.alias("shape"), text.alias("day")), {"day": "datetime"})
    return typed.groupBy("shape").agg(F.count("*").alias("n"), F.sum("day_parse_failed").alias("failed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                      F.sum(F.datediff("day", F.lit("1970-01-01"))).alias("days"))


# Written dates; those of the last three name a month only, and the last but three has a clock inside.
WRITTEN_DATES = ["E, dd MMM yyyy", "EEEE, MMMM d, yyyy", "dd-MMM-yy", "ddMMMyyyy", "MMM d, ''yy", "yyyy MMM dd", "E MMM d '10:00:00' yyyy", "MMM yyyy", "yyyy-MM", "MM/yyyy"]


@query("coerce_written_dates", """WITH t AS (SELECT o_orderkey % 12 AS shape, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders),
w AS (SELECT shape, CASE WHEN shape IN (4, 11) THEN NULL WHEN shape = 6 THEN day + INTERVAL 10 HOUR WHEN shape BETWEEN 7 AND 9 THEN date_trunc('month', day) ELSE day END AS day FROM t)
SELECT shape, day, count(*) AS n, count(*) FILTER (shape IN (4, 11)) AS failed FROM w GROUP BY ALL""")
def _(spark, d):
    """Dates with week days, ordinal days, two-digit years behind a month's name, a clock in the middle, or no day; two shapes are no dates."""
    shape, day = F.col("o_orderkey") % 12, F.col("o_orderdate")
    dom = F.dayofmonth(day)
    ending = F.when(dom.isin(1, 21, 31), "st").when(dom.isin(2, 22), "nd").when(dom.isin(3, 23), "rd").otherwise("th")
    text = F.when(shape == 10, F.concat(dom.cast("string"), ending, F.lit(" of "), F.date_format(day, "MMMM yyyy"))).otherwise("MMM 99 of 2024")
    for i, pattern in enumerate(WRITTEN_DATES):
        text = F.when(shape == i, F.date_format(day, pattern)).otherwise(text)
    typed = K.coerce_types(table(spark, d, "orders").select(shape.alias("shape"), text.alias("day")), {"day": "datetime"})
    return typed.groupBy("shape", "day").agg(F.count("*").alias("n"), F.sum("day_parse_failed").alias("failed"))


CANON_SQL = """nullif(list_aggregate(list_transform(string_split(trim(regexp_replace(regexp_replace(
  CASE WHEN lower(trim({0})) IN ('n/a', '', 'nan', 'none', 'null', 'na', '-', 'unknown', 'nil', '#n/a') THEN NULL ELSE {0} END,
  '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '), '')"""


@query("null_text", f"""WITH {MESSY_SQL}
SELECT CASE WHEN lower(trim(priority)) NOT IN ('n/a', '') THEN trim(priority) END AS priority, count(*) AS n FROM messy_sales GROUP BY 1""")
def _(spark, d):
    return K.null_text(_messy(spark, d, "priority"), ["priority"]).groupBy("priority").agg(F.count("*").alias("n"))


@query("canonical_text", f"""WITH {MESSY_SQL}
SELECT {CANON_SQL.format('priority')} AS priority, {CANON_SQL.format('status')} AS status, count(*) AS n FROM messy_sales GROUP BY 1, 2""")
def _(spark, d):
    return K.canonical_text(_messy(spark, d, "priority", "status"), ["priority", "status"]).groupBy(
        "priority", "status").agg(F.count("*").alias("n"))


@query("category_label_norm", f"""WITH {MESSY_SQL}
SELECT nullif(lower(trim(regexp_replace(regexp_replace(priority, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))), '') AS priority, count(*) AS n
FROM messy_sales GROUP BY 1""")
def _(spark, d):
    return K.category_label_norm(_messy(spark, d, "priority"), ["priority"]).groupBy("priority").agg(F.count("*").alias("n"))


MERGES_SQL = f"""{MESSY_SQL}, labels AS (SELECT {CANON_SQL.format('status')} AS label, count(*) AS n FROM messy_sales GROUP BY 1),
edges AS (SELECT s.label AS raw, t.label AS canonical, s.n AS row_count, t.n AS target_n, levenshtein(s.label, t.label) AS distance
  FROM labels s JOIN labels t ON s.label <> t.label AND t.n > s.n AND lower(s.label[1]) = lower(t.label[1])
    AND levenshtein(s.label, t.label) <= 2 AND least(length(s.label), length(t.label)) >= 6
    AND s.n * 100.0 / (SELECT sum(n) FROM labels) <= 1),
merges AS (SELECT 'status' AS "column", raw, canonical, row_count, distance FROM edges
  WHERE canonical NOT IN (SELECT raw FROM edges)
  QUALIFY row_number() OVER (PARTITION BY raw ORDER BY target_n DESC, canonical) = 1)"""


def _status(spark, d):
    return K.canonical_text(_messy(spark, d, "status"), ["status"])


def _merges(spark, d):
    return C.fuzzy_merges(C.label_counts(_status(spark, d), ["status"]))


@query("fuzzy_category_merge", f"""WITH {MERGES_SQL}
SELECT coalesce(m.canonical, l.label) AS status, CAST(sum(l.n) AS BIGINT) AS n FROM labels l LEFT JOIN merges m ON l.label = m.raw GROUP BY 1""")
def _(spark, d):
    return C.fuzzy_category_merge(_status(spark, d), ["status"])[0].groupBy("status").agg(F.count("*").alias("n"))


@query("fuzzy_merge_list", f"WITH {MERGES_SQL} SELECT * FROM merges")
def _(spark, d):
    return _merges(spark, d)


@query("fuzzy_review_list", """WITH labels AS (SELECT p_brand[1] || 'r' || p_brand[7:] AS label, count(*) AS n FROM part GROUP BY 1),
near AS (SELECT a.label, a.n AS row_count, b.label AS near_candidate, levenshtein(a.label, b.label) AS distance,
  row_number() OVER (PARTITION BY a.label ORDER BY levenshtein(a.label, b.label), b.n DESC, b.label) AS rn
  FROM labels a JOIN labels b ON a.label <> b.label AND levenshtein(a.label, b.label) <= 2
    AND least(length(a.label), length(b.label)) < 6)
SELECT 'brand' AS "column", label, row_count, near_candidate, distance FROM near WHERE rn = 1""")
def _(spark, d):
    brand = table(spark, d, "part").select(F.concat(F.lit("Br"), F.substring("p_brand", 7, 9)).alias("brand"))
    labels = C.label_counts(brand, ["brand"])
    return C.fuzzy_flags(labels, C.fuzzy_merges(labels))


# ---- encodings ----

ORDER = ["Pending", "Shipped", "Complete", "Cancelled"]


@query("encode_ordinal", f"""WITH {MESSY_SQL}
SELECT CASE lower(trim(status)) WHEN 'pending' THEN 0 WHEN 'shipped' THEN 1 WHEN 'complete' THEN 2 WHEN 'cancelled' THEN 3 END AS status__ordinal,
  count(*) AS n FROM messy_sales GROUP BY 1""")
def _(spark, d):
    return K.encode_ordinal(_messy(spark, d, "status"), "status", ORDER).groupBy("status__ordinal").agg(F.count("*").alias("n"))


def _hot_totals(df, column):
    return df.groupBy(F.lit(column).alias("source")).agg(F.count("*").alias("n"), *[
        F.sum(quoted(c)).alias(c.lower().replace(" ", "_")) for c in df.columns if c.startswith(f"{column}__")])


@query("encode_one_hot", f"""WITH {MESSY_SQL}
SELECT 'segment' AS source, count(*) AS n, {', '.join(f"count(*) FILTER (segment = '{s}') AS segment__{s.lower()}"
    for s in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM messy_sales""")
def _(spark, d):
    return _hot_totals(K.encode_one_hot(_messy(spark, d, "segment"), "segment"), "segment")


@query("encode_top_other", """WITH t AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn FROM t)
SELECT CASE WHEN rn <= 8 THEN v ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def _(spark, d):
    hot = K.encode_one_hot(table(spark, d, "part").select("p_brand"), "p_brand")
    flags = [c for c in hot.columns if c.startswith("p_brand__")]
    sums = hot.agg(*[F.sum(quoted(c)).alias(c) for c in flags])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c.split("__")[1]).alias("label"), quoted(c).alias("n"))
                                           for c in flags])).alias("_x")).select("_x.*")


# ---- imputation ----

FILLS = ["quantity", "unit_price", "discount_rate"]
FILL_STATS = "count(*) AS n, round(sum({0}), 2) AS total, count({0}) AS filled"


def _fill_totals(df, column, by="line"):
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(column), 2).alias("total"), F.count(column).alias("filled"))


@query("impute_mean", f"""WITH {MESSY_SQL}, f AS (SELECT line, coalesce(unit_price, (SELECT avg(unit_price) FROM messy_sales)) AS v FROM messy_sales)
SELECT line, {FILL_STATS.format('v')} FROM f GROUP BY 1""")
def _(spark, d):
    return _fill_totals(I.impute_mean(_messy(spark, d, "line", "unit_price"), ["unit_price"]), "unit_price")


@query("impute_median", f"""WITH {MESSY_SQL}, f AS (SELECT line, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM messy_sales)) AS v FROM messy_sales)
SELECT line, {FILL_STATS.format('v')} FROM f GROUP BY 1""")
def _(spark, d):
    return _fill_totals(I.impute_median(_messy(spark, d, "line", "quantity"), ["quantity"]), "quantity")


@query("impute_mode", f"""WITH {MESSY_SQL}, m AS (SELECT segment FROM messy_sales WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1),
mq AS (SELECT discount_rate FROM messy_sales WHERE discount_rate IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, discount_rate LIMIT 1)
SELECT coalesce(segment, (SELECT segment FROM m)) AS segment, count(*) AS n,
  round(sum(coalesce(discount_rate, (SELECT discount_rate FROM mq))), 3) AS rates FROM messy_sales GROUP BY 1""")
def _(spark, d):
    return I.impute_mode(_messy(spark, d, "segment", "discount_rate"), ["segment", "discount_rate"]).groupBy("segment").agg(
        F.count("*").alias("n"), F.round(F.sum("discount_rate"), 3).alias("rates"))


@query("impute_label", f"WITH {MESSY_SQL} SELECT coalesce(segment, 'Unknown') AS segment, count(*) AS n FROM messy_sales GROUP BY 1")
def _(spark, d):
    return I.impute_label(_messy(spark, d, "segment"), ["segment"]).groupBy("segment").agg(F.count("*").alias("n"))


ORDERED = "o_orderdate, o_orderkey"


@query("impute_ffill", f"""WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE o_totalprice END AS price FROM orders),
f AS (SELECT o_orderkey, last_value(price IGNORE NULLS) OVER (ORDER BY {ORDERED} ROWS UNBOUNDED PRECEDING) AS price FROM o)
SELECT o_orderkey, price FROM f""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(
        F.col("o_orderkey") % 10 >= 4, F.col("o_totalprice")).alias("price"))
    return I.impute_ffill(o, ["price"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "price")


CUSTOMER_SQL = """base AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS balance,
    sum(o_totalprice) / 100 AS spend, CAST(count(o_orderkey) AS DOUBLE) * 100 AS orders,
    CASE WHEN c_custkey % 7 = 1 THEN NULL ELSE avg(CAST(o_orderstatus = 'F' AS INT)) * 1000 END AS finished
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal)"""


def _customers(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("s"), F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("balance"),
        (F.col("s") / 100).alias("spend"), (F.coalesce("n", F.lit(0)).cast("double") * 100).alias("orders"),
        F.when(F.col("c_custkey") % 7 != 1, F.col("f") * 1000).alias("finished"))


def _term(c):
    return f"CASE WHEN q.{c} IS NOT NULL AND e.{c} IS NOT NULL THEN (q.{c} - e.{c}) * (q.{c} - e.{c}) ELSE 0 END"


def _knn_sql(t):
    cols = ["balance", "spend", "orders", "finished"]
    both = " + ".join(f"CAST(q.{c} IS NOT NULL AND e.{c} IS NOT NULL AS INT)" for c in cols)
    return f"""SELECT c_custkey, avg(v) AS v FROM (SELECT q.c_custkey, e.{t} AS v, row_number() OVER (PARTITION BY q.c_custkey
        ORDER BY ({' + '.join(_term(c) for c in cols)}) * 4.0 / ({both}), e.c_custkey) AS rn
      FROM base q JOIN base e ON e.{t} IS NOT NULL AND ({both}) > 0 WHERE q.{t} IS NULL) WHERE rn <= 5 GROUP BY 1"""


@query("impute_knn", f"""WITH {CUSTOMER_SQL}, b AS ({_knn_sql('balance')}), f AS ({_knn_sql('finished')})
SELECT c_custkey, round(coalesce(balance, b.v), 4) AS balance, round(coalesce(finished, f.v), 4) AS finished
FROM base LEFT JOIN b USING (c_custkey) LEFT JOIN f USING (c_custkey)""")
def _(spark, d):
    out = I.impute_knn(_customers(spark, d), ["balance", "finished"], ["c_custkey"])
    return out.select("c_custkey", F.round("balance", 4).alias("balance"), F.round("finished", 4).alias("finished"))


@query("impute_iterative")
def _(spark, d):
    out = I.impute_iterative(_customers(spark, d), ["balance", "spend", "finished"], ["balance", "spend", "orders", "finished"])
    return out.select("c_custkey", *[F.round(c, 4).alias(c) for c in ("balance", "spend", "finished")])


def _related(spark, d):
    """Four measures tied by an exact relation: bulk = 3 quantity + 200 discount_rate - 7, weight = quantity / 2 + 40 discount_rate, each with its own gaps."""
    key, q, r = F.col("order_id") * 7 + F.col("line"), F.col("units_sold"), F.col("discount_percentage")
    s = sales(spark, d, "order_id", "line", "units_sold", "discount_percentage")
    return s.select("order_id", "line", q.alias("quantity"), r.alias("rate"), F.when(key % 5 > 0, 3 * q + 200 * r - 7).alias("bulk"),
                    F.when(key % 7 > 1, q / 2 + 40 * r).alias("weight"))


RELATED_SQL = f"""WITH {SALES_SQL} SELECT line, count(*) AS n, round(avg(3 * units_sold + 200 * discount_percentage - 7), 2) AS bulk,
  round(avg(units_sold / 2 + 40 * discount_percentage), 2) AS weight, 0 AS far FROM sales GROUP BY 1"""


def _related_totals(spark, d, out):
    want = (F.abs(F.col("bulk") - (3 * F.col("quantity") + 200 * F.col("rate") - 7)) > 0.01) | (F.abs(F.col("weight") - (F.col("quantity") / 2 + 40 * F.col("rate"))) > 0.01)
    return out.groupBy("line").agg(F.count("*").alias("n"), F.round(F.avg("bulk"), 2).alias("bulk"), F.round(F.avg("weight"), 2).alias("weight"), F.count_if(want).alias("far"))


@query("impute_iterative_related", RELATED_SQL)
def _(spark, d):
    return _related_totals(spark, d, I.impute_iterative(_related(spark, d), ["bulk", "weight"], ["quantity", "rate", "bulk", "weight"]))


@query("drop_rows_null", f"WITH {MESSY_SQL} SELECT segment, count(*) AS n FROM messy_sales WHERE quantity IS NOT NULL GROUP BY 1")
def _(spark, d):
    return I.drop_rows_null(_messy(spark, d, "segment", "quantity"), ["quantity"]).groupBy("segment").agg(F.count("*").alias("n"))


@query("drop_column", f"WITH {MESSY_SQL} SELECT line, count(segment) AS n FROM messy_sales GROUP BY 1")
def _(spark, d):
    return I.drop_column(_messy(spark, d, "line", "segment", "quantity"), ["quantity"]).groupBy("line").agg(F.count("segment").alias("n"))


@query("impute_plan", f"""WITH {MESSY_SQL}, q AS (SELECT quantile_cont(quantity, 0.5) AS med, avg(discount_rate) AS mean FROM messy_sales)
SELECT coalesce(segment, 'Unknown') AS segment, count(*) AS n, round(sum(coalesce(quantity, med)), 2) AS quantity,
  round(sum(coalesce(discount_rate, mean)), 3) AS discount_rate, count(unit_price) AS priced
FROM messy_sales, q WHERE priority IS NOT NULL AND status <> '' GROUP BY 1""")
def _(spark, d):
    m = _messy(spark, d, "segment", "quantity", "discount_rate", "unit_price", "priority", "active")
    out = I.impute_plan(
        m, {"segment": "impute_unknown_label", "quantity": "impute_median", "discount_rate": "impute_mean",
            "unit_price": "impute_mean", "priority": "drop_rows", "active": "drop_column"}, {"unit_price": "currency"})
    return out.groupBy("segment").agg(
        F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"),
        F.round(F.sum("discount_rate"), 3).alias("discount_rate"), F.count("unit_price").alias("priced"))


# ---- clipping, scaling, dates, derived ----

@query("clip_outliers", f"""WITH {SALES_SQL}, b AS (SELECT quantile_cont(unit_price, [0.25, 0.75]) AS u,
  quantile_cont(net_sales, [0.05, 0.95]) AS s FROM sales),
c AS (SELECT product_category, units_sold, net_sales, least(greatest(net_sales, s[1]), s[2]) AS clipped,
  net_sales < s[1] OR net_sales > s[2] AS hit FROM sales, b)
SELECT product_category, count(*) AS n, round(sum(clipped), 2) AS clipped, round(sum(net_sales), 2) AS raw,
  count(*) FILTER (hit) AS was_clipped FROM c GROUP BY 1""")
def _(spark, d):
    out = K.clip_outliers(sales(spark, d, "product_category", "net_sales"), ["net_sales"], risk="high")
    return out.groupBy("product_category").agg(
        F.count("*").alias("n"), F.round(F.sum("net_sales"), 2).alias("clipped"), F.round(F.sum("net_sales_raw"), 2).alias("raw"),
        F.count_if("net_sales_was_clipped").alias("was_clipped"))


@query("scale_minmax", f"""WITH {SALES_SQL}, r AS (SELECT min(unit_price) AS a, max(unit_price) AS b, min(cost) AS c, max(cost) AS e FROM sales)
SELECT product_category, round(avg((unit_price - a) / (b - a)), 6) AS unit_price, round(avg((cost - c) / (e - c)), 6) AS cost
FROM sales, r GROUP BY 1""")
def _(spark, d):
    out, _ = K.scale_minmax(sales(spark, d, "product_category", "unit_price", "cost"), ["unit_price", "cost"])
    return out.groupBy("product_category").agg(F.round(F.avg("unit_price_scaled"), 6).alias("unit_price"),
                                               F.round(F.avg("cost_scaled"), 6).alias("cost"))


@query("unscale_minmax", f"""WITH {SALES_SQL} SELECT product_category, round(sum(cost), 4) AS cost FROM sales GROUP BY 1""")
def _(spark, d):
    scaled, params = K.scale_minmax(sales(spark, d, "product_category", "cost"), ["cost"], overwrite=True)
    return K.unscale_minmax(scaled, params).groupBy("product_category").agg(F.round(F.sum("cost"), 4).alias("cost"))


@query("date_features", """SELECT year(o_orderdate) AS order_date_year, month(o_orderdate) AS order_date_month,
  quarter(o_orderdate) AS order_date_quarter, day(o_orderdate) AS order_date_day, isodow(o_orderdate) - 1 AS order_date_day_of_week,
  CAST(isodow(o_orderdate) >= 6 AS INT) AS order_date_is_weekend, week(o_orderdate) AS order_date_week_of_year, count(*) AS n
FROM orders GROUP BY ALL""")
def _(spark, d):
    f = K.date_features(table(spark, d, "orders").select(F.col("o_orderdate").alias("order_date")), ["order_date"]).drop("order_date")
    return f.groupBy(*f.columns).agg(F.count("*").alias("n"))


@query("derive_metrics", f"""WITH {SALES_SQL}, x AS (SELECT product_category, net_sales - cost AS p, (net_sales - cost) / net_sales * 100 AS m,
  net_sales / units_sold AS u, (epoch_us(ship_date) - epoch_us(order_date)) / 1e6 / 86400 AS days,
  cost + tax_amount AS c FROM sales)
SELECT product_category, round(sum(p), 4) AS derived_profit, round(avg(m), 4) AS derived_profit_margin_pct,
  round(avg(u), 4) AS derived_revenue_per_unit, round(avg(days), 4) AS derived_days_to_ship,
  round(avg(c), 4) AS derived_total_cost_with_tax FROM x GROUP BY 1""")
def _(spark, d):
    out, _ = K.derive_metrics(sales(spark, d, "product_category", "net_sales", "cost", "units_sold", "order_date", "ship_date",
                                    "tax_amount"), {"net_sales": "revenue"})
    return out.groupBy("product_category").agg(
        F.round(F.sum("derived_profit"), 4).alias("derived_profit"),
        *[F.round(F.avg(c), 4).alias(c) for c in ("derived_profit_margin_pct", "derived_revenue_per_unit",
                                                  "derived_days_to_ship", "derived_total_cost_with_tax")])


# ---- deduplication ----

DEDUP = ("order_id", "line", "status", "priority", "quantity", "sales")


@query("dedup_exact", f"""WITH {MESSY_SQL}, d AS (SELECT DISTINCT {', '.join(DEDUP)} FROM messy_sales)
SELECT status, count(*) AS n, round(sum(sales), 4) AS sales FROM d GROUP BY 1""")
def _(spark, d):
    return D.dedup_exact(_messy(spark, d, *DEDUP)).groupBy("status").agg(
        F.count("*").alias("n"), F.round(F.sum("sales"), 4).alias("sales"))


@query("dedup_canonical", f"""WITH {MESSY_SQL}, d AS (SELECT DISTINCT order_id // 50 AS block, {CANON_SQL.format('priority')} AS priority FROM messy_sales)
SELECT priority, count(*) AS n FROM d GROUP BY 1""")
def _(spark, d):
    m = _messy(spark, d, "order_id", "priority").select(F.floor(F.col("order_id") / 50).alias("block"), "priority")
    return D.dedup_canonical(m, ["priority"]).groupBy("priority").agg(F.count("*").alias("n"))


@query("dedup_by_key", f"""WITH {MESSY_SQL}
SELECT order_id, line, sales FROM messy_sales QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY line, sales, quantity) = 1""")
def _(spark, d):
    return D.dedup_by_key(_messy(spark, d, "order_id", "line", "sales", "quantity"), ["order_id"],
                          ["line", "sales", "quantity"]).select("order_id", "line", "sales")


@query("duplicate_samples", f"""WITH {MESSY_SQL}, g AS (SELECT coalesce(segment, 'null') || '|' || status AS signature, count(*) AS n
  FROM messy_sales GROUP BY 1 HAVING count(*) > 1)
SELECT * FROM g ORDER BY n DESC, signature LIMIT 5""")
def _(spark, d):
    return D.duplicate_samples(_messy(spark, d, "segment", "status"))


@query("row_survival", f"""WITH {MESSY_SQL}
SELECT 'drop_null_quantity' AS step, count(*) AS rows_before, count(quantity) AS rows_after,
  round(count(quantity) * 100.0 / count(*), 2) AS survival_pct, count(quantity) >= 0.5 * count(*) AS survives FROM messy_sales""")
def _(spark, d):
    m = _messy(spark, d, "quantity")
    return D.row_survival(m, I.drop_rows_null(m, ["quantity"]), "drop_null_quantity")


@query("null_diff", f"""WITH {MESSY_SQL}
SELECT 'priority' AS "column", 0 AS nulls_before, count(*) FILTER (lower(trim(priority)) IN ('n/a', '')) AS nulls_after,
  count(*) FILTER (lower(trim(priority)) IN ('n/a', '')) AS change FROM messy_sales
UNION ALL SELECT 'segment', count(*) FILTER (segment IS NULL), 0, -count(*) FILTER (segment IS NULL) FROM messy_sales""")
def _(spark, d):
    m = _messy(spark, d, "priority", "segment", "status")
    return D.null_diff(m, I.impute_label(K.null_text(m, ["priority"]), ["segment"]))


@query("row_accounting", f"""WITH {MESSY_SQL}, raw AS (SELECT order_id // 50 AS block, priority, quantity FROM messy_sales),
e AS (SELECT DISTINCT * FROM raw), c AS (SELECT DISTINCT block, {CANON_SQL.format('priority')} AS priority, quantity FROM e)
SELECT (SELECT count(*) FROM raw) AS input_rows, (SELECT count(*) FROM raw) - (SELECT count(*) FROM e) AS exact_duplicates_removed,
  (SELECT count(*) FROM e) - (SELECT count(*) FROM c) AS canonical_duplicates_removed,
  (SELECT count(*) - count(quantity) FROM c) AS imputation_drops, (SELECT count(quantity) FROM c) AS final_rows""")
def _(spark, d):
    raw = _messy(spark, d, "order_id", "priority", "quantity").select(
        F.floor(F.col("order_id") / 50).alias("block"), "priority", "quantity")
    exact = D.dedup_exact(raw)
    canonical = D.dedup_canonical(exact, ["priority"])
    return D.row_accounting(raw, exact, canonical, I.drop_rows_null(canonical, ["quantity"]))
