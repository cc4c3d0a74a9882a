"""Queries of the readers, writers and the profile."""

from pyspark.sql import functions as F

from ..functions.lineage import scratch_path
from ..functions.text import LOAD_NULLS
from ..operators import profile as P
from ..sources import readers as R, writers as W
from .registry import query
from .views import MESSY_SQL, SALES_SQL, messy_sales, sales, table

# ---- sources and sinks: each writes files derived from the given tables, then reads them back ----


def _write_lines(lines, name, path, encoding="UTF-8"):
    """One-column text with ``name`` as the header line of every part file."""
    (lines.toDF(name).write.option("encoding", encoding).option("quote", "").option("sep", "\t")
     .option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


@query("read_csv_encoded", """
SELECT o_orderstatus AS status, count(*) AS lines, count(*) AS accented, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "encoded")
    _write_lines(table(spark, d, "orders").select(F.concat_ws(
        ";", F.col("o_orderkey").cast("string"), F.concat(F.lit("café é "), "o_orderstatus"))), "head", path, "ISO-8859-1")
    parts = F.split("value", ";")
    return (R.read_csv_encoded(spark, path).where("value != 'head'")
            .select(parts[0].cast("long").alias("k"), parts[1].alias("t"))
            .groupBy(F.substring("t", -1, 1).alias("status"))
            .agg(F.count("*").alias("lines"), F.count_if(F.col("t").startswith("café é")).alias("accented"),
                 F.sum("k").alias("key_sum")))


@query("read_csv_windows", """
SELECT o_orderstatus AS status, count(*) AS lines, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS euros,
  sum(CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END) AS quotes FROM orders GROUP BY 1""")
def _(spark, d):
    """Files of windows-1252, whose bytes 0x80 to 0x9F are euro signs and quotes."""
    path = scratch_path(spark, "windows")
    marked = F.when(F.col("o_orderkey") % 2 == 0, F.lit("\x80 é ")).otherwise(F.lit("\x93x\x94 "))
    _write_lines(table(spark, d, "orders").select(F.concat_ws(";", F.col("o_orderkey").cast("string"), F.concat(marked, "o_orderstatus"))), "key;text", path, "ISO-8859-1")
    typed = R.read_csv_mixed(spark, path)
    return typed.groupBy(F.substring("text", -1, 1).alias("status")).agg(
        F.count("*").alias("lines"), F.sum("key").alias("key_sum"), F.count_if(F.col("text").startswith("€ é ")).alias("euros"),
        F.count_if(F.col("text").startswith("“x” ")).alias("quotes"))


def _mixed_file(spark, d, ext=""):
    """Lines with ',' or ';' by key, a quoted text holding the other delimiter, and blank lines."""
    path = scratch_path(spark, "mixed") + ext
    sep = F.when(F.col("o_orderkey") % 3 == 0, ";").otherwise(",")
    line = F.concat(F.col("o_orderkey").cast("string"), sep, F.lit('"'), "o_orderpriority", F.lit('; x"'), sep,
                    F.col("o_totalprice").cast("string"), sep, F.date_format("o_orderdate", "yyyy-MM-dd"))
    with_blank = F.when(F.col("o_orderkey") % 50 == 7, F.array(line, F.lit("  "))).otherwise(F.array(line))
    _write_lines(table(spark, d, "orders").select(F.explode(with_blank)), "order_id,priority,total,order_date", path)
    return path


MIXED_SQL = """
SELECT o_orderpriority || '; x' AS priority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys,
  round(sum(o_totalprice), 4) AS total, min(o_orderdate) AS first_day
FROM orders GROUP BY 1"""


def _mixed_totals(df):
    return df.groupBy("priority").agg(
        F.count("*").alias("n"), F.sum("order_id").alias("keys"), F.round(F.sum("total"), 4).alias("total"),
        F.min("order_date").alias("first_day"))


@query("read_csv_mixed", MIXED_SQL)
def _(spark, d):
    return _mixed_totals(R.read_csv_mixed(spark, _mixed_file(spark, d)))


@query("load_table", MIXED_SQL)
def _(spark, d):
    return _mixed_totals(R.load_table(spark, _mixed_file(spark, d, ".tsv")))


@query("read_json_any", """
SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 4) AS balance, CAST(sum(c_custkey) AS BIGINT) AS keys
FROM customer GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "lines") + ".jsonl"
    table(spark, d, "customer").write.json(path)
    return R.read_json_any(spark, path).groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("balance"), F.sum("c_custkey").alias("keys"))


@query("read_json_list", """SELECT c_mktsegment || ', "x" [' || CAST(c_custkey % 3 AS VARCHAR) || '}' AS segment, count(*) AS n, round(sum(c_acctbal), 4) AS balance,
  CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1""")
def _(spark, d):
    """A list of records over several lines, with commas, quotes and brackets inside texts."""
    path = scratch_path(spark, "list") + ".json"
    odd = F.concat("c_mktsegment", F.lit(', "x" ['), (F.col("c_custkey") % 3).cast("string"), F.lit("}"))
    record = F.to_json(F.struct(F.col("c_custkey").alias("key"), odd.alias("segment"), F.struct(F.col("c_acctbal").alias("balance")).alias("money")))
    one = table(spark, d, "customer").select(record.alias("r")).agg(F.array_join(F.collect_list("r"), ",\n  ").alias("r"))  # the document that is read below
    one.select(F.concat(F.lit("[\n  "), "r", F.lit("\n]"))).coalesce(1).write.text(path)
    return R.read_json_any(spark, path).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("money.balance"), 4).alias("balance"), F.sum("key").alias("keys"))


@query("read_json_columns", """SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 4) AS balance, CAST(sum(c_custkey) AS BIGINT) AS keys
FROM customer GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "columns") + ".json"
    c = table(spark, d, "customer")
    cell = lambda name: F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('":'), F.substring(
        F.to_json(F.array(name)), F.lit(2), F.length(F.to_json(F.array(name))) - 2))), ", ")
    columns = {"key": cell("c_custkey"), "segment": cell("c_mktsegment"), "balance": cell("c_acctbal")}
    whole = F.concat(F.lit("{"), F.concat_ws(",\n", *[F.concat(F.lit(f'"{n}": {{'), x, F.lit("}")) for n, x in columns.items()]), F.lit("}"))
    c.agg(whole.alias("r")).coalesce(1).write.text(path)
    return R.read_json_any(spark, path).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 4).alias("balance"), F.sum("key").alias("keys"))


@query("read_parquet", """
SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def _(spark, d):
    return R.read_parquet(spark, f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("infer_types", f"""
SELECT 'order_id' AS "column", 'bigint' AS dtype, count(*) AS n FROM orders
UNION ALL SELECT 'total', 'double', count(*) FROM orders
UNION ALL SELECT 'day', 'timestamp_ntz', count(*) FROM orders
UNION ALL SELECT 'open', 'boolean', count(*) FROM orders
UNION ALL SELECT 'priority', 'string', count(*) FILTER (
    CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_orderpriority END NOT IN ({", ".join(f"'{w}'" for w in LOAD_NULLS)}))
  FROM orders""")
def _(spark, d):
    text = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_totalprice").cast("string").alias("total"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        F.when(F.col("o_orderstatus") == "O", "True").otherwise("False").alias("open"),
        F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_orderpriority")).alias("priority"))
    typed = R.infer_types(text)
    from ..functions.reshape import long_agg
    return long_agg(typed, {f.name: {"dtype": F.lit(f.dataType.simpleString()), "n": F.count(f.name)}
                            for f in typed.schema})


@query("write_cleaned", f"""
WITH {SALES_SQL}
SELECT product_category AS category, count(*) AS n, round(sum(units_sold), 2) AS units FROM sales GROUP BY 1""")
def _(spark, d):
    path = W.write_cleaned(sales(spark, d, "order_id", "product_category", "units_sold"), scratch_path(spark, "cleaned"))
    return spark.read.csv(path, header=True, schema="order_id long, product_category string, units_sold double").groupBy(
        F.col("product_category").alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("units_sold"), 2).alias("units"))


@query("write_diagnostics", """
SELECT 'keys' AS step, count(*) AS n FROM (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'status', count(DISTINCT o_orderstatus) FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    path = W.write_diagnostics({"keys": o.select("o_orderkey"), "status": o.groupBy("o_orderstatus").count()},
                               scratch_path(spark, "diagnostics"))
    parts = [spark.read.json(f"{path}/{s}").agg(F.count("*").alias("n")).select(F.lit(s).alias("step"), "n")
             for s in ("keys", "status")]
    return parts[0].unionAll(parts[1])


@query("union_sources", """
SELECT 'customers' AS _source_sheet, count(*) AS n, count(c_custkey) AS custs, 0 AS supps, true AS schema_mismatch FROM customer
UNION ALL SELECT 'suppliers', count(*), 0, count(s_suppkey), true FROM supplier""")
def _(spark, d):
    both, mismatch = R.union_sources({"customers": table(spark, d, "customer"), "suppliers": table(spark, d, "supplier")})
    return both.groupBy("_source_sheet").agg(
        F.count("*").alias("n"), F.count("c_custkey").alias("custs"), F.count("s_suppkey").alias("supps"),
        F.lit(mismatch).alias("schema_mismatch"))


# ---- profile ----

PROFILED = {
    "order_id": "bigint", "line": "int", "amount": "string", "status": "string", "priority": "string",
    "segment": "string", "order_date": "string", "quantity": "double", "unit_price": "double",
    "discount_rate": "double", "active": "string",
}
NUMBERS = [c for c, t in PROFILED.items() if t in ("bigint", "int", "double")]
TEXTS = [c for c, t in PROFILED.items() if t == "string"]
ORDER = ["order_id", "line"]
ROW_ORDER = ", ".join(f'"{c}" NULLS FIRST' for c in PROFILED)
CELLS = ", ".join(f'"{c}"' for c in PROFILED)
NULLS = " + ".join(f'CAST("{c}" IS NULL AS INT)' for c in PROFILED)


def _messy(spark, d):
    return messy_sales(spark, d, *PROFILED)


def _union(parts):
    return " UNION ALL ".join(parts)


SHAPE_SQL = f"""shape AS (
  SELECT count(*) AS row_count, {len(PROFILED)} AS column_count, count(*) * {len(PROFILED)} AS total_cells,
    CAST(sum({NULLS}) AS BIGINT) AS total_missing,
    round(sum({NULLS}) * 100.0 / (count(*) * {len(PROFILED)}), 2) AS missing_pct,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT {CELLS} FROM messy_sales)) AS duplicate_rows,
    round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT {CELLS} FROM messy_sales))) * 100.0 / count(*), 2) AS duplicate_pct
  FROM messy_sales)"""


@query("profile_shape", f"WITH {MESSY_SQL}, {SHAPE_SQL} SELECT * FROM shape")
def _(spark, d):
    return P.profile_shape(_messy(spark, d))


@query("profile_shape_nulls", """
WITH t AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS b,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS d FROM orders),
n AS (SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT a, b, c, d FROM t)) AS kinds,
  CAST(sum(CAST(a IS NULL AS INT) + CAST(b IS NULL AS INT) + CAST(c IS NULL AS INT) + CAST(d IS NULL AS INT)) AS BIGINT) AS total_missing FROM t)
SELECT row_count, 4 AS column_count, row_count * 4 AS total_cells, total_missing, round(total_missing * 100.0 / (row_count * 4), 2) AS missing_pct,
  row_count - kinds AS duplicate_rows, round((row_count - kinds) * 100.0 / row_count, 2) AS duplicate_pct FROM n""")
def _(spark, d):
    """Rows that differ only in which column holds the value."""
    key = F.col("o_orderkey")
    return P.profile_shape(table(spark, d, "orders").select(
        F.when(key % 2 == 0, F.col("o_orderstatus")).alias("a"), F.when(key % 2 == 1, F.col("o_orderstatus")).alias("b"),
        F.when(key % 3 == 0, F.col("o_custkey")).alias("c"), F.when(key % 3 == 1, F.col("o_custkey")).alias("d")))


@query("profile_confidence", f"""WITH {MESSY_SQL}, {SHAPE_SQL}
SELECT row_count, missing_pct, duplicate_pct,
  round(1.0 - missing_pct / 100 * 0.5 - duplicate_pct / 100 * 0.3, 3) AS confidence FROM shape""")
def _(spark, d):
    return P.profile_confidence(P.profile_shape(_messy(spark, d)))


def _column_sql(c, t, i):
    samples = f"""(SELECT string_agg(v, '|' ORDER BY rn) FROM (SELECT "{c}" AS v,
        row_number() OVER (ORDER BY {ROW_ORDER}) AS rn FROM messy_sales WHERE "{c}" IS NOT NULL) WHERE rn <= 3)"""
    return f"""SELECT '{c}' AS "column", '{t}' AS dtype, {i} AS position, count(*) AS "rows",
        count(*) - count("{c}") AS missing_count, round((count(*) - count("{c}")) * 100.0 / count(*), 2) AS missing_pct,
        count(DISTINCT "{c}") + max(CAST("{c}" IS NULL AS INT)) AS unique_count,
        {samples if t == 'string' else 'NULL'} AS samples FROM messy_sales"""


@query("profile_columns", f"""WITH {MESSY_SQL}, p AS ({_union(_column_sql(c, t, i) for i, (c, t) in enumerate(PROFILED.items()))})
SELECT *, round(unique_count / "rows", 6) AS cardinality_ratio,
  unique_count / "rows" >= 0.95 AND missing_count = 0 AND "rows" > 1 AS candidate_key_hint FROM p""")
def _(spark, d):
    p = P.profile_columns(_messy(spark, d), ORDER)
    return p.withColumn("samples", F.when(F.col("dtype") == "string", F.array_join("sample_values", "|"))).drop(
        "sample_values").withColumn("cardinality_ratio", F.round("cardinality_ratio", 6))


def _iqr_sql(c):
    return f"""SELECT '{c}' AS "column", round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
        count(*) FILTER ("{c}" < lo OR "{c}" > hi) AS outlier_count,
        round(count(*) FILTER ("{c}" < lo OR "{c}" > hi) * 100.0 / count(*), 2) AS outlier_pct
      FROM messy_sales, (SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM
        (SELECT quantile_cont(CAST("{c}" AS DOUBLE), [0.25, 0.75]) AS q FROM messy_sales)) GROUP BY lo, hi"""


@query("outlier_iqr", f"""WITH {MESSY_SQL}, o AS ({_union(_iqr_sql(c) for c in NUMBERS)})
SELECT *, outlier_count > 0 AS has_outliers FROM o""")
def _(spark, d):
    return P.outlier_iqr(messy_sales(spark, d, *NUMBERS))


@query("distribution_shape", f"""WITH {MESSY_SQL}, s AS ({_union(
    f'''SELECT '{c}' AS "column", count("{c}") AS n, skewness("{c}") AS s, kurtosis("{c}") AS k FROM messy_sales'''
    for c in NUMBERS)})
SELECT "column", n, round(s, 4) AS skewness, CASE WHEN abs(s) <= 0.5 AND abs(k) <= 1 THEN 'normal'
  WHEN s > 1 THEN 'right_skewed' WHEN s < -1 THEN 'left_skewed' ELSE 'symmetric' END AS distribution_type,
  abs(s) <= 0.5 AND abs(k) <= 1 AS is_normal FROM s""")
def _(spark, d):
    return P.distribution_shape(messy_sales(spark, d, *NUMBERS))


HIDDEN_WORDS = ", ".join(f"'{w}'" for w in [
    "n/a", "na", "none", "null", "missing", "unknown", "#n/a", "nil", "-", ".", "?", "n.a.", "not available",
    "not applicable", "nan", "undefined"])


@query("implicit_missing", f"""WITH {MESSY_SQL}, cells AS ({_union(
    [f'''SELECT '{c}' AS "column", 'sentinel' AS kind, CAST(CAST("{c}" AS BIGINT) AS VARCHAR) AS "value" FROM messy_sales
         WHERE "{c}" IN (0, -1, -9, -99, -999, -9999, -99999, 999, 9999, 99999)''' for c in NUMBERS]
    + [f'''SELECT '{c}', 'pattern', lower(trim("{c}")) FROM messy_sales WHERE lower(trim("{c}")) IN ({HIDDEN_WORDS})'''
       for c in TEXTS])})
SELECT "column", kind, "value", count(*) AS n FROM cells GROUP BY ALL
HAVING "value" <> '0' OR count(*) >= 0.25 * (SELECT count(*) FROM messy_sales)""")
def _(spark, d):
    return P.implicit_missing(_messy(spark, d))


@query("candidate_keys", """
SELECT 'o_orderkey' AS "column" FROM orders HAVING count(DISTINCT o_orderkey) = count(*)
UNION ALL SELECT 'o_totalprice' FROM orders HAVING count(DISTINCT o_totalprice) = count(*)
UNION ALL SELECT 'o_custkey' FROM orders HAVING count(DISTINCT o_custkey) = count(*)
UNION ALL SELECT 'o_orderdate' FROM orders HAVING count(DISTINCT o_orderdate) = count(*)
UNION ALL SELECT 'o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) = count(*)
UNION ALL SELECT 'o_orderpriority' FROM orders HAVING count(DISTINCT o_orderpriority) = count(*)""")
def _(spark, d):
    return P.candidate_keys(P.profile_columns(table(spark, d, "orders")))


@query("identical_columns", f"""WITH {SALES_SQL}, t AS (
  SELECT *, units_sold AS units_copy, region AS area, CASE WHEN order_id = 3 THEN cost + 1 ELSE cost END AS cost_copy FROM sales)
SELECT 'units_sold' AS col1, 'units_copy' AS col2 FROM t HAVING bool_and(units_sold IS NOT DISTINCT FROM units_copy)
UNION ALL SELECT 'region', 'area' FROM t HAVING bool_and(region IS NOT DISTINCT FROM area)
UNION ALL SELECT 'cost', 'cost_copy' FROM t HAVING bool_and(cost IS NOT DISTINCT FROM cost_copy)
UNION ALL SELECT 'units_sold', 'cost' FROM t HAVING bool_and(units_sold IS NOT DISTINCT FROM cost)
UNION ALL SELECT 'region', 'product_category' FROM t HAVING bool_and(region IS NOT DISTINCT FROM product_category)""")
def _(spark, d):
    s = sales(spark, d, "order_id", "region", "product_category", "units_sold", "cost").withColumns({
        "units_copy": F.col("units_sold"), "area": F.col("region"),
        "cost_copy": F.when(F.col("order_id") == 3, F.col("cost") + 1).otherwise(F.col("cost"))})
    return P.identical_columns(s)


PAIRED = ["quantity", "unit_price", "discount_rate", "tax", "sales"]


@query("raw_correlations", f"""WITH {MESSY_SQL}, c AS ({_union(
    f'''SELECT '{a}' AS col1, '{b}' AS col2, corr("{a}", "{b}") AS r FROM messy_sales'''
    for i, a in enumerate(PAIRED) for b in PAIRED[i + 1:])})
SELECT col1, col2, round(r, 4) AS r FROM c WHERE abs(r) >= 0.5 AND NOT isnan(r)""")
def _(spark, d):
    return P.raw_correlations(messy_sales(spark, d, *PAIRED))


@query("parseability", f"""WITH {MESSY_SQL}
SELECT 'order_date' AS "column", 100.0 AS datetime_pct, 0.0 AS numeric_pct
UNION ALL SELECT 'status', 0.0, 0.0 UNION ALL SELECT 'amount', 0.0, 0.0
UNION ALL SELECT 'active', 0.0, round(count(*) FILTER (regexp_full_match(active, '[0-9]+')) * 100.0 / count(active), 2) FROM messy_sales
UNION ALL SELECT 'quantity', 0.0, 0.0""")
def _(spark, d):
    return P.parseability(messy_sales(spark, d, "order_date", "status", "amount", "active", "quantity"))


def _often(c, test):
    return f"""count("{c}") > 0 AND count(*) FILTER ({test}) >= 0.1 * count("{c}")"""


@query("format_hints", f"""WITH {MESSY_SQL} {_union(f'''SELECT '{c}' AS "column", {_often(c, f"regexp_matches({c}, '[$€£¥₹]')")} AS currency_like,
  {str("date" in c or "time" in c).lower()} OR ({_often(c, f"trim({c}) LIKE '%-%' AND length(trim({c})) >= 8")}) AS date_like,
  {str(c == "id" or c.endswith("_id") or c.startswith("id_")).lower()} AS identifier_like, {_often(c, f"contains({c}, '@')")} AS at_like,
  {_often(c, f"regexp_matches({c}, '^[ ]*[0-9][0-9][0-9][0-9]') AND contains({c}, '-')")} AS iso_like FROM messy_sales''' for c in TEXTS)}""")
def _(spark, d):
    return P.format_hints(messy_sales(spark, d, *TEXTS))
