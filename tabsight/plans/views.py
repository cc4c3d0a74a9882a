"""``sales`` and ``messy_sales``: one flat table over the star schema, and the same with planted faults.

Only the joins that the asked columns need are made. No join is hinted: the table sizes at run time decide.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.partitions import spread

SALES = {
    "order_id": "l_orderkey", "line": "l_linenumber", "order_date": "o_orderdate", "ship_date": "l_shipdate",
    "region": "r_name", "customer_segment": "c_mktsegment", "product_category": "p_type",
    "sales_representative": "p_brand", "order_status": "o_orderstatus", "units_sold": "l_quantity",
    "unit_price": "p_retailprice", "net_sales": "l_extendedprice * (1 - l_discount)",
    "cost": "p_retailprice * l_quantity", "discount_percentage": "l_discount",
    "tax_amount": "l_extendedprice * l_tax", "shipping_cost": "0.01D * l_extendedprice",
    "profit": "l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity",
    "profit_margin": "try_divide(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity, "
                     "l_extendedprice * (1 - l_discount))",
    "returned": "l_returnflag = 'R'",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _star(spark, sf_dir, text: str) -> DataFrame:
    """lineitem with the dimensions whose columns occur in ``text``. Customers are joined to the orders, so that the rows of lineitem move once for their part and once for their order."""
    df = spread(table(spark, sf_dir, "lineitem"))
    if "p_" in text:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if any(c in text for c in ("o_", "c_", "r_name")):
        orders = table(spark, sf_dir, "orders")
        if any(c in text for c in ("c_mkt", "r_name")):
            customer = table(spark, sf_dir, "customer")
            if "r_name" in text:
                customer = (customer.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return df


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    names = columns or tuple(SALES)
    exprs = {c: SALES[c] for c in names}
    return _star(spark, sf_dir, " ".join(exprs.values())).select(*[F.expr(e).alias(c) for c, e in exprs.items()])


MESSY = {
    "order_id": "l_orderkey",
    "line": "l_linenumber",
    "amount": """case l_linenumber % 4 when 1 then '$' || format_number(l_extendedprice, 2)
        when 2 then '€' || translate(format_number(l_extendedprice, 2), ',.', '.,')
        when 3 then '(' || format_number(l_extendedprice, 2) || ')' else 'abc' end""",
    "status": """case l_orderkey % 200 when 0 then 'Completed' when 1 then 'Canceled' when 2 then 'SHIPPED'
        when 3 then ' pending ' else
        case l_orderkey % 4 when 0 then 'Complete' when 1 then 'Cancelled' when 2 then 'Shipped' else 'Pending' end end""",
    "priority": """case l_orderkey % 9 when 0 then 'n/a' when 1 then '' when 2 then upper(replace(o_orderpriority, ' ', '__'))
        when 3 then ' ' || lower(o_orderpriority) || ' ' else o_orderpriority end""",
    "segment": "if(l_orderkey % 10 = 4, null, c_mktsegment)",
    "order_date": """case l_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
        when 1 then date_format(o_orderdate, 'MM/dd/yyyy') when 2 then date_format(o_orderdate, 'yyyy/MM/dd')
        else date_format(o_orderdate, 'dd MMM yyyy') end""",
    "quantity": "case when l_orderkey % 10 = 0 then null when l_orderkey % 97 = 5 then -999.0D else l_quantity end",
    "unit_price": "if(l_orderkey % 10 = 0, null, p_retailprice)",
    "discount_rate": "if(l_orderkey % 10 = 3, null, l_discount)",
    "tax": "l_extendedprice * l_tax",
    "sales": "l_extendedprice",
    "active": "case l_linenumber % 5 when 0 then 'yes' when 1 then 'FALSE' when 2 then '1' when 3 then 'no' else 'maybe' end",
}


def messy_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Planted faults: nulls by order key, money and dates as text, rare spellings, sentinels, every 50th row twice."""
    names = columns or tuple(MESSY)
    exprs = {c: MESSY[c] for c in names}
    base = _star(spark, sf_dir, " ".join(exprs.values())).select(
        *[F.expr(e).alias(c) for c, e in exprs.items()],
        F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 50 == 0, 2).otherwise(1).alias("_times"))
    return base.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_t", "_times")


SALES_SQL = """sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, o_orderdate AS order_date, l_shipdate AS ship_date,
    r_name AS region, c_mktsegment AS customer_segment, p_type AS product_category, p_brand AS sales_representative,
    o_orderstatus AS order_status, l_quantity AS units_sold, p_retailprice AS unit_price,
    l_extendedprice * (1 - l_discount) AS net_sales, p_retailprice * l_quantity AS cost,
    l_discount AS discount_percentage, l_extendedprice * l_tax AS tax_amount,
    CAST(0.01 AS DOUBLE) * l_extendedprice AS shipping_cost,
    l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS profit,
    (l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity)
      / nullif(l_extendedprice * (1 - l_discount), 0) AS profit_margin,
    l_returnflag = 'R' AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey)"""

MESSY_SQL = """messy AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line,
    CASE l_linenumber % 4 WHEN 1 THEN '$' || format('{:,.2f}', l_extendedprice)
      WHEN 2 THEN '€' || translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
      WHEN 3 THEN '(' || format('{:,.2f}', l_extendedprice) || ')' ELSE 'abc' END AS amount,
    CASE l_orderkey % 200 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Canceled' WHEN 2 THEN 'SHIPPED' WHEN 3 THEN ' pending '
      ELSE CASE l_orderkey % 4 WHEN 0 THEN 'Complete' WHEN 1 THEN 'Cancelled' WHEN 2 THEN 'Shipped' ELSE 'Pending' END
      END AS status,
    CASE l_orderkey % 9 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN upper(replace(o_orderpriority, ' ', '__'))
      WHEN 3 THEN ' ' || lower(o_orderpriority) || ' ' ELSE o_orderpriority END AS priority,
    CASE WHEN l_orderkey % 10 = 4 THEN NULL ELSE c_mktsegment END AS segment,
    CASE l_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%d %b %Y') END AS order_date,
    o_orderdate AS true_date, l_extendedprice AS true_amount,
    CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 97 = 5 THEN -999.0 ELSE l_quantity END AS quantity,
    CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE p_retailprice END AS unit_price,
    CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_discount END AS discount_rate,
    l_extendedprice * l_tax AS tax, l_extendedprice AS sales,
    CASE l_linenumber % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN 'no' ELSE 'maybe' END AS active
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey),
messy_sales AS (SELECT * FROM messy UNION ALL SELECT * FROM messy WHERE (order_id * 7 + line) % 50 = 0)"""
