"""The whole run as a query: what the cleaned table holds and how its rows are accounted for."""

from pyspark.sql import functions as F

from .registry import query
from .run import run
from .views import MESSY_SQL, messy_sales

COLUMNS = ["order_id", "line", "amount", "status", "segment", "order_date", "quantity"]
KEYS = ["order_id", "line"]


@query("run", f"""WITH {MESSY_SQL}, d AS (SELECT {", ".join(COLUMNS)}, any_value(true_amount) AS true_amount FROM messy_sales GROUP BY {", ".join(COLUMNS)}),
a AS (SELECT count(*) AS input_rows, count(*) - (SELECT count(*) FROM d) AS exact_duplicates, 0 AS canonical_duplicates, (SELECT count(*) FROM d) AS final_rows FROM messy_sales),
c AS (SELECT ['Complete', 'Cancelled', 'Shipped', 'Pending'][order_id % 4 + 1] AS status, count(*) AS n, CAST(sum(order_id) AS BIGINT) AS keys,
  round(sum(CASE line % 4 WHEN 1 THEN true_amount WHEN 2 THEN true_amount WHEN 3 THEN -true_amount END), 2) AS amount,
  CAST(sum(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM d GROUP BY 1)
SELECT * FROM c, a""")
def _(spark, d):
    """Profile, tags, cleaning, analysis and checks of a messy table."""
    done = run(messy_sales(spark, d, *COLUMNS), "messy", keys=KEYS, order_by=KEYS)
    totals = done.cleaned.groupBy("status").agg(F.count("*").alias("n"), F.sum("order_id").alias("keys"), F.round(F.sum("amount"), 2).alias("amount"),
                                                F.count_if(F.col("segment") == "Unknown").alias("filled"))
    rows = done.tables["row_accounting"].select("input_rows", F.col("exact_duplicates_removed").alias("exact_duplicates"),
                                                F.col("canonical_duplicates_removed").alias("canonical_duplicates"), "final_rows")
    return totals.crossJoin(rows)  # one row of accounts
