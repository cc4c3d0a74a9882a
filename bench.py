"""Times the headline queries: prints one JSON line."""

import json
import os
import time

from tabsight.functions.lineage import scratch_path
from tabsight.operators.profile import full_profile
from tabsight.plans.queries import QUERIES
from tabsight.plans.session import local_session
from tabsight.sources import load_table

HEADLINE = [
    "profile_shape", "profile_columns", "outlier_iqr", "raw_correlations", "implicit_missing", "clean_currency", "canonical_text",
    "fuzzy_category_merge", "impute_plan", "impute_ffill", "impute_knn", "dedup_exact", "dedup_by_key", "structural_issues",
    "quality_score", "describe_numeric", "corr_pearson", "corr_spearman", "growth_monthly", "rank_dimension", "anomaly_summary",
    "trend_regression", "ground_claims_documents", "vector_topk", "chart_query",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS"))
    QUERIES["read_parquet"](spark, sf_dir).collect()  # starts the engine
    times = {}
    path = scratch_path(spark, "bench") + ".csv"
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_returnflag").orderBy("l_orderkey", "l_linenumber").limit(
        50_000).coalesce(1).write.option("header", True).csv(path)
    for name in ("csv_profile_cold", "csv_profile_warm"):  # load and profile a CSV of 50,000 rows and 3 columns
        start = time.perf_counter()
        full_profile(load_table(spark, path), "csv").collect()
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
