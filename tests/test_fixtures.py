"""Small frames with known outcomes, one per behaviour."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import Row, functions as F

from tabsight.functions.lineage import scratch_path
from tabsight.operators import (anomalies as A, blueprint as B, categories as C, charts as H, cleaning as K, correlation as R, dedup as D,
                                facts as X, imputation as I, profile as P, rankings as G, retrieval as E, rules as V, selection as S,
                                stats as T, timeseries as M, validate as Z)
from tabsight.options import DEFAULTS
from tabsight.sources import readers, writers


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def column(spark, name, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")


# ---- sources ----

ORDERS = [("O1", 10.5, "ok"), ("O2", None, "ok"), ("O3", 7.25, "late"), ("O4", 3.0, "ok")]


def put(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("name,text", [
    ("a.csv", "order_id,amount,status\nO1,10.5,ok\nO2,,ok\n\nO3,7.25,late\nO4,3.0,ok\n"),
    ("plain", "order_id;amount;status\nO1;10.5;ok\nO2,,ok\nO3;7.25;late\nO4,3.0,ok\n"),
    ("a.json", '[{"order_id":"O1","amount":10.5,"status":"ok"},{"order_id":"O2","amount":null,"status":"ok"},\n'
               '{"order_id":"O3","amount":7.25,"status":"late"},{"order_id":"O4","amount":3.0,"status":"ok"}]'),
    ("a.jsonl", '{"order_id":"O1","amount":10.5,"status":"ok"}\n{"order_id":"O2","amount":null,"status":"ok"}\n'
                '{"order_id":"O3","amount":7.25,"status":"late"}\n{"order_id":"O4","amount":3.0,"status":"ok"}\n'),
    ("dict.json", '{"order_id":{"0":"O1","1":"O2","2":"O3","3":"O4"},"amount":{"0":10.5,"1":null,"2":7.25,"3":3.0},'
                  '"status":{"0":"ok","1":"ok","2":"late","3":"ok"}}'),
    ("dict2.json", '{\n "order_id":{"0":"O1","1":"O2","2":"O3","3":"O4"},\n "amount":{"0":10.5,"1":null,"2":7.25,"3":3.0},\n'
                   ' "status":{"0":"ok","1":"ok","2":"late","3":"ok"}\n}'),
])
def test_every_format_gives_the_same_table(spark, tmp_path, name, text):
    df = readers.load_table(spark, put(str(tmp_path / name), text))
    assert sorted(rows(df, "order_id", "amount", "status")) == ORDERS


def test_parquet_and_nan(spark):
    path = scratch_path(spark, "t") + ".parquet"
    spark.createDataFrame([(1, float("nan")), (2, 1.0)], "a int, b double").write.parquet(path)
    assert sorted(rows(readers.load_table(spark, path), "a", "b")) == [(1, None), (2, 1.0)]


def test_encodings_are_found_per_file(spark, tmp_path):
    for name, enc, ch in (("u", "utf-8-sig", "é"), ("w", "cp1252", "€"), ("l", "latin-1", "\x81é")):
        put(str(tmp_path / name), f"x {ch}\n", enc)
    got = {r["file"][-1]: r["value"] for r in readers.read_csv_encoded(spark, str(tmp_path)).collect()}
    assert got == {"u": "x é", "w": "x €", "l": "x \x81é"}


def test_bad_lines(spark, tmp_path):
    path = put(str(tmp_path / "b.csv"), 'a,b\n1,"x, y"\n1,2,3\n5;6\n')
    assert rows(readers.read_csv_mixed(spark, path, on_bad="only"), "value") == [("1,2,3",)]
    assert sorted(rows(readers.read_csv_mixed(spark, path, on_bad="drop"), "a", "b")) == [(1, "x, y"), (5, "6")]
    with pytest.raises(Exception, match="fits neither"):
        readers.read_csv_mixed(spark, path, infer=False).collect()


def test_union_tags_and_reports_different_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "k")], "x int, y string")
    out, mismatch = readers.union_sources({"one": a, "two": b})
    assert mismatch and sorted(rows(out, "_source_sheet", "x", "y")) == [("one", 1, None), ("two", 2, "k")]
    assert not readers.union_sources({"one": a, "two": a})[1]


def test_replacing_a_scope_keeps_the_others(spark):
    path = scratch_path(spark, "docs")
    writers.replace_scope(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "scope_id string, n int"), path)
    writers.replace_scope(spark.createDataFrame([("a", 9)], "scope_id string, n int"), path)
    assert sorted(rows(spark.read.parquet(path), "scope_id", "n")) == [("a", 9), ("b", 3)]


# ---- profile ----

def test_skewness_and_shape(spark):
    df = column(spark, "v", [1.0] * 12 + [2.0] * 4 + [100.0] * 4, "double")
    r = P.distribution_shape(df).first()
    assert r["skewness"] == 1.6241 and r["distribution_type"] == "right_skewed" and not r["is_normal"]


def test_hidden_nulls(spark):
    df = spark.createDataFrame([(25, "ok"), (-999, "n/a"), (30, "ok"), (-999, " None "), (35, "ok")], "age long, status string")
    assert sorted(rows(P.implicit_missing(df), "column", "value", "n")) == [("age", "-999", 2), ("status", "n/a", 1), ("status", "none", 1)]


def test_zero_counts_only_when_frequent(spark):
    assert rows(P.implicit_missing(column(spark, "x", [0, 1, 2, 3], "int")), "value", "n") == [("0", 1)]
    assert rows(P.implicit_missing(column(spark, "x", [0, 1, 2, 3, 4], "int")), "value", "n") == []


def test_relations(spark):
    df = spark.createDataFrame([(i, i, i * 10, i * 20) for i in range(1, 6)], "customer_id int, mirror_id int, sales int, revenue int")
    assert {r[0] for r in rows(P.candidate_keys(P.profile_columns(df)), "column")} == {"customer_id", "mirror_id", "sales", "revenue"}
    assert rows(P.identical_columns(df), "col1", "col2") == [("customer_id", "mirror_id")]
    assert all(abs(r["r"] - 1) < 1e-9 for r in P.raw_correlations(df).collect())


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "a int, b double")
    assert rows(P.pair_correlations(df), "r") == [(None,)]


def test_parse_hints_and_tags(spark):
    df = spark.createDataFrame([("A100", "2024-01-02", "$10.50"), ("A101", "2024-02-03", "$20.25")],
                               "customer_id string, order_date string, amount string")
    p = {r["column"]: r for r in B.blueprint(P.full_profile(df, "t")).collect()}
    assert p["customer_id"]["candidate_key_hint"] and p["order_date"]["datetime_pct"] == 100.0 and p["amount"]["currency_like"]
    assert [p[c]["semantic_tag"] for c in ("customer_id", "order_date", "amount")] == ["identifier", "datetime", "currency"]


def test_unique_count_takes_null_as_a_value(spark):
    r = P.profile_columns(column(spark, "x", ["a", "a", None], "string")).first()
    assert (r["unique_count"], r["missing_count"], r["missing_pct"], r["sample_values"]) == (2, 1, 33.33, ["a", "a"])


def test_dots_in_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "`a.b` double, `c d` string")
    assert P.profile_columns(df).count() == 2 and P.outlier_iqr(df).first()["column"] == "a.b"
    assert K.scale_minmax(df, ["a.b"])[0].columns[-1] == "a.b_scaled"


# ---- cleaning ----

def test_money(spark):
    texts = ["$1,234.56", "$12,345.00", "1,234", "€1.234,56", "$999", "10.5", "₹1,00,000", "(123.45)", "Rs. 5", "USD 7", "1.234.567", "-£3", "1e3", "5d"]
    want = [1234.56, 12345.0, 1234.0, 1234.56, 999.0, 10.5, 100000.0, -123.45, 5.0, None, 1234567.0, -3.0, 1000.0, None]
    out = K.clean_currency(column(spark, "m", texts, "string"), ["m"])
    assert rows(out, "m") == [(w,) for w in want] and [r[0] for r in rows(out, "m_parse_failed")] == [0] * 9 + [1, 0, 0, 0, 1]


def test_money_failures_and_numbers(spark):
    out = K.clean_currency(column(spark, "m", ["abc", "$1,234.56", None], "string"), ["m"])
    assert rows(out, "m", "m_parse_failed") == [(None, 1), (1234.56, 0), (None, 0)]
    assert rows(K.clean_currency(column(spark, "m", [1234.567], "double"), ["m"]), "m") == [(1234.567,)]
    assert K.currency_checks(K.clean_currency(column(spark, "m", ["x"], "string"), ["m"]), ["m"]).first()["critical"]


def test_mixed_dates(spark):
    texts = ["2024-01-31", "01/31/2024", "31/01/2024", "2024/01/31", "31 Jan 2024", "Jan 31, 2024", "2024-01-31 10:00:00", "20240131", "13/13/2024", "x"]
    got = [r[0] and r[0].strftime("%Y-%m-%d") for r in rows(K.coerce_types(column(spark, "d", texts, "string"), {"d": "datetime"}), "d")]
    assert got == ["2024-01-31"] * 8 + [None, None]


def test_written_dates(spark):
    good = {"Fri, 05 Jan 2024": "2024-01-05", "5th Jan 2024": "2024-01-05", "05-Jan-24": "2024-01-05", "Fri Jan 5 10:00:00 2024": "2024-01-05 10:00:00", "Jan 2024": "2024-01-01",
            "2024-01": "2024-01-01", "January 5th, 2024": "2024-01-05", "5 Sept. 1969": "1969-09-05", "05jan2024": "2024-01-05", "Thursday, the 1st": None, "1/2/4": None,
            "31.12.2024": "2024-12-31", "12/2024": "2024-12-01", "2024-13": None, "20240229T235959Z": None, "2024-02-29T23:59:59Z": "2024-02-29 23:59:59", "Jan 24": None, "2024": None,
            "may be 2024": None, "10:30 PM, Mar 3 2021": "2021-03-03 22:30:00", "Sat, 9 Mar 2024 10:00:00 +0130": "2024-03-09 08:30:00", "30 Feb 2024": None, "1,234": None, "12.5": None,
            "192.168.1.1": None, "555-1234": None, "1-2-3-4": None, "2024-01-05-06": None, "march": None, "room 5 of 2024": None, "2023-02-29": None, "12/31/99": "1999-12-31"}
    out = rows(K.coerce_types(column(spark, "d", list(good), "string"), {"d": "datetime"}), "d")
    assert {t: r[0] and str(r[0]).removesuffix(" 00:00:00") for t, r in zip(good, out)} == good


def test_title_case_and_null_words(spark):
    texts = ["home_delivery", "o'NEIL  x", "3RD-party", " N/A ", "é-ÉTÉ", None, "\tab\n"]
    assert rows(K.canonical_text(column(spark, "t", texts, "string"), ["t"]), "t") == [
        ("Home Delivery",), ("O'Neil X",), ("3Rd Party",), (None,), ("É Été",), (None,), ("Ab",)]


def test_labels_are_case_folded(spark):
    texts = ["Straße", "STRASSE", "ΟΔΟΣ", "οδος", "οδοσ", "ﬁne", "FINE", "ısı", "Kelvin \u212a", "ÉTÉ", "İ", "A_b"]
    got = rows(K.category_label_norm(column(spark, "t", texts, "string"), ["t"]), "t")
    assert [r[0] for r in got] == [" ".join(t.replace("_", " ").split()).casefold() for t in texts]
    titled = [r[0] for r in rows(K.canonical_text(column(spark, "t", texts[:2], "string"), ["t"]), "t")]
    assert titled == ["Strasse", "Strasse"]
    assert rows(K.encode_ordinal(column(spark, "t", ["STRASSE", "weg"], "string"), "t", ["Weg", "Straße"]), "t__ordinal") == [(1,), (0,)]


def test_booleans(spark):
    out = K.coerce_types(column(spark, "b", ["Yes", "0", "TRUE", "maybe"], "string"), {"b": "boolean"})
    assert rows(out, "b") == [(True,), (False,), (True,), (None,)]


def labels(spark, counts, name="s"):
    return C.label_counts(column(spark, name, [v for v, n in counts.items() for _ in range(n)], "string"), [name])


def test_rare_spellings_merge(spark):
    n = labels(spark, {"Complete": 100, "Completed": 1, "Cancelled": 100, "Canceled": 1, "Shipped": 1})
    assert sorted(rows(C.fuzzy_merges(n), "raw", "canonical", "row_count")) == [("Canceled", "Cancelled", 1), ("Completed", "Complete", 1)]


@pytest.mark.parametrize("counts", [
    {"North": 300, "South": 300, "East": 2, "West": 2, "N": 1, "S": 1}, {"Card": 400, "Cash": 2, "Wire": 300, "Gift": 2},
    {"Houston": 400, "Boston": 2, "Dallas": 300, "Austin": 300}, {"Offline": 49, "Online": 51}])
def test_different_names_stay(spark, counts):
    assert C.fuzzy_merges(labels(spark, counts)).count() == 0


def test_geographic_columns_are_left_alone():
    assert C.mergeable_columns(["country", "state_name", "status", "city"], {"city"}) == ["status"]


def test_merge_chain_follows_frequency(spark):
    # 'Shippedxx' is near 'Shippedx' only, which itself joins 'Shipped'; it therefore stays.
    n = labels(spark, {"Shipped": 1000, "Shippeda": 4, "Shippedabc": 2, "Pending": 1000, "Returned": 1000, "Cancelled": 1000})
    assert rows(C.fuzzy_merges(n), "raw", "canonical") == [("Shippeda", "Shipped")]


def test_short_neighbours_are_flagged(spark):
    n = labels(spark, {"Central": 5, "Cc": 3, "Cd": 2})
    m = C.fuzzy_merges(n)
    assert m.count() == 0 and sorted(rows(C.fuzzy_flags(n, m), "label", "near_candidate")) == [("Cc", "Cd"), ("Cd", "Cc")]


def test_canonical_duplicates_and_one_hot_names(spark):
    df = spark.createDataFrame([(1, "Home_Delivery", 10.0), (1, "home delivery", 10.0)], "record_id int, shipping_mode string, amount double")
    out = K.encode_one_hot(D.dedup_canonical(df, ["shipping_mode"]), "shipping_mode")
    assert out.count() == 1 and "shipping_mode__Home Delivery" in out.columns


def test_one_hot_bucket_and_near_unique(spark):
    many = column(spark, "c", [f"v{i:02d}" for i in range(12) for _ in range(20 - i)] + [None], "string")
    out = K.encode_one_hot(many, "c")
    flags = [c for c in out.columns if c.startswith("c__")]
    assert len(flags) == 9 and "c__Other" in flags and out.where("c is null").first()["c__Other"] == 1
    assert K.encode_one_hot(column(spark, "c", [str(i) for i in range(30)], "string"), "c").columns == ["c"]
    few = K.encode_one_hot(column(spark, "c", ["a", None, "b"], "string"), "c")
    assert rows(few, "c__a", "c__b") == [(1, 0), (0, 0), (0, 1)]


def test_money_is_never_filled(spark):
    df = column(spark, "amount", [100.0, None, 300.0], "double")
    assert rows(I.impute_plan(df, {"amount": "impute_median"}, {"amount": "currency"}), "amount") == [(100.0,), (None,), (300.0,)]


def test_mode_takes_the_smallest_of_ties_by_number(spark):
    assert I.modes(column(spark, "n", [9, 10, None], "int"), ["n"]) == {"n": "9"}


def test_clipping(spark):
    uniform = column(spark, "q", [float(i) for i in range(1, 10001)], "double")
    assert K.clip_bounds(uniform, ["q"])["q"][2] == "iqr" and K.clip_outliers(uniform, ["q"]).where("q_was_clipped").count() == 0
    spike = column(spark, "q", [10.0] * 20 + [1000.0], "double")
    assert K.clip_bounds(spike, ["q"]) == {}
    out = K.clip_outliers(spike, ["q"], risk="critical")
    assert out.where("q_was_clipped").count() == 1 and out.agg(F.max("q_raw")).first()[0] == 1000.0


def test_scaling_back_and_forth(spark):
    df = column(spark, "x", [2.0, 4.0, None, 6.0], "double")
    out, params = K.scale_minmax(df, ["x"], overwrite=True)
    assert rows(out, "x") == [(0.0,), (0.5,), (None,), (1.0,)]
    assert rows(K.unscale_minmax(out, params), "x") == rows(df, "x")


def test_weekend_is_zero_for_missing_dates(spark):
    out = K.date_features(column(spark, "d", ["2024-06-01", None], "string"), ["d"])
    assert rows(out, "d_day_of_week", "d_is_weekend", "d_week_of_year") == [(5, 1, 22), (None, 0, None)]


def test_key_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, None)], "k int, o int, v string")
    assert sorted(rows(D.dedup_by_key(df, ["k"], ["o"]), "k", "v")) == [(1, "a"), (2, None)]
    assert D.business_keys(["order_id", "id"], []) == ["order_id", "id"]
    with pytest.raises(ValueError):
        D.dedup_exact(df, expected_duplicates=1)
    with pytest.raises(ValueError):
        D.assert_survival(10, 4, "step")


# ---- rules ----

def test_reconciliation(spark):
    def diverged(factor, add):
        df = spark.createDataFrame([(100.0 + i, 50.0 + i, (50.0) * factor + add + i * (factor - 1)) for i in range(100)], "Revenue double, Cost double, Profit double")
        out, src = K.derive_metrics(df, {"Revenue": "revenue", "Cost": "cost"})
        return {r["derived_column"]: r["diverged"] for r in V.reconcile_derived(out, src).collect()}
    assert diverged(1, 0)["derived_profit"] is False
    assert diverged(3, 500)["derived_profit"] is True


def test_per_unit_price_is_a_formula(spark):
    df = spark.createDataFrame([(10.0 * i, float(i), 10.0) for i in (1, 2, 3, 4)], "`Total Revenue` double, `Units Sold` double, `Unit Price` double")
    df = df.withColumn("Unit Price", F.col("Total Revenue") / F.col("Units Sold"))
    out, src = K.derive_metrics(df, {"Total Revenue": "revenue", "Unit Price": "price"})
    assert src["derived_revenue_per_unit"] == ["Total Revenue", "Units Sold"] or "derived_revenue_per_unit" not in src


def test_structural_issues(spark):
    df = spark.createDataFrame([(5, 10.0, 1, 10, 0), (3, 25.0, 5, 2, 1), (-2, 150.0, 0, 3, 0), (8, 0.0, 0, 3, 1)],
                               "quantity int, discount_pct double, return_quantity int, order_quantity int, Units_range_failed int")
    got = dict(rows(V.structural_issues(df, {"quantity": "count"}), "rule", "count"))
    assert got == {"quantity < 0": 1, "discount_pct out of [0, 100]": 1, "return_quantity > order_quantity": 1, "Units_range_failed": 2}


def test_no_structural_issue_and_review(spark):
    assert V.structural_summary(column(spark, "revenue", [100.0, 120.0, 1e7], "double")).first()["issue_rows"] == 0
    flagged = column(spark, "quantity_range_failed", [1] * 10, "int").withColumn("i", F.monotonically_increasing_id())
    s = V.structural_summary(flagged).first()
    assert s["review_required"] and s["confident_rows"] == 0 and s["issue_rows"] == 10
    assert V.structural_examples(flagged, ["i"]).count() == 5


def test_ratio_bounds(spark):
    df = column(spark, "conversion_rate", [0.1, 0.2, 25.0], "double")
    assert rows(V.structural_issues(df, {"conversion_rate": "percentage"}, {"conversion_rate": "ratio"}), "count") == [(1,)]


# ---- statistics ----

def test_impact_ranks_revenue_first(spark):
    df = spark.createDataFrame([(100.0, 50.0)] * 20 + [(1e6, 5e5)], "revenue double, cost double")
    assert A.anomaly_impact(df, ["revenue", "cost"]).first()["column"] == "revenue"


def test_leakage_names():
    assert [n for n in ("CustomerId", "risk_score", "predicted_label", "revenue", "IsValid", "Guideline", "row_uuid") if R.leaky_name(n)] == [
        "CustomerId", "risk_score", "predicted_label", "row_uuid"]


def test_complementary_columns_are_leakage(spark):
    df = spark.createDataFrame([((i * 7 % 100) / 100, 1 - (i * 7 % 100) / 100, float(i * 31 % 97), float(i * 57 % 89)) for i in range(300)],
                               "p double, q double, n1 double, n2 double")
    got = {r[0] for r in rows(R.leakage_columns(df, P.pair_correlations(df)), "column")}
    assert got == {"p", "q"}


def test_trend_on_month_index_and_p_value(spark):
    df = spark.createDataFrame([(f"2024-0{m}-01", float(v)) for m, v in ((1, 10), (2, 13), (3, 15), (4, 20))], "d string, quantity double").withColumn(
        "order_date", F.to_date("d").cast("timestamp_ntz"))
    r = M.trend_regression(df, ["quantity"], "order_date").first()
    assert r["x_axis"] == "order_date_year_month_index" and r["slope"] == 3.2 and r["n"] == 4
    assert abs(M.t_two_sided(2.0, 10) - 0.07338803) < 1e-6 and abs(M.t_two_sided(-1.0, 3) - 0.39100222) < 1e-6
    assert abs(M.t_two_sided(1.96, 1e6) - 0.05) < 1e-4


def test_growth_over_500_months_and_zero_base(spark):
    df = spark.range(500).select(F.expr("timestamp_ntz '1980-01-15' + make_ym_interval(0, cast(id as int))").alias("d"), (F.col("id") + 1.0).alias("revenue"))
    assert M.growth_monthly(df, "d", "revenue").count() == 499 and M.growth_yearly(df, "d", "revenue").count() == 42
    base = df.withColumn("revenue", F.when(F.col("revenue") == 2, 0.0).otherwise(F.col("revenue")))
    assert M.growth_monthly(base, "d", "revenue").count() == 498


def test_all_labels_stay_in_the_distribution(spark):
    df = column(spark, "segment", [f"s{i % 700}" for i in range(3000)], "string")
    assert T.category_distribution(df, ["segment"]).count() == 700
    top = rows(T.category_top_other(df, ["segment"]), "value", "count")
    assert len(top) == 15 and sum(n for _, n in top) == 3000


def test_priority_dimensions_always_rank(spark):
    data = [(f"R{i % 3}", f"C{i % 4}", f"S{i % 2}", f"P{i % 5}", f"City{i % 15}", float(i)) for i in range(120)]
    df = spark.createDataFrame(data, "Region string, Product_Category string, Customer_Segment string, Sales_Representative string, Customer_City string, v double")
    chosen = [r[0] for r in rows(G.select_dimensions(G.dimension_totals(df, "v", df.columns[:5]), df.columns[:5]).orderBy("rank"), "dimension")]
    assert set(chosen[:4]) == set(df.columns[:4]) and chosen[4] == "Customer_City"


def test_rank_slices_show_every_category_once(spark):
    df = spark.createDataFrame([(c, v) for c, v in (("a", 4.0), ("b", 3.0), ("c", 2.0), ("d", 1.0))], "k string, v double")
    got = rows(X.rank_slices(G.rank_dimension(df, "v", ["k"])), "part", "place", "value")
    assert sorted(got) == [("bottom", 1, "d"), ("top", 1, "a"), ("top", 2, "b"), ("top", 3, "c")]


def test_discount_buckets_merge_equal_edges(spark):
    df = spark.createDataFrame([(0.0, False)] * 60 + [(0.1, True)] * 30 + [(0.2, True)] * 10, "discount double, returned boolean")
    got = sorted(rows(T.discount_return_rate(df, "discount", "returned"), "bucket", "lower", "upper", "return_rate_pct", "records"))
    assert got == [(1, 0.0, 0.1, 33.33, 90), (2, 0.1, 0.2, 100.0, 10)]


def test_lead_time_by_dimension(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-03", "A"), ("2024-01-01", "2024-01-04", "A"), ("2024-01-02", "2024-01-03", "B"),
                                ("2024-01-01", "2024-01-04", "B")], "`Order Date` string, `Ship Date` string, Region string")
    out, _ = K.derive_metrics(df)
    assert sorted(r[0] for r in rows(out, "derived_days_to_ship")) == [1.0, 2.0, 3.0, 3.0]
    assert {r[0]: r[1] for r in rows(T.lead_time_by(out, "derived_days_to_ship", ["Region"]), "value", "mean_days")} == {"A": 2.5, "B": 2.0}


# ---- output checks, facts ----

def test_merge_safety(spark):
    m = spark.createDataFrame([("t", 1, "c", "Offline", "Online", 49)], "table_name string, run_id int, column string, raw string, canonical string, row_count long")
    n = spark.createDataFrame([("t", 1, "c", "Offline", 49), ("t", 1, "c", "Online", 51)], "table_name string, run_id int, column string, value string, n long")
    assert Z.check_merges(m, n).first()["unsafe"] and Z.merges_verdict(Z.check_merges(m, n)).first()["status"] == "fail"


def test_small_trend_sample_warns(spark):
    t = spark.createDataFrame([("t", 1, True, 4), ("u", 1, False, 4)], "table_name string, run_id int, significant boolean, n int")
    assert sorted(rows(Z.check_trend_n(t), "table_name", "status")) == [("t", "warn"), ("u", "pass")]


def test_kappa_of_equal_raters(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "x string, y string")
    assert Z.cohen_kappa(df, "x", "y").first()["kappa"] == 1.0
    assert Z.cohen_kappa(df.where("x = 'a'"), "x", "y").first()["kappa"] == 1.0


@pytest.mark.parametrize("text,facts,want", [("r=0.97 across 340 rows", [0.97, 340.0], (2, 2)), ("grew by 58%", [12.0], (1, 0)), ("top 3", [3.0], (0, 0)),
                                             ("-1,234.5 and 5%", [-1200.0, 5.9], (2, 2)), ("0.2", [-0.8], (1, 1))])
def test_claims(spark, text, facts, want):
    out = X.ground_claims(spark.createDataFrame([(1, text)], "id int, text string"), column(spark, "fact", facts, "double"), ["id"])
    assert rows(out, "claims_checked", "claims_grounded") == [want]


def test_missing_action(spark):
    before = spark.createDataFrame([("a", 5, 50.0), ("b", 5, 50.0), ("c", 0, 0.0), ("d", 2, 20.0)], "column string, missing_count long, missing_pct double")
    plan = spark.createDataFrame([("a", "count", "impute_median"), ("b", "currency", "impute_median"), ("c", "count", "none"), ("d", "count", "impute_mean")],
                                 "column string, semantic_tag string, null_action string")
    after = spark.createDataFrame([("a", 0), ("b", 5), ("d", 2)], "column string, missing_count long")
    assert dict(rows(X.missing_action(before, plan, after), "column", "action")) == {"a": "median imputation", "b": "left as null", "d": "left as null"}


def test_chart_requests(spark):
    df = spark.createDataFrame([("N", 1.0), ("N", 2.0), ("S", 5.0)], "region string, revenue double")
    assert rows(H.chart_query(df, "bar", "region", "revenue"), "label", "value") == [("S", 5.0), ("N", 3.0)]
    assert H.chart_query(df, "scatter", "revenue", "revenue").count() == 3
    for bad in (dict(chart="pie", x="region", y="revenue"), dict(chart="bar", x="nope", y="revenue"), dict(chart="histogram", x="region"),
                dict(chart="bar", x="region", y="revenue", not_allowed={"revenue"})):
        with pytest.raises(ValueError):
            H.chart_query(df, **bad)


def test_summary_document_is_always_returned(spark):
    docs = spark.createDataFrame([("s", i, "dataset_summary" if i == 0 else "stat", [1.0, float(i + 1)] if i else [-1.0, 0.0]) for i in range(9)],
                                 "scope_id string, doc_id int, doc_type string, embedding array<double>")
    q = spark.createDataFrame([("s", 0, [1.0, 1.0])], "scope_id string, question_id int, embedding array<double>")
    got = rows(E.vector_topk(docs, q), "doc_id", "rank")
    assert (0, 0) in got and len(got) == 7


def test_histogram_of_a_constant(spark):
    out = T.histogram(column(spark, "x", [2.0, 2.0], "double"), "x", 4)
    assert sum(r[0] for r in rows(out, "count")) == 2
