"""A whole run over the messy view."""

import pytest

from tabsight.plans.run import run
from tabsight.plans.views import messy_sales


@pytest.fixture(scope="module")
def done(spark, sf):
    keys = ["order_id", "line", "sales", "tax"]
    return run(messy_sales(spark, sf), "messy", keys=keys, order_by=keys)


def test_rows_are_accounted_for(done):
    a = done.tables["row_accounting"].first()
    assert a["input_rows"] == done.raw.count()
    assert a["final_rows"] == done.cleaned.count() == a["input_rows"] - a["exact_duplicates_removed"] - a["canonical_duplicates_removed"] - a["imputation_drops"]


def test_money_text_is_parsed_and_kept_null(done):
    assert dict(done.cleaned.dtypes)["amount"] == "double"
    c = done.tables["currency_checks"].first()
    assert c["failed"] == c["nulls"] > 0 and not c["critical"]


def test_spellings_are_merged(done):
    assert {r["status"] for r in done.cleaned.select("status").distinct().collect()} == {"Complete", "Cancelled", "Shipped", "Pending"}
    assert done.tables["normalization"].count() == 2


def test_labels_are_filled_and_money_is_not(done):
    assert done.cleaned.where("segment is null").isEmpty() and not done.cleaned.where("unit_price is null").isEmpty()
    action = {r["column"]: r["action"] for r in done.tables["missing_action"].collect()}
    assert action["segment"] == "constant value (Unknown)" and action["unit_price"] == "left as null"


def test_every_result_can_be_read(done):
    for name, df in done.tables.items():
        assert df.columns and df.collect() is not None, name
    v = done.tables["validation"].first()
    assert v["passed"] and 0 < v["validation_score"] <= 100
    q = done.tables["quality_adjusted"].first()
    assert 0 <= q["overall_quality_score"] <= q["score_before"] <= 100


def test_unknown_row_order_is_refused(spark):
    from tabsight.plans.run import clean_table
    from pyspark.sql import Row
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, v double")
    base = dict(semantic_tag="count", intended_type="float", numeric_pct=0.0, currency_like=False, is_identifier=False, encoding="none",
                financial_role=None, analysis_allowed=True, scaling_allowed=False, has_outliers=False, distribution_type="")
    rows = [Row(column="id", null_action="none", **base), Row(column="v", null_action="impute_forward_fill", **base)]
    with pytest.raises(ValueError, match="order_by"):
        clean_table(df, rows)
