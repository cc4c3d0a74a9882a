"""The building blocks that must hold at any size, forced onto their large-input paths by small limits."""

import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions import distinct, moments
from tabsight.functions.numbers import nan_to_null
from tabsight.functions.ordered import forward_fill, row_index, running_count, with_chunks
from tabsight.functions.quantiles import column_quantiles, exact_quantiles
from tabsight.operators.categories import near_labels
from tabsight.operators.correlation import corr_pearson, corr_spearman
from tabsight.operators.neighbours import impute_knn
from tabsight.operators import neighbours, regression, retrieval
from tabsight.operators.profile import identical_columns, pair_correlations, profile_columns
from tabsight.operators.regression import bayesian_ridge, impute_iterative
from tabsight.operators.retrieval import sample_rows, vector_topk
from tabsight.options import DEFAULTS
from tabsight.sources import json_scan, read_json_any

SMALL = replace(DEFAULTS, in_memory_rows=100, chunk_rows=50)


def frame(seed=1, n=1000):
    g = np.random.default_rng(seed)
    a = np.round(g.lognormal(2, 1.5, n), 3)
    a[: n // 3] = 7.0  # one value holds a third of the rows
    return pd.DataFrame({"id": np.arange(n), "k": g.choice(["x", "x", "x", "y", "z"], n), "a": a, "b": g.normal(0, 1, n)})


def test_quantiles_by_histograms_equal_numpy(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["column"]: r["q"] for r in column_quantiles(df, ["a", "b"], probs, SMALL).collect()}
    for c in ("a", "b"):
        np.testing.assert_allclose(got[c], pdf[c].quantile(probs), rtol=1e-12)


def test_bracket_search_survives_wrong_guesses(spark, monkeypatch):
    import tabsight.functions.quantiles as Q
    pdf = frame(n=5000)
    df = spark.createDataFrame(pdf)
    for sample, fetch in ((50, 10), (200, 300), (20_000, 50_000)):
        monkeypatch.setattr(Q, "SAMPLE_ROWS", sample)
        monkeypatch.setattr(Q, "COLLECT_VALUES", fetch)
        monkeypatch.setattr(Q.math, "sqrt", (lambda x: 1e9) if sample == 50 else __import__("math").sqrt)
        probs = [0.0, 0.25, 0.5, 0.975, 1.0]
        got = {r["column"]: r["q"] for r in column_quantiles(df, ["a", "b"], probs, SMALL).collect()}
        for c in ("a", "b"):
            np.testing.assert_allclose(got[c], pdf[c].quantile(probs), rtol=1e-12)


def test_quantiles_mix_big_and_small_keys(spark):
    pdf = frame()
    pdf.loc[:20, "k"] = "rare"
    pdf.loc[21:30, "k"] = None
    got = {r["k"]: r["q"][0] for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], "a", [0.5], SMALL).collect()}
    want = pdf.groupby("k", dropna=False)["a"].median()
    assert {None if k is None or k != k else k for k in want.index} == set(got)
    for k, v in want.items():
        assert abs(got[None if k != k or k is None else k] - v) < 1e-9


def test_chunks_follow_the_order_and_fill_forward(spark):
    pdf = frame()
    pdf["gap"] = pdf["b"].where(pdf["id"] % 7 < 2)
    pdf.loc[:40, "gap"] = None
    df = nan_to_null(spark.createDataFrame(pdf.sample(frac=1, random_state=3)))
    chunked, k = with_chunks(df, ["a", "id"], SMALL)
    assert k > 5
    ranges = chunked.groupBy("_chunk").agg(F.min(F.struct("a", "id")).alias("lo"), F.max(F.struct("a", "id")).alias("hi")).orderBy("_chunk").collect()
    assert all(tuple(x["hi"]) < tuple(y["lo"]) for x, y in zip(ranges, ranges[1:]))
    got = forward_fill(df, ["gap"], ["a", "id"], SMALL).orderBy("id").toPandas()["gap"]
    want = pdf.sort_values(["a", "id"])["gap"].ffill().sort_index()
    np.testing.assert_allclose(got.astype(float), want.astype(float))


def test_chunks_over_dates_and_nulls(spark):
    days = pd.date_range("2020-01-01", periods=300, freq="h")
    pdf = pd.DataFrame({"id": range(300), "t": days, "v": [1.0 if i % 10 == 0 else None for i in range(300)]})
    df = spark.createDataFrame(pdf)
    pos = row_index(df, ["t", "id"], opts=SMALL).orderBy("id").toPandas()["row_index"]
    assert list(pos) == list(range(300))


def test_running_count(spark):
    pdf = frame()
    counts = pdf.groupby(["k", "a"]).size().reset_index(name="n")
    got = running_count(spark.createDataFrame(counts), "k", "a", "n", SMALL).toPandas().sort_values(["k", "a"])
    want = counts.sort_values(["k", "a"]).groupby("k")["n"].cumsum() - counts.sort_values(["k", "a"])["n"]
    np.testing.assert_array_equal(got["_below"], want)


def test_spearman_in_chunks(spark):
    pdf = frame()[["a", "b"]].assign(c=lambda d: d["a"] * 2 + d["b"])
    r = corr_spearman(spark.createDataFrame(pdf), ["a", "b", "c"], SMALL).collect()
    want = pdf.rank().corr()
    for row in r:
        assert abs(row["r"] - want.loc[row["col1"], row["col2"]]) < 1e-9


@pytest.mark.parametrize("cells", [1_000_000, 70])
def test_spearman_of_mostly_equal_values(spark, cells):
    """With 70 cells a task the runs of equal values, and of columns, go over many tasks."""
    g = np.random.default_rng(4)
    n = 500
    pdf = pd.DataFrame({"a": np.where(g.random(n) < 0.9, 1.0, g.normal(size=n)), "b": g.integers(0, 3, n).astype(float), "c": g.normal(size=n), "d": np.full(n, 2.0)})
    pdf["e"] = -pdf["c"] + pdf["b"]
    df = spark.createDataFrame(pdf).repartition(4)
    got = {(r["col1"], r["col2"]): r["r"] for r in corr_spearman(df, list(pdf), replace(DEFAULTS, rank_cells=cells)).collect()}
    want = pdf.rank().corr()
    assert len(got) == 10
    for (a, b), r in got.items():
        assert (r is None) if "d" in (a, b) else abs(r - want.loc[a, b]) < 1e-9


def test_many_columns_plan_and_run(spark, monkeypatch):
    g = np.random.default_rng(6)
    pdf = pd.DataFrame(g.normal(100, 3, (60, 500)), columns=[f"c{i}" for i in range(500)])
    pdf["c7"], pdf["c9"], pdf["c499"] = pdf["c3"] * -2 + 1, 0.1, pdf["c3"]
    pdf.loc[::7, "c5"] = np.nan
    df = nan_to_null(spark.createDataFrame(pdf)).cache()
    monkeypatch.setattr(moments, "BLOCK", 200)
    pairs = {(r["col1"], r["col2"]): r["r"] for r in pair_correlations(df).collect()}
    want = pdf.corr()
    assert len(pairs) == 500 * 499 // 2 and abs(pairs["c3", "c7"] + 1) < 1e-9 and pairs["c3", "c9"] is None
    for a, b in (("c0", "c1"), ("c4", "c5"), ("c5", "c450"), ("c199", "c200"), ("c3", "c499")):
        assert abs(pairs[a, b] - want.loc[a, b]) < 1e-9
    assert identical_columns(df).collect() == [("c3", "c499")]
    listwise = {(r["col1"], r["col2"]): r["r"] for r in corr_pearson(df, list(pdf)).collect()}
    assert abs(listwise["c0", "c499"] - pdf.dropna()[["c0", "c499"]].corr().iloc[0, 1]) < 1e-9


def test_counts_of_different_values(spark, monkeypatch):
    g = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"dense": np.arange(n) * 3 - 500, "sparse": g.integers(-2**60, 2**60, n), "few": g.integers(0, 9, n), "text": [f"t{i // 2}" for i in range(n)],
                        "num": np.where(np.arange(n) % 3 == 0, 0.5, np.arange(n) / 7), "flag": np.arange(n) % 2 == 0})
    df = spark.createDataFrame(pdf).withColumn("day", F.date_add(F.lit("2020-01-01"), (F.col("dense") % 2000).cast("int"))).withColumn("none", F.lit(None).cast("string")).withColumn(
        "gaps", F.when(F.col("dense") % 2 == 0, F.col("dense"))).withColumn("sometimes", F.when(F.col("dense") % 2 == 0, "null"))
    monkeypatch.setattr(distinct, "FEW", 100)
    want = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    assert distinct.distinct_counts(df, distinct.sketch(df)) == want
    assert distinct.unique_columns(df, df.columns) == ["dense", "sparse"]
    assert {r["column"]: r["unique_count"] for r in profile_columns(df).collect()} == {c: k + (c in ("none", "gaps", "sometimes")) for c, k in want.items()}


def brute_knn(pdf, target, features, k=5):
    x = pdf[features].to_numpy(float)
    j = features.index(target)
    out = pdf[target].copy()
    for i in np.flatnonzero(np.isnan(x[:, j])):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        n = both.sum(1)
        d = np.where(both, (x - x[i]) ** 2, 0.0).sum(1) * len(features) / np.where(n == 0, 1, n)
        d[(n == 0) | np.isnan(x[:, j])] = np.inf
        best = np.argsort(d, kind="stable")[:k]
        best = best[np.isfinite(d[best])]
        out.iloc[i] = x[best, j].mean() if len(best) else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("top,step", [(12, 4), (2, 1)])
def test_knn_cells_equal_brute_force(spark, monkeypatch, top, step):
    """With a top tree of two levels the deeper ones are split node by node in the table, as very many rows are."""
    monkeypatch.setattr(neighbours, "TOP_DEPTH", top)
    monkeypatch.setattr(neighbours, "STEP", step)
    g = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "p": g.normal(0, 1, n), "q": g.normal(0, 3, n), "r": g.gamma(2, 2, n)})
    pdf.loc[: n // 3, ["p", "q"]] = [0.5, 0.5]  # a third of the rows in one spot
    for c, m in (("p", 9), ("q", 7), ("r", 5)):
        pdf.loc[pdf["id"] % m == 1, c] = np.nan
    got = impute_knn(nan_to_null(spark.createDataFrame(pdf)), ["r", "p"], ["id"], ["p", "q", "r"], cell_rows=40).orderBy("id").toPandas()
    for c in ("r", "p"):
        np.testing.assert_allclose(got[c].astype(float), brute_knn(pdf, c, ["p", "q", "r"]), rtol=1e-9)


def reference_rounds(pdf, features, rounds):
    x = pdf[features].to_numpy(float)
    hole = np.isnan(x)
    x = np.where(hole, np.nanmedian(x, 0), x)
    order = [j for j in np.argsort(hole.sum(0), kind="stable") if hole[:, j].any()]
    for _ in range(rounds):
        for j in order:
            others = [i for i in range(len(features)) if i != j]
            seen = ~hole[:, j]
            a, b = x[seen][:, others], x[seen][:, j]
            ac, bc = a - a.mean(0), b - b.mean()
            w = bayesian_ridge(len(b), ac.T @ ac, ac.T @ bc, bc @ bc)
            x[hole[:, j], j] = (x[hole[:, j]][:, others] - a.mean(0)) @ w + b.mean()
    return x


def test_iterative_equals_row_by_row_rounds(spark):
    g = np.random.default_rng(8)
    n = 400
    a = g.normal(50, 5, n)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + g.normal(0, 2, n), "c": -a + g.normal(0, 3, n), "i": np.arange(n)})
    pdf.loc[pdf["i"] % 6 == 0, "b"] = np.nan
    pdf.loc[pdf["i"] % 4 == 1, "c"] = np.nan
    pdf.loc[pdf["i"] % 24 == 0, "c"] = np.nan
    df = nan_to_null(spark.createDataFrame(pdf))
    got = impute_iterative(df, ["b", "c"], ["a", "b", "c"]).orderBy("i").toPandas()
    want = reference_rounds(pdf, ["a", "b", "c"], 10)
    np.testing.assert_allclose(got[["a", "b", "c"]].astype(float), want, rtol=1e-3)


def test_models_from_scans_equal_models_from_patterns(spark, monkeypatch):
    g = np.random.default_rng(3)
    n = 700
    a = g.normal(20, 4, n)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + g.normal(0, 1, n), "c": 30 - a + g.normal(0, 2, n), "i": np.arange(n)})
    for k, c in enumerate("abc"):
        pdf.loc[g.random(n) < 0.1 * (k + 1), c] = np.nan
    df = nan_to_null(spark.createDataFrame(pdf).repartition(3))
    few = impute_iterative(df, ["a", "b", "c"], ["a", "b", "c"]).orderBy("i").toPandas()
    monkeypatch.setattr(regression, "MOST_PATTERNS", 1)
    many = impute_iterative(df, ["a", "b", "c"], ["a", "b", "c"]).orderBy("i").toPandas()
    np.testing.assert_allclose(few.astype(float), many.astype(float), rtol=1e-8)
    np.testing.assert_allclose(many[["a", "b", "c"]].astype(float), reference_rounds(pdf, ["a", "b", "c"], 10), rtol=1e-2)


def test_any_number_of_patterns(spark):
    """25 columns with gaps at random: nearly every row has a pattern of its own."""
    g = np.random.default_rng(9)
    n, p = 1500, 25
    base = g.normal(0, 1, (n, 3))
    x = base @ g.normal(0, 1, (3, p)) + 5
    holes = g.random((n, p)) < 0.15
    holes[:, 0] = False
    pdf = pd.DataFrame(np.where(holes, np.nan, x), columns=[f"c{i}" for i in range(p)]).assign(i=np.arange(n))
    names = [f"c{i}" for i in range(p)]
    opts = replace(DEFAULTS, iterative_rounds=2)
    got = impute_iterative(nan_to_null(spark.createDataFrame(pdf).repartition(4)), names, names, opts).orderBy("i").toPandas()[names].to_numpy(float)
    assert len({tuple(h) for h in holes}) > 1000 and not np.isnan(got).any()
    assert (got[~holes] == x[~holes]).all() and np.abs(got - x)[holes].mean() < 0.3 * np.abs(x - x.mean(0))[holes].mean()


def test_bayesian_ridge_finds_the_line():
    g = np.random.default_rng(0)
    x = g.normal(size=(5000, 2))
    y = x @ [3.0, -2.0] + g.normal(0, 0.1, 5000)
    xc, yc = x - x.mean(0), y - y.mean()
    w = bayesian_ridge(5000, xc.T @ xc, xc.T @ yc, yc @ yc)
    np.testing.assert_allclose(w, [3.0, -2.0], atol=0.01)


def test_json_documents_in_byte_ranges(spark, tmp_path):
    """Ranges of a few hundred bytes: texts, names and records are cut anywhere, also at quotes, backslashes and commas in texts."""
    g = np.random.default_rng(3)
    odd = ['a,b', 'q"uote', "back\\slash", '\\"', "[1,{", "}],", "é,中", "", "line\nbreak", "\\\\", ',",']
    text = lambda: "".join(g.choice(odd, g.integers(0, 5)))
    records = [{"id": int(i), "t": text(), "deep": {"x": [1, 2, {"y": text()}]}, "v": None if i % 5 == 0 else float(i) / 4} for i in range(400)]
    columns = {"na,me": {str(i): text() + "." for i in range(300)}, "n": {str(i): i * 2 for i in range(300)}, "some": {str(i): None if i % 3 else f"s,{i}" for i in range(300)}}
    (tmp_path / "list.json").write_text(json.dumps(records, indent=1, ensure_ascii=False))
    (tmp_path / "flat.json").write_text(json.dumps(records))
    (tmp_path / "dict.json").write_text(json.dumps(columns, ensure_ascii=False))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"a": {"1": i}, "b": f"x,{i}"}) for i in range(50)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert json_scan.fragments(spark, f"{tmp_path}/list.json").select("start").distinct().count() > 20
        for name in ("list", "flat"):
            got = {r["id"]: (r["t"], r["deep"]["x"], r["v"]) for r in read_json_any(spark, f"{tmp_path}/{name}.json").collect()}
            assert len(got) == 400
            for r in records:
                assert got[r["id"]][0] == r["t"] and got[r["id"]][2] == r["v"] and json.loads(got[r["id"]][1][2])["y"] == r["deep"]["x"][2]["y"]
        got = {r["n"]: (r["na,me"], r["some"]) for r in read_json_any(spark, f"{tmp_path}/dict.json").collect()}
        assert got == {2 * i: (columns["na,me"][str(i)], columns["some"][str(i)]) for i in range(300)}
        assert read_json_any(spark, f"{tmp_path}/lines.json").select("a.1", "b").orderBy("1").first() == (0, "x,0")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_near_labels_by_halves(spark, d):
    g = np.random.default_rng(d)
    letters = list("abAé")
    words = {"".join(g.choice(letters, g.integers(1, 12))) for _ in range(140)}
    words |= {w[:k] + "b" + w[k:] for w in list(words)[:40] for k in (0, len(w) // 2, len(w))} | {w[1:] for w in list(words)[:20]} | {"", "x" * 5}
    words = sorted(words)
    labels = spark.createDataFrame([("c", w, i) for i, w in enumerate(words)] + [("other", w, 1) for w in words[:5]], "column string, label string, n long")
    got = {(r["label"], r["other"], r["distance"]) for r in near_labels(labels, labels, replace(DEFAULTS, fuzzy_distance=d)).where("column = 'c'").collect()}
    assert got == {(a, b, e) for a in words for b in words if a and b and a != b and a[0].lower() == b[0].lower() and abs(len(a) - len(b)) <= d and (e := edit_distance(a, b)) <= d}


def test_long_labels_meet(spark):
    long = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 2000))
    changed, less = long[:700] + "Z" + long[701:], long[:500] + long[501:1500] + long[1501:]
    labels = spark.createDataFrame([("c", w, 1) for w in (long, changed, less, long[:900])], "column string, label string, n long")
    got = {(r["label"], r["other"]): r["distance"] for r in near_labels(labels, labels).collect()}
    assert got == {(long, changed): 1, (changed, long): 1, (long, less): 2, (less, long): 2}


def test_one_scope_of_most_rows(spark, monkeypatch):
    """900 of 1000 documents and most questions in one scope, in blocks of 50 and 4; repeated vectors tie, some vectors have no direction."""
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 50)
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 4)
    g = np.random.default_rng(7)
    x = g.normal(size=(1000, 6)).round(1)
    x[100:140] = x[3]
    kinds = ["dataset_summary" if i % 300 == 250 else "trend" if i % 4 == 0 else "row" for i in range(1000)]
    docs = [("big" if i % 10 else f"s{i % 30}", i, kinds[i], None if i == 11 else [0.0] * 6 if i == 12 else x[i].tolist()) for i in range(1000)]
    questions = [("big", j, g.normal(size=6).tolist()) for j in range(10)] + [("big", 10, x[3].tolist()), ("s10", 11, x[5].tolist()), ("none", 12, x[5].tolist())]
    got = {}
    for r in vector_topk(spark.createDataFrame(docs, "scope_id string, doc_id long, doc_type string, embedding array<double>"),
                         spark.createDataFrame(questions, "scope_id string, question_id int, embedding array<double>")).collect():
        got.setdefault(r["question_id"], set()).add((r["kind"], r["rank"], r["doc_id"]))
    assert set(got) == set(range(12))
    for scope, q, v in questions[:-1]:
        own = [d for d in docs if d[0] == scope]
        far = lambda d: (lambda u, w: np.inf if u is None or not any(u) else round(1 - float(np.dot(u, w) / np.sqrt(np.dot(u, u) * np.dot(w, w))), 9))(d[3], v)
        want, facts = set(), []
        for kind, k in (("row", 8), ("fact", 6)):
            best = sorted((far(d), d[1]) for d in own if (d[2] == "row") == (kind == "row"))[:k]
            want |= {(kind, n + 1, i) for n, (_, i) in enumerate(best)}
            facts += [i for _, i in best]
        summaries = [d[1] for d in own if d[2] == "dataset_summary"]
        if summaries and not set(summaries) & set(facts):
            want.add(("fact", 0, summaries[0]))
        assert got[q] == want


def test_sample_is_stable_and_exact_in_size(spark):
    df = spark.range(5000).toDF("id")
    a = {r[0] for r in sample_rows(df, ["id"], 300).collect()}
    b = {r[0] for r in sample_rows(df.repartition(7), ["id"], 300).collect()}
    assert len(a) == 300 and a == b


@pytest.mark.parametrize("few", [0, 100_000])
def test_text_measures_read_each_value_once_for_all_its_rows(spark, monkeypatch, few):
    """A column of few values is counted by value first; both ways agree with the measures row by row and with the number of values."""
    import datetime
    from tabsight.operators import profile as P
    from tabsight.options import DEFAULTS as opts
    rows = [("2024-01-02", "7", "$5", datetime.datetime(2024, 1, 2))] * 60 + [("a-b@c.example", None, "x", None)] * 30 + [(None, " 12 ", "", None), ("03/04/2024", "1e3", "n", None)] * 5
    df = spark.createDataFrame(rows, "a string, b string, c string, d timestamp_ntz")
    monkeypatch.setattr(P, "FEW_TEXTS", few)
    got = P._text_measures(df, distinct.sketch(df))
    by = {r["column"]: r.asDict() for r in P.parseability(df).join(P.format_hints(df), "column").collect()}
    for c in df.columns:
        assert {**got[c], "column": c} == ({**by[c], "distinct": len({r[df.columns.index(c)] for r in rows} - {None})} if few else by[c])


def test_pairs_with_columns_known_to_hold_no_null(spark):
    g = np.random.default_rng(5)
    pdf = pd.DataFrame(g.normal(size=(200, 3)), columns=list("abc")).assign(d=lambda x: x["a"] + x["b"])
    pdf.loc[::7, "c"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double")
    got = {(r["col1"], r["col2"]): r["r"] for r in pair_correlations(df, full={"a", "b", "d"}).collect()}
    want = pdf.corr()
    for (x, y), r in got.items():
        assert abs(r - want.loc[x, y]) < 1e-12


@pytest.mark.parametrize("way", ["box", "median", "lead"])
def test_grouped_quantiles_make_joined_rows_once(spark, way):
    from tabsight.operators.charts import chart_query
    from tabsight.operators.stats import box_stats, lead_time_by
    made = spark.sparkContext.accumulator(0)
    pdf = frame()

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame(pdf[["id", "a"]]).mapInArrow(seen, "id long, a double").join(spark.createDataFrame(pdf[["id", "k"]]), "id")
    want = pdf.groupby("k")["a"].median().to_dict()
    if way == "box":
        got = {r["label"]: r["median"] for r in box_stats(df, "a", "k", SMALL).collect()}
    elif way == "median":
        got = {r["label"]: r["value"] for r in chart_query(df, "line", "k", "a", agg="median", opts=SMALL).collect()}
    else:
        got = {r["value"]: r["median_days"] for r in lead_time_by(df, "a", ["k"], opts=SMALL).collect()}
    assert made.value == len(pdf)
    assert got == pytest.approx(want)


def test_distinct_rows_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """A table larger than the session's partitions are meant for gets more tasks; null, the two zeros and NaN are equal to themselves only."""
    from tabsight.functions import partitions
    from tabsight.operators.dedup import distinct_rows
    rows = [(None, 0.0, "a"), (None, -0.0, "a"), (1, float("nan"), None), (1, float("nan"), None), (None, None, "a"), (1, None, None)] + [(i, 1.5, "x") for i in range(200)] * 3
    spark.createDataFrame(rows, "`_row_hash` long, b double, c string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = sorted(map(str, distinct_rows(df).collect()))
    monkeypatch.setattr(partitions, "PART_BYTES", 50)
    dealt = distinct_rows(df)
    assert dealt.rdd.getNumPartitions() == partitions.parts_for(df) > 8
    assert dealt.columns == df.columns and sorted(map(str, dealt.collect())) == plain and len(plain) == 204


def test_rows_are_dealt_by_known_sizes_not_by_guesses(spark, monkeypatch):
    """A checkpoint counts by its files and a table not kept yet by what it is made of; the optimizer's guess for a join is the product of its sides."""
    from tabsight.functions import partitions
    from tabsight.functions.lineage import cut
    from tabsight.operators.dedup import distinct_rows
    monkeypatch.setattr(partitions, "PART_BYTES", 2**14)
    left = spark.range(300).select("id", F.col("id").cast("string").alias("a"))
    joined = left.join(left.withColumnRenamed("a", "b"), "id")
    small = cut(joined)
    assert partitions.parts_for(small) <= 3
    pairs = left.join(small.select(F.col("id").alias("k"), "b"), F.col("id") == F.col("k"), "left")
    assert distinct_rows(pairs).count() == 300 and distinct_rows(pairs).rdd.getNumPartitions() <= 8
    kept = joined.select("*", F.lit(1).alias("one")).persist()
    assert partitions.parts_for(kept.where("id > 0")) <= 3
    kept.count()
    assert partitions.parts_for(kept.where("id > 1")) <= 3
    kept.unpersist()


def test_profiled_rows_are_made_in_slices_and_leave_nothing(spark, sf, monkeypatch):
    """Slices of the join key filter both sides before they move and give each row once, null keys too; the rows and the shuffles of every query are gone at the end."""
    import os
    from tabsight.functions import lineage
    from tabsight.operators import profile as P
    from tabsight.plans.views import sales
    folder = lineage.shared_folder(spark).removeprefix("file://")
    df = sales(spark, sf, "order_id", "customer_segment", "product_category", "net_sales")
    want = sorted(map(tuple, df.collect()))
    setting = spark.conf.get(lineage.SHUFFLE_CLEANUP)
    monkeypatch.setattr(lineage, "SLICE_BYTES", lineage.known_bytes(df) // 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = df.where(F.pmod(F.xxhash64("order_id"), F.lit(4)) == 1)._jdf.queryExecution().optimizedPlan().toString()
        assert one.count("pmod(xxhash64(l_orderkey") == one.count("pmod(xxhash64(o_orderkey") == 1
        before = set(os.listdir(folder))
        with lineage.held_on_disk(df, "order_id") as rows:
            assert len(set(os.listdir(folder)) - before) == 1 and sorted(map(tuple, rows.collect())) == want
            assert rows.dtypes == df.dtypes and not lineage.more_than_scan(rows)
        assert set(os.listdir(folder)) == before and spark.conf.get(lineage.SHUFFLE_CLEANUP) == setting
        monkeypatch.setattr(lineage, "SLICE_BYTES", 8)
        odd = spark.createDataFrame([(None, 1.0), (None, 1.0), (3, None), (4, float("nan"))], "k long, v double").join(spark.range(2).select("id"))
        assert lineage.known_bytes(odd) >= 16
        with lineage.held_on_disk(odd, "k") as rows:
            assert spark.conf.get(lineage.SHUFFLE_CLEANUP) == "true"
            assert sorted(map(str, rows.collect())) == sorted(map(str, odd.collect()))
        monkeypatch.setattr(lineage, "SLICE_BYTES", 2**40)
        with pytest.raises(ZeroDivisionError), lineage.held_on_disk(df, "order_id"):
            1 / 0
        assert set(os.listdir(folder)) == before
        monkeypatch.setattr(lineage, "SLICE_BYTES", lineage.known_bytes(df) // 3)
        got = P.full_profile(df, "t", join_key="order_id").collect()
        assert set(os.listdir(folder)) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    assert sorted(map(str, got)) == sorted(map(str, P.full_profile(df, "t").collect()))


def test_many_values_are_counted_in_passes(spark, monkeypatch):
    """Numbers are counted by themselves, with one zero and one NaN, and few columns at once; texts by fingerprints."""
    from tabsight.functions import distinct as D
    rows = [(i * 1.25 if i % 9 else None, float(i % 700) if i % 700 else (-0.0 if i % 2 else 0.0), i * 10**9, f"t{i % 900}") for i in range(2000)]
    rows += [(float("nan"), float("nan"), 5, None)] * 3
    df = spark.createDataFrame(rows, "a double, b float, c long, d string").repartition(4)
    monkeypatch.setattr(D, "FEW", 10)
    monkeypatch.setattr(D, "PASS_CELLS", 2500)
    seen = D.sketch(df)
    passes = D._passes(list(df.schema), seen)
    assert sorted([f.name for f in p] for p in passes) == [["a"], ["b"], ["c"], ["d"]] and [len(D._numbers(f)) for f in df.schema] == [1, 1, 1, 2]
    assert D.distinct_counts(df, seen) == {"a": 1778, "b": 701, "c": 2001, "d": 900}
    monkeypatch.setattr(D, "PASS_CELLS", 10**6)
    assert len(D._passes(list(df.schema), seen)) == 3 and D.distinct_counts(df, seen) == {"a": 1778, "b": 701, "c": 2001, "d": 900}


@pytest.mark.parametrize("odd", [False, True])
def test_profile_takes_moments_and_pairs_from_one_scan(spark, monkeypatch, odd):
    """Shapes and correlations equal Spark's aggregates, with nulls and constants; only NaN or infinity make the profile use those aggregates."""
    from tabsight.operators import profile as P
    rng = np.random.default_rng(5)
    a = rng.gamma(2.0, 3.0, 400) + 1e6
    rows = [(float(x), None if i % 7 == 0 else float(2 * x + rng.normal()), 3.25, int(i % 11), None, float("nan") if odd and i == 9 else float(i * i))
            for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, same double, n int, nothing double, q double").repartition(5)
    shapes = {r["column"]: r for r in P.distribution_shape(df).collect()}
    pairs = {(r["col1"], r["col2"]): r["r"] for r in P.raw_correlations(df).collect()}
    used = []
    monkeypatch.setattr(P, "skewness_agg", lambda c, f=P.skewness_agg: used.append(c) or f(c))
    got = {r["column"]: r for r in P.full_profile(df, "t").collect()}
    assert bool(used) == odd
    for c, r in shapes.items():
        assert (got[c]["distribution_type"], got[c]["is_normal"]) == (r["distribution_type"], r["is_normal"])
    for c in df.columns:
        own = [abs(r) for p, r in pairs.items() if c in p]
        assert got[c]["partners"] == len(own)
        assert got[c]["max_abs_r"] == pytest.approx(max([0.0, *own]), abs=1e-4, nan_ok=True)
