"""Profile of a table: shape, columns, outliers, distributions, hidden nulls, keys, pairs, parse rates, format hints."""

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.dates import parse_datetime
from ..functions.distinct import distinct_counts, sketch
from ..functions.fingerprint import row_hash
from ..functions.lineage import held_on_disk, written
from ..functions.moments import SUMS, all_pair_sums, correlations, power_sums, shape_of
from ..functions.numbers import (NUMERIC_TYPES, datetime_columns, kurtosis_agg, numeric_columns, pct, pearson_agg, ratio,
                                 sample_kurtosis, sample_skewness, skewness_agg, string_columns)
from ..functions.partitions import held
from ..functions.quantiles import column_quantiles
from ..functions.reshape import first_values, long_agg
from ..functions.text import HIDDEN_NULL_WORDS, MONEY_SYMBOLS, quoted, strip, to_number
from ..options import DEFAULTS, Options

# Numbers that often stand for "missing".
SENTINELS = [-99999.0, -9999.0, -999.0, -99.0, -9.0, -1.0, 0.0, 999.0, 9999.0, 99999.0]


def null_counts(df: DataFrame) -> DataFrame:
    return long_agg(df, {c: {"rows": F.count("*"), "missing_count": F.count("*") - F.count(quoted(c))}
                         for c in df.columns})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(row_count, total_missing, distinct_rows)`` of a table, exact.

    Rows are grouped by two 64-bit fingerprints that know which cells are null, combined before the shuffle: 24 bytes a row. A group of one row is a
    distinct row for certain. Only rows of larger groups are looked at again and grouped by their cells, so equal fingerprints prove nothing by
    themselves. The groups above one are a small part of a table's rows, or their rows are combined before they move.
    """
    cells = [quoted(c) for c in df.columns]
    prints = [row_hash(df.columns, 0).alias("_h"), row_hash(df.columns, 1).alias("_g")]
    nulls = sum((c.isNull().cast("int") for c in cells), F.lit(0))
    with held(df):
        groups = written(df.select(*prints, nulls.alias("_nulls")).groupBy("_h", "_g").agg(F.count("*").alias("_n"), F.sum("_nulls").alias("_nulls")), "row-groups")
        totals = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("_nulls"), F.lit(0)).alias("total_missing"),
                            F.count_if(F.col("_n") == 1).alias("_single"))
        again = groups.where("_n > 1").select("_h", "_g")
        suspects = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)], *prints).join(again, ["_h", "_g"], "left_semi")
        verified = written(suspects.groupBy("_h", "_g", *[f"c{i}" for i in range(len(cells))]).agg(F.lit(1).alias("_one")).agg(
            F.count("*").alias("_several")), "row-verified")
    return totals.join(verified).select("row_count", "total_missing", (F.col("_single") + F.col("_several")).alias("distinct_rows"))  # one row each


def profile_shape(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows."""
    cols, r = len(df.columns), F.col("row_count")
    return duplicate_rows(df).withColumn("duplicate_rows", r - F.col("distinct_rows")).select(
        r, F.lit(cols).alias("column_count"), (r * cols).alias("total_cells"), "total_missing",
        pct(F.col("total_missing"), r * cols).alias("missing_pct"), "duplicate_rows",
        pct(F.col("duplicate_rows"), r).alias("duplicate_pct"))


def _count_rows(df: DataFrame, seen: dict[str, dict], opts: Options, known: dict[str, int] | None = None) -> list[tuple]:
    """(column, dtype, position, rows, missing, missing %, different values with null as one, share, key hint) of each column; ``known`` has the
    different values of columns that are counted already."""
    known = known or {}
    counts, out = known | distinct_counts(df.select(*[quoted(c) for c in df.columns if c not in known]), seen), []
    for i, f in enumerate(df.schema):
        rows, missing = seen[f.name]["rows"], seen[f.name]["rows"] - seen[f.name]["values"]
        unique = counts[f.name] + (missing > 0)
        share = unique / rows if rows else None
        out.append((f.name, f.dataType.simpleString(), i, rows, missing, _percent(missing, rows), unique, share,
                    bool(rows > 1 and not missing and share >= opts.key_ratio)))
    return out


def _percent(part: int, whole: int) -> float:
    """As ``pct`` rounds: half up, on the decimal digits of the double."""
    return float(Decimal(repr(part / whole * 100)).quantize(Decimal("0.01"), ROUND_HALF_UP)) if whole else 0.0


COUNTS_SCHEMA = ("column string, dtype string, position int, rows long, missing_count long, missing_pct double, unique_count long, cardinality_ratio double, "
                 "candidate_key_hint boolean")


def profile_columns(df: DataFrame, order_by=None, opts: Options = DEFAULTS, firsts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per column; the distinct count takes null as one value. ``firsts`` saves looking at the first rows again.

    A sketch chooses how each column is counted exactly; no cell's text is shuffled. The driver sees one row per column.
    """
    with held(df):
        firsts = firsts or first_values(df, df.columns, 3, order_by)
        rows = _count_rows(df, sketch(df), opts)
    return df.sparkSession.createDataFrame([(*r, firsts[r[0]][:3]) for r in rows if r[3]], COUNTS_SCHEMA + ", sample_values array<string>")


def outlier_iqr(df: DataFrame, columns=None, opts: Options = DEFAULTS) -> DataFrame:
    """Tukey fences per numeric column and how many values lie outside. Two passes: quartiles, then one aggregate."""
    columns = columns or numeric_columns(df)
    fences = {}
    with held(df.select(*[quoted(c) for c in columns])) as narrow:
        rows = narrow.agg(F.count("*")).first()[0]
        for r in column_quantiles(narrow, columns, [0.25, 0.75], opts, rows=rows).collect():  # one row per column
            q1, q3 = r["q"]
            fences[r["column"]] = (q1 - opts.fence * (q3 - q1), q3 + opts.fence * (q3 - q1))
        found = long_agg(narrow, _fence_metrics(columns, fences, opts))
        return df.sparkSession.createDataFrame(found.collect(), found.schema).withColumn("has_outliers", F.col("outlier_count") > 0)


def _fence_metrics(columns: list[str], fences: dict, opts: Options) -> dict:
    metrics = {}
    for c in columns:
        lo, hi = fences.get(c, (None, None))
        v, n = quoted(c).cast("double"), F.count(quoted(c))
        enough = n >= opts.min_fence_values
        outside = F.when(enough, F.count_if((v < F.lit(lo).cast("double")) | (v > F.lit(hi).cast("double"))))
        metrics[c] = {
            "lower_bound": F.when(enough, F.round(F.lit(lo).cast("double"), 4)),
            "upper_bound": F.when(enough, F.round(F.lit(hi).cast("double"), 4)),
            "outlier_count": F.coalesce(outside, F.lit(0)),
            "outlier_pct": pct(F.coalesce(outside, F.lit(0)), F.count("*")),
        }
    return metrics


def _shape_metrics(c: str, opts: Options) -> dict:
    return _shape_columns(F.count(quoted(c)), skewness_agg(quoted(c)), kurtosis_agg(quoted(c)), opts)


def _shape_columns(n, skew, tail, opts: Options) -> dict:
    enough = n >= 3
    normal = enough & (F.abs(skew) <= opts.normal_skew) & F.coalesce(F.abs(tail) <= opts.normal_kurtosis, F.lit(False))
    kind = (F.when(normal, "normal").when(enough & (skew > opts.skewed), "right_skewed").when(enough & (skew < -opts.skewed), "left_skewed")
            .otherwise("symmetric"))
    return {"n": n, "skewness": F.when(enough, F.round(skew, 4)).otherwise(0.0), "distribution_type": kind, "is_normal": normal}


def distribution_shape(df: DataFrame, columns=None, opts: Options = DEFAULTS) -> DataFrame:
    return long_agg(df, {c: _shape_metrics(c, opts) for c in columns or numeric_columns(df)})


def implicit_missing(df: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Values that stand for "missing": ``(column, kind, value, n)``. Only suspect cells leave a task."""
    numeric, texts = numeric_columns(df), string_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), F.lit("sentinel").alias("kind"),
                      F.when(quoted(c).cast("double").isin(SENTINELS), F.format_string("%d", quoted(c).cast("long")))
                      .alias("value")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("pattern").alias("kind"),
                       F.when(F.lower(strip(quoted(c))).isin(HIDDEN_NULL_WORDS), F.lower(strip(quoted(c))))
                       .alias("value")) for c in texts]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, kind string, value string, n long")
    suspects = F.filter(F.array(*cells), lambda x: x["value"].isNotNull())
    found = (df.select(F.explode(suspects).alias("_x")).select("_x.*")
             .groupBy("column", "kind", "value").agg(F.count("*").alias("n")))
    zero = (F.col("kind") == "sentinel") & (F.col("value") == "0")
    rows = df.agg(F.count("*")).scalar()
    return found.where(~zero | (F.col("n") >= opts.zero_share * rows))


def candidate_keys(profile: DataFrame) -> DataFrame:
    return profile.where((F.col("unique_count") == F.col("rows")) & (F.col("missing_count") == 0)
                         & (F.col("rows") > 0)).select("column")


def identical_columns(df: DataFrame, columns=None) -> DataFrame:
    """Pairs of columns of one type that agree in every row; null equals null.

    Each column gets a fingerprint: the hashes of its cells together with the number of their row, combined over all rows. Equal columns have equal ones, so only columns that share
    theirs are compared cell by cell, each with the first of its group: the plan grows with the columns, not with their pairs.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    nothing = df.sparkSession.createDataFrame([], "col1 string, col2 string")
    if len(fields) < 2:
        return nothing
    row, cells = F.col("_row"), [(F.isnull(F.col(f"c{i}")), F.col(f"c{i}")) for i in range(len(fields))]
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), *[quoted(f.name).alias(f"c{i}") for i, f in enumerate(fields)])
    prints = numbered.agg(*[F.bit_xor(F.xxhash64(F.lit(salt), row, *cells[i])).alias(f"h{i}_{salt}") for i in range(len(fields)) for salt in (1, 2)]).first()
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(fields):
        groups.setdefault((f.dataType.simpleString(), prints[f"h{i}_1"], prints[f"h{i}_2"]), []).append(i)
    maybe = [(own[0], i) for own in groups.values() for i in own[1:]]
    if not maybe or prints["h0_1"] is None:  # no two alike, or no rows
        return nothing
    sure = numbered.agg(*[F.bool_and(F.col(f"c{a}").eqNullSafe(F.col(f"c{b}"))).alias(f"s{b}") for a, b in maybe]).first()
    same = [[own[0], *[i for i in own[1:] if sure[f"s{i}"]]] for own in groups.values()]
    return df.sparkSession.createDataFrame([(fields[a].name, fields[b].name) for own in same for a, b in combinations(own, 2)], "col1 string, col2 string")


def pair_correlations(df: DataFrame, columns=None, full: set[str] = frozenset()) -> DataFrame:
    """Pairwise-complete Pearson r of every numeric pair: few columns in one aggregate, many by sums of products in blocks of columns. ``full`` names columns
    known to hold no null: their deviation is one aggregate for all pairs of such columns."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, r double")
    if len(columns) > WIDE:
        return correlations(all_pair_sums(df, columns), columns)
    metrics = {f"{i}": {"r": pearson_agg(quoted(a).cast("double"), quoted(b).cast("double"), a not in full, b not in full)}
               for i, (a, b) in enumerate(pairs)}
    names = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2")) for a, b in pairs])
    return long_agg(df, metrics, "_i").select(names[F.col("_i").cast("int")].alias("_p"), "r").select("_p.*", "r")


WIDE = 24  # columns from which pairs are summed by matrix products in Python tasks


def raw_correlations(df: DataFrame, columns=None, opts: Options = DEFAULTS, full: set[str] = frozenset()) -> DataFrame:
    return pair_correlations(df, columns, full).where(F.abs("r") >= opts.report_r).withColumn("r", F.round("r", 4))


def _times(test, n=None):
    """How many rows hold the test; ``n`` is the number of rows a row stands for."""
    return F.count_if(test) if n is None else F.coalesce(F.sum(F.when(test, n)), F.lit(0))


def _parse_metrics(df: DataFrame, c: str, n=None) -> dict:
    if not isinstance(df.schema[c].dataType, T.StringType):
        return {"datetime_pct": F.lit(100.0 if c in datetime_columns(df) else 0.0), "numeric_pct": F.lit(0.0)}
    v = quoted(c)
    values = _times(v.isNotNull(), n)
    return {"datetime_pct": pct(_times(parse_datetime(v).isNotNull(), n), values), "numeric_pct": pct(_times(to_number(v).isNotNull(), n), values)}


def parseability(df: DataFrame) -> DataFrame:
    """Share of non-null text that reads as a date, and as a number."""
    return long_agg(df, {c: _parse_metrics(df, c) for c in df.columns})


def _hint_metrics(c: str, opts: Options, n=None) -> dict:
    v, low = quoted(c).cast("string"), c.lower()
    values = _times(quoted(c).isNotNull(), n)

    def often(test):
        return (values > 0) & (_times(test, n) >= opts.hint_share * values)

    dashed = often(strip(v).contains("-") & (F.length(strip(v)) >= 8))
    return {"currency_like": often(v.rlike(f"[{MONEY_SYMBOLS[:5]}]")), "date_like": F.lit("date" in low or "time" in low) | dashed,
            "identifier_like": F.lit(low.endswith("_id") or low == "id" or low.startswith("id_")), "at_like": often(v.contains("@")),
            "iso_like": often(v.rlike(r"^\s*\d{4}") & v.contains("-"))}


def _hinted(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (*NUMERIC_TYPES, T.BooleanType))]


FEW_TEXTS = 100_000  # values by the sketch up to which a column's text is measured once per value
GROUPED = (T.StringType(), T.TimestampType(), T.TimestampNTZType(), T.DateType())


def _text_measures(df: DataFrame, seen: dict[str, dict], opts: Options = DEFAULTS) -> dict[str, dict]:
    """Parse rates and format hints by column, over all values. The rows of a column that a sketch found to have few values are first counted by value, in every task
    before the shuffle, and each value is read once for all its rows; ``distinct`` is then their exact number. Other columns are read row by row."""
    hinted = [f for f in df.schema if f.name in _hinted(df)]
    few = [f.name for f in hinted if f.dataType in GROUPED and seen[f.name]["about"] <= FEW_TEXTS]
    many = [f.name for f in hinted if f.name not in few]
    out = {}
    if few:
        parts = []
        for c in few:
            values = df.groupBy(quoted(c)).agg(F.count("*").alias("_n"))
            metrics = _parse_metrics(df, c, F.col("_n")) | _hint_metrics(c, opts, F.col("_n")) | {"distinct": F.count(quoted(c))}
            parts.append(values.agg(*[e.alias(m) for m, e in metrics.items()]).select(F.lit(c).alias("column"), *metrics))
        out |= {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in reduce(lambda a, b: a.unionAll(b), parts).collect()}
    if many:
        rows = long_agg(df, {c: _parse_metrics(df, c) | _hint_metrics(c, opts) for c in many}).collect()
        out |= {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in rows}
    return out


def format_hints(df: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Money, date and identifier hints of non-numeric columns, from the name and the share of all their values that look so."""
    columns = _hinted(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, currency_like boolean, date_like boolean, identifier_like boolean, at_like boolean, iso_like boolean")
    return long_agg(df, {c: _hint_metrics(c, opts) for c in columns})


def profile_confidence(shape: DataFrame) -> DataFrame:
    raw = 1.0 - F.col("missing_pct") / 100 * 0.5 - F.col("duplicate_pct") / 100 * 0.3
    return shape.select("row_count", "missing_pct", "duplicate_pct",
                        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 3).alias("confidence"))


# What a profile row holds, and its value for columns a measure does not apply to.
PROFILE_SCHEMA = (
    "table_name string, column string, position int, dtype string, rows long, missing_count long, missing_pct double, unique_count long, "
    "cardinality_ratio double, candidate_key_hint boolean, sample_values array<string>, datetime_pct double, numeric_pct double, "
    "currency_like boolean, date_like boolean, identifier_like boolean, at_like boolean, iso_like boolean, has_outliers boolean, distribution_type string, is_normal boolean, "
    "max_abs_r double, partners long, p95 double, has_datetime boolean")
NOT_MEASURED = {"datetime_pct": 0.0, "numeric_pct": 0.0, "currency_like": False, "date_like": False, "identifier_like": False, "at_like": False, "iso_like": False, "has_outliers": False, "distribution_type": "",
                "is_normal": False, "max_abs_r": 0.0, "partners": 0, "p95": None}


def _shapes_and_pairs(df: DataFrame, numeric: list[str], seen: dict[str, dict], opts: Options) -> tuple[dict[str, dict], list]:
    """The distribution of each numeric column and the strong correlations. Both come from one scan of sums around the means that ``seen`` has; columns with NaN,
    infinity or a range beyond the doubles' take Spark's aggregates, and many columns are paired in blocks."""
    if not numeric:
        return {}, []
    spark = df.sparkSession
    finite = all(seen[c]["_mean"] is None or math.isfinite(seen[c]["_mean"]) and math.isfinite(seen[c]["_max"] - seen[c]["_min"]) for c in numeric)
    wide = len(numeric) > WIDE
    full = {c for c in numeric if seen[c]["values"] == seen[c]["rows"]}
    if not finite:
        found = long_agg(df, {c: _shape_metrics(c, opts) for c in numeric}).collect()
        return {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in found}, raw_correlations(df, numeric, opts, full).collect()
    width = [(seen[c]["_max"] - seen[c]["_min"]) or 1.0 if seen[c]["_mean"] is not None else 1.0 for c in numeric]
    middle = [seen[c]["_min"] if seen[c]["_min"] == seen[c]["_max"] else seen[c]["_mean"] for c in numeric]
    sums = power_sums(df, numeric, [m or 0.0 for m in middle], width, not wide).collect()
    rows = [(numeric[r["i"]], int(r["n"]), *shape_of(r["n"], r["sx"], r["sxx"], r["s3"], r["s4"])) for r in sums if r["i"] == r["j"]]
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    skew = F.coalesce(sample_skewness(n, g1), F.when(n >= 3, F.lit(0.0)))
    tail = F.coalesce(sample_kurtosis(n, g2), F.when(n >= 4, F.lit(0.0)))
    shapes = spark.createDataFrame(rows, "column string, n long, g1 double, g2 double").select(
        "column", *[e.alias(k) for k, e in _shape_columns(n, skew, tail, opts).items()]).collect()
    if wide or len(numeric) < 2:
        pairs = raw_correlations(df, numeric, opts, full).collect()
    else:
        both = spark.createDataFrame([tuple(r) for r in sums if r["i"] < r["j"]], "i int, j int, " + ", ".join(f"{x} double" for x in (*SUMS, "s3", "s4")))
        pairs = correlations(both, numeric).where(F.abs("r") >= opts.report_r).withColumn("r", F.round("r", 4)).collect()
    return {r["column"]: r.asDict() for r in shapes}, pairs


def full_profile(df: DataFrame, table_name: str, order_by=None, opts: Options = DEFAULTS, join_key: str | None = None) -> DataFrame:
    """Everything the tagging rules read, one row per column. ``join_key`` names the column on which the rows of a large table are joined.

    One wide aggregate holds the sketch and the bounds of numbers; after it come the moments and correlations of numbers, the measures of texts, the exact counts and
    the quantiles, each over the whole table. The rows per column they give are put together on the driver.
    """
    numeric = numeric_columns(df)
    more = {c: {"_min": F.min(quoted(c)).cast("double"), "_max": F.max(quoted(c)).cast("double"), "_mean": F.avg(quoted(c).cast("double"))} for c in numeric}
    with held_on_disk(df, join_key) as df:
        firsts, seen = first_values(df, df.columns, 3, order_by), sketch(df, more)
        shapes, pairs = _shapes_and_pairs(df, numeric, seen, opts)
        texts = _text_measures(df, seen, opts)
        counted = _count_rows(df, seen, opts, {c: m["distinct"] for c, m in texts.items() if "distinct" in m})
        quantiles = column_quantiles(df, numeric, [0.25, 0.75, 0.95], opts, rows=counted[0][3] if counted else 0).collect() if numeric else []
    names = [f.split()[0] for f in COUNTS_SCHEMA.split(", ")]
    found = {r[0]: {**NOT_MEASURED, **seen[r[0]], **shapes.get(r[0], {}), **texts.get(r[0], {}), **dict(zip(names, r)), "table_name": table_name, "sample_values": firsts[r[0]][:3],
                    "has_datetime": bool(datetime_columns(df))} for r in counted}
    for r in quantiles:
        q1, q3, p95 = r["q"]
        own, width = found[r["column"]], opts.fence * (r["q"][1] - r["q"][0])
        own["p95"] = p95
        own["has_outliers"] = own["n"] >= opts.min_fence_values and (own["_min"] < q1 - width or own["_max"] > q3 + width)
    for r in pairs:
        for c in (r["col1"], r["col2"]):
            found[c]["max_abs_r"] = max(found[c]["max_abs_r"], abs(r["r"]))
            found[c]["partners"] += 1
    names = [f.split()[0] for f in PROFILE_SCHEMA.split(", ")]
    return df.sparkSession.createDataFrame([tuple(f.get(n) for n in names) for f in found.values() if f["rows"]], PROFILE_SCHEMA)
