"""Rows and facts as documents, a stable row sample, and cosine top-k inside a scope."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.lineage import written
from ..functions.ordered import row_index
from ..functions.text import quoted
from ..options import DEFAULTS, Options

# Cell texts left out of a row document.
BLANK = ["", "nan", "none", "nat"]


def row_documents(df: DataFrame, order_by: list[str], opts: Options = DEFAULTS) -> DataFrame:
    """``(row_index, text)`` such as ``Row 3: a=1 | b=x``; empty cells are left out."""
    def cell(c):
        t = quoted(c).cast("string")
        return F.when(~F.lower(F.trim(t)).isin(BLANK), F.concat(F.lit(f"{c}="), t))
    numbered = row_index(df, order_by, "row_index", opts)
    return numbered.select("row_index", F.concat(F.lit("Row "), F.col("row_index").cast("string"), F.lit(": "),
                                                 F.concat_ws(" | ", *[cell(c) for c in df.columns])).alias("text"))


def sample_rows(df: DataFrame, keys: list[str], n: int | None = None, seed: int = 42, opts: Options = DEFAULTS) -> DataFrame:
    """At most n rows, the same ones in every run: those with the smallest hash of their key.

    A hash limit that lets through little more than n rows is found first, so the final sort is small at any size.
    """
    n = n or opts.row_documents
    order = F.sha2(F.concat_ws("|", *[quoted(k).cast("string") for k in keys], F.lit(str(seed))), 256)
    total = df.count()
    if total <= n:
        return df
    hashed = df.withColumn("_h", order)
    share = 1.2 * n / total
    while share < 1.0:
        limit = f"{int(share * 16 ** 12):012x}"  # the first twelve hexadecimal digits say how far down the order a row is
        candidates = hashed.where(F.substring("_h", 1, 12) < limit)
        if candidates.limit(n).count() >= n:
            return candidates.orderBy("_h", *[quoted(k) for k in keys]).limit(n).drop("_h")
        share *= 2
    return hashed.orderBy("_h", *[quoted(k) for k in keys]).limit(n).drop("_h")


def fact_documents(scope: str, dataset: DataFrame | None = None, columns: DataFrame | None = None, described: DataFrame | None = None,
                   pairs: DataFrame | None = None, trends: DataFrame | None = None, ranked: DataFrame | None = None,
                   anomalies: DataFrame | None = None, validation: DataFrame | None = None) -> DataFrame:
    """``(scope_id, doc_type, text)``: one document per fact row; results that are not given are skipped."""
    def doc(df, kind, template, *cols):
        if df is None:
            return None
        return df.select(F.lit(scope).alias("scope_id"), F.lit(kind).alias("doc_type"),
                         F.format_string(template, *[F.coalesce(quoted(c).cast("string"), F.lit("none")) for c in cols]).alias("text"))

    parts = [
        doc(dataset, "dataset_summary", "Table with %s rows and %s columns, %s%% of cells missing.", "row_count", "column_count", "missing_pct"),
        doc(columns, "column_meta", "Column %s is %s, tagged %s.", "column", "intended_type", "semantic_tag"),
        doc(described, "descriptive_stat", "%s has mean %s, median %s, standard deviation %s, from %s to %s.",
            "column", "mean", "median", "std", "min", "max"),
        doc(pairs, "correlation", "%s and %s: %s %s correlation, r = %s.", "col1", "col2", "strength", "direction", "pearson_r"),
        doc(trends, "trend", "%s goes %s over time, r squared %s.", "column", "trend", "r_squared"),
        doc(ranked, "ranking", "%s %s has a total of %s and a share of %s%%.", "dimension", "value", "total", "share_pct"),
        doc(anomalies, "anomaly_summary", "%s rows (%s%%) are outliers in %s columns.", "flagged_rows", "flagged_row_pct", "flagged_columns"),
        doc(validation, "quality_validation", "Validation score %s, passed: %s, confidence %s.", "validation_score", "passed", "confidence"),
    ]
    return reduce(lambda a, b: a.unionByName(b), [p for p in parts if p is not None])


BLOCK_DOCS, BLOCK_QUESTIONS, MOST_BROADCAST = 8192, 1024, 1_000_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; null ones, and what a shorter one lacks, are zeros."""
    rows = [np.zeros(0) if v is None else np.array([np.nan if x is None else x for x in v], dtype=float) if None in v else np.asarray(v, dtype=float) for v in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN for a row without a direction."""
    size = np.sqrt((x * x).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size[:, None] > 0, x / size[:, None], np.nan)


def _nearest(question: np.ndarray, docs: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of the k nearest, ties by position. ``rough`` distances of the matrix product choose who is measured again, pair by pair, so
    that equal vectors have equal distances."""
    k = min(k, len(docs))
    if not k:
        return np.zeros(0, dtype=int), np.zeros(0)
    near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 1e-9)
    sure = 1 - (docs[near] * question).sum(axis=1)
    sure = np.where(np.isnan(sure), np.inf, sure)
    best = np.lexsort((near, sure))[:k]
    return near[best], sure[best]


def _by_scope(df: DataFrame, scope: str, each: int, name: str) -> DataFrame:
    """(scope, name): into how many blocks a scope's rows are dealt."""
    return df.groupBy(quoted(scope).alias("_scope")).agg(F.ceil(F.count("*") / each).cast("int").alias(name))


def vector_topk(docs: DataFrame, questions: DataFrame, scope: str = "scope_id", opts: Options = DEFAULTS) -> DataFrame:
    """Nearest documents by cosine per question within its scope: rows and facts apart, the summary always.

    ``docs``: ``(scope, doc_id, doc_type, embedding)``; ``questions``: ``(scope, question_id, embedding)``. A scope's documents are dealt by a hash of their id into blocks, and its questions
    too, so a scope of most rows is many tasks; a task scores one block of either as a matrix product and passes on the few best of each question. A
    vector that is null or of length zero has no distance (null) and comes last.
    """
    spread = written(_by_scope(docs, scope, BLOCK_DOCS, "_parts").join(_by_scope(questions, scope, BLOCK_QUESTIONS, "_copies"), "_scope"), "scopes")  # scopes that have both
    sized = F.broadcast(spread) if spread.count() <= MOST_BROADCAST else spread
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = docs.join(sized, quoted(scope) == F.col("_scope")).select(
        F.col("_scope").alias("_in"), "doc_id", "doc_type", "embedding", block("doc_id", "_parts").alias("_part"), every("_copies").alias("_copy"))
    q = questions.join(sized, quoted(scope) == F.col("_scope")).select(
        F.col("_scope").alias("_of"), "question_id", "embedding", block("question_id", "_copies").alias("_at"), every("_parts").alias("_to"))
    kinds = {n: df.schema[c].dataType.simpleString() for n, df, c in (("_scope", docs, scope), ("question_id", questions, "question_id"), ("doc_id", docs, "doc_id"))}
    schema = f"_scope {kinds['_scope']}, question_id {kinds['question_id']}, doc_id {kinds['doc_id']}, doc_type string, distance double, kind string"
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        left = left.sort_by("doc_id")
        x, y = _matrix(left["embedding"]), _matrix(right["embedding"])
        width = max(x.shape[1], y.shape[1])
        x, y = (_unit(np.pad(m, ((0, 0), (0, width - m.shape[1])))) for m in (x, y))
        rough = 1 - y @ x.T
        rough = np.where(np.isnan(rough), np.inf, rough)
        types = np.array(left["doc_type"].to_pylist(), dtype=object)
        groups = [("row", np.flatnonzero(types == "row"), opts.top_rows), ("fact", np.flatnonzero(types != "row"), opts.top_fact_docs)]
        summary = np.flatnonzero(types == "dataset_summary")[:1]
        who, which, far, kind = [], [], [], []
        for j in range(len(y)):
            for name, own, k in [*groups, ("fact", summary, 1)]:
                at, distance = _nearest(y[j], x[own], rough[j, own], k)
                who += [j] * len(at)
                which += own[at].tolist()
                far += distance.tolist()
                kind += [name] * len(at)
        picked = left.take(which)
        distance = pa.array([None if f == np.inf else f for f in far], pa.float64())
        return pa.Table.from_arrays([picked["_in"], right["question_id"].take(pa.array(who)), picked["doc_id"], picked["doc_type"], distance, pa.array(kind, pa.string())], schema=fields)

    found = d.groupBy("_in", "_part", "_copy").cogroup(q.groupBy("_of", "_to", "_at")).applyInArrow(score, schema).dropDuplicates(["_scope", "question_id", "doc_id"])
    found = written(found.withColumnRenamed("_scope", scope), "nearest")  # a few rows per question and block
    w = Window.partitionBy(scope, "question_id", "kind").orderBy(F.col("distance").asc_nulls_last(), "doc_id")
    limit = F.when(F.col("kind") == "row", opts.top_rows).otherwise(opts.top_fact_docs)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    keys = [scope, "question_id"]
    first = Window.partitionBy(*keys).orderBy("doc_id")
    summary = found.where("doc_type = 'dataset_summary'").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    have = ranked.where("doc_type = 'dataset_summary'").select(*keys).distinct()
    extra = summary.join(have, keys, "left_anti").withColumn("rank", F.lit(0))
    return ranked.unionByName(extra).select(scope, "question_id", "doc_id", "doc_type", "distance", "kind", "rank")
