"""Exact top-k inner products by aggregation without random access.

Vectors lie in blocks, whose every component has a sorted list. A query reads the lists from their better end, some entries at a time, and all queries of a
block read to the same depth. What it has read of a vector bounds its score from below (unread components at their list's worst) and above (at the list's next value). Vectors whose
upper bound is under the k-th lower bound leave; when about k are left, or the lists are read to their end, no outsider can qualify and the scores of the rest are made whole.
Blocks of queries meet blocks of vectors, so that each task holds one of either, and each task passes on k rows of a query.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written

BLOCK_VECTORS, BLOCK_QUERIES = 4096, 512
FIRST_READ, DEEPER = 64, 8  # entries of each list that are read first; how many times as many next
MOST_PARTITIONS = 20_000
BLOCK = "ids binary, cells binary, n int, d int"
NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class SortedLists:
    """A block's lists: for each component its values in ascending order. Reading a list down to an entry gives the vectors at or beyond that value."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells = ids, cells
        self.plain = cells.astype(np.float64)
        self.values = np.sort(cells.T, axis=1).astype(np.float64)

    def top(self, query_id: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) that hold the block's k best that reach ``floor``; a few more may be among them."""
        return self.tops(np.array([query_id]), query[None, :], k, np.array([floor]))[0]

    def tops(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``top`` of each query. All queries read to the same depth, so their bounds are products of matrices."""
        n, weight = len(self.ids), queries.astype(np.float64)
        up, down = np.maximum(weight, 0.0), np.minimum(weight, 0.0)  # lists read from their upper, from their lower end
        least, most = self.values[:, 0], self.values[:, -1]
        slack = 2.0 ** -40 * (np.abs(weight) @ np.maximum(np.abs(least), np.abs(most)))
        live = self.ids[None, :] != query_ids[:, None]
        reading, at = np.flatnonzero(live.sum(axis=1) > 2 * k), FIRST_READ
        while at < n and len(reading):
            high, low = self.values[:, n - at], self.values[:, at - 1]  # the last values read bound the next
            lower = up[reading] @ np.where(self.plain >= high, self.plain, least).T + down[reading] @ np.where(self.plain <= low, self.plain, most).T
            upper = up[reading] @ np.maximum(self.plain, high).T + down[reading] @ np.minimum(self.plain, low).T
            lower[~live[reading]] = -np.inf
            bar = np.maximum(floors[reading], np.partition(lower, n - k, axis=1)[:, n - k]) - slack[reading]
            live[reading] &= upper + slack[reading, None] >= bar[:, None]
            reading = reading[live[reading].sum(axis=1) > 2 * k]
            at *= DEEPER
        whole = {}
        if len(reading) and float(np.abs(self.plain).max()) * float(np.abs(weight).sum(axis=1).max()) < 2.0 ** 53:  # then sums of doubles are exact
            whole = dict(zip(reading.tolist(), (weight[reading] @ self.plain.T).astype(np.int64)))
        out = []
        for i, query in enumerate(queries):
            left = np.flatnonzero(live[i])
            scores = whole[i][left] if i in whole else self.exact(left, query)
            if len(left) > 2 * k:
                keep = scores >= np.partition(scores, len(left) - k)[len(left) - k]
                left, scores = left[keep], scores[keep]
            out.append((self.ids[left], scores))
        return out

    def exact(self, live: np.ndarray, query: np.ndarray) -> np.ndarray:
        cells = self.cells[live]
        if len(live) and float(np.abs(cells.astype(np.float64)).max()) * float(np.abs(query.astype(np.float64)).sum()) >= 2.0 ** 62:
            sums = cells.astype(object) @ query.astype(object)
            return np.array([max(-2**63, min(2**63 - 1, int(s))) for s in sums], dtype=np.int64)
        return cells @ query


def _blocks(rows_each: int):
    def pack(batches):
        ids, vectors = [], []
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows_each:
                    yield _packed(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield _packed(ids, vectors)
    return pack


def _packed(ids: list, vectors: list) -> pa.RecordBatch:
    d = max(map(len, vectors))
    cells = np.zeros((len(ids), d), dtype=np.int64)
    for i, v in enumerate(vectors):
        cells[i, :len(v)] = v
    return pa.RecordBatch.from_arrays(
        [pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()),
         pa.array([len(ids)], pa.int32()), pa.array([d], pa.int32())], ["ids", "cells", "n", "d"])


def _cells(data: bytes, n: int, d: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), dtype=np.int64)
    out[:, :d] = np.frombuffer(data, dtype=np.int64).reshape(n, d)
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, ~scores))[:k]  # ~s orders as -s does and has no overflow
    return ids[keep], scores[keep]


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(_id, _v): floor(scale * x) of every component. Vectors that are null or hold a null or non-finite component, and null ids, take no part;
    rows equal in id and vector are one."""
    finite = F.forall("_x", lambda c: F.coalesce(c.cast("double") * 0.0 == 0.0, F.lit(False)))  # infinity and NaN times 0 are NaN
    rows = table.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_x"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_x").isNotNull() & finite)
    return rows.select("_id", F.transform("_x", lambda c: F.floor(c.cast("double") * scale)).alias("_v"))


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k rows with the highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    ``is_query`` chooses the queries by the id column ``_id``. Ties go to the smaller id; rows with a query's own id are no candidates for it; a query with
    fewer candidates gets all. Shorter vectors count as filled up with zeros. Scores beyond 64 bits are cut to the range. Two queries with
    one id and different vectors get a ranking each. An empty table or no query gives no rows. Other columns are not read.
    """
    vectors = integer_vectors(table, id_col, vector_col, scale)
    n = vectors.count()
    parts = min(MOST_PARTITIONS, max(1, -(-n // BLOCK_VECTORS)))
    vectors = written(vectors.repartition(parts, "_id").dropDuplicates(["_id", "_v"]), "topk-vectors")
    data = written(vectors.repartition(parts, "_id").mapInArrow(_blocks(BLOCK_VECTORS), BLOCK), "topk-blocks")
    chosen = vectors.where(is_query)
    query_parts = min(MOST_PARTITIONS, max(1, -(-chosen.count() // BLOCK_QUERIES)))
    asked = written(chosen.repartition(query_parts, "_id").mapInArrow(_blocks(BLOCK_QUERIES), BLOCK), "topk-queries")
    pairs = data.repartition(parts, "ids").crossJoin(asked.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "cells", "n", "d")]))

    def search(batches):
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        held, lists = None, None
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["d"], row["q_d"])
                if held != (row["ids"], width):
                    held = (row["ids"], width)
                    lists = SortedLists(np.frombuffer(row["ids"], dtype=np.int64), _cells(row["cells"], row["n"], row["d"], width))
                cells = _cells(row["q_cells"], row["q_n"], row["q_d"], width)
                query_ids = np.frombuffer(row["q_ids"], dtype=np.int64)
                keys = [(i, np.trim_zeros(query, "b").tobytes()) for i, query in zip(query_ids.tolist(), cells)]
                had = [best.get(key, NOTHING) for key in keys]
                floors = np.array([float(scores[-1]) if len(scores) == k else -np.inf for _, scores in had])
                for key, (ids, scores), more in zip(keys, had, lists.tops(query_ids, cells, k, floors)):
                    best[key] = _best(np.concatenate((ids, more[0])), np.concatenate((scores, more[1])), k)
                if len(best) > 64 * BLOCK_QUERIES:  # rows of queries done so far go on; the last ranking sorts them out
                    yield from _answers(best)
                    best = {}
        yield from _answers(best)

    found = pairs.mapInArrow(search, "query_id long, _q binary, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "_q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(best: dict):
    for (query_id, key), (ids, scores) in best.items():
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(ids), pa.int64()), pa.array([key] * len(ids), pa.binary()),
                                              pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "_q", "vec_id", "score"])
