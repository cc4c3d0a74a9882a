"""Average ranks of many columns by one sort over the cells, without a join on values."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .lineage import written

CELLS_EACH, MOST_PARTS = 200_000, 200_000


def twice_ranks(rows: DataFrame, width: int, n: int, cells_each: int = CELLS_EACH) -> DataFrame:
    """(row, i, rank2) of every cell: twice its average rank in column i, from 2.

    ``rows`` is a written table (row, x0, x1, …) of ``n`` rows without nulls. Cells are dealt into ranges of (i, value, row), so one value of most rows is
    split over many tasks, and a task holds about ``cells_each`` cells. Within a task ties are runs; a run that goes on in the next task is put together from
    one line per task and column, the only thing the driver sees.
    """
    cells = rows.select("row", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(width)])).alias("i", "v"))
    parts = min(MOST_PARTS, max(1, -(-n * width // cells_each)))
    dealt = cells.repartitionByRange(parts, "i", "v", "row").sortWithinPartitions("i", "v", "row")

    def runs(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        row, i, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        v = v + 0.0
        new_column = np.flatnonzero(np.diff(i, prepend=-1))
        new_run = np.flatnonzero((np.diff(i, prepend=-1) != 0) | np.concatenate(([True], v[1:] != v[:-1])))
        size = np.diff(np.append(new_run, len(v)))
        start = np.arange(len(v)) - np.repeat(new_column, np.diff(np.append(new_column, len(v))))  # place within the column, in this task
        first, last = start[new_run] + 1, start[new_run] + size
        column_end = np.append(new_column[1:], len(v))
        edge = np.zeros(len(new_run), dtype=np.int8)
        edge[np.isin(new_run, new_column)] |= 1  # a run at the begin or the end of a column's stretch may go on in another task
        edge[np.isin(new_run + size, column_end)] |= 2
        key = TaskContext.get().partitionId()
        spread = np.repeat(np.arange(len(new_run)), size)
        for a in range(0, len(v), 100_000):
            s = spread[a:a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), key), pa.int32()), pa.array(row[a:a + 100_000]), pa.array(i[a:a + 100_000], pa.int32()), pa.array(v[a:a + 100_000]),
                 pa.array(first[s] + last[s], pa.int64()), pa.array(edge[s], pa.int8())], ["task", "row", "i", "v", "ends", "edge"])

    ranked = written(dealt.mapInArrow(runs, "task int, row long, i int, v double, ends long, edge byte"), "ranks")
    at_begin, at_end = (F.col("edge").bitwiseAND(b) != 0 for b in (1, 2))
    lines = ranked.groupBy("i", "task").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.count_if(at_begin).alias("n_low"), F.count_if(at_end).alias("n_high")).collect()  # a line per task and column
    shift, low_ends, high_ends = {}, {}, {}
    by_column: dict[int, list] = {}
    for r in lines:
        by_column.setdefault(r["i"], []).append(r)
    for i, own in by_column.items():
        own.sort(key=lambda r: r["task"])  # ranges ascend with the tasks
        offset, ends = 0, {}
        for r in own:
            shift[i, r["task"]] = offset
            for v, a, b in ((r["low"], offset + 1, offset + r["n_low"]), (r["high"], offset + r["n"] - r["n_high"] + 1, offset + r["n"])):
                seen = ends.get(v)
                ends[v] = (min(seen[0], a), max(seen[1], b)) if seen else (a, b)
            offset += r["n"]
        for r in own:
            low_ends[i, r["task"]], high_ends[i, r["task"]] = sum(ends[r["low"]]), sum(ends[r["high"]])
    table = rows.sparkSession.createDataFrame([(i, t, s, low_ends[i, t], high_ends[i, t]) for (i, t), s in shift.items()] or [(0, 0, 0, 0, 0)],
                                              "i int, task int, shift long, low_ends long, high_ends long")
    met = ranked.join(F.broadcast(table), ["i", "task"])  # as many lines as tasks and columns together
    rank2 = F.when(at_begin, F.col("low_ends")).when(at_end, F.col("high_ends")).otherwise(F.col("ends") + 2 * F.col("shift"))
    return met.select("row", "i", rank2.alias("rank2"))
