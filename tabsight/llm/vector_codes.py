"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

The nearest entry is found by slicing and intersecting. Per part and dimension the entries' coordinates are sorted and carry prefix masks: bit e of
mask i says that entry e is among the i smallest. The distance to some entry gives an initial radius; no nearer entry lies outside that radius in any dimension, so
two binary searches per dimension give a range, the range's mask is the difference of two prefix masks, and the masks of all dimensions
ANDed leave the exact candidates, whose distances decide.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
SMALL = 1 << 24  # components below this have squared distances far below 2**63; beyond it Python integers are used
SPLIT = 32
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
ROWS = 4096  # rows worked on at once


class PartSearch:
    """The nearest of at most 64 entries of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(entries.T, order, axis=1)
        self.prefix = np.zeros((entries.shape[1], len(entries) + 1), dtype=np.uint64)
        np.bitwise_or.accumulate(BITS[order], axis=1, out=self.prefix[:, 1:])
        self.order = order

    def distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """Rounded-up distance to the nearest of a few entries: those next to ``x`` in each dimension."""
        best = None
        for d in range(x.shape[1]):
            at = np.minimum(np.searchsorted(self.sorted[d], x[:, d]), len(self.entries) - 1)
            found = self.distance(x, self.order[d, at])
            best = found if best is None else np.minimum(best, found)
        return np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64) + 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; ties go to the lower entry."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        r = self.radius(x)
        masks = np.full(len(x), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[d], x[:, d] - r, side="left")
            high = np.searchsorted(self.sorted[d], x[:, d] + r, side="right")
            masks &= self.prefix[d, high] & ~self.prefix[d, low]
        row, entry = np.nonzero(masks[:, None] & BITS[None, :len(self.entries)])
        found = self.distance(x[row], entry)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(found, starts)
        first = np.flatnonzero(found == least[row])  # candidates come in the order of entries
        first = first[np.searchsorted(row[first], np.arange(len(x)))]
        return entry[first], least


def nearest_large(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for components of any size, with Python integers; distances beyond a long are cut to it at the end."""
    entry, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=object)
    wide = entries.astype(object)
    for i, row in enumerate(x.astype(object)):
        found = ((wide - row) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(wide), dtype=object)
        entry[i] = int(np.argmin(found))
        best[i] = int(found[entry[i]])
    return entry, best


def parts_fit(cells: np.ndarray) -> bool:
    """Whether sums of squared distances of whole vectors with components below SMALL stay in a long."""
    return cells.shape[0] * cells.shape[2] <= 4096


class Codebooks:
    """``cells`` (part, entry, position within part)."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.small = not cells.size or max(int(cells.max()), -int(cells.min())) < SMALL and parts_fit(cells)
        self.search = [PartSearch(part) for part in cells] if self.small else None

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) nearest entries and squared distances summed over the parts."""
        parts, _, width = self.cells.shape
        codes, error = np.zeros((len(x), parts), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        small = np.abs(x).max(axis=1, initial=0) < SMALL if self.small else np.zeros(len(x), bool)
        small &= x.min(axis=1, initial=0) > -SMALL
        for rows, plain in ((np.flatnonzero(small), True), (np.flatnonzero(~small), False)):
            if not len(rows):
                continue
            total = np.zeros(len(rows), dtype=np.int64 if plain else object)
            for p in range(parts):
                own = x[rows, p * width:(p + 1) * width]
                codes[rows, p], found = self.search[p].nearest(own) if plain else nearest_large(own, self.cells[p])
                total = total + found
            error[rows] = total if plain else np.array([min(int(t), 2**63 - 1) for t in total], dtype=np.int64)
        return codes, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.cells.ravel().tolist())).encode()).hexdigest()


def integer_rows(column: pa.Array, width: int | None, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the vectors that take part, their floor(scale · x) filled up with zeros to ``width``, or to the longest)."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False)  # nulls become NaN
    good = np.isfinite(flat).astype(np.int64)
    sizes = np.diff(offsets)
    passed = np.concatenate(([0], np.cumsum(good)))
    whole = passed[offsets[1:]] - passed[offsets[:-1]] == sizes
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(valid & whole)
    width = int(sizes[keep].max(initial=0)) if width is None else width
    out = np.zeros((len(keep), width), dtype=np.int64)
    if not len(keep) or not width:
        return keep, out
    with np.errstate(over="ignore", invalid="ignore"):
        whole_numbers = np.floor(flat * scale)
        # casts beyond 64 bits are undefined: such components are cut to the range
        ints = np.where(whole_numbers >= 2.0 ** 63, 2**63 - 1, np.where(whole_numbers <= -2.0 ** 63, -2**63, 0)).astype(np.int64)
        inside = np.abs(whole_numbers) < 2.0 ** 63
        ints[inside] = whole_numbers[inside].astype(np.int64)
    if (sizes[keep] == width).all():
        return keep, ints[offsets[keep][:, None] + np.arange(width)]
    for i, k in enumerate(keep):
        out[i, :sizes[k]] = ints[offsets[k]:offsets[k + 1]]
    return keep, out


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def first_rows(vectors: DataFrame, n: int = ENTRIES) -> tuple[int, list[list[int]]]:
    """(longest kept vector, the ``n`` kept vectors with the smallest ids). Ids ascend, null comes last, vectors of one id by their components."""
    def smallest(batches):
        kept, longest = [], 0
        for batch in _slices(batches):
            ids = batch.column(0)
            keep, cells = integer_rows(batch.column(1), None)
            longest = max(longest, cells.shape[1])
            known = kept[-1][:2] if len(kept) == n else None
            for k, row in zip(keep, cells.tolist()):
                i = ids[int(k)].as_py()
                place = (i is None, i or 0)
                if known is None or place <= known:
                    size = len(batch.column(1)[int(k)])
                    kept.append((*place, row[:size]))
            kept = sorted(kept)[:n]
        yield pa.RecordBatch.from_arrays([pa.array([longest] * (len(kept) + 1), pa.int64()), pa.array([None if k[0] else k[1] for k in kept] + [None], pa.int64()),
                                          pa.array([k[2] for k in kept] + [None], pa.list_(pa.int64()))], ["longest", "_id", "cells"])

    found = written(vectors.select("_id", "_v").mapInArrow(smallest, "longest long, _id long, cells array<long>"), "codes-first")
    longest = found.agg(F.max("longest")).first()[0] or 0
    rows = found.where(F.col("cells").isNotNull()).orderBy(F.col("_id").asc_nulls_last(), "cells").limit(n).collect()
    return longest, [r["cells"] for r in rows]


def updated(vectors: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Every entry replaced by floor(sum / count) of the parts nearest to it. A task passes on one row per entry."""
    parts, entries, own = books.cells.shape
    wide = parts * own

    def sums(batches):
        count = np.zeros((parts, entries), dtype=np.int64)
        high, low = np.zeros((parts, entries, own), dtype=np.int64), np.zeros((parts, entries, own), dtype=np.int64)
        for batch in _slices(batches):
            _, x = integer_rows(batch.column(0), wide)
            codes, _ = books.codes(x)
            for p in range(parts):
                cells = x[:, p * own:(p + 1) * own]
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(high[p], codes[:, p], cells >> SPLIT)  # two halves, so that sums of any components stay whole
                np.add.at(low[p], codes[:, p], cells & ((1 << SPLIT) - 1))
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(high[part, entry]), pa.list_(pa.int64())),
                 pa.array(list(low[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "high", "low"])

    rows = vectors.select("_v").mapInArrow(sums, "part long, entry long, n long, high array<long>, low array<long>")
    total = lambda name, i: F.sum(F.col(name)[i].cast("decimal(38,0)")).alias(f"{name}{i}")
    table = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[total(x, i) for i in range(own) for x in ("high", "low")]).collect()  # parts × entries rows
    cells = books.cells.copy()
    for r in table:
        cells[r["part"], r["entry"]] = [((int(r[f"high{i}"]) << SPLIT) + int(r[f"low{i}"])) // r["n"] for i in range(own)]
    return Codebooks(cells)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vectors`` (_id, _v): they start with the vectors of the smallest ids and take ``rounds`` updates over all vectors."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries, the bits of a mask")
    longest, first = first_rows(vectors, entries)
    if not first:
        return None
    own = max(1, -(-longest // parts))
    start = np.zeros((len(first), parts * own), dtype=np.int64)
    for i, row in enumerate(first):
        start[i, :len(row)] = row
    books = Codebooks(start.reshape(len(first), parts, own).transpose(1, 0, 2))
    for _ in range(rounds):
        books = updated(vectors, books, longest)
    return books


def with_codes(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(_id, _label, code, error) of the vectors that take part."""
    parts, _, own = books.cells.shape
    hexadecimal = np.array([f"{i:02x}" for i in range(256)])

    def encode(batches):
        for batch in _slices(batches):
            keep, x = integer_rows(batch.column(2), parts * own)
            codes, error = books.codes(x)
            text = ["".join(row) for row in hexadecimal[codes]]
            taken = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["_id", "_label", "code", "error"])

    kind = vectors.schema["_label"].dataType.simpleString()
    return vectors.select("_id", "_label", "_v").mapInArrow(encode, f"_id long, _label {kind}, code string, error long")


HOT_SHARE = 100_000  # labels with more than this part of the rows are added by a broadcast of at most as many rows


def with_label_error(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``label_error``, the errors of a row's label together. Errors are summed inside tasks first; sums of labels with many rows are broadcast (their number is
    bounded by the share they must have), the rest meet their rows in a shuffle that therefore has no hot key."""
    label = F.coalesce(F.col("_label").cast("string"), F.lit("")).alias("_key")
    keyed = rows.withColumn("_null", F.col("_label").isNull()).withColumn("_key", label)
    sums = written(keyed.groupBy("_null", "_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n")).select(
        "_null", "_key", F.least("_sum", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"), (F.col("_n") * HOT_SHARE > n).alias("_hot")), "codes-labels")
    hot, cold = (sums.where(F.col("_hot") == h).drop("_hot") for h in (True, False))
    met = keyed.join(F.broadcast(hot), ["_null", "_key"], "left")
    if cold.isEmpty():
        return met
    met = met.withColumnRenamed("label_error", "_found")
    return met.where("_found is not null").withColumnRenamed("_found", "label_error").unionByName(met.where("_found is null").drop("_found").join(cold, ["_null", "_key"]))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector that takes part: its id, code (two hex digits per part), error, label_error and codebooks_sha256.

    Vectors that are null or hold a null or non-finite component take no part. Components are floor(256 · x), cut to 64 bits; vectors are filled up with zeros
    to a multiple of ``parts`` that holds the longest, so an empty vector is one of zeros. Ids are integers; a null id takes part and comes last when the first entries
    are chosen; rows of one id count each, in the order of their components. With fewer vectors than ``entries`` the codebooks are smaller. Null labels are
    one label. Errors beyond a long are cut to it. An empty table gives no rows. Other columns are not read.
    """
    vectors = table.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_v"))
    books = trained(vectors, parts, entries, rounds)
    if books is None:
        kind = vectors.schema["_label"].dataType.simpleString()
        rows = vectors.limit(0).select("_id", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return rows.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit("").alias("codebooks_sha256"))
    coded = written(with_codes(vectors, books), "codes-rows")
    rows = with_label_error(coded, coded.count())
    return rows.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The registered query in DuckDB SQL, for vectors of one length."""
    steps = [f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({int(SCALE)} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, e[part * len(e) // {parts} + 1:(part + 1) * len(e) // {parts}] AS c FROM v, (SELECT unnest(range({parts})) AS part)),
b0 AS (SELECT part, r - 1 AS entry, c FROM p WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, part, c, unnest(n) FROM (SELECT p.r, p.part, any_value(p.c) AS c, arg_min({{'entry': entry, 'd': d}}, d * 64 + entry) AS n
  FROM (SELECT p.r, p.part, p.c, b.entry, CAST(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN b{i} b ON p.part = b.part) p GROUP BY p.r, p.part))""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, list(f ORDER BY k) AS c FROM (SELECT part, entry, k, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS f
  FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS k FROM a{i}) GROUP BY part, entry, k) GROUP BY part, entry),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), books"""
