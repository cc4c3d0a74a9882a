"""Importance resampling towards a target distribution: hashed n-gram weights, and exact ranks by parallel sorting by regular sampling.

Bucket counts of the corpus and of the target texts give one gain per bucket; an array of gains scores whole texts. For the ranks every task sorts its
run of scored rows and passes on every m-th of them; regular splitters among those cut the runs into segments. Segments that can hold a
drawn row are exchanged and merged locally, and the number of rows in the segments before gives each row its exact rank.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import written
from .text_arrays import small_batches

BUCKETS, NGRAM, SEED = 10_000, 1, 2024
SHARE, LEAST_WORDS = 0.1, 20
SAMPLES = 100_000  # rows the runs pass on for the splitters: every m-th with m = rows / SAMPLES; they steer only how even the segments are
SEGMENT_ROWS, MOST_SEGMENTS = 2_000_000, 20_000

# What a byte counts as: A-Z as a-z, ASCII other than letters and digits as a space, the rest as itself.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PART_BYTES = 1 << 20
KEPT_WORDS = 500_000


class Buckets(dict):
    """Bucket of a feature; forgotten when there are too many, so its memory is bounded."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        bucket = zlib.crc32(feature) % self.n
        if len(feature) <= 64:
            self[feature] = bucket
        return bucket


def feature_buckets(text: bytes, known: Buckets, longest: int = NGRAM):
    """Arrays of the buckets of all runs of 1 to ``longest`` words of a text, repeats counted. A very long text comes in parts."""
    plain, at, before = text.translate(_FOLD), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + PART_BYTES)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        at = end
        if not words:
            continue
        yield np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        if longest > 1:
            joined = before + words
            for n in range(2, longest + 1):  # runs that end in this part
                grams = [b" ".join(joined[max(0, i - n + 1):i + 1]) for i in range(len(before), len(joined)) if i >= n - 1]
                yield np.fromiter(map(known.__getitem__, grams), dtype=np.int64, count=len(grams))
            before = joined[-(longest - 1):]


def _texts(column: pa.Array):
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = NGRAM) -> np.ndarray:
    """Features of all whole texts in each bucket. A task passes on at most one row per bucket, so that many rows at most come back."""
    def count(batches):
        counts, known = np.zeros(buckets, dtype=np.int64), Buckets(buckets)
        for batch in small_batches(batches, 0):
            for text in _texts(batch.column(0)):
                for found in feature_buckets(text, known, longest):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).mapInArrow(count, "bucket long, n long")
    table = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 · ln) of the ratio of a bucket's smoothed shares in the target and the corpus."""
    buckets = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = NGRAM) -> DataFrame:
    """(_id, n_features, weight) of every row: how many features its whole text has, and the sum of their gains."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    buckets = len(gain)

    def weigh(batches):
        known = Buckets(buckets)
        for batch in small_batches(batches, 1):
            n, weight = [], []
            for text in _texts(batch.column(1)):
                found = [(len(b), int(gain[b].sum())) for b in feature_buckets(text, known, longest)]
                n.append(sum(f[0] for f in found))
                weight.append(sum(f[1] for f in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["_id", "n_features", "weight"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(weigh, f"_id {kind}, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 · a Gumbel number) that depends on seed and id alone; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


KEY = ["_minus", "_rest", "_id", "weight", "n_features"]  # the order of ranks: high scores, then small ids, null last; what ties in all is equal


def _key_arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(KEY))]


def splitters(runs: DataFrame, rows: int, segments: int, samples: int = SAMPLES) -> list[tuple]:
    """``segments`` - 1 keys at regular places among every m-th row of each sorted run; about ``samples`` rows come to the driver."""
    step = max(1, rows // samples)

    def sample(batches):
        at = step // 2  # places of a run that are still to come
        for batch in batches:
            take = np.arange(at, batch.num_rows, step)
            at = (at if not len(take) else int(take[-1]) + step) - batch.num_rows
            if len(take):
                yield batch.take(pa.array(take))

    found = runs.mapInArrow(sample, runs.select(*KEY).schema).toArrow()
    if not found.num_rows:
        return []
    order = found.sort_by([(k, "ascending") for k in KEY]).to_pylist()
    at = [len(order) * i // segments for i in range(1, segments)]
    return [tuple(order[i][k] for k in KEY) for i in at]


def ranked(scored: DataFrame, drawn: int, rows: int, segment_rows: int = SEGMENT_ROWS, samples: int = SAMPLES) -> DataFrame:
    """Adds ``rank`` to a written table with the columns KEY: 1, 2, 3… for the ``drawn`` first rows in the order of KEY, else null. Rows may be equal.

    Nothing but the samples and one number per segment comes to the driver; only segments that hold a drawn row are exchanged. A key held by many
    rows lies on several splitters, and its rows are dealt over all segments between them.
    """
    kind = scored.select(*KEY).schema
    runs = scored.select(*KEY).sortWithinPartitions(*KEY)
    cuts = splitters(runs, rows, min(MOST_SEGMENTS, max(1, -(-rows // segment_rows))), samples)
    cut_columns = [np.array([c[i] for c in cuts], dtype=np.int64) for i in range(len(KEY))]

    def segment(batches):
        """Each row's segment, by binary search among the splitters; a row equal to splitters may go to either side of each."""
        turn = 0
        for batch in batches:
            columns = _key_arrays(batch)
            low, high = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            if cuts:
                both = [np.concatenate((c, k)) for c, k in zip(columns, cut_columns)]
                order = np.lexsort(both[::-1])
                is_cut = order >= batch.num_rows
                passed = np.cumsum(is_cut)
                changed = np.zeros(len(order), dtype=bool)
                changed[0] = True
                for b in both:
                    v = b[order]
                    changed[1:] |= v[1:] != v[:-1]
                group = np.cumsum(changed) - 1
                first = np.flatnonzero(changed)
                before = (passed - is_cut)[first]  # splitters below the group, and up to its end
                upto = passed[np.append(first[1:], len(order)) - 1]
                mine = order[~is_cut]
                low[mine], high[mine] = before[group[~is_cut]], upto[group[~is_cut]]
            spot = low + (np.arange(batch.num_rows) + turn) % (high - low + 1)
            turn += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spot)], [*KEY, "_segment"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    dealt = written(runs.mapInArrow(segment, f"{fields}, _segment long"), "resample-runs")
    sizes = np.zeros(len(cuts) + 1, dtype=np.int64)
    for r in dealt.groupBy("_segment").agg(F.count("*").alias("n")).collect():  # one row per segment
        sizes[r["_segment"]] = r["n"]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    last = int(np.searchsorted(offsets[:-1], drawn, side="left"))  # segments from here on begin behind the last drawn row
    exchanged = dealt.where(F.col("_segment") < last)

    def number(batches):
        """Exact ranks of merged segments, which come one after the other."""
        held, at = -1, 0
        for batch in batches:
            segments = batch.column(len(KEY)).to_numpy()
            starts = np.flatnonzero(np.diff(segments, prepend=held))
            place = np.arange(batch.num_rows) + at
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                place[a:b] = np.arange(b - a)
            if batch.num_rows:
                held, at = int(segments[-1]), int(place[-1]) + 1
            rank = offsets[segments] + place + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(KEY)], pa.array(rank, pa.int64(), mask=rank > drawn)], [*KEY, "rank"])

    merged = exchanged.repartition(max(1, min(last, MOST_SEGMENTS)), "_segment").sortWithinPartitions("_segment", *KEY)
    first = merged.mapInArrow(number, f"{fields}, rank long")
    return first.unionByName(dealt.where(F.col("_segment") >= last).select(*KEY, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = round(100 * SHARE), least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", buckets: int = BUCKETS, longest: int = NGRAM, seed: int = SEED, segment_rows: int = SEGMENT_ROWS,
             samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: its id, n_features, weight, score and rank, all long; rank is null for rows that aren't drawn.

    Of the N rows with at least ``least_words`` features, floor(N · percent / 100) with the highest scores are drawn, ties to the smaller id. Null and empty
    texts have no features, weight 0 and are never drawn; a null id is an id like any other, comes last in ties and has the number of an empty id. Rows of
    one id and equal scores come in the order of weight and n_features; equal rows get ranks one after the other. Whole texts count, however long.
    Ids must be integers. An empty table gives no rows, empty target texts give every bucket of the target the same share. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    scored = weighed(docs.withColumn(id_col, F.col(id_col).cast("long")), gain, id_col, text_col, longest).withColumn("_score", F.col("weight") + gumbel(F.col("_id"), seed))
    # numbers without nulls, so that Spark, Arrow and numpy order them alike
    rows = written(scored.select((-F.col("_score")).alias("_minus"), F.col("_id").isNull().cast("long").alias("_rest"), F.coalesce("_id", F.lit(0)).alias("_id"),
                                 "weight", "n_features"), "resample-scored")
    chosen = rows.where(F.col("n_features") >= least_words)
    n = chosen.count()
    out = rows.where(F.col("n_features") < least_words).withColumn("rank", F.lit(None).cast("long"))
    if n:
        out = ranked(chosen, n * percent // 100, n, segment_rows, samples).unionByName(out)
    return out.select(F.when(F.col("_rest") == 0, F.col("_id")).alias(id_col), "n_features", "weight", (-F.col("_minus")).alias("score"), "rank")


def oracle_sql() -> str:
    """The registered query in DuckDB SQL; the checksum is computed from its definition, for each distinct word once."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
  FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
b AS (SELECT unnest({words}) AS w FROM benchmark),
dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w),
vocab AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
    lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, x: xor(t[CAST(xor(c % 256, x) + 1 AS INTEGER)], c // 256))) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)), crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN vocab USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN vocab USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM dw) + {BUCKETS})
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM b) + {BUCKETS})))) AS BIGINT) AS g FROM s FULL JOIN t USING (bucket)),
pairs AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
weights AS (SELECT r, sum(n * g) AS weight FROM pairs JOIN vocab USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank FROM scored WHERE n_features >= {LEAST_WORDS}),
cut AS (SELECT r, rank FROM drawn WHERE rank <= (SELECT count(*) * {round(100 * SHARE)} // 100 FROM drawn))
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN cut USING (r)"""
