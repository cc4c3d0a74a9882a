"""Benchmark decontamination by spaced seeds.

Each mask keeps some word places of a short window and ignores the others, so a window with replaced words still agrees on one of the masks. Hashes of
test and training windows are joined; around each hit the texts are laid over one another and compared word by word.
The four masks below find every stretch of 13 words with up to two replaced ones; the two halves of a shorter test text find it with up to one.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from .common import fresh
from .text_arrays import TOKENS, mix, small_batches, windows, word_hashes

MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 4, 6, 7, 8, 9), (0, 1, 2, 3, 4, 5, 8), (0, 1, 3, 4, 5, 6, 7))
STRETCH, REPLACED, LEAST_WORDS = 13, 2, 8
BITS_PER_SEED, LEAST_BITS, MOST_BITS, PROBES = 64, 16, 27, 3


def masks_for(n: int) -> list[tuple[int, ...]]:
    """The masks of a test text of n words; for one shorter than a stretch its halves."""
    return list(MASKS) if n >= STRETCH else [tuple(range(n // 2)), tuple(range(n // 2, n))]


def allowed(n: int) -> int:
    """Replaced words in a stretch of a test text of n words."""
    return REPLACED if n >= STRETCH else 1


def _seeds(words: np.ndarray, n: int):
    """(place, words the window needs, hash) of all windows of each mask; the hash also holds the mask."""
    for mask in masks_for(n):
        span = mask[-1] + 1 if n >= STRETCH else n
        h = windows(words, mask)[:max(0, len(words) - span + 1)]
        yield np.arange(len(h)), span, mix(h ^ np.uint64(hash_of(mask, min(n, STRETCH))))


def hash_of(mask: tuple[int, ...], n: int) -> int:
    return int(mix(np.array([n << 32 | sum(1 << p for p in mask)], dtype=np.uint64))[0])


def _bit_places(h: np.ndarray, bits: int):
    """The places of a hash in a table of 2**bits bits."""
    for k in range(PROBES):
        yield mix(h + np.uint64(k)) >> np.uint64(64 - bits)


def test_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, words): the test texts as word hashes; those under LEAST_WORDS words say too little and are left out, as are null ids."""
    def items(batches):
        for batch in batches:
            hashes, counts = word_hashes(batch.column(1), TOKENS)
            parts = np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                             ["item_id", "n", "words"])

    source = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("_i"), F.col(text_col).alias("_t"))
    return source.mapInArrow(items, "item_id long, n int, words binary").where(F.col("n") >= LEAST_WORDS).dropDuplicates(["item_id", "words"])


def seed_table(items: DataFrame) -> DataFrame:
    """(hash, item_id, place): one row per window and mask of the test texts."""
    def seeds(batches):
        for batch in batches:
            for item, n, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for place, _, h in _seeds(np.frombuffer(words, np.uint64), n):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([item] * len(h), pa.int64()), pa.array(place, pa.int32())],
                                                     ["hash", "item_id", "place"])

    return items.mapInArrow(seeds, "hash long, item_id long, place int")


def bit_table(seeds: DataFrame, n_seeds: int) -> np.ndarray:
    """Bits set at the places of all seed hashes. Its size follows their number up to 16 MB, whatever the benchmark's size; it only saves rows, a hash
    that passes by chance finds no partner in the join."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n_seeds) * BITS_PER_SEED))))

    def places(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([p for p in _bit_places(h, bits)])) if len(h) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int64))], ["word", "bit"])

    rows = seeds.select("hash").mapInArrow(places, "word long, bit long").groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits set."""
    bits = int(math.log2(len(table))) + 6
    left = np.arange(len(h))
    for k in range(PROBES):
        at = mix(h[left] + np.uint64(k)) >> np.uint64(64 - bits)
        left = left[(table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        if not len(left):
            break
    return left


def _segments(hits: np.ndarray, reach: int, n: int):
    """Stretches of words that hold everything within ``reach`` of a hit: (start, end, first hit, last hit + 1)."""
    cut = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(hits)]))):
        yield max(0, int(hits[a]) - reach), min(n, int(hits[b - 1]) + reach), int(a), int(b)


SEGMENT = "_id long, _h long, start int, total int, words binary, places binary, hashes binary"
CHECKED = "_id long, _h long, item_id long, shift int, first_word int, matched int, n int"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """One row per document and test text that overlap: doc_id, item_id, first_word (of the document, from 0, where the first accepted overlap starts), matched (equal words
    of the best overlay), share (of the test text's words) and n_places (overlays accepted).

    Words are runs of ASCII letters and digits and of what lies beyond ASCII, A-Z as a-z. An overlay of a document and a test text of n words counts if
    somewhere 13 words of the test text in a row stand over the document's with at most two different ones, or all words of a shorter test text with at most one. Test texts
    under 8 words are ignored. Null and empty texts
    overlap with nothing. Rows with equal ids count as one document. Ids are integers; null ids are kept as null. Empty tables give no rows. Other columns are
    not read; texts are whole.
    """
    each = _overlays(docs, benchmark, id_col, text_col, item_col, item_text_col).dropDuplicates(["_id", "item_id", "shift", "first_word"])
    return each.groupBy("_id", "item_id").agg(F.min("first_word").cast("long").alias("first_word"), F.max("matched").cast("long").alias("matched"),
                                              F.max(F.col("matched") / F.col("n")).alias("share"), F.count_distinct("shift").alias("n_places")).select(
        F.col("_id").alias(id_col), F.col("item_id").alias(item_col), "first_word", "matched", "share", "n_places")


def _overlays(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text") -> DataFrame:
    """The accepted overlays, with the id and the hash of the text (_h) of the row they are in."""
    spark = docs.sparkSession
    items = written(test_items(benchmark, item_col, item_text_col), "decon-items")
    seeds = written(seed_table(items), "decon-seeds")
    table = bit_table(seeds, seeds.count())
    sizes = items.agg(F.max("n"), F.collect_set(F.when(F.col("n") < STRETCH, F.col("n")))).first()
    reach, lengths = sizes[0] or 1, sorted(sizes[1]) + [STRETCH]  # at most six lengths
    shared = spark.sparkContext.broadcast(table)  # 16 MB at most

    def look_up(batches):
        bits = shared.value
        for batch in small_batches(batches, 1):
            words, counts = word_hashes(batch.column(1), TOKENS)
            text_hashes = batch.column(2).to_pylist()
            ends = np.cumsum(counts)
            left = np.repeat(ends, counts) - np.arange(len(words))  # words from here to the end of the text
            found, keys = [], []
            for n in lengths:
                for place, span, h in _seeds(words, n):
                    at = _passes(bits, h)
                    at = at[left[at] >= span]
                    found.append(place[at])
                    keys.append(h[at])
            found, keys = np.concatenate(found), np.concatenate(keys)
            order = np.lexsort((keys, found))
            found, keys = found[order], keys[order]
            doc = np.searchsorted(ends, found, side="right")
            ids, rows = batch.column(0).to_pylist(), []
            for d in np.unique(doc):
                a, b = np.searchsorted(doc, [d, d + 1])
                begin = int(ends[d] - counts[d])
                hits = found[a:b] - begin
                for start, end, i, j in _segments(hits, reach, int(counts[d])):
                    rows.append((ids[d], text_hashes[d], start, int(counts[d]), words[begin + start:begin + end].tobytes(),
                                 hits[i:j].astype(np.int32).tobytes(), keys[a + i:a + j].tobytes()))
            if rows:
                yield _rows(rows, SEGMENT)

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_h"))
    near = source.mapInArrow(look_up, SEGMENT).withColumn("_key", F.struct("_id", "_h", "start", F.xxhash64("words", "places")))
    near = written(near, "decon-segments")

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                places, keys = np.frombuffer(row["places"], np.int32), np.frombuffer(row["hashes"], np.int64)
                for at in range(0, len(keys), 10_000):
                    n = len(keys[at:at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array([row["_k"]] * n, batch.schema.field("_k").type), pa.array(places[at:at + n]), pa.array(keys[at:at + n])],
                                                     ["_k", "at", "hash"])

    key_type = near.schema["_key"].dataType.simpleString()
    hits = near.select(F.col("_key").alias("_k"), "places", "hashes").mapInArrow(unpack, f"_k {key_type}, at int, hash long")
    overlays = hits.join(seeds, "hash").select("_k", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    grouped = overlays.groupBy("_k", "item_id").agg(F.collect_set("shift").alias("shifts"))  # at most one for each word of the segment and the item
    pairs = grouped.join(near.dropDuplicates(["_key"]).select("_key", "_id", "_h", "start", "total", "words"), F.col("_k") == F.col("_key")).join(
        items.withColumnRenamed("words", "item_words"), "item_id").select("_id", "_h", "item_id", "start", "total", "words", "item_words", "shifts")
    return pairs.mapInArrow(_verify, CHECKED)


def accepted(doc: np.ndarray, start: int, total: int, item: np.ndarray, shift: int) -> tuple[int, int] | None:
    """(first word, equal words) of the overlay that puts the item's first word on the document's word ``shift``; None if it isn't close enough.
    ``doc`` holds the words from ``start`` on of a document of ``total`` words, at least those under the item."""
    n = len(item)
    low, high = max(0, -shift), min(n, total - shift)
    length = min(n, STRETCH)
    if high - low < length:
        return None
    equal = doc[low + shift - start:high + shift - start] == item[low:high]
    sums = np.convolve(equal, np.ones(length, dtype=np.int64), mode="valid")
    good = np.flatnonzero(sums >= length - allowed(n))
    return (shift + low + int(good[0]), int(equal.sum())) if len(good) else None


def _verify(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            doc, item = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
            for shift in r["shifts"]:
                found = accepted(doc, r["start"], r["total"], item, shift)
                if found:
                    rows.append((r["_id"], r["_h"], r["item_id"], shift, *found, len(item)))
        if rows:
            yield _rows(rows, CHECKED)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [f for f, _ in fields])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The documents that overlap with no test text, with all their columns. Documents with a null id are judged together, like rows with equal ids."""
    name = fresh("bad", docs)
    bad = contaminated(docs, benchmark, id_col, text_col, **columns).select(F.col(id_col).alias(name)).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows whose own text overlaps with no test text, with all their columns. Rows are judged by id and hash of the text, so other texts of
    the same id, or of a null one, stay."""
    name, text = fresh("bad", docs), fresh("bad_text", docs)
    bad = _overlays(docs, benchmark, id_col, text_col, **columns).select(F.col("_id").alias(name), F.col("_h").alias(text)).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (F.xxhash64(f"`{text_col}`") == F.col(text)), "left_anti")


def oracle_sql() -> str:
    """The same result as DuckDB SQL over ``documents`` and ``benchmark``."""
    gap = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    words = f"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{gap}', ' ', 'g'), ' '), lambda x: x <> '')"
    key = lambda t: " UNION ALL ".join(
        f"SELECT id, p, {k} AS m, [" + ", ".join(f"w[p + {x + 1}]" for x in mask) + f"] AS k FROM {t}, range(len(w) - {mask[-1]}) r(p)" for k, mask in enumerate(MASKS))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, {words} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id AS id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT * FROM i WHERE len(w) >= {STRETCH}), dl AS (SELECT * FROM d),
ik AS ({key('il')}), dk AS ({key('dl')}),
sh AS (SELECT *, len(w) AS n FROM i WHERE len(w) >= {LEAST_WORDS} AND len(w) < {STRETCH}), ns AS (SELECT DISTINCT n FROM sh),
sk AS (SELECT id, n, 0 AS m, w[1 : n // 2] AS k FROM sh UNION ALL SELECT id, n, 1, w[n // 2 + 1 : n] FROM sh),
dp AS (SELECT d.id, ns.n, p, d.w FROM d, ns, range(len(d.w) - ns.n + 1) r(p)),
ds AS (SELECT id, n, p, 0 AS m, w[p + 1 : p + n // 2] AS k FROM dp UNION ALL SELECT id, n, p, 1, w[p + n // 2 + 1 : p + n] FROM dp),
hits AS (SELECT DISTINCT dk.id AS d, ik.id AS i, dk.p - ik.p AS s FROM dk JOIN ik USING (m, k)
  UNION SELECT ds.id, sk.id, ds.p FROM ds JOIN sk USING (n, m, k)),
lay AS (SELECT h.d, h.i, h.s, len(i.w) AS n, greatest(0, -h.s) AS lo, least(len(i.w), len(d.w) - h.s) AS hi, d.w AS dw, i.w AS iw
  FROM hits h JOIN d ON h.d IS NOT DISTINCT FROM d.id JOIN i ON h.i = i.id),
eq AS (SELECT *, least(n, {STRETCH}) AS len, list_transform(range(lo, hi), lambda j: CASE WHEN dw[j + s + 1] = iw[j + 1] THEN 1 ELSE 0 END) AS e FROM lay WHERE hi - lo >= least(n, {STRETCH})),
good AS (SELECT *, list_filter(range(0, hi - lo - len + 1), lambda a: list_sum(e[a + 1 : a + len]) >= len - CASE WHEN n >= {STRETCH} THEN {REPLACED} ELSE 1 END) AS g FROM eq)
SELECT d AS doc_id, i AS item_id, min(s + lo + g[1]) AS first_word, max(CAST(list_sum(e) AS BIGINT)) AS matched, max(list_sum(e) / n) AS share, count(DISTINCT s) AS n_places
FROM good WHERE len(g) > 0 GROUP BY d, i"""
