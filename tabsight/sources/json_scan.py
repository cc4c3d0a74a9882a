"""JSON documents of any size read by many tasks: a list of records, or ``{column: {row: value}}``.

A document is read in byte ranges, cut at commas. A first scan sums up each range: whether its quotes leave a string open, and by how much its brackets change the
depth, both if it begins inside a string and if not. These lines, one per range, give every range's state at its begin, so a second scan
finds the borders between items (brackets and commas near the top, outside strings) in all ranges at once. The item a border of ranges cuts is put together from its pieces.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.lineage import written

QUOTE, ESCAPE, COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the text between commas, in order within a byte range, which ``start`` names."""
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bytes inside strings, change of depth at each byte as if outside, whether a string is open at the end)."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != ESCAPE, at, -1))  # the last byte that is no backslash, up to each
    before = np.concatenate(([-1], plain[:-1]))
    quotes = (data == QUOTE) & ((at - 1 - before) % 2 == 0)
    within = (np.cumsum(quotes) + inside) % 2 == 1
    return within, _STEP[data], bool((quotes.sum() + inside) % 2)


def _ranges(batches):
    """((file, start), text) of consecutive fragments of one range; every fragment ends in its comma."""
    for batch in batches:
        files, starts, values = (batch.column(i) for i in range(3))
        key = list(zip(files.to_pylist(), starts.to_pylist()))
        texts = values.to_pylist()
        at = 0
        while at < len(key):
            end = at
            while end < len(key) and key[end] == key[at]:
                end += 1
            yield key[at], (",".join(texts[at:end]) + ",").encode()
            at = end


def _states(parts: DataFrame) -> list[tuple[str, int, bool, int]]:
    """(file, start, in a string, depth) at the begin of every range."""
    def sums(batches):
        seen: dict[tuple, list[int]] = {}
        for key, text in _ranges(batches):
            own = seen.setdefault(key, [0, 0, 0])
            data = np.frombuffer(text, dtype=np.uint8)
            within, step, odd = _structure(data, False)
            deep, flat = int(step[within].sum()), int(step[~within].sum())
            # if the part begins in a string, what seemed outside is inside
            a, b = (flat, deep) if not own[0] else (deep, flat)
            own[1], own[2], own[0] = own[1] + a, own[2] + b, own[0] ^ odd
        if seen:
            rows = [(*k, *v) for k, v in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "start", "odd", "outside", "inside"])

    lines = parts.mapInArrow(sums, "file string, start long, odd long, outside long, inside long").orderBy("file", "start").collect()  # one line per range
    out, file, inside, depth = [], None, False, 0
    for r in lines:
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        out.append((file, r["start"], inside, depth))
        depth += r["inside"] if inside else r["outside"]
        inside ^= bool(r["odd"])
    return out


ITEM = "file string, start long, seq long, whole boolean, ends string, text string"


def items(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """(file, start, seq, ends, text): the text between borders in document order. Borders are brackets that reach or leave a depth up to ``depth``, and commas there;
    ``ends`` is the border behind an item: its character and the depth it stands in, such as ``,2``."""
    parts = fragments(spark, path)
    states = {(f, s): (i, d) for f, s, i, d in _states(parts)}

    def split(batches):
        key, inside, level, seq, open_text, whole, rows = None, False, 0, 0, [], False, []

        def close():
            if key is not None and open_text:
                rows.append((*key, seq, False, "", b"".join(open_text).decode()))

        for own, text in _ranges(batches):
            if own != key:
                close()
                key, seq, open_text, whole = own, 0, [], states[own] == (False, 0) and own[1] == 0
                inside, level = states[own]
            data = np.frombuffer(text, dtype=np.uint8)
            within, step, after = _structure(data, inside)
            step = np.where(within, 0, step)
            level_after = level + np.cumsum(step)
            stands = np.where(step > 0, level_after, level_after - step)  # the depth a bracket opens or closes
            border = (step != 0) & (stands <= depth) | (data == COMMA) & ~within & (level_after <= depth) & (level_after > 0)
            at = 0
            for b in np.flatnonzero(border).tolist():
                piece = b"".join([*open_text, text[at:b]]).decode()
                ends = chr(data[b]) + str(int(stands[b]) if step[b] else int(level_after[b]))
                rows.append((*key, seq, whole, ends, piece))
                seq, at, open_text, whole = seq + 1, b + 1, [], True
            open_text.append(text[at:])
            inside, level = after, int(level_after[-1])
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        close()
        if rows:
            yield _batch(rows)

    found = written(parts.mapInArrow(split, ITEM), "json-items")
    # Pieces: at most the first and the last of each range.
    pieces = found.where("not whole or ends = ''")
    order = Window.partitionBy("file").orderBy("start", "seq")
    chain = pieces.withColumn("_n", F.coalesce(F.count_if(F.col("ends") != "").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("start", "seq", "text", "ends")))
    joined = chain.groupBy("file", "_n").agg(ordered.alias("p")).select(
        "file", F.element_at("p", -1)["start"].alias("start"), F.element_at("p", -1)["seq"].alias("seq"), F.element_at("p", -1)["ends"].alias("ends"),
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return found.where("whole and ends <> ''").select("file", "start", "seq", "ends", "text").unionByName(joined.where("ends <> ''"))


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in ITEM.split(", ")])


def list_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): each element of a list as text on one line."""
    elements = items(spark, path, 1).where(F.col("ends").isin(",1", "]1") & (F.trim(F.translate("text", "\r\n\t", "   ")) != ""))
    return elements.select(F.translate("text", "\r\n", "  ").alias("record"))


def column_cells(spark: SparkSession, path: str) -> DataFrame:
    """(column, row, value) of ``{column: {row: value}}``; values as text, null where null."""
    found = written(items(spark, path, 2), "json-cells")
    named = F.when(F.col("ends") == "{2", F.col("text"))
    inside = Window.partitionBy("file", "start").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cells = found.withColumn("_name", F.last(named, ignorenulls=True).over(inside))
    # A range's first cells belong to the last name of the ranges before: one line per range.
    last = found.where(named.isNotNull()).groupBy("file", "start").agg(F.max_by("text", "seq").alias("_last"))
    lines = found.select("file", "start").distinct().join(last, ["file", "start"], "left")
    earlier = lines.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)))
    cells = cells.where(F.col("ends").isin(",2", "}2") & (F.trim(F.translate("text", "\r\n\t", "   ")) != ""))
    cells = cells.join(earlier.select("file", "start", "_before"), ["file", "start"])
    name = F.json_object_keys(F.concat(F.lit("{"), F.regexp_replace(F.coalesce("_name", "_before"), r"^\s*,", ""), F.lit("null}")))[0]
    pair = F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), "map<string,string>")
    return cells.select(name.alias("column"), F.map_keys(pair)[0].alias("row"), F.map_values(pair)[0].alias("value"))


def is_one_object(spark: SparkSession, path: str) -> bool:
    """Whether each file is a single object rather than one on each line."""
    tops = items(spark, path, 1).where(F.col("ends") == "}1").groupBy("file").agg(F.count("*").alias("n"))
    return tops.where("n > 1").isEmpty()
