"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (of bytes, and of word forms) are scaled by the logarithm of the ratio of their class counts over all labelled rows; a linear
hinge-loss model on the scaled indicators is fitted by dual coordinate descent on a bounded sample, and its margin is turned into a probability by
a logistic curve fitted on margins of rows that the model hadn't seen.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from .common import bounded_sample, fresh, held_out, training_rows
from .text_arrays import WORDS, mix, small_batches

SLOTS = 1 << 18
SAMPLE_ROWS = 5000  # bound of the rows the linear model is fitted on; counts cover all labelled rows
EPOCHS, COST, SMOOTHING = 12, 1.0, 1.0
CUT = 0.3

_CLASS = np.full(256, 5, dtype=np.uint64)  # byte classes of word forms: lower, upper, digit, end mark, other mark, beyond ASCII
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[c for c in range(33, 128) if not chr(c).isalnum()]] = 4
_CLASS[[ord(c) for c in ".,;:?"]] = 3


def _slots(order: int, codes: np.ndarray) -> np.ndarray:
    """The slots of the distinct n-grams of a kind."""
    distinct = np.unique(codes).astype(np.uint64)
    return (mix(distinct + np.uint64(order << 56)) & np.uint64(SLOTS - 1)).astype(np.int32)


def features(data: np.ndarray) -> np.ndarray:
    """The distinct slots of a text's n-grams: three bytes, and one to three neighbouring word forms (classes of the first and the last two bytes, length, and whether
    the word repeats the one before it or the one before that)."""
    found = []
    if len(data) >= 3:
        d = data.astype(np.uint32)
        found.append(_slots(1, d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)))
    gap = WORDS[data]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts):
        size = np.minimum(ends - starts, 15).astype(np.uint64)
        kind = _CLASS[data[starts]] | _CLASS[data[ends - 1]] << np.uint64(3) | _CLASS[data[np.maximum(starts, ends - 2)]] << np.uint64(6)
        word = _word_keys(data, starts, ends)
        for back in (1, 2):
            same = np.zeros(len(word), dtype=np.uint64)
            same[back:] = word[back:] == word[:-back]
            kind = kind | same << np.uint64(8 + back)
        kind = kind.astype(np.uint64)  # 11 bits
        found += [_slots(2, kind | size << np.uint64(11)), _slots(3, kind)]
        if len(kind) > 1:
            found.append(_slots(4, kind[:-1] << np.uint64(11) | kind[1:]))
        if len(kind) > 2:
            found.append(_slots(5, kind[:-2] << np.uint64(22) | kind[1:-1] << np.uint64(11) | kind[2:]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal words."""
    lengths = ends - starts
    inside = np.repeat(starts, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    place = inside - np.repeat(starts, lengths)
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * mix(place.astype(np.uint64) + np.uint64(1))
    return np.add.reduceat(values, np.cumsum(lengths) - lengths)


def _texts(column: pa.Array):
    for text in column:
        yield np.frombuffer(text.as_buffer() if text.is_valid else b"", dtype=np.uint8)


def count_classes(rows: DataFrame) -> np.ndarray:
    """(SLOTS, 2) numbers of documents of label 0 and 1 that hold each slot, over all rows. A task passes on one row per slot it met; SLOTS rows at most come back."""
    def count(batches):
        counts = np.zeros((SLOTS, 2), dtype=np.int64)
        for batch in small_batches(batches, 1):
            for data, label in zip(_texts(batch.column(1).cast(pa.binary())), batch.column(2).to_pylist()):
                counts[features(data), label] += 1
        slot = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot, 0]), pa.array(counts[slot, 1])], ["slot", "n0", "n1"])

    table = rows.select("_id", "_text", "_label").mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((SLOTS, 2))
    counts[table.column("slot").to_numpy()] = np.column_stack([table.column("n0").to_numpy(), table.column("n1").to_numpy()])
    return counts


def log_ratio(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logarithm of the ratio of a slot's shares in the documents of label 1 and 0, each smoothed by the slot's share in all."""
    prior = SMOOTHING * n / max(n.sum(), 1)
    share = (counts + prior) / np.maximum(n + SMOOTHING, 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.log(share[:, 1] / share[:, 0])
    return np.where(np.isfinite(r), r, 0.0)


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights (the last one for the constant 1) that minimise |w|²/2 + COST · sum of hinge losses, one dual variable at a time."""
    w, alpha = np.zeros(SLOTS + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Coefficients (the last one the constant) of a logistic curve, by Newton steps with a little shrinkage."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(h, x.T @ (target - p) - 1e-3 * b), -5, 5)
    return b


def _scaled(slots: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[slots]
    return v / max(np.sqrt(v @ v), 1e-12)


def fit(rows: DataFrame, most: int = SAMPLE_ROWS) -> dict:
    """The model: ratio (of each slot), weights, constant and curve. Without rows of both labels it gives every text the share of label 1 (0.5 without rows)."""
    rows = written(rows, "quality-training")
    by_label = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n = np.array([by_label.get(0, 0), by_label.get(1, 0)], dtype=float)
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2)
        return {"ratio": np.zeros(SLOTS), "weights": np.zeros(SLOTS), "constant": 0.0, "curve": np.array([1.0, np.log(share / (1 - share))])}
    counts = count_classes(rows)

    def learn(batches):
        slots, y = [], []
        for batch in batches:
            slots += [features(d) for d in _texts(batch.column(1).cast(pa.binary()))]
            y += batch.column(2).to_pylist()
        y = np.array(y)
        sign, fold = np.where(y == 1, 1.0, -1.0), np.arange(len(y)) % 2
        margins = np.zeros(len(y))
        ratio = log_ratio(counts, n)
        for k in (0, 1):  # margins of rows neither the ratios nor the weights have seen
            seen = counts.copy()
            for i in np.flatnonzero(fold == k):
                seen[slots[i], y[i]] -= 1
            left = n - np.bincount(y[fold == k], minlength=2)
            other = log_ratio(np.maximum(seen, 0), np.maximum(left, 1))
            train = np.flatnonzero(fold != k)
            w = fit_hinge([slots[i] for i in train], [_scaled(slots[i], other) for i in train], sign[train])
            for i in np.flatnonzero(fold == k):
                margins[i] = w[slots[i]] @ _scaled(slots[i], other) + w[-1]
        curve = fit_logistic(margins[:, None], y)
        w = fit_hinge(slots, [_scaled(s, ratio) for s in slots], sign)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (w, curve)], ["w", "curve"])

    sample = bounded_sample(rows, int(n.sum()), most).repartition(1).sortWithinPartitions("_id", "_text", "_label")
    model = sample.mapInArrow(learn, "w binary, curve binary").first()
    w = np.frombuffer(model["w"])
    return {"ratio": log_ratio(counts, n), "weights": w[:-1], "constant": float(w[-1]), "curve": np.frombuffer(model["curve"])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """One row per row of ``docs`` with all its columns and ``score_col``, the probability of label 1 from the whole text alone. Null and empty texts have no
    n-grams and get what the constant gives. A column of that name, in any case, raises ValueError: ``common.fresh`` finds a free one."""
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {score_col} already")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({k: np.asarray(v, dtype=np.float64) for k, v in model.items()})  # two numbers per slot: 4 MB
    names = docs.columns

    def apply(batches):
        m = shared.value
        ratio, weights, curve = m["ratio"], m["weights"], m["curve"]
        for batch in small_batches(batches, 0):
            out = np.empty(batch.num_rows)
            for i, data in enumerate(_texts(batch.column(0).cast(pa.binary()))):
                slots = features(data)
                margin = (weights[slots] @ _scaled(slots, ratio) if len(slots) else 0.0) + m["constant"]
                out[i] = 1 / (1 + np.exp(-np.clip(curve[0] * margin + curve[1], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*(f"_{i}" for i in range(len(names))), "_score"])

    source = docs.select(F.col(text_col).alias("_t"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"_{i} {source.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(names)))
    return source.mapInArrow(apply, f"{schema}, _score double").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], F.col("_score").alias(score_col))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS) -> dict:
    """Learns from the labelled rows that aren't held out."""
    return fit(training_rows(docs, labels, label), most)


def keep(docs: DataFrame, model: dict, cut: float = CUT, **columns) -> DataFrame:
    """The rows whose score is ``cut`` or more, with just the columns of ``docs``, whatever they are called."""
    name = fresh("score", docs)
    return score(docs, model, score_col=name, **columns).where(F.col(f"`{name}`") >= cut).drop(name)


def digest(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``cut`` on). Empty tables give no rows; equal rows equal scores."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
