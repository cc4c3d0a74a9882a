"""Toxic spans by a linear-chain conditional random field over the words of a text.

Only documents are labelled, so tokens get their labels from them: a word of a toxic document is labelled toxic if the word or one of its beginnings occurs
far more often in the other toxic documents than in the rest. The field has two states; what a word says comes from these ratios and those of its
neighbours, and transitions are learned. Forward-backward marginals give the spans, and their sums, on a logistic curve, the score of a document.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from .common import bounded_sample, held_out, training_rows
from .quality import fit_logistic
from .text_arrays import TOKENS, mix, small_batches, word_beginnings

BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes
MIN_DOCUMENTS = 3  # a feature must occur in so many toxic documents, however many there are
KEPT_RATIO, TOKEN_RATIO = 1.0, 2.5
SAMPLE_ROWS = 4000  # bound of the documents the field is fitted on; counts cover all labelled ones
FILTER_BITS, MOST_BITS = 22, 27
BATCH_BYTES = 3 << 20
CUT = 0.5


class Lexicon:
    """Ratios of features by hash; a table of bits tells most hashes without one apart."""

    def __init__(self, hashes: np.ndarray, t: np.ndarray, n: np.ndarray, total_t: float, total_n: float):
        order = np.argsort(hashes)
        self.hashes, self.t, self.n = hashes[order], t[order].astype(float), n[order].astype(float)
        self.total_t, self.total_n = max(total_t, 1.0), max(total_n, 1.0)
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bits[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h``, rows of the lexicon) of the hashes it has."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(self.hashes) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[row] == h[at]
        return at[same], row[same]

    def ratio(self, rows: np.ndarray, own_label: np.ndarray | None = None) -> np.ndarray:
        """Smoothed log ratios; with the labels of the documents the rows come from, without these documents."""
        t, n = self.t[rows], self.n[rows]
        if own_label is not None:
            t, n = t - (own_label == 1), n - (own_label == 0)
        share = self.total_t / (self.total_t + self.total_n)
        return np.log((t + share) / (n + 1 - share) * self.total_n / self.total_t)


def token_features(hashes: np.ndarray, counts: np.ndarray, lexicon: Lexicon, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features, largest ratio) of each word: constants, ratios of the word and of its best beginning, and its neighbours' largest ratio."""
    n = len(hashes)
    own = np.repeat(labels, counts) if labels is not None else None
    ratios = np.zeros((n, 2))
    for k in range(hashes.shape[1]):
        at, row = lexicon.find(hashes[:, k])
        value = lexicon.ratio(row, own[at] if own is not None else None)
        column = 0 if k == 0 else 1
        np.maximum.at(ratios[:, column], at, value)
    best = ratios.max(axis=1)
    before, after = np.zeros(n), np.zeros(n)
    first = np.zeros(n, dtype=bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    before[1:] = np.where(first[1:], 0.0, best[:-1])
    after[:-1] = np.where(first[1:], 0.0, best[1:])
    x = np.column_stack([np.ones(n), ratios / 4, (best > KEPT_RATIO), (best > TOKEN_RATIO), before / 4, after / 4])
    return x, best


class Lattice:
    """Texts laid side by side by place, so that one numpy step moves all of them on by a word."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), dtype=np.int64)
        rank[order] = np.arange(len(counts))
        longest = int(counts.max()) if len(counts) else 0
        self.width = len(counts) - np.searchsorted(np.sort(counts), np.arange(longest), side="right")
        self.edge = np.concatenate(([0], np.cumsum(self.width)))
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = self.edge[place] + np.repeat(rank, counts)

    def marginals(self, emission: np.ndarray, transition: np.ndarray):
        """Odds of the toxic state at each word, with the forward and backward odds they are made of. ``transition``: start, 0→1, 1→0, 1→1 (logarithms; 0→0 is 0)."""
        psi = np.empty(len(emission))
        psi[self.at] = np.exp(np.clip(emission, -50, 50))
        start, up, down, stay = np.exp(np.clip(transition, -20, 20))
        forward, backward = np.empty(len(psi)), np.ones(len(psi))
        edge, width = self.edge, self.width
        for t in range(len(width)):
            a, b = edge[t], edge[t + 1]
            if t == 0:
                forward[a:b] = psi[a:b] * start
            else:
                previous = forward[edge[t - 1]:edge[t - 1] + width[t]]
                forward[a:b] = psi[a:b] * ((up + previous * stay) / (1.0 + previous * down))
        for t in range(len(width) - 2, -1, -1):
            a, n = edge[t], width[t + 1]
            following = psi[edge[t + 1]:edge[t + 2]] * backward[edge[t + 1]:edge[t + 2]]
            backward[a:a + n] = (down + stay * following) / (1.0 + up * following)
        return psi[self.at], forward[self.at], backward[self.at]


def fit_field(x: np.ndarray, y: np.ndarray, counts: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the word features and transitions that maximise the likelihood of the labels (Adam steps on the mean over words, slightly shrunk)."""
    lattice = Lattice(counts)
    theta = np.zeros(x.shape[1] + 4)
    theta[0] = -2.0
    first = np.zeros(len(x), dtype=bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    inner = np.flatnonzero(~first)
    pair = np.array([(~y[inner - 1] & y[inner]).sum(), (y[inner - 1] & ~y[inner]).sum(), (y[inner - 1] & y[inner]).sum()], dtype=float)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    scale = max(int(y.sum()), 1)
    for step in range(1, steps + 1):
        trans = theta[-4:]
        psi, forward, backward = lattice.marginals(x @ theta[:-4], trans)
        odds = forward * backward
        p = odds / (1 + odds)
        start, up, down, stay = np.exp(trans)
        left, right = forward[inner - 1], psi[inner] * backward[inner]
        z = 1.0 + up * right + down * left + stay * left * right
        expected = np.array([(up * right / z).sum(), (down * left / z).sum(), (stay * left * right / z).sum()])
        gradient = np.concatenate([(y - p) @ x, [(y[first] - p[first]).sum()], pair - expected]) / scale - 1e-3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient ** 2
        theta = theta + 0.15 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return theta[:-4], theta[-4:]


def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a document's marginals add up to: the log odds that any word is toxic, and the logarithm of the expected number."""
    total, none = np.zeros(len(counts)), np.zeros(len(counts))
    held = counts > 0
    if held.any():
        starts = (np.cumsum(counts) - counts)[held]
        total[held] = np.add.reduceat(p, starts)
        none[held] = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), starts)
    some = -np.expm1(none)
    return np.column_stack([np.clip(np.log((some + 1e-6) / (1 - some + 1e-6)), -12, 12) / 4, np.log1p(total)])


def _distinct(hashes: np.ndarray, counts: np.ndarray):
    """Distinct hashes of each text, zeros (no such beginning) left out."""
    for part in np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []:
        u = np.unique(part)
        yield u[u != 0]


def build_lexicon(rows: DataFrame, totals: np.ndarray) -> Lexicon:
    """Counts of features over all labelled documents: those in MIN_DOCUMENTS toxic ones, joined with how often each of them occurs in the others.
    Only features whose ratio reaches KEPT_RATIO come back; their number follows what tells the classes apart, not a share of the documents."""
    def count(batches, bits=None):
        table = bits.value if bits else None
        for batch in small_batches(batches, 0, BATCH_BYTES):
            hashes, counts, _ = word_beginnings(batch.column(0), TOKENS, BEGINNINGS)
            parts = list(_distinct(hashes, counts))
            every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            if table is not None:
                spot = every >> np.uint64(64 - MOST_BITS)
                every = every[(table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
            h, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    toxic = rows.where("_label = 1").select("_text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("t"))
    toxic = written(toxic.where(F.col("t") >= MIN_DOCUMENTS), "toxicity-candidates")
    # a table of bits, of 16 MB however many candidates there are, keeps most other features of the rest from being passed on
    spot = F.shiftrightunsigned(F.col("h"), 64 - MOST_BITS)
    found = toxic.select(F.shiftrightunsigned(spot, 6).alias("w"), (spot % 64).cast("int").alias("i")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, i))").alias("v")).toArrow()
    table = np.zeros(1 << (MOST_BITS - 6), dtype=np.uint64)
    table[found.column("w").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    others = rows.where("_label = 0").select("_text").mapInArrow(lambda batches: count(batches, shared), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    both = toxic.join(others, "h", "left").select("h", "t", F.coalesce("n", F.lit(0)).alias("n"))
    share = float(totals[1] / totals.sum())
    ratio = F.log((F.col("t") + share) / (F.col("n") + 1 - share) * float(totals[0] / totals[1]))
    kept = both.where(ratio >= KEPT_RATIO).toArrow()
    return Lexicon(kept.column("h").to_numpy().view(np.uint64), kept.column("t").to_numpy(), kept.column("n").to_numpy(), totals[1], totals[0])


def fit(rows: DataFrame, most: int = SAMPLE_ROWS) -> dict:
    """The model: lexicon, word weights, transitions and curve. Without rows of both labels every text gets the share of label 1 (0.5 without rows)."""
    rows = written(rows, "toxicity-training")
    by_label = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    totals = np.array([by_label.get(0, 0), by_label.get(1, 0)], dtype=float)
    if not totals.all():
        share = (totals[1] + 1) / (totals.sum() + 2)
        empty = np.zeros(0)
        return {"lexicon": Lexicon(np.zeros(0, np.uint64), empty, empty, *totals[::-1]), "weights": np.array([-20.0, 0, 0, 0, 0, 0, 0]), "transition": np.zeros(4),
                "curve": np.array([0.0, 0.0, np.log(share / (1 - share))])}
    lexicon = build_lexicon(rows, totals)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def learn(batches):
        xs, ys, ns, labels = [], [], [], []
        for batch in small_batches(batches, 1, BATCH_BYTES):
            label = np.array(batch.column(2).to_pylist())
            hashes, counts, _ = word_beginnings(batch.column(1), TOKENS, BEGINNINGS)
            x, best = token_features(hashes, counts, shared.value, label)
            xs.append(x.astype(np.float32))
            ys.append((best >= TOKEN_RATIO) & (np.repeat(label, counts) == 1))
            ns.append(counts)
            labels.append(label)
        x, y, counts, labels = (np.concatenate(v) for v in (xs, ys, ns, labels))
        weights, transition = fit_field(x, y, counts)
        _, forward, backward = Lattice(counts).marginals(x @ weights, transition)
        odds = forward * backward
        curve = fit_logistic(document_features(odds / (1 + odds), counts), labels)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (weights, transition, curve)], ["w", "t", "c"])

    sample = bounded_sample(rows, int(totals.sum()), most).repartition(1).sortWithinPartitions("_id", "_text", "_label")
    m = sample.mapInArrow(learn, "w binary, t binary, c binary").first()
    return {"lexicon": lexicon, "weights": np.frombuffer(m["w"]), "transition": np.frombuffer(m["t"]), "curve": np.frombuffer(m["c"])}


def tag(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, score and spans, the words whose marginal is ``cut`` or more, neighbours joined: first character, end, largest marginal.

    Whole texts are tagged. Null and empty texts have no spans and the score of no words. Ids may be null or repeat; equal rows get equal results; an empty table gives
    no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def apply(batches):
        m = shared.value
        for batch in small_batches(batches, 1, BATCH_BYTES):
            hashes, counts, spots = word_beginnings(batch.column(1), TOKENS, BEGINNINGS)
            x, _ = token_features(hashes, counts, m["lexicon"])
            _, forward, backward = Lattice(counts).marginals(x @ m["weights"], m["transition"])
            odds = forward * backward
            p = odds / (1 + odds)
            z = np.column_stack([document_features(p, counts), np.ones(len(counts))]) @ m["curve"]
            spans: list[list[dict]] = [[] for _ in counts]
            hit = np.flatnonzero(p >= cut)
            doc = np.searchsorted(np.cumsum(counts), hit, side="right")
            last = -2
            for i, d in zip(hit.tolist(), doc.tolist()):
                if i == last + 1 and spans[d]:
                    spans[d][-1]["end"] = int(spots[i, 1])
                    spans[d][-1]["marginal"] = max(spans[d][-1]["marginal"], float(p[i]))
                else:
                    spans[d].append({"first": int(spots[i, 0]), "end": int(spots[i, 1]), "marginal": float(p[i])})
                last = i
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), pa.array(spans, kind)], ["_id", "score", "spans"])

    id_type = source.schema["_id"].dataType.simpleString()
    out = source.mapInArrow(apply, f"_id {id_type}, score double, spans array<struct<first:bigint,end:bigint,marginal:double>>")
    return out.select(F.col("_id").alias(id_col), "score", "spans")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE_ROWS) -> dict:
    """Learns from the labelled rows that aren't held out."""
    return fit(training_rows(docs, labels, label), most)


def digest(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``cut`` on) and n_spans."""
    tagged = tag(docs, train(docs, labels))
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
                         F.size("spans").alias("n_spans"))
