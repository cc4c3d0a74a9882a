"""Token counts of whole texts by rank-synchronous merging in numpy arrays.

Distinct pre-tokens of many texts lie in one flat array of symbols with a sequence number each. In every round each sequence
merges all places of its own lowest-ranked pair at once; sequences without a pair that can be merged leave the array, and the number of their
symbols is their count. This equals merging one place at a time: a pair that a merge makes has a higher rank than the merge itself.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .pieces import PieceCache, in_groups, load_json

NO_RANK = np.int64(2**62)
FLAT_BYTES = 4_000_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts the symbols that remain of byte sequences."""

    def __init__(self, path: str):
        spec = load_json(path)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.bytes = np.array([vocab[s] for s in _byte_symbols()], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        out = np.zeros(len(sequences), dtype=np.int64)
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        symbols = self.bytes[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        pair = np.full(len(symbols), NO_RANK)  # rank of a symbol and its right neighbour
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        pair[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(pair, starts)
            done = least == NO_RANK
            if done.any():
                out[owner[starts[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
                sizes, least = sizes[~done], least[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(pair == np.repeat(least, sizes))
            # Neighbouring hits are one pair of equal symbols in a row: every second one counts, from the left.
            first = np.concatenate(([True], np.diff(hit) != 1))
            run = np.flatnonzero(first)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            symbols[hit] = self.merged[pair[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            pair[hit] = NO_RANK
            place = (np.cumsum(keep) - 1)[hit]
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            for at in (place, place[place > 0] - 1):  # only pairs with a new symbol have a new rank
                at = at[at + 1 < len(symbols)]
                same = owner[at] == owner[at + 1]
                pair[at] = NO_RANK
                pair[at[same]] = self.rank(symbols[at[same]], symbols[at[same] + 1])
        return out


class PieceCounter:
    def __init__(self, path: str):
        import public_tokenizers
        import regex

        spec = load_json(path)
        self.merger = RankMerger(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __call__(self, pieces: list[str]) -> list[int]:
        counts = np.zeros(len(pieces), dtype=np.int64)
        words: dict[str, int] = {}
        owner, word = [], []
        for i, piece in enumerate(pieces):
            parts = [piece]
            if self.special is not None and self.special.search(piece):
                counts[i] += len(self.special.findall(piece))
                parts = self.special.split(piece)
            for part in parts:
                for w in self.pattern.findall(part):
                    owner.append(i)
                    word.append(words.setdefault(w, len(words)))
        sizes, group, size, flat = [], [], 0, [w.encode() for w in words]
        for b in flat:
            group.append(b)
            size += len(b)
            if size >= FLAT_BYTES:
                sizes.append(self.merger.counts(group))
                group, size = [], 0
        if group:
            sizes.append(self.merger.counts(group))
        if owner:
            np.add.at(counts, owner, np.concatenate(sizes)[word])
        return counts.tolist()


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    return PieceCache(PieceCounter(path))


def text_counts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; null and empty texts have none."""
    cache, out = _cache(path), []
    for group in in_groups(texts):
        cache.fill(group)
        out += [sum(map(cache.__getitem__, pieces)) for pieces in group]
    return out


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes (UTF-8), n_tokens as the vocabulary's library gives them, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level BPE file on every worker. Null and empty texts have no bytes and no tokens; a null id stays;
    equal rows are counted each; an empty table gives no rows; other columns are not read. Whole texts count, however long.
    Special strings inside texts are one token. Nothing is shuffled.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def count(batches):
        for batch in batches:
            texts = batch.column(1)
            n = pa.array(text_counts(texts.to_pylist(), vocabulary), pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], ["_id", "n_bytes", "n_tokens"])

    kind = source.schema["_id"].dataType.simpleString()
    counted = source.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
