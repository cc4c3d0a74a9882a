"""Cutting texts where no pre-token of a byte-level BPE can cross, so that equal pieces are tokenized once.

The usual pattern of these vocabularies takes white space only at the start of a pre-token, and looks ahead of a run of white space
only at its end. A cut between a character that isn't white space and one that is therefore never changes a token.
"""

import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import filterfalse

# The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CACHE_PIECES = 1_000_000
LONGEST_KEPT = 256


class PieceCache(dict):
    """Results by piece, in two generations: when the younger is full, the older is dropped, and what is used again comes back from it.

    It keeps about ``most`` pieces; fewer take less memory and are made again more often. Long pieces are forgotten after each group of texts, so its memory is bounded.
    """

    def __init__(self, make, most: int = CACHE_PIECES):
        super().__init__()
        self.make, self.most, self.older, self.long = make, most, {}, []

    def fill(self, texts: list[list[str]]) -> None:
        for p in self.long:
            self.pop(p, None)
        used = set().union(*texts)
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()
        new = used.difference(self)
        known = new.intersection(self.older)
        self.update((p, self.older[p]) for p in known)
        new = list(new - known)
        if new:
            self.update(zip(new, self.make(new), strict=True))
        self.long = [p for p in used if len(p) > LONGEST_KEPT]

    def values(self, texts: list[list[str]]) -> list[list]:
        """The results of each text's pieces. What is missing is made for all texts together."""
        for p in self.long:
            self.pop(p, None)
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()
        missing = set()
        for pieces in texts:
            missing.update(filterfalse(self.__contains__, pieces))
        older, new = self.older.get, []
        for p in missing:
            value = older(p)
            if value is None:
                new.append(p)
            else:
                self[p] = value
        if new:
            self.update(zip(new, self.make(new), strict=True))
        self.long = [p for p in missing if len(p) > LONGEST_KEPT]
        return [list(map(self.__getitem__, pieces)) for pieces in texts]


def in_groups(texts: Iterable[str | None], chars: int = 2_000_000):
    """Lists of the texts' pieces, some texts at a time; null has none."""
    group, size = [], 0
    for text in texts:
        group.append(PIECES.findall(text) if text else [])
        size += len(text) if text else 0
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=4)
def load_json(path: str) -> dict:
    """A byte-level BPE vocabulary file. Other kinds of vocabulary are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
    return spec
