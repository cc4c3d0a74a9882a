"""Exact n-gram Jaccard join: universe partition and the pigeonhole principle, and the classes its links make.

Two sets with Jaccard similarity 0.8 or more differ in at most (|r| + |s|) / 9 shingles. By the size of the smaller set, a pair belongs to a band, whose universe of
shingles is hashed into segments. A set walks the segments of a band in a fixed order and gathers credit: a segment whose content is indexed as a whole earns 1 (if the
other set lacks that content, the two differ there at least once), one that is indexed with all its one-deletion neighbours earns 2, an empty one none. Once the credit passes the
number of differences any partner may have, some indexed content must be common, and the walk ends.

Costs decide the allocation: a segment content that is frequent in a sample (boilerplate) costs many candidates, so it is not indexed and earns nothing, for all sets alike; the walk goes
on to other segments, the last ones with neighbourhoods. Sets that can't gather enough in this way (most of what they hold is frequent, as in a large family of near copies) meet
in an index of their own that ignores costs. The sample only steers the work; no pair is lost whatever it says.

Sets with a common content form a list. Links that don't change the classes needn't be verified: in each round every list proposes pairs between different classes only,
first of all members with one hub, then between what is left, filtered by parity bits that bound the difference of two sets from below. A list of which no pair was left out isn't looked at
again. Pairs are verified on the whole sets.

The join itself comes last: two linked sets are in one class, so within each class all sets are compared with all, block by block on the whole sets.
"""

from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import written
from .common import SPACES, uniform
from .text_arrays import WORDS, mix, small_batches, windows, word_hashes

SHINGLE = 5
PERCENT = 80  # the similarity, as a share of 100
SMALL_BAND = 5  # below 2**5 shingles every shingle is a segment of its own
NEIGHBOUR_SHARE = 0.05  # of a band's segments
SAMPLE_DOCS, FREQUENT = 20_000, 6  # bound of the cost sample; sets of it that share a frequent content
KEYS_EACH = 1_500_000  # keys that one task sorts
SHORT_LIST = 256  # longer lists begin with a hub
FIRST_TRIES, MORE_TRIES = 2, 16  # pairs a node has verified in the first round; how many times as many in each that follows
AT_ONCE = 1 << 20  # 64-bit words of parity bits that are compared at once
CHUNK = 4096  # members of a list that one task compares with others
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18  # of a class, that meet other such blocks of it in the join


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than five words the whole sequence is one, without words there is none."""
    words, counts = word_hashes(texts, WORDS)
    all_windows = windows(words, tuple(range(SHINGLE)))
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(all_windows[at:at + n - SHINGLE + 1]))
        elif n:
            out.append(mix(windows(words[at:at + n], tuple(range(n))) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit numbers of a set."""
    a = mix(np.array([mix(s).sum() + np.uint64(len(s))], dtype=np.uint64))[0]
    b = mix(np.array([mix(s ^ np.uint64(0x5BF03635F0935AD1)).sum()], dtype=np.uint64))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def most_differences(r: int, s: int) -> int:
    """How many shingles may be in one of two similar sets of these sizes only."""
    return (100 - PERCENT) * (r + s) // (100 + PERCENT)


def _family(s: np.ndarray, band: int, need: int, frequent: np.ndarray, salt: int):
    """(keys, credit reached) of one walk."""
    tag = np.uint64((band * 1_000_003 + salt * 7_919 + 17) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    token = mix(s ^ tag)
    if band < SMALL_BAND:
        keys = np.sort(token)
        keys = keys[~_among(keys, frequent)]
        return keys[:need], min(len(keys), need)
    m = int(np.ceil(0.6 * (1 << band))) + 2
    first_neighbour = m - int(np.ceil(NEIGHBOUR_SHARE * m))
    segment = ((token >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], mix(token[order] + np.uint64(1))
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    sizes = np.diff(np.append(starts, len(segment)))
    index = segment[starts]
    content = np.add.reduceat(value, starts)
    place = mix(index.astype(np.uint64) + tag)
    keys = mix(content ^ place)
    cheap = ~_among(keys, frequent)
    credit = cheap.astype(np.int64)
    neighbours = np.flatnonzero((index >= first_neighbour) & (sizes >= 2))
    deleted, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if credit.sum() < need and len(neighbours):  # only a walk that gets this far needs them; it then holds all of them
        owner = np.repeat(neighbours, sizes[neighbours])
        inside = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in neighbours])
        deleted = mix((content[owner] - value[inside]) ^ place[owner])
        fine = np.ones(len(starts), dtype=bool)
        costly = _among(deleted, frequent)
        fine[owner[costly]] = False
        deleted, owner = deleted[~costly], owner[~costly]
        credit[neighbours] += (cheap & fine)[neighbours]
    reached = np.cumsum(credit)
    end = int(np.searchsorted(reached, need)) + 1  # segments walked
    out = keys[:end][cheap[:end]]
    return np.concatenate((out, deleted[owner < end])), int(reached[min(end, len(reached)) - 1])


def _among(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys) or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


NONE = np.zeros(0, np.uint64)


def index_keys(s: np.ndarray, frequent: np.ndarray = NONE) -> np.ndarray:
    """All keys under which a set is indexed. Two similar sets have one in common."""
    n = len(s)
    if not n:
        return NONE
    top = n.bit_length() - 1
    low = -(-n * PERCENT // 100)
    bands = [(top, most_differences(n, n * 100 // PERCENT))]
    if low.bit_length() - 1 < top:
        bands.append((top - 1, most_differences(n, (1 << top) - 1)))
    out = []
    for band, differences in bands:
        keys, credit = _family(s, band, differences + 1, frequent, 0)
        out.append(keys)
        if credit <= differences and len(frequent):
            keys, credit = _family(s, band, differences + 1, NONE, 1)
            out.append(keys)
        if credit <= differences:  # too few segments with content: the smallest shingles, for pairs of such sets
            token = np.sort(mix(s ^ np.uint64(band * 77_041 + 5)))
            out.append(token[:differences + 1])
    return np.concatenate(out)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Bits of which each holds the parity of the shingles hashed to it: two sets differ in at least as many shingles as bits. Their number follows the size of the
    set; that of a partner is the same or twice as large."""
    n = max(len(s), 1)
    words = max(1, 1 << (n - 1).bit_length() >> 6)  # one to two bits a shingle
    at = mix(s ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - (words.bit_length() - 1 + 6))
    odd = np.bincount(at.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def fold_bits(bits: np.ndarray, words: int) -> np.ndarray:
    """The same bits for half as many places, again and again: neighbouring places are joined by exclusive or."""
    while bits.shape[-1] > words:
        plain = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(*bits.shape[:-1], -1), axis=-1, bitorder="little")
        bits = np.packbits(plain[..., 0::2] ^ plain[..., 1::2], axis=-1, bitorder="little").view("<u8")
    return bits


MEMBERS = "_id long, n_shingles long, a long, b long, bits binary, h long"


def _members(batches):
    for batch in small_batches(batches, 1):
        sets = shingle_sets(batch.column(1))
        ids = [set_id(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([i[0] for i in ids], pa.int64()),
                                          pa.array([i[1] for i in ids], pa.int64()), pa.array([parity_bits(s).tobytes() for s in sets], pa.binary()), batch.column(2)],
                                         ["_id", "n_shingles", "a", "b", "bits", "h"])


def _frequent_keys(source: DataFrame, n: int, keys_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that at least FREQUENT different sets of a bounded sample of the documents share, and into how many parts the sets of each should be dealt."""
    rate = min(1.0, SAMPLE_DOCS / max(n, 1))

    def keys(batches):
        for batch in small_batches(batches, 1):
            found = {}
            for s in shingle_sets(batch.column(1)):
                node = set_id(s)[0]
                if len(s) and node not in found:
                    found[node] = np.unique(index_keys(s))
            if found:
                nodes = np.repeat(np.array(list(found), dtype=np.int64), [len(k) for k in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(found.values())).view(np.int64)), pa.array(nodes)], ["key", "a"])

    sample = source.where(uniform(F.col("_id"), F.col("_text"), F.lit("cost")) < rate)
    table = sample.mapInArrow(keys, "key long, a long").distinct().groupBy("key").count().where(F.col("count") >= FREQUENT).toArrow()
    found, expected = table.column("key").to_numpy().view(np.uint64), table.column("count").to_numpy() / rate
    order = np.argsort(found)
    return found[order], np.ceil(expected[order] / keys_each).astype(np.uint64)


def _salts(keys: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Into how many parts the sets of each key are dealt."""
    out = np.ones(len(keys), dtype=np.uint64)
    at = np.flatnonzero(_among(keys, frequent[0]))
    out[at] = frequent[1][np.searchsorted(frequent[0], keys[at])]
    return out


def _lists(source: DataFrame, frequent: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """(list_id, node, weight): the sets that share a key, each such list once, with the members' number of companions in all lists its task saw.

    A key that many sets are expected to have is dealt over several parts by set, and its list is named after the key; it is never in one task.
    """
    shared = source.sparkSession.sparkContext.broadcast(frequent)  # bounded by the sample

    def index(batches):
        for batch in small_batches(batches, 1):
            keys, nodes, done = [], [], set()
            for s in shingle_sets(batch.column(1)):
                node = set_id(s)[0]
                if len(s) and node not in done:
                    done.add(node)
                    k = index_keys(s, shared.value[0])
                    keys.append(k)
                    nodes.append(np.full(len(k), node, dtype=np.int64))
            if not keys:
                continue
            keys, nodes = np.concatenate(keys), np.concatenate(nodes)
            salt = mix(nodes.view(np.uint64)) % _salts(keys, shared.value)
            part = (mix(keys + salt) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, nodes, part = keys[order], nodes[order], part[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
            rows = [(int(part[i]), keys[i:j].tobytes(), nodes[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
            p, k, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["part", "keys", "nodes"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
        nodes = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("nodes")])
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
        once = new_key | np.concatenate(([True], nodes[1:] != nodes[:-1]))
        keys, nodes, new_key = keys[once], nodes[once], new_key[once]
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(starts, len(keys)))
        split = _salts(keys[starts], shared.value) > 1
        many = np.flatnonzero((sizes > 1) | split)
        if not len(many):
            return pa.table({"list_id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})
        name = mix(np.add.reduceat(mix(nodes.view(np.uint64)), starts) + sizes.astype(np.uint64))
        name = np.where(split, mix(keys[starts] ^ np.uint64(0x6A09E667F3BCC909)), name)[many].view(np.int64)
        distinct, first, times = np.unique(name, return_index=True, return_counts=True)
        size = sizes[many[first]]
        at = np.repeat(starts[many[first]], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        member = nodes[at]
        known, place = np.unique(member, return_inverse=True)
        companions = np.bincount(place, weights=np.repeat((size - 1) * times, size)).astype(np.int64)
        return pa.table({"list_id": np.repeat(distinct, size), "node": member, "weight": companions[place]})

    packed = source.mapInArrow(index, "part long, keys binary, nodes binary")
    found = packed.groupBy("part").applyInArrow(meet, "list_id long, node long, weight long")
    return written(found.groupBy("list_id", "node").agg(F.max("weight").alias("weight")), "jaccard-lists")


def _sets_of(source: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members): the sets of the given nodes, each made from one text. A table of bits (16 MB at most) over the hashes of these texts keeps the other documents' sets from
    being made."""
    hashes = members.join(nodes, F.col("a") == F.col("node"), "left_semi").groupBy("a").agg(F.min("h").alias("h"))
    bits = min(27, max(12, (max(1, nodes.count()) * 16).bit_length()))
    spot = F.shiftrightunsigned(F.col("h"), 64 - bits)
    rows = hashes.select(F.shiftrightunsigned(spot, 6).alias("w"), (spot % 64).cast("int").alias("i")).groupBy("w").agg(
        F.expr("bit_or(shiftleft(1L, i))").alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    shared = source.sparkSession.sparkContext.broadcast(table)

    def sets(batches):
        t = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            wanted = (t[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            for some in small_batches([batch.filter(pa.array(wanted))], 1):
                found = {set_id(s)[0]: s.tobytes() for s in shingle_sets(some.column(1)) if len(s)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "members"])

    made = source.select(F.xxhash64("_text").alias("h"), "_text").mapInArrow(sets, "node long, members binary")
    return written(made.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")


def _plausible(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    """The pairs whose sizes and parity bits don't rule out a link."""
    left, right = (traits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}")) for x in "ab")

    def check(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(fold_bits(x, words) ^ fold_bits(y, words)).sum())
                keep.append(min(n, m) * 100 >= max(n, m) * PERCENT and apart <= most_differences(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) for distinct pairs. The sets of the more frequent side, a, come last, so that a hub's is split by adaptive execution."""
    left, right = (sets.select(F.col("node").alias(x), F.col("members").alias(f"s{x}")) for x in "ab")

    def check(batches):
        for batch in batches:
            out = []
            for sa, sb in zip(batch.column(2), batch.column(3)):
                r, s = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                common = int((r[np.minimum(np.searchsorted(r, s), len(r) - 1)] == s).sum())
                out.append(100 * common >= PERCENT * (len(r) + len(s) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return joined.mapInArrow(check, "a long, b long, linked boolean")


def _star(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """One step of the alternating stars that turn connected edges into stars around their smallest node. Aggregate and join, no group is held."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    if smaller_only:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    met = both.join(least, "u")
    kept = met.where("v > u").select("v", "m") if not smaller_only else met.select("v", "m").union(least.select("u", "m"))
    return kept.toDF("a", "b").where("a <> b").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge list reaches. Each step is written, and the loop ends when every node has one edge to a node without one."""
    edges = written(edges.select("a", "b").where("a <> b"), "classes")
    while True:
        edges = written(_star(edges, False), "classes")
        edges = written(_star(edges, True), "classes")  # b < a in every edge
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


FOUND = pa.schema([(c, pa.int64()) for c in ("list_id", "a", "b", "d")])


def _proposals(lists: DataFrame, nodes: DataFrame, tries: int) -> DataFrame:
    """(list_id, a, b, d): pairs of different classes in a common list that may be similar and weren't verified, with their differing bits d: the ``tries`` closest of each
    node in each list. ``nodes``: node, root, n, bits, refused. A list of which pairs are left out also has a row with null a and b; only such lists need be looked at again, with more tries.

    Only members outside a list's largest class look for partners, among all members: of any two classes, one is not the largest. A list of up to CHUNK members is compared as
    one row; of longer ones, blocks of the members outside meet blocks of all members. The members' classes and the lists' states are written, so that no list is made twice.
    """
    rooted = written(lists.select("list_id", "node").join(nodes.select("node", "root"), "node"), "jaccard-rooted")
    held = rooted.groupBy("list_id", "root").agg(F.count("*").alias("k"))
    state = held.groupBy("list_id").agg(F.count("*").alias("roots"), F.sum("k").alias("size"), F.max_by("root", F.struct("k", "root")).alias("main")).where("roots > 1")
    state = written(state.select("list_id", "size", "main"), "jaccard-lists-state")
    rows = rooted.select("list_id", "node").join(state, "list_id").join(nodes, "node")
    packed = F.collect_list(F.struct("node", "root", "n", "bits", "refused"))
    short = rows.where(F.col("size") <= CHUNK).groupBy("list_id").agg(packed.alias("out")).select("list_id", "out", F.lit(None).cast(
        "array<struct<node:bigint,root:bigint,n:bigint,bits:binary,refused:array<bigint>>>").alias("all"))
    longest = state.agg(F.max("size")).first()[0] or 0
    long = rows.where(F.col("size") > CHUNK)
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK))
    every = long.groupBy("list_id", chunk.alias("c")).agg(packed.alias("all"))
    outside = long.where("root <> main").groupBy("list_id", chunk.alias("d")).agg(packed.alias("out"))

    def propose(batches):
        for batch in batches:
            out = []
            for list_id, left, right in zip(batch.column(0).to_pylist(), _sides(batch.column(1)), _sides(batch.column(2))):
                a, b, d, more = _closest(left, right, tries) if right else _closest(left.outside(), left, tries)
                if len(a):
                    out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(a), list_id), a, b, d)], schema=FOUND))
                if more:
                    out.append(pa.RecordBatch.from_pydict({"list_id": [list_id], "a": [None], "b": [None], "d": [None]}, schema=FOUND))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    made = short.union(outside.join(every, "list_id").select("list_id", "out", "all")) if longest > CHUNK else short
    return written(made.mapInArrow(propose, "list_id long, a long, b long, d long"), "jaccard-found")


def _first_tries(found: DataFrame, tries: int) -> DataFrame:
    """(a, b): of all pairs that were found, the ``tries`` closest of each node."""
    found = found.select("a", "b", "d").distinct()
    ends = found.select("a", "b", "d", F.explode(F.array("a", "b")).alias("u"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "a", "b"))
    return ends.withColumn("r", rank).where(F.col("r") <= tries).select("a", "b").distinct()


def _still_open(found: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame:
    """The found pairs that weren't verified and still join two classes."""
    seen = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left, right = (labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return found.join(seen, ["a", "b"], "left_anti").join(left, "a").join(right, "b").where("ra <> rb").select("a", "b", "d")


class _Side:
    """Members of a list: node, root, n, and their parity bits and refused partners in flat arrays with bounds."""

    def __init__(self, node, root, n, bits, bit_bounds, refused, refused_bounds):
        self.node, self.root, self.n, self.bits, self.refused = node, root, n, bits, refused
        self.at, self.words = bit_bounds[:-1] // 8, np.diff(bit_bounds) // 8
        self.refused_bounds = refused_bounds

    def matrix(self, words: int) -> np.ndarray:
        out = np.empty((len(self.node), words), dtype=np.uint64)
        for size in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == size)
            out[own] = fold_bits(self.bits[self.at[own][:, None] + np.arange(size)], words)
        return out


    def outside(self) -> "_Side":
        """The members outside the largest class, or all where every class has one member."""
        roots, counts = np.unique(self.root, return_counts=True)
        if counts.max() == 1:
            return self
        rows = np.flatnonzero(self.root != roots[counts.argmax()])
        out = copy(self)
        out.node, out.root, out.n, out.at, out.words = (x[rows] for x in (self.node, self.root, self.n, self.at, self.words))
        others = np.diff(self.refused_bounds)
        out.refused_bounds = np.concatenate(([0], np.cumsum(others[rows])))
        first, end = self.refused_bounds[0], self.refused_bounds[-1]
        out.refused = self.refused[first:end][np.repeat(np.isin(np.arange(len(others)), rows), others)]
        return out


def _sides(column: pa.Array):
    """The members of each row of a column of lists, or None. The lists stay flat arrays; no object is made per member."""
    bounds = column.offsets.to_numpy()
    node, root, n, bits, refused = column.values.flatten()
    node, root, n = (x.to_numpy(zero_copy_only=False) for x in (node, root, n))
    bits = bits.cast(pa.large_binary())
    bit_bounds = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset:bits.offset + len(bits) + 1] if len(bits) else np.zeros(1, np.int64)
    words = np.frombuffer(bits.buffers()[2] or b"", np.uint8)
    words = words[:len(words) // 8 * 8].view("<u8")  # all bits are whole words
    others = pa.compute.fill_null(pa.compute.list_value_length(refused), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    refused_bounds, refused = np.concatenate(([0], np.cumsum(others))), refused.flatten().to_numpy(zero_copy_only=False)
    for i, valid in enumerate(column.is_valid().to_pylist()):
        a, b = int(bounds[i]), int(bounds[i + 1])
        yield _Side(node[a:b], root[a:b], n[a:b], words, bit_bounds[a:b + 1], refused, refused_bounds[a:b + 1]) if valid else None


def _closest(left: _Side, right: _Side | None, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(a, b, differing bits, whether some have more): for each member of ``left`` its ``tries`` closest plausible partners of other classes in ``right``, or in ``left`` itself."""
    right = right or left
    words = int(min(left.words.min(), right.words.min()))
    y = right.matrix(words)
    x = y if right is left else left.matrix(words)
    step = max(1, AT_ONCE // (len(right.node) * words))
    found, more = [], False
    for at in range(0, len(left.node), step):
        n = left.n[at:at + step, None]
        fits = (np.minimum(right.n, n) * 100 >= np.maximum(right.n, n) * PERCENT) & (right.root != left.root[at:at + step, None])
        i, j = np.nonzero(fits)
        i += at
        apart = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64)
        good = np.flatnonzero(apart * (100 + PERCENT) <= (100 - PERCENT) * (right.n[j] + left.n[i]))
        good = good[np.lexsort((apart[good], i[good]))]
        i, j, apart = i[good], j[good], apart[good]
        unseen = np.ones(len(i), dtype=bool)
        for k in np.unique(i).tolist() if left.refused_bounds[-1] > left.refused_bounds[0] else ():
            refused, own = left.refused[left.refused_bounds[k]:left.refused_bounds[k + 1]], slice(*np.searchsorted(i, (k, k + 1)))
            unseen[own] = ~np.isin(right.node[j[own]], refused)
        i, j, apart = i[unseen], j[unseen], apart[unseen]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < tries
        more |= not keep.all()
        one, other = left.node[i[keep]], right.node[j[keep]]
        found.append((np.minimum(one, other), np.maximum(one, other), apart[keep]))
    return *(np.concatenate(c) for c in zip(*found)), more


def _labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b): only the roots they join are looked at."""
    left, right = (labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    joined = classes(links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("least"))
    return written(labels.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")), "jaccard-labels")


def members_and_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys_each: int = KEYS_EACH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: _id, n_shingles, a, b and the text's hash h of each row; labels: node, root of the sets (by a) that were candidates; sets: node, members of those that were made)."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    members = written(source.withColumn("h", F.xxhash64("_text")).mapInArrow(_members, MEMBERS), "jaccard-members")
    total = members.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("s")).first()
    if members.groupBy("a").agg((F.min("b") != F.max("b")).alias("x")).where("x").limit(1).count():
        raise ValueError("two different sets have the same 64-bit number; choose another seed in text_arrays")
    parts = max(1, -(-int(total["s"]) * 2 // (5 * keys_each)))  # about 0.4 keys a shingle
    lists = _lists(source, _frequent_keys(source, int(total["n"]), keys_each), parts)
    nodes = written(lists.select("node").distinct(), "jaccard-nodes")
    traits = written(members.select(F.col("a").alias("node"), F.col("n_shingles").alias("n"), "bits").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "jaccard-traits")
    # Long lists first compare all members with one hub; in short ones the closest pairs are looked for at once.
    sized = lists.groupBy("list_id").agg(F.count("*").alias("size"), F.max_by("node", F.struct("weight", "node")).alias("a"))
    stars = lists.join(sized.where(F.col("size") > SHORT_LIST).select("list_id", "a"), "list_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    short = lists.join(sized.where(F.col("size") <= SHORT_LIST).select("list_id"), "list_id", "left_semi")
    alone = traits.withColumn("root", F.col("node")).withColumn("refused", F.array().cast("array<bigint>"))
    found = _proposals(short, alone, FIRST_TRIES)
    pairs = written(_plausible(stars, traits).union(_first_tries(found.where("a is not null"), FIRST_TRIES)).distinct(), "jaccard-pairs")
    left = lists.join(sized.where(F.col("size") > SHORT_LIST).select("list_id").union(found.where("a is null").select("list_id")), "list_id", "left_semi")
    left = written(left.select("list_id", "node"), "jaccard-left")
    found = found.where("a is not null").select("a", "b", "d")
    labels = nodes.select("node", F.col("node").alias("root"))
    sets = done = None
    tries = FIRST_TRIES
    while True:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(wanted if sets is None else wanted.join(sets, "node", "left_anti"), "jaccard-wanted")
        if sets is None or wanted.limit(1).count():
            more = _sets_of(source, members, wanted)
            sets = more if sets is None else sets.union(more)
        verified = written(_verified(pairs, sets), "jaccard-verified")
        done = verified if done is None else done.union(verified)
        labels = _labels(labels, verified.where("linked"))
        failed = done.where("not linked").select("a", "b")
        refused = failed.union(failed.select("b", "a")).toDF("node", "other").groupBy("node").agg(F.collect_set("other").alias("refused"))
        tries *= MORE_TRIES
        found = _still_open(found, labels, done)
        if left.limit(1).count():
            state = written(traits.join(labels, "node").join(refused, "node", "left"), "jaccard-state")
            new = _proposals(left, state, tries)
            left = written(left.join(new.where("a is null").select("list_id").distinct(), "list_id", "left_semi"), "jaccard-left")
            found = found.union(new.where("a is not null").select("a", "b", "d"))
        found = written(found.distinct(), "jaccard-found")
        pairs = written(_first_tries(found, tries), "jaccard-pairs")
        if not pairs.limit(1).count():
            return members, labels, sets


def _linked(batches, pairs: bool):
    """Links between two blocks of a class, or within one: (a, b) each once, or (node, rows) with the rows of all sets a set is linked with."""
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):  # two blocks at a time as Python objects
            left, right = left.as_py(), right.as_py()
            same = right is None
            every = left if same else left + right
            sets = [np.frombuffer(x["members"], np.uint64) for x in every]
            nodes, weight = np.array([x["node"] for x in every]), np.array([x["copies"] for x in every])
            _, at = np.unique(np.concatenate(sets), return_inverse=True)
            sizes = np.array([len(x) for x in sets])
            starts = np.cumsum(sizes) - sizes
            has, rows, found = np.zeros(int(at.max()) + 1, dtype=bool), np.zeros(len(every), dtype=np.int64), []
            for i in range(len(left)):
                first = i + 1 if same else len(left)
                if first == len(every):
                    continue
                own = at[starts[i]:starts[i] + sizes[i]]
                has[own] = True
                common = np.add.reduceat(has[at[starts[first]:]].astype(np.int64), starts[first:] - starts[first])
                has[own] = False
                j = first + np.flatnonzero(100 * common >= PERCENT * (sizes[i] + sizes[first:] - common))
                rows[i] += weight[j].sum()
                rows[j] += weight[i]
                if pairs:
                    found.append((np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])))
            if pairs and found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])
            elif not pairs and rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows > 0]), pa.array(rows[rows > 0])], ["node", "rows"])


def _class_blocks(source: DataFrame, members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(left, right): all blocks of each class with all, each two once; ``right`` is null for a block with itself. A block's size is bounded, a class's is not."""
    own = members.where("n_shingles > 0").groupBy(F.col("a").alias("node")).agg(F.first("n_shingles").alias("n"), F.count("*").alias("copies")).join(labels, "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    many = own.groupBy("root").agg(F.count("*").alias("k"), blocks.alias("m")).where("k > 1")
    nodes = written(own.join(many, "root").select("node", "root", "copies", "m", F.pmod(F.xxhash64("node"), "m").cast("int").alias("c")), "jaccard-class-nodes")
    missing = written(nodes.select("node").join(sets, "node", "left_anti"), "jaccard-wanted")
    if missing.limit(1).count():
        sets = sets.union(_sets_of(source, members, missing))
    packed = sets.join(nodes, "node").groupBy("root", "c", "m").agg(F.collect_list(F.struct("node", "copies", "members")).alias("left"))
    packed = written(packed, "jaccard-blocks")
    ahead = packed.where("c + 1 < m").select("root", "left", F.explode(F.sequence(F.col("c") + 1, F.col("m") - 1)).alias("d"))
    met = ahead.join(packed.select("root", F.col("c").alias("d"), F.col("left").alias("right")), ["root", "d"]).select("left", "right")
    return packed.select("left", F.lit(None).cast(packed.schema["left"].dataType).alias("right")).union(met)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys_each: int = KEYS_EACH) -> tuple[DataFrame, DataFrame]:
    """The join: (membership: doc_id, set_id, one row per row of ``docs``, null without words; links: a, b, every two different sets that link, once, a < b).

    Rows of one set link too; with them, membership and links are all pairs of rows.
    """
    members, labels, sets = members_and_classes(docs, id_col, text_col, keys_each)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    made = _class_blocks(source, members, labels, sets).mapInArrow(lambda batches: _linked(batches, True), "a long, b long")
    return members.select(F.col("_id").alias(id_col), F.when(F.col("n_shingles") > 0, F.col("a")).alias("set_id")), made


def _component_rows(members: DataFrame, labels: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """(_id, n_shingles, component_id, n_links); without ``degrees`` (node, rows) the last counts the copies only."""
    smallest = members.where("n_shingles > 0").groupBy("a").agg(F.min("_id").alias("least"), F.count("*").alias("copies")).join(
        labels.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    smallest = written(smallest, "jaccard-nodes")
    named = smallest.join(smallest.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("a").alias("node"), "component_id", "copies")
    if degrees is not None:
        named = named.join(degrees, "node", "left").select("node", "component_id", (F.col("copies") + F.coalesce("rows", F.lit(0))).alias("copies"))
    some = F.col("n_shingles") > 0
    return members.join(named, F.col("a") == F.col("node"), "left").select(
        "_id", "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), F.when(some, F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys_each: int = KEYS_EACH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (distinct shingles of five words) and component_id, the smallest id reachable by links.

    Two documents link when their sets' Jaccard similarity is 0.8 or more, so equal sets do. Null and empty texts and texts without words have no shingle and
    link with nothing: their component is their own id. Null ids don't count for the smallest; a class of nothing else has a null one. Rows with equal ids and different texts
    are nodes of their own. An empty table gives no rows; other columns are not read. Shingles are compared as 64-bit hashes.
    """
    members, labels, _ = members_and_classes(docs, id_col, text_col, keys_each)
    return _component_rows(members, labels).select(F.col("_id").alias(id_col), "n_shingles", "component_id")


def components_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys_each: int = KEYS_EACH) -> DataFrame:
    """As ``components``, with n_links: the number of other rows a row links with, copies among them. All pairs of a class are verified."""
    members, labels, sets = members_and_classes(docs, id_col, text_col, keys_each)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    degrees = _class_blocks(source, members, labels, sets).mapInArrow(lambda batches: _linked(batches, False), "node long, rows long").groupBy("node").agg(F.sum("rows").alias("rows"))
    return _component_rows(members, labels, degrees).select(F.col("_id").alias(id_col), "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, of each class the row with the smallest id (then the smallest set number and text hash). Rows without words are in no class and all stay;
    a class with null ids only keeps one of them.

    The choice is made among ids and hashes; whole rows are shuffled once, to meet the chosen (id, hash of the text), and no set is made again for it.
    """
    members, labels, _ = members_and_classes(docs, id_col, text_col)
    rows = members.where("n_shingles > 0").groupBy("a", F.col("_id").alias("i"), "h").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("i").isNull().alias("z"), "i", "a", "h", "n")).alias("f")
    chosen = rows.join(labels, F.col("a") == F.col("node"), "left").groupBy(F.coalesce("root", "a").alias("class")).agg(best).select("f.i", "f.h", "f.n")
    names = docs.columns
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"),
                         F.coalesce(F.col(text_col).rlike(f"[^{SPACES}]"), F.lit(False)).alias("_words"))
    met = source.where("_words").join(written(chosen, "jaccard-chosen"), F.col("_id").eqNullSafe(F.col("i")) & (F.col("_h") == F.col("h")))
    kept = met.where("n = 1").unionByName(met.where("n > 1").dropDuplicates(["_id", "_h"]))  # repeated rows are one
    cells = [F.col(f"_{i}").alias(c) for i, c in enumerate(names)]
    return kept.select(*cells).unionByName(source.where("not _words").select(*cells))
