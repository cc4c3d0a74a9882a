"""Words and word windows of many texts as flat numpy arrays of 64-bit hashes.

A word's hash is a sum over its bytes of a random number for the byte times a random odd number for its place, mixed at the end. Two different words
have equal hashes with a chance of about 2**-63; nothing here depends on the worker or the run.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_random = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _random.integers(1, 2**64, size=256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]  # A-Z count as a-z


def _separators(codes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


WORDS = _separators(SPACE_BYTES)  # words are runs of anything but ASCII white space
TOKENS = _separators(c for c in range(128) if not chr(c).isalnum())  # words are ASCII letters, digits and what lies beyond ASCII
_PLACES = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    """The factors of the first n places in a word."""
    global _PLACES
    if n > len(_PLACES):
        _PLACES = mix(np.arange(1, 2 * n + 1, dtype=np.uint64)) | np.uint64(1)
    return _PLACES


def _hash_chunk(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start positions) of the words in a chunk that cuts no word."""
    space = gap[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    inside = np.flatnonzero(~space)
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside)) - np.repeat(offsets, lengths)
    values = _LOWER[data[inside]] * _places(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, offsets)), starts


def word_hashes(texts: pa.Array, gap: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text). Words are runs of bytes that ``gap`` doesn't mark; A-Z count as a-z.
    Null has none. Memory beyond the result is bounded by a chunk or the longest word."""
    texts = texts.cast(pa.large_binary()) if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    valid = np.ones(len(texts), bool) if texts.null_count == 0 else texts.is_valid().to_numpy(zero_copy_only=False)
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    group, size = [], 0

    def flush():
        # a space between texts, so that words don't run together
        parts, bounds, at = [], [], 0
        for i in group:
            parts += [data[offsets[i]:offsets[i + 1]], np.array([0x20], np.uint8)]
            at += int(offsets[i + 1] - offsets[i]) + 1
            bounds.append(at)
        h, starts = _hash_chunk(np.concatenate(parts), gap)
        hashes.append(h)
        counts[group] = np.diff(np.searchsorted(starts, bounds), prepend=0)

    for i in range(len(texts)):
        length = int(offsets[i + 1] - offsets[i])
        if not valid[i] or not length:
            continue
        if length > CHUNK_BYTES:
            if group:
                flush()
                group, size = [], 0
            own = data[offsets[i]:offsets[i + 1]]
            at, n = 0, 0
            while at < length:
                end = min(length, at + CHUNK_BYTES)
                while end < length and not gap[own[end]]:  # on to the end of the word
                    ahead = np.flatnonzero(gap[own[end:end + CHUNK_BYTES]])
                    end = end + int(ahead[0]) if len(ahead) else min(length, end + CHUNK_BYTES)
                h, _ = _hash_chunk(own[at:end], gap)
                hashes.append(h)
                n, at = n + len(h), end
            counts[i] = n
            continue
        group.append(i)
        size += length
        if size >= CHUNK_BYTES:
            flush()
            group, size = [], 0
    if group:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def windows(hashes: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``places`` (from 0) of the window that starts at each word; windows that pass the end of the array are left out."""
    n = len(hashes) - places[-1]
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for p in places:
        out = (out ^ hashes[p:p + len(out)]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def small_batches(batches, text_column: int, most: int = 4 * CHUNK_BYTES):
    """Batches cut so that the texts of each are about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_beginnings(texts: pa.Array, gap: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each word and of its first ``lengths`` bytes, 0 where it is shorter; number of words of each text; first and end character of
    each word in its text). All texts of the array are worked on at once."""
    rows = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.large_binary())]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    data = np.frombuffer(b" ".join([bytes(r) for r in rows]) + b" ", dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    space = gap[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, begins)) if len(rows) else np.zeros(0, np.int64)
    lengths_ = ends - starts
    out = np.zeros((len(starts), 1 + len(lengths)), dtype=np.uint64)
    characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    text_start = np.repeat(begins[:-1], counts)
    spots = np.column_stack([characters[starts], characters[ends]]) - characters[text_start][:, None] if len(starts) else np.zeros((0, 2), np.int64)
    if not len(starts):
        return out, counts, spots
    inside = np.flatnonzero(~space)
    offsets = np.cumsum(lengths_) - lengths_
    place = np.arange(len(inside)) - np.repeat(offsets, lengths_)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[data[inside]] * _places(int(lengths_.max()))[place])))
    out[:, 0] = mix(sums[offsets + lengths_] - sums[offsets])
    for k, n in enumerate(lengths, 1):
        long = np.flatnonzero(lengths_ >= n)
        out[long, k] = mix((sums[offsets[long] + n] - sums[offsets[long]]) ^ np.uint64(k * 0x5851F42D4C957F2D & (1 << 64) - 1))
    return out, counts, spots
