"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: frames, each with the ids (little-endian unsigned 32-bit) of whole documents; one skippable frame with the index of documents;
one skippable frame with the seek table of the public seekable format (compressed size, size, checksum of each frame). Any zstandard
decoder reads the file as the plain sequence of ids. A reader that wants some documents reads the tail, then only the frames that hold them.
"""

import os
import re
import struct
import uuid

from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import scratch_path, written
from .pieces import CACHE_PIECES, WHITE, PieceCache, in_groups, load_json

TOGETHER = 2_000  # pieces that go through the library as one text
FRAME_IDS = 65_536  # a frame is closed once it holds so many ids; a document is never split
# Fixed values of the seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_END, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class PieceEncoder:
    """Ids of pieces by the tokenizers library, as bytes. Pieces that can stand behind one another go through it together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        spec = load_json(path)
        self.tokenizer = Tokenizer.from_file(path)
        stand_ins = {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
        sizes = {i: len(s) for s, i in spec["model"]["vocab"].items()} | stand_ins  # one character of a symbol is one byte
        self.sizes = np.zeros(max(sizes) + 1, dtype=np.int64)
        self.sizes[list(sizes)] = list(sizes.values())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, pieces: list[str]) -> list[bytes]:
        joined, alone = [], []
        for p in pieces:
            (joined if p[0] in WHITE_SET and p[-1] not in WHITE_SET else alone).append(p)
        out = {p: np.array(ids, dtype="<u4").tobytes() for p, ids in zip(alone, self.encode(alone))}
        for at in range(0, len(joined), 20_000):
            some = joined[at:at + 20_000]
            ids = np.array(list(chain.from_iterable(self.encode(["".join(some[i:i + TOGETHER]) for i in range(0, len(some), TOGETHER)]))), dtype="<u4")
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in some), np.int64, len(some)))
            ends = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            out.update((p, raw[start:end]) for p, start, end in zip(some, [0, *ends], ends))
        return [out[p] for p in pieces]


WHITE_SET = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))


@lru_cache(maxsize=2)
def _cache(path: str, most: int) -> PieceCache:
    return PieceCache(PieceEncoder(path), most)


def encode_texts(texts: Iterable[str | None], path: str, cached: int = CACHE_PIECES):
    """The ids of each text as bytes, in order; null and empty texts have none. The process keeps the ids of about ``cached`` pieces."""
    cache = _cache(path, cached)
    for group in in_groups(texts):
        for values in cache.values(group):
            yield b"".join(values)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes one file; it appears under its name only when whole, so a repeated task replaces it by the same bytes."""

    def __init__(self, path: str):
        import zstandard

        self.fs, self.path = _filesystem(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frames, self.docs, self.open, self.size = [], [], [], 0
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.size += len(ids)
        self.n_ids += len(ids) // 4
        if self.size >= 4 * FRAME_IDS:
            self._close_frame()

    def _close_frame(self) -> None:
        import xxhash

        plain = b"".join(self.open)
        if len(plain) >= 2**32:
            raise ValueError("a frame of 4 GB or more can't be entered in the seek table")
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        index = self.zstd.compress(np.array(self.docs, dtype=INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(index) + 4) + index + struct.pack("<I", len(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_END))
        self.out.close()
        self.fs.move(self.temporary, self.path)


INDEX = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n", "<u4"), ("frame", "<u4")])


def read_file(path: str, wanted=None):
    """(doc_id, position in the file, ids) of the file's documents in order; with ``wanted`` (a set of ids) only of those.

    Frames without a wanted document are not read. A frame whose checksum differs raises ValueError.
    """
    import xxhash
    import zstandard

    fs, name = _filesystem(path)
    with fs.open_input_file(name) as f:
        end = f.size()
        f.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_END:
            raise ValueError(f"{path} has no seek table")
        table_at = end - 9 - 12 * count - 8
        f.seek(table_at + 8)
        frames = np.frombuffer(f.read(12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        f.seek(table_at - 4)
        size = struct.unpack("<I", f.read(4))[0]
        f.seek(table_at - 4 - size)
        unpack = zstandard.ZstdDecompressor()
        docs = np.frombuffer(unpack.decompress(f.read(size)), dtype=INDEX)
        starts = np.concatenate(([0], np.cumsum(docs["n"].astype(np.int64))))
        offsets = np.concatenate(([0], np.cumsum(frames[:, 0])))
        before = np.concatenate(([0], np.cumsum(frames[:, 1] // 4)))
        take = np.ones(len(docs), bool) if wanted is None else np.isin(docs["doc_id"], list(wanted)) & (docs["null"] == 0)
        held, plain = -1, b""
        for i in np.flatnonzero(take):
            k = int(docs["frame"][i])
            if k != held:
                f.seek(int(offsets[k]))
                plain = unpack.decompress(f.read(int(frames[k, 0])))
                if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != frames[k, 2]:
                    raise ValueError(f"frame {k} of {path} is damaged")
                held = k
            at = int(starts[i] - before[k])
            yield None if docs["null"][i] else int(docs["doc_id"][i]), int(starts[i]), np.frombuffer(
                plain, dtype="<u4", count=int(docs["n"][i]), offset=4 * at)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text", cached: int = CACHE_PIECES) -> DataFrame:
    """Encodes every whole text, appends ``end_id``, writes files in ascending id order (null first) and returns their list:
    file, position, n_docs, n_ids, start (ids in all files before it).

    Ids must be integers. Null and empty texts are one end id. Rows with equal ids lie in the order of their texts' hashes, equal rows
    next to each other. An empty table makes no files. Documents are dealt into ranges of (id, hash of text), so an id that a third of the rows share is split;
    a task holds one frame, and its worker the ids of about ``cached`` pieces. ``folder`` is a shared folder (default: a new one in spark.checkpoint.dir). Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    order = ["_id", "_hash"]
    dealt = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches):
        writer, at = None, TaskContext.get().partitionId()
        name = f"{folder}/tokens-{at:06d}.zst"
        end = struct.pack("<I", end_id)
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = FrameWriter(name)
            ids, texts = batch.column(0).to_pylist(), (t.as_py() for t in batch.column(2))  # texts become Python objects a group at a time
            for doc_id, own in zip(ids, encode_texts(texts, vocabulary, cached), strict=True):
                writer.add(doc_id, own + end)
            pa.default_memory_pool().release_unused()  # what this and earlier stages left in the worker
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([len(writer.docs)], pa.int64()),
                                              pa.array([writer.n_ids], pa.int64())], ["file", "position", "n_docs", "n_ids"])

    files = written(dealt.mapInArrow(write, "file string, position long, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """One row per document of the listed files: doc_id, start (ids of all documents before it), n_tokens, ids, file.

    ``wanted``: a short list of ids; only the frames that hold them are decompressed.
    """
    keep = None if wanted is None else set(wanted)

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                for doc_id, at, ids in read_file(file, keep):
                    rows.append((doc_id, start + at, len(ids), ids, file))
                    size += len(ids)
                    if size >= 1_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    n = max(1, files.count())
    dealt = files.select("file", "start").repartition(min(n, 8 * files.sparkSession.sparkContext.defaultParallelism), "file")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, file string")


def _batch(rows) -> pa.RecordBatch:
    doc_id, start, n, ids, file = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                                       pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(file)],
                                      ["doc_id", "start", "n_tokens", "ids", "file"])


def token_digest(docs: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the files, reads them back and returns per document: doc_id, start, n_tokens, ids_crc32 (unsigned), file.

    Edge cases are those of ``write_token_files``.
    """
    read = read_token_files(write_token_files(docs, vocabulary, folder, **options))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "file")
