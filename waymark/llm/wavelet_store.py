"""Token ids as wavelet-matrix files: one compressed file for each shard, with token access, counting and occurrence lookup.

Documents are range-partitioned by id and sorted, so files follow ascending ids. A task cuts its documents into shards of about
`shard_tokens` ids (a longer document stands alone) and writes each as one file, by a name fixed by partition and number, through a
move; a task run again writes the same. Ids of all documents before a file come from the sum over partitions, stored as Parquet beside the files.

File: magic, JSON header, then zstd-compressed parts: document ids, their null marks, token counts, and the bit-planes. A position's rank is
a popcount over its plane; running counts for each 512 bits are rebuilt on opening.

A document longer than a shard is a shard of its own. Null or empty text: the end id alone. Null ids: sort first. Repeated rows: stored each, side by side. Empty table: no files, no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_tokens import BLOCK, encoder
from .common import blocks, shared_folder, text_of

MAGIC = b"WVM1"


class WaveletMatrix:
    """A sequence of unsigned ids as bit-planes, most significant first; each plane holds the order that the one before left."""

    def __init__(self, planes: list[np.ndarray], length: int) -> None:
        """planes: packed bits, a multiple of 64 bytes each."""
        self.planes, self.n, self.bits = planes, length, len(planes)
        self.before = [np.concatenate([[0], np.cumsum(np.bitwise_count(p.reshape(-1, 64)).sum(axis=1, dtype=np.int64))]) for p in planes]
        self.zeros = [length - int(b[-1]) for b in self.before]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32  # half as much to move
        planes, x = [], np.ascontiguousarray(ids, kind)
        for b in range(bits - 1, -1, -1):
            bit = (x & kind(1 << b)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 64, np.uint8)]))
            x = np.concatenate([np.compress(~bit, x), np.compress(bit, x)])
        return cls(planes, len(ids))

    def rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, np.int64)
        out = self.before[level][at >> 9].copy()
        plane = self.planes[level]
        for k, p in enumerate(at.tolist()):
            start = (p >> 9) << 6
            out[k] += int.from_bytes(plane[start : p >> 3].tobytes(), "little").bit_count() + ((int(plane[p >> 3]) & ((1 << (p & 7)) - 1)).bit_count() if p & 7 else 0)
        return out

    def access(self, at: int) -> int:
        """The id at a position."""
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at >> 3]) >> (at & 7) & 1
            ones = int(self.rank1(level, np.array([at]))[0])
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self.rank1(level, np.array([lo, hi])).tolist()
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id; -1 if there is none."""
        lo, hi = self._range(token, 0, self.n)
        if k >= hi - lo:
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            nth = at - self.zeros[level] if one else at  # the nth one (or zero) of this plane
            counts = self.before[level] if one else np.arange(len(self.before[level])) * 512 - self.before[level]
            block = int(np.searchsorted(counts, nth, side="right")) - 1
            found = np.unpackbits(self.planes[level][block * 64 : block * 64 + 64], bitorder="little")
            at = block * 512 + int(np.flatnonzero(found == one)[nth - int(counts[block])])
        return at

    def all(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[~bit] = x[: self.zeros[level]]
            back[bit] = x[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            x = back
        return x.astype(np.uint32)


def pack(docs: np.ndarray, missing: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, **header) -> bytes:
    """One shard as a file's bytes."""
    import zstandard

    matrix = WaveletMatrix.build(ids, bits)
    parts = [zstandard.compress(x.tobytes(), 1) for x in (docs.astype("<i8"), missing.astype(np.uint8), lengths.astype("<i8"), *matrix.planes)]
    head = json.dumps(header | {"docs": len(docs), "tokens": len(ids), "bits": bits, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts)


def unpack(data: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """(header, document ids, null marks, token counts, matrix) of a file's bytes."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    size = int.from_bytes(data[4:8], "little")
    head, at, parts = json.loads(data[8 : 8 + size]), 8 + size, []
    for n in head["parts"]:
        parts.append(zstandard.decompress(data[at : at + n]))
        at += n
    docs, missing, lengths = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8).astype(bool), np.frombuffer(parts[2], "<i8")
    return head, docs, missing, lengths, WaveletMatrix([np.frombuffer(p, np.uint8) for p in parts[3:]], head["tokens"])


def located(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself resolves it: settled once, so that tasks and readers mean the same place."""
    if ":/" in folder:
        return folder if "://" in folder else folder.replace(":/", ":///", 1)
    base = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"{base.rstrip('/')}{folder}" if not base.startswith("file:") else f"file://{folder}"


def write_shards(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id", bits: int = 16, shard_tokens: int = 1 << 21) -> str:
    """Encodes all texts, appends end_id to each and writes the files in ascending order of the integer key; returns their folder."""
    folder = located(docs.sparkSession, folder or f"{shared_folder(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{path}/shards")
        partition, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end, held, tokens, shard, before = np.array([end_id], "<u4").tobytes(), [], 0, 0, 0

        def flush() -> None:
            nonlocal held, tokens, shard, before
            lengths = np.array([len(i) // 4 for _, i in held])
            ids = np.frombuffer(b"".join(i for _, i in held), "<u4")
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"ids need more than {bits} bits")
            data = pack(np.array([d or 0 for d, _ in held]), np.array([d is None for d, _ in held]), lengths, ids, bits, partition=partition, shard=shard, before=before)
            name = f"{path}/shards/part-{partition:06d}-{shard:05d}.wvm"
            with store.open_output_stream(f"{path}/shards/.{partition}-{shard}-{attempt}") as out:
                out.write(data)
            store.move(f"{path}/shards/.{partition}-{shard}-{attempt}", name)
            held, before, tokens, shard = [], before + tokens, 0, shard + 1

        codec = encoder(vocabulary, pattern)
        for b in blocks(batches, "t", BLOCK):
            for d, ids in zip(b.column("d").to_pylist(), codec.encode(b.column("t").to_pylist()), strict=True):
                held.append((d, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= shard_tokens:
                    flush()
        if held:
            flush()
        if before:
            yield pa.RecordBatch.from_pydict({"partition": pa.array([partition], pa.int32()), "tokens": pa.array([before], pa.int64()), "shards": pa.array([shard], pa.int32())})

    rows = docs.select(F.col(key).cast("long").alias("d"), text_of(text).alias("t"))
    parts = rows.repartitionByRange(F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), "t").mapInArrow(write, "partition int, tokens long, shards int")
    parts.write.parquet(f"{folder}/partitions")
    return folder


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of all files in a folder; start: ids of all documents before."""
    return _read(spark, folder, "start long, ids array<int>", lambda s, n, at, raw: [pa.array(s, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([at, [at[-1] + n[-1]]]), pa.int32()), pa.array(raw.astype(np.int32)))])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all files in a folder: ids decoded in the tasks, as little-endian unsigned 32-bit integers."""

    def columns(s, n, at, raw) -> list[pa.Array]:
        view = memoryview(raw.astype("<u4").tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
        return [pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]

    return _read(spark, folder, "start long, n_tokens long, ids_crc32 long", columns)


def _read(spark: SparkSession, folder: str, schema: str, columns) -> DataFrame:
    totals = spark.read.schema("partition int, tokens long, shards int").parquet(f"{folder}/partitions").groupBy("partition").agg(F.max("tokens").alias("tokens"), F.max("shards").alias("shards"))
    # one row for each task that wrote: as many as partitions, whatever the number of documents
    before, base, shards = {}, 0, 0
    for p, n, k in totals.orderBy("partition").collect():
        before[p], base, shards = base, base + n, shards + k
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                head, docs, missing, lengths, matrix = unpack(data.as_py())
                at = np.cumsum(lengths) - lengths
                start = before[head["partition"]] + head["before"] + at
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=missing), *columns(start, lengths, at, matrix.all())], names)

    if not before:
        return spark.createDataFrame([], f"doc_id long, {schema}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(f"{folder}/shards")
    if (there := files.select("path").count()) != shards:  # paths alone: nothing is read
        raise RuntimeError(f"{folder} has {there} of {shards} shards: the tasks that wrote them and this reader don't share it")
    return files.select("content").mapInArrow(read, f"doc_id long, {schema}")
