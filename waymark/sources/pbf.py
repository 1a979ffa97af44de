"""Map extracts in the binary format (PBF): a Python data source whose tasks are runs of bytes of a file, not files.

A file is a chain of blobs, each behind a small header. A task looks for the first header that starts in its run and follows the chain to the run's end; the driver knows files' lengths alone.
A place counts as a header if its length, kind and size are in order and a header of the same sort, or the end of the file, comes right after its blob."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: its longest header and blob, the features that a reader here knows, kinds of members.
_MOST_HEADER, _MOST_BLOB = 64 * 1024, 32 * 1024 * 1024
_KNOWN = {"OsmSchema-V0.6", "DenseNodes"}
_WAY_MEMBER = 1

#: A data header: four bytes of length, whose first two are naught, then the kind as field 1.
_START = re.compile(rb"(?=\x00[\x00\x01]..\x0a\x07OSMData)", re.DOTALL)

_SCHEMAS = {
    "nodes": "id long, lat double, lng double, tags map<string, string>, edited string",
    "ways": "id long, refs array<long>, tags map<string, string>, edited string",
    "relations": "id long, members array<long>, tags map<string, string>, edited string",
}


# --- messages


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers as they come, unsigned; bytes uncopied would outlive their block, so they are copied."""
    at, end = 0, len(buf)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            if at + size > end:
                raise ValueError("a field ends beyond its message")
            yield number, buf[at : at + size]
            at += size
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
        else:
            raise ValueError(f"no such wire type: {wire}")


def _signed(values: np.ndarray) -> np.ndarray:
    """Zigzag: 0, 1, 2, 3 stand for 0, -1, 1, -2."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned integers of many packed fields in one array, and where each field starts and ends in it."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    offsets = np.concatenate([[0], np.cumsum(last)])[bounds].astype(np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64), offsets
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts), offsets


def _running(deltas: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running sums that start anew with each list."""
    total = np.concatenate([[0], np.cumsum(deltas)])
    return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))


# --- blobs


def _header(head: bytes) -> tuple[str, int]:
    """Kind and size of the blob behind a header."""
    found = dict(_fields(head))
    kind, size = found[1].decode(), found[3]
    if not 0 <= size <= _MOST_BLOB:
        raise ValueError("a blob longer than the format allows")
    return kind, size


def _unpacked(blob: bytes) -> bytes:
    found = dict(_fields(blob))
    size = found.get(2, 0)
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3], bufsize=max(size, 1))
    for number, codec in ((6, "lz4_raw"), (7, "zstd")):
        if number in found:
            return pa.Codec(codec).decompress(found[number], size).to_pybytes()
    raise ValueError(f"a blob packed in a way that isn't known here: fields {sorted(found)}")


def _blobs(file, size: int, start: int, end: int) -> Iterator[tuple[str, bytes]]:
    """(kind, blob) of the blobs whose headers start in [start, end) of a file."""
    held = file.read_at(min(size, end + _MOST_HEADER) - start, start)

    def take(at: int, n: int) -> bytes:
        if at + n > size:
            raise ValueError("the file ends within a blob")
        return held[at - start : at - start + n] if at >= start and at + n <= start + len(held) else file.read_at(n, at)

    def header(at: int) -> tuple[str, int, int]:
        n = int.from_bytes(take(at, 4), "big")
        if not 0 < n <= _MOST_HEADER:
            raise ValueError("no header here")
        kind, length = _header(take(at + 4, n))
        return kind, at + 4 + n, length

    def stands(at: int) -> bool:
        try:
            _, body, length = header(at)
            return body + length == size or bool(header(body + length)[0])
        except (ValueError, KeyError, IndexError, UnicodeDecodeError, AttributeError, TypeError):
            return False

    at = start if start == 0 else next((start + m.start() for m in _START.finditer(held) if start + m.start() < end and stands(start + m.start())), end)
    while at < min(end, size):
        kind, body, length = header(at)
        yield kind, take(body, length)
        at = body + length


# --- blocks


class _Block:
    """One block of objects: its words, and the scale of its places and times."""

    def __init__(self, raw: bytes, keys: tuple[str, ...]):
        self.groups, scale, words = [], {}, []
        for number, value in _fields(raw):
            if number == 1:
                words = [v.decode("utf-8", "replace") for n, v in _fields(value) if n == 1]
            elif number == 2:
                self.groups.append(value)
            else:
                scale[number] = value
        self.words = pa.array(words, pa.string())
        self.step, self.tick = scale.get(17, 100), scale.get(18, 1000)
        self.lat0, self.lng0 = (self._whole(scale.get(n, 0)) for n in (19, 20))
        exact, starts = {k for k in keys if not k.endswith("*")}, tuple(k[:-1] for k in keys if k.endswith("*"))
        self.wanted = np.array([w in exact or bool(starts) and w.startswith(starts) for w in words], bool) if keys else None

    @staticmethod
    def _whole(value: int) -> int:
        return value - (1 << 64) if value >> 63 else value

    def degrees(self, units: np.ndarray, base: int) -> pa.Array:
        return pa.array((base + self.step * units) / 1e9, pa.float64())

    def days(self, stamps: np.ndarray) -> pa.Array:
        days = (stamps * self.tick).astype("datetime64[ms]").astype("datetime64[D]").astype(str)
        return pa.array(days, pa.string(), mask=stamps == 0)

    def tags(self, keys: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Objects that carry none of the wanted keys have an empty map."""
        if self.wanted is not None:
            hits = np.concatenate([[0], np.cumsum(self.wanted[keys])])[offsets]
            counts = np.diff(offsets)
            stay = hits[1:] > hits[:-1]
            mask = np.repeat(stay, counts)
            keys, values, offsets = keys[mask], values[mask], np.concatenate([[0], np.cumsum(np.where(stay, counts, 0))])
        take = lambda at: self.words.take(pa.array(at.astype(np.int64)))
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), take(keys), take(values))

    def dense(self, raw: bytes) -> list[pa.Array]:
        found = dict(_fields(raw))
        column = lambda part: np.cumsum(_signed(_packed([part])[0]))
        ids, lats, lngs = (column(found.get(n, b"")) for n in (1, 8, 9))
        stamps = dict(_fields(found.get(5, b""))).get(2, b"")
        words = _packed([found.get(10, b"")])[0].astype(np.int64)
        # one list for all nodes: key, value, key, value, ..., and a nought after each node; no list at all if none has a tag
        ends = np.flatnonzero(words == 0)
        told = words[words != 0]
        offsets = np.concatenate([[0], (ends - np.arange(len(ends))) // 2]) if len(words) else np.zeros(len(ids) + 1, np.int64)
        when = self.days(column(stamps)) if stamps else pa.nulls(len(ids), pa.string())
        return [pa.array(ids, pa.int64()), self.degrees(lats, self.lat0), self.degrees(lngs, self.lng0), self.tags(told[::2], told[1::2], offsets), when]

    def several(self, raws: list[bytes]) -> tuple[list[dict], pa.Array, pa.Array]:
        """Fields, tags and days of nodes, ways or relations that stand one by one."""
        found = [dict(_fields(raw)) for raw in raws]
        (keys, offsets), (values, _) = (_packed([f.get(n, b"") for f in found]) for n in (2, 3))
        stamps = np.array([dict(_fields(f.get(4, b""))).get(2, 0) for f in found], np.int64)
        return found, self.tags(keys.astype(np.int64), values.astype(np.int64), offsets), self.days(stamps)

    def nodes(self, raws: list[bytes]) -> list[pa.Array]:
        found, tags, when = self.several(raws)
        whole = lambda n: _signed(np.array([f.get(n, 0) for f in found], np.uint64))
        return [pa.array(whole(1), pa.int64()), self.degrees(whole(8), self.lat0), self.degrees(whole(9), self.lng0), tags, when]

    def ways(self, raws: list[bytes]) -> list[pa.Array]:
        found, tags, when = self.several(raws)
        deltas, offsets = _packed([f.get(8, b"") for f in found])
        refs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_running(_signed(deltas), offsets), pa.int64()))
        return [pa.array([self._whole(f[1]) for f in found], pa.int64()), refs, tags, when]

    def relations(self, raws: list[bytes]) -> list[pa.Array]:
        found, tags, when = self.several(raws)
        deltas, offsets = _packed([f.get(9, b"") for f in found])
        way = _packed([f.get(10, b"") for f in found])[0] == _WAY_MEMBER
        kept = np.concatenate([[0], np.cumsum(way)])[offsets]
        members = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(_running(_signed(deltas), offsets)[way], pa.int64()))
        return [pa.array([self._whole(f[1]) for f in found], pa.int64()), members, tags, when]

    def columns(self, kind: str) -> Iterator[list[pa.Array]]:
        """Columns of the objects of a kind, a group's at a time."""
        number, decode = {"nodes": (1, self.nodes), "ways": (3, self.ways), "relations": (4, self.relations)}[kind]
        for group in self.groups:
            alone = []
            for n, value in _fields(group):
                if n == number:
                    alone.append(value)
                elif n == 2 and kind == "nodes":
                    yield self.dense(value)
            if alone:
                yield decode(alone)


# --- the source


@dataclass
class _Run(InputPartition):
    path: str
    size: int
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "nodes")
        self.keys = tuple(k for k in options.get("keys", "").split(",") if k)
        self.run = int(options.get("runBytes", str(16 * 1024 * 1024)))

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".pbf")]
        return [_Run(f.path, f.size, at, min(at + self.run, f.size)) for f in files for at in range(0, f.size, self.run)] or [_Run("", 0, 0, 0)]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.size:
            return
        names = [c.split()[0] for c in re.sub(r"<.*?>", "", _SCHEMAS[self.kind]).split(", ")]
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(partition.path) as file:
            for kind, blob in _blobs(file, partition.size, partition.start, partition.end):
                if kind == "OSMHeader":
                    needs = {v.decode() for n, v in _fields(_unpacked(blob)) if n == 4} - _KNOWN
                    if needs:
                        raise ValueError(f"{partition.path} needs features that aren't known here: {sorted(needs)}")
                elif kind == "OSMData":
                    for columns in _Block(_unpacked(blob), self.keys).columns(self.kind):
                        yield pa.RecordBatch.from_arrays(columns, names)


class OsmPbf(DataSource):
    """Options: path (a file, or a folder of .pbf files, of any file system that Arrow opens), kind (nodes, ways, relations), keys (tags to keep, see read_osm_pbf), runBytes (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_osm_pbf(spark: SparkSession, path: str, keys: tuple[str, ...] = (), run_bytes: int = 16 * 1024 * 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, ways and relations as `read_osm_xml` gives them; objects without tags have an empty map.

    keys: tags that the caller will ask for, `disused:*` for all that start so. Objects with none of them keep their place, refs or members and lose their tags in the reader, so most words never leave it; the others keep all their tags.
    A damaged file fails; a file that needs unknown features is refused."""
    spark.dataSource.register(OsmPbf)
    read = spark.read.format("osm_pbf").option("keys", ",".join(keys)).option("runBytes", str(run_bytes))
    return tuple(read.option("kind", kind).load(path) for kind in ("nodes", "ways", "relations"))
