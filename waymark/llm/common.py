"""What several operators of this subpackage share: words, blocks of documents, spare names; tables kept in the shared folder come from the library."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from waymark.operators.staging import connected_components, shared_folder, staged  # noqa: F401  (used throughout this subpackage)

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def spare(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it (column names count without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def strings(column: pa.Array) -> list[str]:
    """The column's strings, without nulls, as a list; its to_pylist makes an object of Arrow's for each first, which takes ten times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def distinct(x: np.ndarray) -> np.ndarray:
    """The numbers without repeats, ascending. np.unique fills a hash table first, which takes many times as long as a sort."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, ascending; the place of each of x among them)."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(x)]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 64-bit hashes, in order (wraps around)."""
    x = (a ^ (a >> np.uint64(32))) * _GOLD + (b ^ _STEP)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each text). A-Z count as a-z; null counts as empty."""
    import xxhash

    # taken anew first: pyarrow 23's ascii_lower misreads some slices
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))
    words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    coded = words.dictionary_encode()
    table = strings(coded.dictionary)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in table), np.uint64, len(table))
    codes = coded.indices.to_numpy()
    if "" in table:
        keep = codes != table.index("")
        codes, of = codes[keep], of[keep]
    return hashed[codes], np.bincount(of, minlength=len(texts))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: a worker that Spark keeps for its next task otherwise holds the most that it ever had."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each block have about most_bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at] - size[at]
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            pa.default_memory_pool().release_unused()
            yield batch.slice(at, to - at)
            at = to
    give_back()


# --- vectors


def finite(vector: str):
    """True where the vector and all its components are there and finite."""
    return F.coalesce(F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def integers(vector, scale: int):
    """array<long> of floor(scale * x), x as double; an error beyond 2^62."""
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is beyond 2^62 after scaling")).cast("long")))


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """An Arrow array of lists of `dim` numbers, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The integer matrices as int64 where no squared distance or sum of theirs can pass it, else as Python's integers."""
    dim = max((p.shape[-1] for p in parts), default=1)
    small = all(not p.size or max(abs(int(p.max())), abs(int(p.min()))) ** 2 * 4 * dim < 2**62 for p in parts)
    return [p.astype(np.int64 if small else object) for p in parts]


def narrow(x: np.ndarray) -> tuple[np.ndarray, str]:
    """x in the narrowest of int16, int32 and int64 that holds it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    width = next(w for w in ("<i2", "<i4", "<i8") if np.iinfo(w).min <= low and high <= np.iinfo(w).max)
    return x.astype(width), width


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of tables that are no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
