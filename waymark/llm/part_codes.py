"""Vector code compression: product codes learnt by Lloyd's method over the distinct integer parts of all vectors.

Each component x becomes floor(scale * x) and a vector is cut into equal consecutive parts. Equal parts of a position become one row with its weight
(added up before rows meet, so one part held by a third of all vectors is no hot spot). Rounds go over these distinct rows alone: each is assigned
to the nearest entry of its position's codebook, its components count by weight, and the driver gets parts x entries x components sums.
At the end each distinct part has a code and an error once, which are joined back to the vectors by position and part; a part that many vectors
share is a skewed key of that join, which Spark splits (spark.sql.adaptive.skewJoin).

A part travels as the bytes of the narrowest integers that hold it: equal parts have equal bytes.

Vectors that are null, hold null or non-finite components or have another length than the commonest take no part; neither does anything if that
length can't be cut into equal parts (an error). Ties: the lower entry; among first entries of equal ids the smaller vector. Null ids: coded, never a first entry. Fewer vectors
than entries: as many entries as there are. Repeated rows: each is coded. Null labels count together. Empty table: no rows. Extra columns are left out.
Sums and distances are exact; a component beyond 2^62 or an error beyond a long is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact, finite, integers, matrix, narrow, staged


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; argmin gives the lower of equals."""
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row as the bytes of the narrowest integers that hold it."""
    short, kind = narrow(x)
    if kind == "<i2":
        return pa.Array.from_buffers(pa.binary(2 * x.shape[1]), len(x), [None, pa.py_buffer(short.tobytes())]).cast(pa.binary())
    return pa.array([narrow(part)[0].tobytes() for part in x], pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Parts of `width` components from their bytes, each as narrow as it was stored."""
    raw = column.to_pylist()
    size = np.array([len(r) // width for r in raw])
    out = np.zeros((len(raw), width), np.int64)
    for w in (2, 4, 8):
        own = np.flatnonzero(size == w)
        if len(own):
            out[own] = np.frombuffer(b"".join([raw[i] for i in own]), f"<i{w}").reshape(-1, width)
    return out


def _each_position(batch: pa.RecordBatch, books: list[np.ndarray], width: int):
    """(position, its rows of the batch, their parts, entry, squared distance)."""
    at, parts = batch.column("part").to_numpy(), _unpacked(batch.column("value"), width)
    for p in np.unique(at):
        rows = np.flatnonzero(at == p)
        for low in range(0, len(rows), 4096):
            own = rows[low : low + 4096]
            x, book = exact(parts[own], books[p])
            yield int(p), own, x, *nearest_entries(x, book)


def _learnt(distinct: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after a round of weighted Lloyd."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, own, x, entry, _ in _each_position(batch, books, width):
                w = weight[own].astype(object)
                for e in np.unique(entry):
                    mine = entry == e
                    total = held.setdefault((p, int(e)), [0, [0] * width])
                    total[0] += int(w[mine].sum())
                    total[1] = [a + int(b) for a, b in zip(total[1], (x[mine].astype(object) * w[mine, None]).sum(axis=0), strict=True)]
        flat = [(p, e, -1, Decimal(n)) for (p, e), (n, _) in held.items()] + [(p, e, i, Decimal(v)) for (p, e), (_, s) in held.items() for i, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["part", "entry", "i", "v"])

    got = distinct.mapInArrow(sums, "part int, entry int, i int, v decimal(38,0)").groupBy("part", "entry", "i").agg(F.sum("v").alias("v")).collect()
    found = {(r["part"], r["entry"], r["i"]): int(r["v"]) for r in got}  # parts x entries x (components + 1) numbers
    after = [b.copy() for b in books]
    for (p, e, i), v in found.items():
        if i >= 0:
            after[p][e, i] = v // found[p, e, -1]
    return after


def codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each vector; code: two hexadecimal digits for each part."""
    if entries > 256:
        raise ValueError("a code has two digits, so a codebook has 256 entries at most")
    rows = vectors.where(finite(vector)).select(F.col(key).cast("long").alias("id"), F.col(label).alias("l"), F.col(vector).alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else parts
    if dim % parts or not dim:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    width = dim // parts
    kept = staged(rows.where(F.size("v") == dim).select("id", "l", integers(F.col("v"), scale).alias("v"), F.monotonically_increasing_id().alias("row")), "part-codes")
    first = np.array([r["v"] for r in kept.where("id is not null").orderBy("id", "v").limit(entries).select("v").collect()], object).reshape(-1, dim)  # `entries` vectors
    if not len(first):
        first = np.zeros((1, dim), object)  # no vector has an id; an entry at the origin
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dim, np.int64)
            row = np.repeat(b.column("row").to_numpy(), parts)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.tile(np.arange(parts, dtype=np.int32), len(x))), _bytes(x.reshape(-1, width))], ["row", "part", "value"])

    each = kept.select("row", "v").mapInArrow(cut, "row long, part int, value binary")
    distinct = staged(each.groupBy("part", "value").agg(F.count("*").alias("weight")), "parts")
    for _ in range(rounds):
        books = _learnt(distinct, books, width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for _, own, _, e, d in _each_position(batch, books, width):
                entry[own], error[own] = e, d
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("value"), pa.array(entry), pa.array([int(d) for d in error], pa.int64())], ["part", "value", "entry", "error"])

    final = distinct.select("part", "value").mapInArrow(coded, "part int, value binary, entry int, error long")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))), "")
    joined = each.join(final, ["part", "value"]).groupBy("row").agg(digits.alias("code"), F.sum("error").alias("error"))  # `parts` entries a row
    found = staged(kept.select("row", "id", "l").join(joined, "row").select("id", "l", "code", "error"), "coded")
    by_label = found.groupBy("l").agg(F.sum("error").alias("label_error")).withColumnRenamed("l", "l2")
    text = ",".join(str(v) for book in books for v in book.reshape(-1)) if common else ""
    out = found.join(by_label, F.col("l").eqNullSafe(F.col("l2")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
