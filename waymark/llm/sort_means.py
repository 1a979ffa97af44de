"""Centroid clustering by sort-means, on integer vectors, so that every sum and every distance is exact.

Each component x becomes floor(scale * x). A round orders, for every centroid, the other centroids by their distance from it; a vector scans that
order from the centroid that it had before and stops at the first one strictly farther from that centroid than twice the vector is. What lies
beyond can't be nearer (triangle inequality), and at exactly twice the distance it can tie, so the result is that of a full scan.

Vectors are kept in blocks, one row of a table for some thousand vectors: ids, packed components, centroids so far, and the block's sums for
each centroid. A round reads blocks and writes blocks, then adds up the sums alone (the other columns aren't read again); the driver gets
k x dim sums, whatever the table's size. The table of the round before is removed; a lost executor costs the tasks that it held.

Vectors that are null, of another length than `dim`, or with null or non-finite components take no part. Ties: the smaller centroid; among first
centroids of equal hash (repeated ids) the smaller vector. Null ids: clustered, but never a first centroid. Fewer than k vectors with an id: as many centroids
as there are. Repeated rows count each. Empty table: no rows. Extra columns are left out. Components of any size are summed exactly; a component beyond 2^62 or a
distance beyond a long is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, finite, integers, matrix, narrow, remove, shared_folder

BLOCK = "ids array<long>, x binary, width string, of binary, far array<long>, sums array<struct<c:int,s:array<decimal(38,0)>>>"


def scan_orders(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, apart): for each centroid all centroids by distance from it, itself first, and their squared distances in that order."""
    apart = ((centres[:, None] - centres[None]) ** 2).sum(axis=2)
    k = len(centres)
    order = np.array([sorted(range(k), key=lambda c: (c != a, apart[a, c], c)) for a in range(k)], int).reshape(k, k)
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(x: np.ndarray, centres: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row of x, scanned from the centroid that it had before."""
    order, apart = scan_orders(centres)
    first = ((x - centres[before]) ** 2).sum(axis=1)
    best, far, open_ = before.copy(), first.copy(), np.arange(len(x))
    for step in range(1, len(centres)):
        open_ = open_[(apart[before[open_], step] <= 4 * first[open_]).astype(bool)]
        if not len(open_):
            break
        other = order[before[open_], step]
        d = ((x[open_] - centres[other]) ** 2).sum(axis=1)
        better = ((d < far[open_]) | ((d == far[open_]) & (other < best[open_]))).astype(bool)
        best[open_[better]], far[open_[better]] = other[better], d[better]
    return best, far


def _packed(ids: pa.Array, x: np.ndarray, of: np.ndarray, far: np.ndarray | None) -> pa.RecordBatch:
    """A block, with what its vectors add to each centroid: their number, squared distances and components."""
    sums = []
    for c in np.unique(of):
        own = of == c
        inertia = 0 if far is None else int(far[own].sum(dtype=object))
        sums.append({"c": int(c), "s": [Decimal(int(v)) for v in (own.sum(), inertia, *x[own].sum(axis=0))]})
    x, width = narrow(x)
    put = [[ids.to_pylist()], [x.tobytes()], [width], [of.astype(np.int32).tobytes()], [None if far is None else [int(d) for d in far]], [sums]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(put, _TYPES, strict=True)], _NAMES)


_SUM = pa.struct([("c", pa.int32()), ("s", pa.list_(pa.decimal128(38, 0)))])
_NAMES = ["ids", "x", "width", "of", "far", "sums"]
_TYPES = [pa.list_(pa.int64()), pa.binary(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(_SUM)]


def _assigned(blocks: DataFrame, centres: list[list[int]], dim: int, last: bool) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centres, object).reshape(-1, dim)
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a block
                x = np.frombuffer(batch.column("x")[i].as_py(), batch.column("width")[i].as_py()).reshape(-1, dim).astype(np.int64)
                before = np.frombuffer(batch.column("of")[i].as_py(), np.int32).astype(np.int64)
                a, b = exact(x, middle)
                of, far = nearest(a, b, before)
                yield _packed(batch.column("ids")[i].values, a, of, far if last else None)

    return blocks.mapInArrow(go, BLOCK)


def _gathered(blocks: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """centroid: (vectors, inertia, sums of components); k x dim numbers reach the driver."""
    each = blocks.select(F.explode("sums").alias("s")).select("s.c", F.posexplode("s.s").alias("p", "v"))
    found: dict[int, dict[int, int]] = {}
    for r in each.groupBy("c", "p").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["c"], {})[r["p"]] = int(r["v"])
    return {c: (s[0], s[1], [s[p] for p in range(2, len(s))]) for c, s in found.items()}


def clusters(vectors: DataFrame, first: Column, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, key: str = "vec_id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector. first: text whose order picks the first k centroids; null: never."""
    spark: SparkSession = vectors.sparkSession
    rows = vectors.where(finite(vector) & (F.size(vector) == dim)).select(F.col(key).cast("long").alias("id"), integers(F.col(vector), scale).alias("v"), first.alias("o"))
    start = [list(r["v"]) for r in rows.where("o is not null").orderBy("o", "v").limit(k).select("v").collect()]  # k vectors
    folder = f"{shared_folder(spark)}/sort-means-{uuid.uuid4().hex}"

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                b = whole.slice(at, block_rows)
                x = matrix(b.column("v"), dim, np.int64)
                yield _packed(b.column("id"), exact(x)[0], np.zeros(len(x), np.int32), None)

    def kept(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{folder}/{step}")
        remove(spark, f"{folder}/{step - 1}")
        return spark.read.schema(BLOCK).parquet(f"{folder}/{step}")

    blocks, centres = kept(rows.select("id", "v").mapInArrow(block, BLOCK), 0), start
    found: dict[int, tuple[int, int, list[int]]] = {}
    if centres:
        for step in range(1, rounds + 2):
            blocks = kept(_assigned(blocks, centres, dim, step > rounds), step)
            found = _gathered(blocks)
            if step <= rounds:
                centres = [[s // found[c][0] for s in found[c][2]] if c in found else own for c, own in enumerate(centres)]
    else:
        blocks = blocks.limit(0)
    total = sum(f[1] for f in found.values())
    per = lambda make, kind: F.array(*[F.lit(make(c)).cast(kind) for c in range(len(centres))]) if centres else F.array().cast(f"array<{kind}>")
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                of = pa.array(np.frombuffer(b.column("of")[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, of, b.column("far")[i].values], [key, "cluster", "distance"])

    out = blocks.select("ids", "of", "far").mapInArrow(each, f"`{key}` long, cluster int, distance long")
    inertias = F.get(per(lambda c: found.get(c, (0, 0))[1], "long"), F.col("cluster"))
    return out.select(key, "cluster", "distance", inertias.alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), F.get(per(digest, "string"), F.col("cluster")).alias("centroid_sha256"))
