"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only; texts are never shuffled.

The ring has 2**slice_bits slices. Each shard owns `virtual_nodes` points, each at the start of a slice; a slice belongs to the first point
at or after it, clockwise. A key lies in the slice of its hash. A shard takes the keys of its own slices, in ring order, up to its bound
(row counts at most one apart); keys beyond the bound continue clockwise to the next point whose shard has room. Only the counts
of slices (at most 2**slice_bits small rows) are planned with; rows are then numbered within their slice and cut where the plan says. Rows are numbered
in salted parts of a slice, by their contents and, for equal rows, by their number in the input, so a key that a third of all rows share
never meets in one task; ids, sizes, checksums and salts are kept in the shared folder, so both passes see the same.

Null keys: one slice, cut like any other. Null or empty texts: size 1. Repeated rows: each placed. Empty table: no rows. Extra
columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of


def ring(df_slice, slice_bits: int):
    """The slice of a hashed key: the top bits of its hash, in unsigned order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("key"), df_slice), 64 - slice_bits).cast("int")


def points(spark, shards: int, virtual_nodes: int, slice_bits: int) -> list[tuple[int, int]]:
    """(slice, shard) of all virtual nodes in ring order; a slice that two shards want goes to the smaller. shards x virtual_nodes at most."""
    nodes = spark.range(shards * virtual_nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    placed = nodes.select(F.shiftrightunsigned(F.xxhash64(F.lit("node"), "shard", "copy"), 64 - slice_bits).cast("int").alias("at"), "shard")
    return sorted(map(tuple, placed.groupBy("at").agg(F.min("shard")).collect()))


def plan(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slice, first number, numbers, shard, first slot): where the rows of each slice go. counts: rows of each slice."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slots, out, over = [0] * shards, [], []
    at = [a for a, _ in nodes]

    def take(piece: int, first: int, want: int, shard: int) -> int:
        got = min(want, room[shard])
        if got:
            out.append((piece, first, got, shard, slots[shard]))
            room[shard] -= got
            slots[shard] += got
        return got

    for piece in sorted(counts):  # home shards first
        k = bisect_left(at, piece) % len(nodes)
        if (got := take(piece, 0, counts[piece], nodes[k][1])) < counts[piece]:
            over.append((piece, k, got))
    for piece, k, first in over:  # then clockwise
        while first < counts[piece]:
            k = (k + 1) % len(nodes)
            first += take(piece, first, counts[piece] - first, nodes[k][1])
    return out


#: Rows of one key and text to a part, about.
PART = 1 << 20


def shard(docs: DataFrame, shards: int = 16, virtual_nodes: int = 128, slice_bits: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, home_shard); slots run from 0 without gaps in each shard."""
    spark = docs.sparkSession
    nodes = points(spark, shards, virtual_nodes, slice_bits)
    owner = {s: k for k, (_, s) in enumerate(nodes)}
    if len(owner) < shards:
        raise ValueError("too few virtual nodes: some shard has no point")
    size = F.octet_length(text_of(text)).cast("long") + 1
    keyed = docs.select(F.col(key), size.alias("size"), F.crc32(text_of(text)).alias("text_crc32"), ring(F.col(key), slice_bits).alias("__slice"))
    many = max(8, docs.count() // PART)  # parts of equal rows, so that a part of one key stays bounded whatever the table
    salt = F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(8)) * many + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(many))
    keyed = staged(keyed.withColumn("__salt", salt.cast("long")), "keyed")
    part = keyed.groupBy("__slice", "__salt").count()
    counts = {r[0]: r[1] for r in part.groupBy("__slice").agg(F.sum("count")).collect()}
    at = [a for a, _ in nodes]
    rows = [(*r, nodes[bisect_left(at, r[0]) % len(nodes)][1]) for r in plan(counts, nodes, shards)]
    kinds = {"__slice": pa.int32(), "__first": pa.int64(), "__many": pa.int64(), "shard": pa.int32(), "__slot": pa.int64(), "home_shard": pa.int32()}
    cuts = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=[*kinds]))  # an Arrow table stays in the JVM: no Python worker reads it
    # rows before each part of its slice: a slice has a row here for a million of its rows, or 64
    starts = part.withColumn("__before", F.sum("count").over(Window.partitionBy("__slice").orderBy("__salt")) - F.col("count")).select("__slice", "__salt", "__before")
    number = F.row_number().over(Window.partitionBy("__slice", "__salt").orderBy(key, "text_crc32", "size")) - 1
    numbered = keyed.join(starts, ["__slice", "__salt"]).withColumn("__n", number + F.col("__before"))
    placed = numbered.join(F.broadcast(cuts), "__slice")  # cuts: at most slices + shards + nodes rows
    placed = placed.where((F.col("__n") >= F.col("__first")) & (F.col("__n") < F.col("__first") + F.col("__many")))
    slot = F.col("__slot") + F.col("__n") - F.col("__first")
    return placed.select(key, "size", "text_crc32", "shard", slot.alias("slot"), "home_shard")
