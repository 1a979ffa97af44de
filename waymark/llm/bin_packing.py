"""Best-fit packing by minimum bin slack.

All pieces are at most `capacity` long, so their lengths make a histogram of at most `capacity` numbers, whatever their count. On it the
driver repeats: a bitset subset-sum over the lengths still there finds the fullest feasible bin; that combination is taken as often as the
counts allow, and removed. Each length so gets a list of runs "the next r pieces of this length go to place q of bins b, b+1, ...",
at most a few thousand in all. Pieces are numbered within their length in two steps (numbers within salted groups, then the groups'
starts), so a very common length never meets in one task, and joined with the runs.

Null or empty text: the end id alone, one piece. Repeated rows: packed each. Empty table: no pieces. Extra columns of docs: left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_tokens import encoder
from .common import blocks, give_back, spare, staged, text_of


#: Matches that the encoder of a packing worker remembers within a task.
REMEMBER = 200_000
#: Bytes of text that it is given at once; of twice as much it needs twice the room, beside workers that other stages of a pipeline left behind.
BLOCK = 2 << 20


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, capacity: int, text: str = "text", key: str = "doc_id", short_first: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's ids with the end id, cut only where longer than capacity. One piece may be shorter: the last, or with short_first the first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = encoder(vocabulary, pattern, REMEMBER), np.array([end_id], "<u4").tobytes()
        for part in blocks(batches, "__t", BLOCK):
            rows: list[tuple] = []
            for d, raw in enumerate(codec.encode(part.column(1).to_pylist())):
                raw += end
                ends = range(len(raw) % (4 * capacity) or 4 * capacity, len(raw) + 1, 4 * capacity) if short_first else [*range(4 * capacity, len(raw), 4 * capacity), len(raw)]
                rows += [(d, k, at // 4, (to - at) // 4, zlib.crc32(raw[at:to])) for k, (at, to) in enumerate(zip([0, *ends], ends, strict=False))]
            of, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], [key, "piece", "start", "length", "ids_crc32"])
        codec.forget()  # a worker is kept while the other stages of a pipeline run
        give_back()

    rows = docs.select(key, text_of(text).alias("__t"))
    return rows.mapInArrow(cut, f"{key} {rows.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, first: int, capacity: int) -> list[int]:
    """Lengths of the fullest bin that holds one piece of length `first`, by subset sums as bits of one integer; longer pieces are preferred."""
    room, full = capacity - first, (1 << (capacity - first + 1)) - 1
    left = counts.copy()
    left[first] -= 1
    reach, steps = 1, []
    for n in range(min(room, first), 0, -1):
        many, size = int(min(left[n], room // n)), 1
        while many and not reach >> room & 1:  # counts by powers of two
            take = min(size, many)
            steps.append((n, take, reach))
            reach |= reach << (n * take) & full
            many, size = many - take, size * 2
        if reach >> room & 1:
            break
    best = (reach & full).bit_length() - 1
    out = [first]
    for n, take, before in reversed(steps):
        if not before >> best & 1:
            out += [n] * take
            best -= n * take
    return out


def runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, first bin, offset, how many): pieces first.. of a length go to bins first.. at an offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    used, out, bins = np.zeros(capacity + 1, np.int64), [], 0
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        chosen = fullest(counts, longest, capacity)
        need = np.bincount(chosen, minlength=capacity + 1)
        times = int(min(counts[n] // need[n] for n in set(chosen)))
        offset = 0
        for n in chosen:
            out.append((n, int(used[n]), bins, offset, times))
            used[n] += times
            counts[n] -= times
            offset += n
        bins += times


#: Pieces of one length to a task, about.
GROUP = 1 << 20


def pack(pieces: DataFrame, capacity: int, salt: list[str], groups: int | None = None) -> DataFrame:
    """pieces (with length) with sequence_id and offset, which replace columns of those names; other columns pass through, whatever they are called. salt: columns that tell most pieces apart. Groups grow with the pieces; of their counts only the histogram of lengths reaches the driver."""
    own, extra = pieces.columns, {n: spare(pieces.columns, n) for n in ("__g", "__n", "__k", "__before", "firsts", "bins", "offsets")}
    stored = staged(pieces.drop("sequence_id", "offset"), "pieces")
    groups = groups or 64 + stored.count() // GROUP
    kept = stored.withColumn(extra["__g"], F.pmod(F.xxhash64(*salt), F.lit(groups)).cast("int"))
    counted = staged(kept.groupBy("length", extra["__g"]).count(), "counts")
    histogram = {n: c for n, c in counted.groupBy("length").agg(F.sum("count")).collect()}  # at most capacity rows
    starts_of = counted.select("length", extra["__g"], (F.sum("count").over(Window.partitionBy("length").orderBy(extra["__g"])) - F.col("count")).alias(extra["__before"]))
    spark = pieces.sparkSession
    table = sorted(runs(histogram, capacity))
    # for each length, its runs in order of first number, for a search within the row; at most `capacity` rows
    by: dict[int, list] = {}
    for n, first, at, offset, times in table:
        by.setdefault(n, []).append((first, at, offset, times))
    runs_of = spark.createDataFrame([(n, [x[0] for x in r], [x[1] for x in r], [x[2] for x in r]) for n, r in by.items()], f"length long, {extra['firsts']} array<long>, {extra['bins']} array<long>, {extra['offsets']} array<long>")
    number = F.row_number().over(Window.partitionBy("length", extra["__g"]).orderBy(*salt))
    placed = kept.join(starts_of, ["length", extra["__g"]]).withColumn(extra["__n"], number - 1 + F.col(extra["__before"]))
    placed = placed.join(F.broadcast(runs_of), "length")
    # the last run that starts at or before the number
    k = F.size(F.filter(extra["firsts"], lambda f: f <= F.col(extra["__n"]))) - 1
    placed = placed.withColumn(extra["__k"], k)
    found = {"sequence_id": F.get(extra["bins"], F.col(extra["__k"])) + F.col(extra["__n"]) - F.get(extra["firsts"], F.col(extra["__k"])), "offset": F.get(extra["offsets"], F.col(extra["__k"]))}
    return placed.withColumns(found).select(*[c for c in own if c.lower() not in ("sequence_id", "offset")], "sequence_id", "offset")
