"""Near duplicates among embeddings: coarse inverted lists, residual product codes, table-lookup distances, exact cosines.

Fit: on a sample of at most `sample_rows` distinct unit vectors (smallest hashes) the driver learns coarse centroids and, for each of `parts`
subspaces, a codebook of residuals. Index: all vectors; equal ones of a label are one entry with its number and smallest id. An entry lies in the list of its nearest
centroid as the codes of its residual and the length of what the codes leave out. Search: every entry is also a query. It visits its own list and
each list c whose squared distance exceeds the least by at most 2 r |c - c1| z / sqrt(dim), where r is the distance of unit vectors at the threshold:
with z = sqrt(dim) no linked pair can be missed, with the default z = 2 the share of links found is measured (tests; README). A pair is found if
either of the two visits the other's list. In a list, distances to codes are sums of table lookups; what lies within
r^2 + e^2 + 2 r e s / sqrt(dim) of a code (e: what the code leaves out; s = 4) is compared by exact cosine in double precision.

Lists go by label. Entries and visitors of a list are dealt over parts of about part_rows by hash, and each pair of parts is a task of its own, so
a label or list that holds a third of all rows meets in no task. A task returns, for each of its visitors, how many rows it is linked with, and
edges of one spanning forest, so a group of n near copies gives no n x n rows. Each link is counted once for either side: the visitor counts it, and the
entry counts it there only if it doesn't visit the visitor's list itself.

Vectors that are null, zero, hold null or non-finite components or have another length than the commonest, and rows with a null label or a null id, link with nothing:
n_links 0, component_id their own id, kept (a null id is its own component). Repeated rows are rows of their own, linked with each other.
Empty table: no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, finite, matrix, staged

ROW = "label string, list int, cls long, x binary, codes binary, left double, lists array<int>, times long"


def centroids(data: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's method on a sample."""
    at = data[np.random.default_rng(seed).choice(len(data), min(k, len(data)), replace=False)]
    for _ in range(rounds):
        of = (-2 * data @ at.T + (at**2).sum(axis=1)).argmin(axis=1)
        sums, n = np.zeros_like(at), np.bincount(of, minlength=len(at))
        np.add.at(sums, of, data)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def tame(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square is lost; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)


def encode(residual: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, length of what they leave out) of residuals. books: parts x entries x width."""
    parts, _, width = books.shape
    cut = residual.reshape(len(residual), parts, width)
    codes = np.stack([_squares(cut[:, p], books[p]).argmin(axis=1) for p in range(parts)], axis=1).astype(np.uint8)
    return codes, np.linalg.norm(residual - books[np.arange(parts), codes].reshape(len(residual), -1), axis=1)


def lookups(query: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each query (a residual) to each entry's code: a table of the query's distances to all codebook entries, looked up by code."""
    parts, _, width = books.shape
    cut, out = query.reshape(len(query), parts, width), np.zeros((len(query), len(codes)))
    for p in range(parts):
        out += _squares(cut[:, p], books[p])[:, codes[:, p]]
    return out


def _hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the nodes a[i] and b[i] in `root`, where each node ends at the smallest of its component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, parts: int = 8, entries: int = 256, probe_slack: float = 2.0, code_slack: float = 4.0, sample_rows: int = 16_000, list_rows: int = 800, most_lists: int = 1024, part_rows: int = 20_000,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 5,
) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    fine = finite("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    spark = vectors.sparkSession
    common = rows.where(fine).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    alone = lambda df: df.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return alone(rows)
    dim = common["n"]
    takes = fine & (F.size("v") == dim)
    distinct = staged(rows.where(takes).groupBy("label", "v").agg(F.count("*").alias("times"), F.min("id").alias("low")).withColumn("cls", F.monotonically_increasing_id()), "vectors")
    data = tame(np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v"), "label", "v").limit(sample_rows).select("v").collect()], float))  # sample_rows vectors
    data /= np.linalg.norm(data, axis=1)[:, None]
    coarse = centroids(data, max(1, min(most_lists, distinct.count() // list_rows)), 8, seed)
    cut = np.array_split(np.arange(dim), min(parts, dim))
    wide = max(len(c) for c in cut)
    fill = lambda x: np.concatenate([np.pad(x[:, c], ((0, 0), (0, wide - len(c)))) for c in cut], axis=1)  # noqa: E731  parts of equal width, zeros behind
    left = fill(data - coarse[_squares(data, coarse).argmin(axis=1)])
    learnt = [centroids(left[:, p * wide : (p + 1) * wide], entries, 6, seed + p) for p in range(len(cut))]
    books = np.stack(learnt)
    apart = np.sqrt(_squares(coarse, coarse))
    reach = np.sqrt(2 - 2 * threshold)
    share = lambda slack: min(1.0, slack / np.sqrt(dim))
    store = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"  # as exact as the input
    kept = spark.sparkContext.broadcast((coarse, books, apart))  # at most most_lists centroids, parts x 256 entries

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books, apart = kept.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                raw = matrix(b.column("v"), dim)
                x = tame(raw)
                x /= np.linalg.norm(x, axis=1)[:, None]
                far = _squares(x, coarse)
                own = far.argmin(axis=1)
                seen = far - far[np.arange(len(x)), own][:, None] <= 2 * reach * share(probe_slack) * apart[own]
                codes, over = encode(fill(x - coarse[own]), books)
                put = [b.column("label"), pa.array(own.astype(np.int32)), b.column("cls"), pa.array([r.tobytes() for r in raw.astype(store)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(over), pa.array([np.flatnonzero(s).tolist() for s in seen], pa.list_(pa.int32())), b.column("times")]
                yield pa.RecordBatch.from_arrays(put, ["label", "list", "cls", "x", "codes", "left", "lists", "times"])

    indexed = staged(distinct.select("label", "v", "cls", "times").mapInArrow(index, ROW), "lists")
    # how many parts the entries and the visitors of each list are dealt over; most lists have one of either, and aren't in this table
    many = lambda n: F.ceil(n / part_rows).cast("int")
    sizes = indexed.select("label", F.explode("lists").alias("at"), (F.col("at") == F.col("list")).cast("int").alias("own")).groupBy("label", "at").agg(many(F.sum("own")).alias("down"), many(F.count("*")).alias("across")).where("down > 1 or across > 1")
    sent = indexed.withColumn("at", F.explode("lists")).join(sizes, ["label", "at"], "left").fillna(1, ["down", "across"])
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "cls"), F.greatest(F.lit(1), F.col(n))).cast("int")
    sent = sent.withColumns({"i": part(1, "down"), "j": part(2, "across"), "own": F.col("at") == F.col("list")})
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    last = lambda n: F.greatest(F.lit(0), F.col(n) - 1)
    down = F.transform(F.sequence(F.lit(0), last("down")), lambda i: cell(i, F.col("j")))  # a visitor meets every part of the entries
    across = F.transform(F.sequence(F.lit(0), last("across")), lambda j: cell(F.col("i"), j))  # an entry every part of the visitors
    sent = sent.withColumn("cell", F.explode(F.array_distinct(F.when(F.col("own"), F.concat(down, across)).otherwise(down))))
    sent = sent.select("label", "at", "cell.i", "cell.j", "list", "cls", "x", "codes", "left", "lists", "times", (F.col("own") & (F.col("cell.i") == F.col("i"))).alias("entry"), (F.col("cell.j") == F.col("j")).alias("visitor"))

    def compare(key_, table):
        """Of one pair of parts of a list: the links of each visitor, and what holds its rows together."""
        coarse, books, _ = kept.value
        here = key_[1].as_py()
        raw = tame(np.frombuffer(b"".join(table.column("x").to_pylist()), store).astype(np.float64).reshape(-1, dim))
        unit = raw / np.linalg.norm(raw, axis=1)[:, None]
        entry, visitor = (np.flatnonzero(table.column(c).to_numpy()) for c in ("entry", "visitor"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(raw), -1)
        over, cls, times, lists = (table.column(c).to_numpy() for c in ("left", "cls", "times", "list"))
        goes = table.column("lists").combine_chunks()
        visits = np.zeros((len(raw), len(coarse)), bool)
        visits[np.repeat(np.arange(len(raw)), np.diff(goes.offsets.to_numpy())), goes.flatten().to_numpy()] = True
        limit = (reach + 1e-9) ** 2 + over**2 + 2 * reach * over * share(code_slack)
        counts, root = np.zeros(len(raw), np.int64), np.arange(len(raw))
        for low in range(0, len(visitor), 256):
            q = visitor[low : low + 256]
            query = fill(unit[q] - coarse[here])
            for at in range(0, len(entry), 1024):
                e = entry[at : at + 1024]
                near = lookups(query, books, codes[e]) <= limit[e]
                a, b = np.nonzero(near)
                a, b = q[a], e[b]
                a, b = a[a != b], b[a != b]
                for some in range(0, len(a), 65_536):
                    x, y = a[some : some + 65_536], b[some : some + 65_536]
                    linked = np.einsum("ij,ij->i", raw[x], raw[y]) / (np.linalg.norm(raw[x], axis=1) * np.linalg.norm(raw[y], axis=1)) >= threshold
                    x, y = x[linked], y[linked]
                    met = ~visits[y, lists[x]]  # the entry doesn't come to the visitor's list, so it counts here
                    for one, other in ((x, y), (y[met], x[met])):
                        counts += np.bincount(one, times[other], len(raw)).astype(np.int64)
                    _hooked(root, x, y)
        some = np.flatnonzero((counts > 0) | (root != np.arange(len(root))))
        return pa.table({"cls": cls[some], "n": counts[some], "root": cls[root[some]]})

    found = staged(sent.groupBy("label", "at", "i", "j").applyInArrow(compare, "cls long, n long, root long"), "links")
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "near-vectors")
    classes = distinct.join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    classes = staged(classes, "classes")
    smallest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    told = classes.join(smallest, "root").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = rows.where(takes).join(told, ["label", "v"]).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return linked.unionAll(alone(rows.where(~takes)))
