"""Clusters, part codes and near duplicates of embeddings against brute force, on odd rows and on the smallest tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import part_codes, residual_codes, sort_means
from waymark.llm import queries as q

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, distance string, cluster int, row int, l string"


def made(dim, n=120, seed=3):
    """Vectors with groups of near copies, equal rows and ties, and rows that take no part."""
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, dim)) / math.sqrt(dim)
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(base)]
    hub = base[7]
    rows += [(1000 + i, [float(np.float32(x)) for x in hub + rnd.normal(size=dim) * 0.03 / math.sqrt(dim) * (i % 9)], [0, None, 1, 1][i % 4]) for i in range(60)]
    rows += [(2000 + i, [0.5] * dim, 2) for i in range(40)]  # one vector that many rows hold
    rows += [(2000, [0.5] * dim, 2), (2001, [-0.25] * dim, 2)]  # ids that repeat
    odd = [(1, None), (2, [None] + [1.0] * (dim - 1)), (3, [math.nan] * dim), (4, [math.inf] + [0.0] * (dim - 1)), (5, [0.0] * dim), (6, [1.0] * (dim - 1)), (7, []), (None, [0.5] * dim)]
    rows += [(i if i is None else 3000 + i, v, 1) for i, v in odd]
    return [(*r, "text", 5, 6, None) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(made(16), SCHEMA).repartition(5)


def valid(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_means(rows, k, rounds, scale, dim):
    kept = [(r[0], [math.floor(scale * x) for x in r[1]]) for r in valid(rows, dim)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            if own := [v for (_, v), c in zip(kept, of) if c == n]:
                centres[n] = [sum(col) // len(own) for col in zip(*own)]
    last = [near(v) for _, v in kept]
    per = [sum(d for d, c in last if c == n) for n in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, per[c], sum(per), digest[c]) for (i, _), (d, c) in zip(kept, last)), key=repr)


def means(df, dim, k=8, rounds=10, scale=1024, **more):
    hashed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    got = sort_means.clusters(df, hashed, k=k, rounds=rounds, scale=scale, dim=dim, **more)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_means_are_exact(odd):
    assert means(odd, 16, block_rows=7) == brute_means(made(16), 8, 10, 1024, 16)


def test_more_centroids_than_vectors_ties_and_large_components(spark):
    few = [(i, [float(x)] * 2, 0, "", 0, 0, "") for i, x in enumerate([0, 2, 1, 1, -3e6, 5e12])]
    df = spark.createDataFrame(few, SCHEMA.replace("array<float>", "array<double>"))
    for k in (2, 3, 9):
        want = brute_means(few, k, 4, 16, 2)
        if all(r[2] < 2**63 for r in want) and sum(r[2] for r in want) < 2**63:
            assert means(df, 2, k=k, rounds=4, scale=16) == want
    small = df.where("vec_id < 5")
    assert means(small, 2, k=3, rounds=4, scale=16) == brute_means(few[:5], 3, 4, 16, 2)
    assert means(df.limit(0), 2) == []
    assert means(df.where("vec_id = 3"), 2, k=4, rounds=2) == brute_means([few[3]], 4, 2, 1024, 2)


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    centres = np.array([[4], [2], [0], [9]])
    x = np.array([[3], [1], [2], [6], [7]])
    for before in range(4):
        of, far = sort_means.nearest(x, centres, np.full(len(x), before))
        want = [min(((v - c) ** 2, n) for n, c in enumerate([4, 2, 0, 9])) for v in [3, 1, 2, 6, 7]]
        assert list(zip(far.tolist(), of.tolist())) == want


def test_means_on_the_table(spark):
    rows = [tuple(r) for r in q.table(spark, SF, "embeddings").collect()]
    assert sorted((tuple(r) for r in q.op11_sort_means(spark, SF).collect()), key=repr) == brute_means(rows, 8, 10, 1024, 64)


def brute_codes(rows, parts, entries, rounds, scale, dim):
    kept = [(r[0], r[2], [math.floor(scale * x) for x in r[1]]) for r in valid(rows, dim)]
    width = dim // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    first = sorted((i, v) for i, _, v in kept if i is not None)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, c)), n) for n, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(cut(v, p), books[p])[1] for *_, v in kept]
            books[p] = [tuple(sum(c) // len(own) for c in zip(*own)) if (own := [cut(v, p) for (*_, v), e in zip(kept, of) if e == n]) else books[p][n] for n in range(len(first))]
    last = [[near(cut(v, p), books[p]) for p in range(parts)] for *_, v in kept]
    error = [sum(d for d, _ in found) for found in last]
    by = {}
    for (_, label, _), e in zip(kept, error):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{n:02x}" for _, n in found), e, by[label], digest) for (i, label, _), found, e in zip(kept, last, error)), key=repr)


def coded(df, **more):
    return sorted((tuple(r) for r in part_codes.codes(df, **more).collect()), key=repr)


def test_codes_are_exact(odd):
    assert coded(odd, parts=4, entries=16, rounds=6) == brute_codes(made(16), 4, 16, 6, 4096, 16)


def test_codes_of_few_wide_and_no_vectors(spark):
    few = [(i, [float(x), float(-x), 1.0, float(x * x)], None if i % 2 else 4, "", 0, 0, "") for i, x in enumerate([0, 2, 1, 1, -3000, 40000])]
    df = spark.createDataFrame(few, SCHEMA)
    assert coded(df, parts=2, entries=16, rounds=3) == brute_codes(few, 2, 16, 3, 4096, 4)
    assert coded(df, parts=4, entries=2, rounds=3, scale=1) == brute_codes(few, 4, 2, 3, 1, 4)
    assert coded(df.limit(0), parts=2) == []
    with pytest.raises(ValueError, match="equal parts"):
        part_codes.codes(df, parts=3)


def test_codes_on_the_table(spark):
    rows = [tuple(r) for r in q.table(spark, SF, "embeddings").collect()]
    assert sorted((tuple(r) for r in q.op13_part_codes(spark, SF).collect()), key=repr) == brute_codes(rows, 8, 16, 6, 4096, 64)


def brute_near(rows, dim, threshold):
    """(id, links, component, kept) of each row, and the pairs of rows that are linked."""
    fine = [n for n, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([rows[n][1] for n in fine])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([rows[n][2] for n in fine])
    links = (x @ x.T >= threshold) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    root = np.arange(len(fine))
    while True:
        low = np.array([min([root[i], *root[np.flatnonzero(links[i])]]) for i in range(len(fine))])
        if (low == root).all():
            break
        root = low
    out = {n: (rows[n][0], 0, rows[n][0], True) for n in range(len(rows))}
    for i, n in enumerate(fine):
        smallest = min(rows[fine[j]][0] for j in np.flatnonzero(root == root[i]))
        out[n] = (rows[n][0], int(links[i].sum()), smallest, smallest == rows[n][0])
    return sorted(out.values(), key=repr)


def near(df, **more):
    return sorted((tuple(r) for r in residual_codes.near_duplicates(df, **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"list_rows": 8, "probe_slack": 99.0, "code_slack": 99.0}, {"list_rows": 8, "probe_slack": 99.0, "code_slack": 99.0, "part_rows": 5}, {"list_rows": 40, "part_rows": 16, "probe_slack": 99.0, "code_slack": 99.0}])
def test_near_duplicates(odd, more):
    """Whole slack misses nothing, however lists are cut and dealt over parts."""
    assert near(odd, **more) == brute_near(made(16), 16, 0.93)


def test_no_vectors_take_part(spark, odd):
    assert near(odd.limit(0)) == []
    assert near(odd.where("embedding is null")) == [(3001, 0, 3001, True)]
    huge = spark.createDataFrame([(1, [1e300, 2e300], 1), (2, [1e-300, 2e-300], 1), (3, [-1e300, 5.0], 1)], "vec_id long, embedding array<double>, label int")
    assert near(huge) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_share_of_links_found(spark):
    """Pairs right at the threshold, in data without clusters, over many lists: the hardest case for the probes."""
    rnd, n, dim = np.random.default_rng(1), 6000, 64
    a = rnd.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rnd.normal(size=(n, dim))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.935 * a + math.sqrt(1 - 0.935**2) * side
    rows = [(2 * i + s, v[i].tolist(), 1) for i in range(n) for s, v in enumerate((a, b))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = residual_codes.near_duplicates(df, list_rows=100).agg(F.sum("n_links")).first()[0]
    assert got / (2 * n) > 0.98, got / (2 * n)


def test_near_duplicates_on_the_table(spark):
    rows = [tuple(r) for r in q.table(spark, SF, "embeddings").collect()]
    assert sorted((tuple(r) for r in q.op12_residual_codes(spark, SF).collect()), key=repr) == brute_near(rows, 64, 0.93)
