"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are native columns over whole texts. The trees are fitted on the driver over the statistics (no texts) of at most
`max_rows` labelled documents, then flattened into arrays that every task walks with numpy, a level at a time for all rows of a batch.

Null and empty texts: all statistics 0, scored like any other row. Labels: null labels and ids are left out; a document labelled twice
counts with the lower label. No labels at all: every score is 0.5. Repeated rows: each is scored. Extra columns pass through `score`;
its own columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, text_of
from .quality_rules import let
from .quality_rules import statistics as rule_statistics

#: Labelled rows to fit on at most: 20,000 rows of about 16 doubles are 3 MB on the driver.
MAX_ROWS = 20_000


#: Names of the statistics, in order.
NAMES = "words word_length symbols repeated_lines repeated_words line_words stop_words exclaims upper digits stops".split()


def statistics(text: str = "text") -> Column:
    """array<double> of a document's statistics, computed once for a row."""
    body = text_of(text)
    kept = lambda pattern: F.length(F.regexp_replace(body, pattern, "")).cast("double")

    def measured(s: Column) -> Column:
        per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
        n, chars = s["n_words"], F.length(body)
        shares = [("word_chars", n), ("n_symbols", n), ("n_dup_lines", s["n_lines"]), ("n_repeat_words", n), ("n_words", s["n_lines"]), ("n_stop_words", n), ("n_exclaims", n)]
        return F.array(F.log1p(n.cast("double")), *[per(s[a], b) for a, b in shares], per(kept(r"[^\p{Lu}]+"), chars), per(kept(r"[^0-9]+"), chars), per(kept(r"[^.?!,;:]+"), n))

    return let(rule_statistics(body), measured)


@dataclass
class Forest:
    """All trees in shared arrays: node i goes left where x[feature[i]] <= threshold[i]; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, leaf_rows: int = 10, ridge: float = 1.0) -> Forest:
    """Gradient boosting on the logistic loss; splits are sought on histograms over quantile bins."""
    y = y.astype(float)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(y) else []
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if edges else None
    f, t, left, right, value, roots, margin = [], [], [], [], [], [], np.full(len(y), base)

    def node() -> int:
        k = len(f)
        f.append(0), t.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees if edges else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for k, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None, None)
                for j, e in enumerate(edges) if d < depth and len(rows) >= 2 * leaf_rows else ():
                    c = codes[rows, j]
                    n = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    gl, hl = (np.cumsum(np.bincount(c, weights=w[rows], minlength=len(e) + 1))[:-1] for w in (g, h))
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(n < leaf_rows) | (len(rows) - n < leaf_rows)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
                if best[1] is None:
                    value[k] = rate * gs / (hs + ridge)
                    margin[rows] += value[k]
                else:
                    _, j, b = best
                    f[k], t[k], left[k], right[k] = j, edges[j][b], node(), node()
                    goes = codes[rows, j] <= b
                    following += [(left[k], rows[goes]), (right[k], rows[~goes])]
            level = following
    if not roots:
        roots = [node()]
    return Forest(np.array(roots), np.array(f), np.array(t), np.array(left), np.array(right), np.array(value), depth, base)


def learn(docs: DataFrame, labels: DataFrame, rows: Column | None = None, label: str = "quality", text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Forest:
    """A forest for P(label = 1), fitted on the `max_rows` labelled documents (among `rows`) with the smallest hash of their key."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if rows is None else rows))
    chosen = chosen.groupBy(key).agg((F.min(label) > 0).cast("int").alias("__y")).orderBy(F.xxhash64(key), key).limit(max_rows)
    known = docs.select(key, text).join(F.broadcast(chosen), key).withColumn("__x", statistics(text))  # at most max_rows keys
    data = known.select("__x", "__y").orderBy(F.xxhash64(key), key).limit(max_rows).collect()  # statistics alone
    return fit(np.array([r[0] for r in data]).reshape(-1, len(NAMES)), np.array([r[1] for r in data]))


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """docs with score: P(label = 1)."""
    docs = docs.drop("score")
    made = spare(docs.columns, "__x")
    known = docs.withColumn(made, statistics(text))
    kept = docs.schema.fields

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(made)
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            found = [forest.score(values[i : i + 2000]) for i in range(0, b.num_rows, 2000)]
            columns = [b.column(f.name) for f in kept] + [pa.array(np.concatenate(found) if found else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return known.mapInArrow(walk, f"{fields + ', ' if kept else ''}score double")
