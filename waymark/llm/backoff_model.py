"""LM scoring by a weighted backoff automaton.

States are the n-grams of up to order - 1 words seen in training (and the root). From state h, a seen n-gram h w has an arc that weighs
log10 p(w | h) and leads to the longest state that ends h w; any other w takes the failure arc, which weighs
log10(mu / (c(h) + mu)) and leads to h without its first word. Probabilities are Dirichlet-smoothed,
p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), and absolutely discounted at the root,
p(w) = (c(w) - d) / N with the d V / N left over for any unknown word; each sums to one, so the model is proper.

The automaton grows with the corpus and is never broadcast. Documents are cut into blocks, kept in the shared folder as word hashes; each block sends
the hashes of its distinct n-grams, packed by hash range, with their training counts; each range sums its counts and answers every block
with the totals of the n-grams it sent. A block so gets what is needed for the part of the automaton that its own texts can visit: it numbers the
states, stores their arcs and failure arcs, and walks its texts through them from left to right, side by side, each carrying its state; a part of its texts
at a time, with the states that these can visit. Long texts are cut into lanes; a lane begins order - 1 words early, after which its state is that of the whole text. Words are told apart by 64-bit hashes, longer
n-grams by 64 bits. Hash ranges grow with the input.

Null or empty text: the end token alone. A text's history starts empty. Repeated rows: each counts and is scored. Null ids: held_out is null, and they
aren't learnt from. Empty table: no rows. Without any training token: every word is unknown, with probability 1. Very long texts: a block each. Extra
columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct, mix, numbered, staged, text_of, word_hashes

#: Hash of the token that ends each text; words hash elsewhere.
END = np.uint64(0xE4D)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with each text's end, tokens of each text)."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return np.insert(words, ends, END), counts + 1


def _grams(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order, the hash of the n-gram that ends at each position, or 0 where the text is too short before it."""
    position = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [tokens]
    for n in range(2, order + 1):
        longer = np.zeros_like(tokens)
        longer[1:] = mix(out[-1][:-1], tokens[1:])
        longer[position < n - 1] = 0
        out.append(longer)
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, those of one place side by side."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _squeezed(x: np.ndarray, low: int = 0) -> bytes:
    """Numbers as bytes, those of one place side by side, so that leading zeros cost nothing. The `low` lowest places are left as they are: random ones don't shrink, and spoil the code of those beside them."""
    import zstandard

    raw = _planes(x)
    return len(x).to_bytes(4, "little") + raw[:low].tobytes() + zstandard.compress(raw[low:].tobytes(), 1)


def _unsqueezed(data: bytes, kind: str, low: int = 0) -> np.ndarray:
    import zstandard

    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    raw = np.concatenate([np.frombuffer(data, np.uint8, low * n, 4), np.frombuffer(zstandard.decompress(data[4 + low * n :]), np.uint8)])
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def _keys_out(keys: np.ndarray) -> bytes:
    """Hashes, best in ascending runs, as their steps (which wrap around): the five low bytes of a step are random."""
    return _squeezed(np.diff(keys, prepend=np.uint64(0)), 5)


def _keys_in(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(data, "<u8", 5), dtype=np.uint64)


def _pack_counts(x: np.ndarray) -> bytes:
    """Most counts are small: a byte each, and the large ones apart."""
    import zstandard

    large = np.flatnonzero(x >= 255)
    return len(x).to_bytes(4, "little") + zstandard.compress(np.minimum(x, 255).astype(np.uint8).tobytes() + x[large].astype("<i8").tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    n, raw = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:])
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<i8")
    return out


#: Bytes of text to a block, and to each hash range.
BLOCK, RANGE = 8 << 20, 16 << 20
#: Tokens of a block whose part of the automaton is built at once, about.
PART = 600_000
def _parts(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The texts from .. to of each part of a block: about `most` tokens; a longer text stands alone."""
    out, at, ends = [], 0, np.cumsum(counts)
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + most, side="right")))
        out.append((at, to))
        at = to
    return out


#: Words to a lane.
LANE = 512


def score(docs: DataFrame, learn: Column, order: int = 3, mu: float = 2.0, discount: float = 0.5, ranges: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, learnt, n_tokens, n_known, train_tokens, base_score, score). Texts where `learn` holds are learnt from; all are scored."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("d"), text_of(text).alias("t"), learn.alias("l"))
    kind, rows_type = rows.schema["d"].dataType.simpleString(), to_arrow_type(rows.schema["d"].dataType)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE)
    width = (1 << 64) // ranges + 1
    edges = np.array([r * width for r in range(1, ranges)], np.uint64)

    def name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t", BLOCK):
            hashes, counts = _tokens(b.column("t"))
            local, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
            often = np.argsort(-times, kind="stable")  # the most frequent words first: small numbers; those as frequent by hash
            rank = np.empty(len(often), "<u4")
            rank[often] = np.arange(len(often))
            packed = {"counts": [_squeezed(counts.astype("<i8"))], "vocabulary": [_keys_out(local[often])], "tokens": [_squeezed(rank[at])]}
            yield pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "docs": pa.array([b.column("d")], pa.list_(rows_type)), "learnt": pa.array([b.column("l")], pa.list_(pa.bool_())), **packed})

    def read(counts: bytes, vocabulary: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each text, words by number, the number of each token's word, word hashes of all tokens)."""
        words, at = _keys_in(vocabulary), _unsqueezed(tokens, "<u4")
        return _unsqueezed(counts, "<i8"), words, at, words[at]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's distinct n-grams and training counts, cut by hash range."""
        for batch in batches:
            for row in range(batch.num_rows):
                name, learnt = batch.column("block")[row].as_py(), batch.column("learnt")[row].values
                counts, _, _, hashes = read(*(batch.column(c)[row].as_py() for c in ("counts", "vocabulary", "tokens")))
                used = np.repeat(learnt.fill_null(False).to_numpy(zero_copy_only=False), counts)
                for n, g in enumerate(_grams(hashes, counts, order), 1):
                    keys, learn_from = distinct(g[g != 0]), np.sort(g[used & (g != 0)])
                    total = np.diff(np.searchsorted(learn_from, keys), append=len(learn_from))
                    cut = np.searchsorted(keys, edges)
                    out: dict[str, list] = {c: [] for c in ("range", "keys", "counts")}
                    for r, (k, c) in enumerate(zip(np.split(keys, cut), np.split(total, cut), strict=True)):
                        if len(k):
                            out["range"].append(r), out["keys"].append(_keys_out(k)), out["counts"].append(_pack_counts(c))
                    m = len(out["range"])
                    yield pa.RecordBatch.from_pydict({"range": pa.array(out["range"], pa.int32()), "block": [name] * m, "n": pa.array([n] * m, pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    def answer(_, table):
        """One hash range: totals over all blocks, given back to each block for the keys it sent; tokens and words as a row without a block."""
        ns, names, keys, counts = (table.column(c).to_pylist() for c in ("n", "block", "keys", "counts"))
        out: dict[str, list] = {c: [] for c in ("block", "n", "range", "totals", "words", "tokens")}
        r = table.column("range")[0].as_py()
        for n in sorted(set(ns)):
            rows = [i for i, x in enumerate(ns) if x == n]
            each = [_keys_in(keys[i]) for i in rows]
            every, at = np.unique(np.concatenate(each), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([_unpack_counts(counts[i]) for i in rows])).astype("<i8")
            if n == 1:
                out["block"].append(None), out["n"].append(1), out["range"].append(r), out["totals"].append(b"")
                out["words"].append(int((total > 0).sum())), out["tokens"].append(int(total.sum()))
            for i, where in zip(rows, np.split(at, np.cumsum([len(e) for e in each])[:-1]), strict=True):
                out["block"].append(names[i]), out["n"].append(n), out["range"].append(r), out["words"].append(0), out["tokens"].append(0)
                out["totals"].append(_pack_counts(total[where]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    named = staged(rows.mapInArrow(name_blocks, f"block string, docs array<{kind}>, learnt array<boolean>, counts binary, vocabulary binary, tokens binary"), "blocks")
    sent = named.select("block", "learnt", "counts", "vocabulary", "tokens").mapInArrow(send, "range int, block string, n int, keys binary, counts binary")
    answers = staged(sent.groupBy("range").applyInArrow(answer, "block string, n int, range int, totals binary, words long, tokens long"), "answers")
    words, tokens = (x or 0 for x in answers.agg(F.sum("words"), F.sum("tokens")).first())

    def run(_, left, right):
        """Each block's texts, once through its part of the automaton."""
        out = []
        got: dict[tuple[int, int], bytes] = dict(zip(zip(right.column("n").to_pylist(), right.column("range").to_pylist(), strict=True), right.column("totals").to_pylist(), strict=True))
        for row in range(left.num_rows):
            counts, _, at, hashes = read(*(left.column(c)[row].as_py() for c in ("counts", "vocabulary", "tokens")))
            pa.default_memory_pool().release_unused()
            grams = _grams(hashes, counts, order)
            del hashes
            every, totals = [], []  # for each order: all n-grams of the block, and their totals
            for n, g in enumerate(grams, 1):
                keys = distinct(g[g != 0])
                held = np.diff([0, *np.searchsorted(keys, edges).tolist(), len(keys)])
                every.append(keys), totals.append(np.concatenate([_unpack_counts(got[n, r]) for r in np.flatnonzero(held).tolist()]) if len(keys) else np.zeros(0, np.int64))
            known, base, weight = _scored(grams, every, totals, counts, at, words, tokens, mu, discount)
            docs_, learnt = left.column("docs")[row].values, left.column("learnt")[row].values
            out.append(pa.table({key: docs_, "learnt": learnt, "n_tokens": pa.array(counts), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(counts), tokens)), "base_score": pa.array(base), "score": pa.array(weight)}))
        return pa.concat_tables(out) if out else pa.table({key: pa.array([], rows_type), "learnt": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})

    asked = answers.where("block is not null").select("block", "n", "range", "totals")
    return named.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, f"{key} {kind}, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scored(grams: list[np.ndarray], every: list[np.ndarray], totals: list[np.ndarray], counts: np.ndarray, at: np.ndarray, words: int, tokens: int, mu: float, discount: float, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each text of a block. For each order, grams: the n-gram that ends at each position; every: all of them, ascending, and totals: their training counts. at: the number of each token's word."""
    out, ends = [], np.cumsum(counts)
    for i, j in _parts(counts, part):
        here, many = slice(ends[i] - counts[i], ends[j - 1]), counts[i:j]
        number, some = [], []  # of the n-grams of a part: that which ends at each position (-1: none), and their totals
        for g, keys, total in zip((g[here] for g in grams), every, totals, strict=True):
            ids = np.full(len(g), -1)
            own, ids[g != 0] = numbered(g[g != 0])
            number.append(ids), some.append(total[np.searchsorted(keys, own)])
        known = some[0][number[0]]
        base = np.log10((known + 0.1) / (tokens + 0.1 * (words + 1)))
        first = np.cumsum(many) - many  # each text has its end token at least
        weight = Automaton(number, some, many, at[here], words, tokens, mu, discount).walk(at[here], many)
        out.append((np.add.reduceat((known > 0).astype(np.int64), first), np.add.reduceat(base, first), weight))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Automaton:
    """The part of the automaton that some texts can visit: numbered states, arcs in order of (state, word), failure arcs.

    State 0 is the root; every n-gram of up to order - 1 words that was seen in training is one more."""

    def __init__(self, number: list[np.ndarray], totals: list[np.ndarray], counts: np.ndarray, word: np.ndarray, words: int, tokens: int, mu: float, discount: float) -> None:
        """number[n - 1]: the n-gram that ends at each position, -1 where there is none; totals[n - 1]: training counts of the n-grams; word: the number of each position's word."""
        order, n = len(number), len(word)
        self.order, self.words = order, int(word.max(initial=0)) + 1
        seen = [np.where(ids >= 0, total[ids] if len(total) else 0, 0) for ids, total in zip(number, totals, strict=True)]
        root = np.where(seen[0] > 0, np.maximum(seen[0] - discount, 1e-9), discount * words) / max(tokens, 1) if tokens else np.ones(n)
        # state of the n-gram that ends at each position, for n = 0 .. order - 1; -1 where it was never seen
        state, first = [np.zeros(n, np.int64)], 1
        where = [np.zeros(1, np.int64)]  # a position at which each state's n-gram ends
        for k in range(1, order):
            ids = np.cumsum(totals[k - 1] > 0) - 1 + first
            state.append(np.where(seen[k - 1] > 0, ids[number[k - 1]] if len(ids) else -1, -1))
            at = np.zeros(int((totals[k - 1] > 0).sum()), np.int64)
            some = np.flatnonzero(seen[k - 1] > 0)
            at[state[k][some] - first] = some
            where.append(at)
            first += len(at)
        self.fails = np.concatenate([np.zeros(1, np.int64), *[state[k - 1][where[k]] for k in range(1, order)]])
        count = np.concatenate([np.zeros(1, np.int64), *[seen[k - 1][where[k]] for k in range(1, order)]])
        self.fail_weight = np.concatenate([[0.0], np.log10(mu / (count[1:] + mu))])
        # arcs: from the root with every word here; from a state with the words seen after it
        starts = np.zeros(n, bool)
        starts[np.cumsum(counts) - counts] = True
        keys, weights, nexts, likely = [], [], [], root
        for k in range(order):
            if k:
                before = np.zeros(n, np.int64)
                before[1:] = state[k][:-1]
                before[starts] = -1
                likely = (seen[k] + mu * likely) / (np.where(before > 0, count[before], 0) + mu)
                arcs = np.flatnonzero(seen[k] > 0)
            else:
                before, arcs = np.zeros(n, np.int64), np.arange(n)
            key, at = np.unique(before[arcs] * self.words + word[arcs], return_index=True)
            at = arcs[at]
            keys.append(key), weights.append(np.log10(likely[at]))
            # to the longest state that ends the words read
            goes = np.zeros(len(at), np.int64)
            for j in range(1, min(k + 1, order - 1) + 1):
                goes = np.where(state[j][at] > 0, state[j][at], goes)
            nexts.append(goes)
        order_ = np.argsort(np.concatenate(keys))
        self.keys, self.weights, self.nexts = (np.concatenate(x)[order_] for x in (keys, weights, nexts))

    def walk(self, word: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 weight of each text: all lanes move one word at a time from left to right, each carrying its state."""
        ends = np.cumsum(counts)
        many = -(-counts // LANE)
        text = np.repeat(np.arange(len(counts)), many)
        first = (ends - counts)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * LANE
        last = np.minimum(first + LANE, ends[text])
        begin = np.maximum(first - (self.order - 1), (ends - counts)[text])  # as far back as a state can remember
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        lanes = np.argsort(begin - last, kind="stable")  # longest first: those still moving lie in front
        length = (last - begin)[lanes]
        for step in range(int(length[0]) if len(length) else 0):
            on = lanes[: int(np.searchsorted(-length, -step, side="left"))]
            at = begin[on] + step
            s, w, gain = state[on], word[at].astype(np.int64), np.zeros(len(on))
            todo = np.arange(len(on))
            while len(todo):
                key = s[todo] * self.words + w[todo]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                here, miss = todo[hit], todo[~hit]
                gain[here] += self.weights[found[hit]]
                s[here] = self.nexts[found[hit]]
                gain[miss] += self.fail_weight[s[miss]]
                s[miss] = self.fails[s[miss]]
                todo = miss
            state[on] = s
            total[on] += np.where(at >= first[on], gain, 0.0)
        return np.bincount(text, weights=total, minlength=len(counts))
