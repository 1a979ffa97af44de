"""N-gram Jaccard join by PartEnum signatures; exact.

A document's set: its distinct 5-word shingles (64-bit hashes). Equal sets are one node. Sizes fall into bands [b, floor(1.25 b)]; sets
with a similarity of 0.8 or more lie in the same band or in neighbouring ones, so each set takes part in the instance of its own
band and in that of the band below. There two similar sets differ in at most k elements. Hashing deals the elements over n1 parts, so
that in some part at most one differs, and each part over n2 cells; each choice of n2 - 1 cells of a part is one signature, and one of
them has equal contents in both. Contents are summed hashes. A signature without contents is sent only by sets with so many empty
ones that all agreeing signatures might be empty - then those of the partner are, too.

Signatures travel packed, by hash range. A range gives back groups of nodes with a signature in common. n1 has two parts to spare (sets of more than
about 36), so similar sets agree in three parts; pairs of small groups must do so to stay candidates, which passages that
many documents share hardly ever reach. Parts whose agreeing signature may be empty, and so unsent, in both sets count as agreeing: each set has
a mask of them. To join a group of copies it isn't necessary
to compare all its pairs: each node is first compared with the neighbour that most nodes share signatures with; what that links is one
component; then each node with the nearest of its group in another component; then the pairs that are still apart. Of a large group only pairs
that sketches allow leave the task, and a task compares two blocks of 2,048 nodes at most: the nodes of a group's largest component meet the others, never
each other. All comparisons are exact, on whole sets of 64-bit hashes; only sets of pairs that sketches allow are read (again, by a fixed-size
filter on ids) and moved. Nodes of one signature are one array in one task: 8 bytes for each distinct set (equal sets of a block are sent
once). Hash ranges grow with the documents.

Null or empty texts, and texts without a word: n_shingles 0, linked with nothing. One to four words: one shingle, the whole sequence. Null ids: such
rows are returned with component_id null and link nothing. Repeated rows: equal sets are linked. Empty table: no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, connected_components, give_back, mix, spare, staged, text_of, word_hashes

WIDTH = 5
#: Bytes of text to a block; a task holds about forty times as much while it makes signatures.
BLOCK = 2 << 20


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, sorted in each text; sizes of the sets)."""
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(starts + counts, counts) - np.arange(len(words))  # words from here to the end of the text
    n, rolled = len(words), words.copy()
    for step in range(1, width):
        rolled[: n - step] = mix(rolled[: n - step], words[step:]) if n > step else rolled[: n - step]
    whole = left >= width
    hashes, owner = rolled[whole], of[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        seq = mix(np.zeros(len(short), np.uint64), counts[short].astype(np.uint64))
        for step in range(width - 1):
            more = counts[short] > step
            seq[more] = mix(seq[more], words[starts[short[more]] + step])
        hashes, owner = np.concatenate([hashes, seq]), np.concatenate([owner, short])
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def sums(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Sum of the hashes of each owner, modulo 2**64 (halves are summed exactly as doubles)."""
    low = np.bincount(owner, weights=(hashes & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(np.uint64)
    high = np.bincount(owner, weights=(hashes >> np.uint64(32)).astype(np.float64), minlength=n).astype(np.uint64)
    return low + (high << np.uint64(32))


class Bands:
    """Size bands and, for the instance of each, the signature scheme."""

    def __init__(self, largest: int) -> None:
        self.low, self.k, self.n1, self.n2 = [1], [], [], []
        while True:
            high = self.low[-1] * 5 // 4
            k = (high + high * 5 // 4) // 9
            parts = (k + 1 + 1) // 2
            self.k.append(k)
            self.n1.append(parts + (2 if parts >= 6 else 0))
            self.n2.append(8 if k <= 3 else 4)
            if high >= largest:
                break
            self.low.append(high + 1)
        self.low, self.k, self.n1, self.n2 = map(np.array, (self.low, self.k, self.n1, self.n2))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


#: Part number of a signature that is enough by itself. Other part numbers are smaller than NUMBERS; above them stand, in pairs, the unsent parts.
ALONE = 0xFFFF
NUMBERS, SHIFT = 0x3FFF, 14
#: Groups of more nodes are given back whole; of smaller ones, pairs with enough parts in common.
SMALL = 8


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, part) of all sets, and the mask of each set; hashes: the elements of all sets in a row.

    Where an instance has two spare parts, similar sets agree in three parts at least; its signatures tell their part. A part in which two sets agree
    only by empty contents is hollow in both. The mask has a bit for each hollow part, so two masks have at least as many bits in common
    as there are such parts (all bits are set if two hollow parts of an instance meet in a bit).
    """
    bands = Bands(int(sizes.max(initial=1)))
    masks = np.zeros(len(sizes), np.uint64)
    own, out_of, out_sig, out_part = bands.of(np.maximum(sizes, 1)), [], [], []
    strong = mix(hashes, np.full(len(hashes), 11, np.uint64))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for below in (0, 1):
        band = own - below
        use = (band >= 0) & (sizes > 0)
        band = np.maximum(band, 0)
        use &= bands.k[band] > 0
        n1, n2, k = (np.where(use, x[band], 0) for x in (bands.n1, bands.n2, bands.k))
        slots = n1 * n2
        base = np.cumsum(slots) - slots
        total = int(slots.sum())
        if not total:
            continue
        here = use[owner]
        o, h = owner[here], strong[here]
        tagged = mix(h, (band[o] + 1000).astype(np.uint64))
        part = ((tagged >> np.uint64(40)) % n1[o].astype(np.uint64)).astype(np.int64)
        cell = base[o] + part * n2[o] + ((tagged & np.uint64(0xFFFFFF)) % n2[o].astype(np.uint64)).astype(np.int64)
        content, count = sums(cell, h, total), np.bincount(cell, minlength=total)
        # parts: n1 for each set; cells of a part lie side by side
        set_of = np.repeat(np.arange(len(sizes)), slots)
        part_at = np.repeat(np.cumsum(n1) - n1, slots) + (np.arange(total) - base[set_of]) // n2[set_of]
        parts = int(n1.sum())
        whole, many = sums(part_at, content, parts), np.bincount(part_at, weights=count, minlength=parts)
        without, empty = whole[part_at] - content, many[part_at] == count
        hollow = np.zeros(parts, bool)
        hollow[part_at[empty]] = True
        good = n1 - k // 2  # parts in which at most one element differs
        set_at = np.repeat(np.arange(len(sizes)), n1)
        many_hollow = np.bincount(set_at, weights=hollow, minlength=len(sizes))
        risky = many_hollow >= good
        bit = np.uint64(1) << ((np.arange(parts) - np.repeat(np.cumsum(n1) - n1, n1) + 32 * (band[set_at] & 1)) & 63)[hollow].astype(np.uint64)
        mask = np.zeros(len(sizes), np.uint64)
        np.bitwise_or.at(mask, set_at[hollow], bit)
        masks |= np.where(np.bitwise_count(mask) < many_hollow, ~np.uint64(0), mask)
        send = ~empty | risky[set_of]
        place = (np.arange(total) - base[set_of]).astype(np.uint64) + (band[set_of].astype(np.uint64) << np.uint64(32))
        number = (np.arange(total) - base[set_of]) // n2[set_of]
        number = np.where((good[set_of] >= 3) & (n1[set_of] <= NUMBERS), number, ALONE)
        out_part.append(number[send])
        out_of.append(set_of[send])
        out_sig.append(mix(mix(without, place), many[part_at].astype(np.uint64) - count.astype(np.uint64))[send])
    if not out_of:
        return np.array([], int), np.array([], np.uint64), np.array([], int), masks
    return np.concatenate(out_of), np.concatenate(out_sig), np.concatenate(out_part), masks


def _sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, sizes, hash of each set) of a block."""
    hashes, sizes = shingle_sets(batch.column("t"))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return hashes, sizes, mix(sums(owner, mix(hashes, np.full(len(hashes), 7, np.uint64)), len(sizes)), sizes.astype(np.uint64)).astype(np.int64)


def _documents(rows: DataFrame) -> DataFrame:
    """(d, n, sid) of each row: size and hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t", BLOCK):
            _, sizes, sid = _sets_of(b)
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(sizes, pa.int64()), pa.array(sid)], ["d", "n", "sid"])

    return rows.mapInArrow(run, "d long, n long, sid long")


def _thin(x: np.ndarray) -> bytes:
    """Numbers below 2**32 that mostly rise by little, as bytes."""
    import zstandard

    return zstandard.compress(np.diff(x.astype("<u4"), prepend=np.uint32(0)).tobytes(), 1)


def _thick(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<u4"), dtype="<u4")


def _squeezed(masks: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(masks.astype("<u8").tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), "<u8")


def _signed(rows: DataFrame, ranges: int) -> DataFrame:
    """Packed signatures (range, sids, masks, many, sigs, parts) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t", BLOCK):
            hashes, sizes, sid = _sets_of(b)
            _, first = np.unique(sid, return_index=True)
            once = np.zeros(len(sid), bool)
            once[first] = True
            of, sig, part, masks = signatures(hashes[np.repeat(once, sizes)], sizes[once])
            at = ((sig >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            cut, sids = np.searchsorted(at[order], np.arange(ranges + 1)), sid[once]
            for r in np.flatnonzero(np.diff(cut)).tolist():  # ranges that the block has signatures of
                some = order[cut[r] : cut[r + 1]]
                which, many = np.unique(of[some], return_counts=True)
                some = some[np.argsort(of[some], kind="stable")]
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "sids": [sids[which].tobytes()], "masks": [_squeezed(masks[which])], "many": [_thin(many)], "sigs": [sig[some].astype("<u4").tobytes()], "parts": [_thin(part[some])]})

    return rows.where("d is not null").mapInArrow(run, "range int, sids binary, masks binary, many binary, sigs binary, parts binary")


#: Bits of the filter that tells which documents are wanted: 16 MB, whatever the number of documents. Beyond some ten million wanted
#: documents it lets more and more others through, which costs time, not results.
FILTER_BITS = 27
PAGE = 1 << 15  # bits to a page of the filter


def _places(d: np.ndarray) -> np.ndarray:
    return (mix(d.astype(np.uint64), np.full(len(d), 17, np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(wanted: DataFrame):
    """A broadcast bitmap of the ids d of `wanted`: pages are made in the tasks and merged by page; at most 4,096 rows of 4 KB reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(_places(b.column("d").to_numpy()))
            for page, rows in zip(*_split(at // PAGE, at % PAGE), strict=True):
                np.bitwise_or.at(pages.setdefault(page, np.zeros(PAGE // 8, np.uint8)), rows >> 3, np.uint8(1) << (rows & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"page": pa.array(list(pages), pa.int32()), "bits": pa.array([x.tobytes() for x in pages.values()], pa.binary())})

    def merge(_, table):
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"page": table.column("page")[:1], "bits": [out.tobytes()]})

    merged = wanted.select("d").mapInArrow(mark, "page int, bits binary").groupBy("page").applyInArrow(merge, "page int, bits binary")
    flags = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for page, bits in merged.collect():
        flags[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bits, np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(flags)


def _split(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """(distinct keys, the values of each); key is sorted."""
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return key[start].tolist(), np.split(value, start[1:]) if len(start) else []


def _held(rows: DataFrame, known: DataFrame, what: str, name: str) -> DataFrame:
    """(sid, n, s): the sketch or the whole set (sorted 64-bit hashes) of each known (sid, d), read again from the documents. Only texts of wanted ids are cut into words."""
    wanted = _filter(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for batch in batches:
            at = _places(batch.column("d").to_numpy())
            some = batch.filter(pa.array((flags[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)))
            for b in blocks([some], "t", BLOCK):
                hashes, sizes, sid = _sets_of(b)
                use = np.flatnonzero(sizes > 0)
                ends = np.cumsum(sizes)
                raw = _sketches(hashes, sizes) if what == "sketch" else [hashes[e - n : e].astype("<u8").tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                made = [pa.array(sid[use]), b.column("d").take(pa.array(use)), pa.array(sizes[use], pa.int64()), pa.array([raw[k] for k in use.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["sid", "d", "n", "s"])

    found = rows.where("d is not null").mapInArrow(run, "sid long, d long, n long, s binary")
    # ids whose bits coincide come too, and rows that are repeated come more than once
    out = staged(found.join(known.select("sid", "d"), ["sid", "d"], "left_semi").select("sid", "n", "s").dropDuplicates(["sid"]), name)
    wanted.destroy()  # executors needn't keep it
    return out


def _pairs_of(starts: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, place of a, place of b) of all pairs of groups of up to SMALL nodes, a size at a time."""
    for z in range(2, SMALL + 1):
        at = np.flatnonzero(size == z)
        for i in range(z):
            for j in range(i + 1, z):
                yield at, starts[at] + i, starts[at] + j


def _grouper(ranges: int):
    def groups(_, table):
        """Of one hash range: large groups of nodes that share a signature (members), and pairs of small ones, packed by hash of the pair (to, pairs)."""
        give_back()
        cat = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        many, part = (np.concatenate([_thick(x) for x in table.column(c).to_pylist()]) for c in ("many", "parts"))
        sids, masks = cat("sids", "<i8"), np.concatenate([_unsqueezed(x) for x in table.column("masks").to_pylist()])
        of, sig = np.repeat(np.arange(len(sids), dtype=np.int32), many), cat("sigs", "<u4")
        order = np.argsort(sig, kind="stable")
        sig, of, part = sig[order], of[order], part[order]
        twin = np.zeros(len(sig), bool)
        twin[1:] = sig[1:] == sig[:-1]
        keep = twin.copy()
        keep[:-1] |= twin[1:]
        sig, of, part = sig[keep], of[keep], part[keep]
        # by signature and part: signatures of different parts that share 32 bits aren't one group, or pairs would lose a part
        sid = sids[of]
        order = np.lexsort((sid, part, sig))
        sig, sid, part, mask = sig[order], sid[order], part[order], masks[of[order]]
        other = np.ones(len(sig), bool)
        other[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
        new = other.copy()
        new[1:] |= sid[1:] != sid[:-1]
        sid, part, mask, other = sid[new], part[new], mask[new], other[new]
        starts = np.flatnonzero(other)
        size = np.diff(np.concatenate([starts, [len(sid)]])).astype(int)
        # large groups, each membership once
        large = np.flatnonzero(size > SMALL)
        seen: dict[bytes, np.ndarray] = {}
        for k in large.tolist():
            m = sid[starts[k] : starts[k] + size[k]]
            seen.setdefault(m.tobytes(), m)
        names = [int(sums(np.zeros(len(m), int), mix(m.astype(np.uint64), np.full(len(m), 5, np.uint64)), 1).astype(np.int64)[0]) for m in seen.values()]
        # pairs of small groups, with their part and how many agreeing parts (two at most) may be unsent
        found = [*_pairs_of(starts, size)]
        a, b = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        where = part[a] | np.minimum(np.bitwise_count(mask[a] & mask[b]), 2).astype(part.dtype) << SHIFT
        a, b = sid[a], sid[b]
        to = ((mix(a.astype(np.uint64), b.astype(np.uint64)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(ranges + 1))
        rows = [(r, order[cut[r] : cut[r + 1]]) for r in range(ranges) if cut[r] < cut[r + 1]]
        n, k = len(names), len(rows)
        members = pa.array([*seen.values(), *[None] * k], pa.list_(pa.int64()))
        packed = [np.rec.fromarrays([a[o], b[o], where[o]], dtype=PAIR).tobytes() for _, o in rows]
        return pa.table({"g": pa.array([*names, *[None] * k], pa.int64()), "members": members, "to": pa.array([*[None] * n, *[r for r, _ in rows]], pa.int32()), "pairs": pa.array([*[None] * n, *packed], pa.binary())})

    return groups


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("part", "<u2")])


def _agreeing(_, table):
    """Of one hash range of pairs: those that agree in three parts at least, unsent ones counted, or by a signature that is enough."""
    give_back()
    pairs = np.unique(np.concatenate([np.frombuffer(x, PAIR) for x in table.column("pairs").to_pylist()]))
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    starts = np.flatnonzero(new)
    parts = np.diff(np.concatenate([starts, [len(pairs)]]))
    unsent = np.maximum.reduceat(pairs["part"], starts) >> SHIFT  # 3: enough by itself
    kept = pairs[starts[parts + unsent >= 3]]
    return pa.table({"a": pa.array(kept["a"].copy()), "b": pa.array(kept["b"].copy())})


def _cells(sizes: np.ndarray) -> np.ndarray:
    """Cells of the sketch of a set, a power of two: as many as elements up to 256, then 256, and one for eight elements of large sets, so that sketches of unlike sets differ whatever their size."""
    small, large = np.minimum(sizes, 256), np.ceil(sizes / 8)
    return 1 << np.clip(np.ceil(np.log2(np.maximum(np.maximum(small, large), 1))).astype(np.int64), 3, 16)


def _sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Elements of each set in each of its cells, 255 at most. Sums of differences never exceed the number of elements that differ."""
    cells = _cells(sizes)
    base, owner = np.cumsum(cells) - cells, np.repeat(np.arange(len(sizes)), sizes)
    cell = (mix(hashes, np.full(len(hashes), 13, np.uint64)) & (cells[owner] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(base[owner] + cell, minlength=int(cells.sum())), 255).astype(np.uint8)
    return [counts[i : i + n].tobytes() for i, n in zip(base.tolist(), cells.tolist(), strict=True)]


def _folded(sketches: np.ndarray, cells: int) -> np.ndarray:
    """Sketches (rows) with cells joined until `cells` are left."""
    while sketches.shape[1] > cells:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] + sketches[:, half:]
    return sketches


def _matrix(raw: list[bytes], cells: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), cells).astype(np.int32)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, sizes m and n, sketches x and y) that may be similar: 9 * differences <= m + n. A full cell tells no more than its limit, so nothing is lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m, n = (batch.column(c).to_numpy() for c in "mn")
        x, y = (batch.column(c).to_pylist() for c in "xy")
        fits = (5 * m >= 4 * n) & (5 * n >= 4 * m)
        own = [np.array([len(r) for r in side]) for side in (x, y)]
        for p in np.unique(own[0][fits]).tolist():
            for q in np.unique(own[1][fits & (own[0] == p)]).tolist():
                at = np.flatnonzero(fits & (own[0] == p) & (own[1] == q))
                for part in np.array_split(at, 1 + len(at) * max(p, q) // (1 << 22)):
                    a, b = _folded(_matrix([x[i] for i in part], p), q), _folded(_matrix([y[i] for i in part], q), p)
                    fits[part] = 9 * np.abs(a - b).sum(axis=1) <= m[part] + n[part]
        yield batch.select(["a", "b"]).filter(pa.array(fits))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, sets x and y) with 100 * intersection >= 80 * union."""
    for batch in batches:
        hit = []
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                hit.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit, pa.int64())) for c in "ab"], ["a", "b"])


#: Nodes of a large group that one task compares with as many others.
TOGETHER = 2048


def _allowed(sid, root, size, own, sketch: list[bytes], alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, how far apart at least) of the nodes in different components, and in different blocks unless the block is alone, that sizes and sketches allow to be similar."""
    order = np.argsort(size, kind="stable")
    sid, root, size, own = sid[order], root[order], size[order], own[order]
    cells = np.array([len(sketch[i]) for i in order])
    left, right, far = [], [], []
    for c in np.unique(cells).tolist():
        rows = np.flatnonzero(cells == c)
        mine = _matrix([sketch[order[i]] for i in rows], c).astype(np.int16)
        # sizes of similar sets are within a quarter, so their sketches have as many cells or twice as many
        for d in (c, 2 * c):
            cols = rows if d == c else np.flatnonzero(cells == d)
            if not len(cols):
                continue
            theirs = mine if d == c else _folded(_matrix([sketch[order[i]] for i in cols], d), c).astype(np.int16)
            # an eighth of the cells tells most pairs apart; the rest are compared whole
            few = max(min(c, 32), c // 8)
            rough, other = _folded(mine, few), _folded(theirs, few)
            first = np.arange(len(rows)) + 1 if d == c else np.searchsorted(size[cols], size[rows])
            last = np.searchsorted(4 * size[cols], 5 * size[rows], side="right")
            at = 0
            while at < len(rows):
                to = at + 1
                while to < len(rows) and (to + 1 - at) * (last[to] - first[at]) * few < 1 << 20:
                    to += 1
                i, j = np.arange(at, to), np.arange(first[at], max(last[to - 1], first[at]))
                fits = (root[rows[i], None] != root[cols[j]]) & (j >= first[i, None]) & (j < last[i, None])
                if not alone:
                    fits &= own[rows[i], None] != own[cols[j]]
                if fits.any():
                    apart = np.abs(rough[i, None] - other[None, j]).sum(axis=2, dtype=np.int32)
                    x, y = np.nonzero(fits & (9 * apart <= size[rows[i], None] + size[cols[j]]))
                    x, y = i[x], j[y]
                    for part in np.array_split(np.arange(len(x)), 1 + len(x) * c // (1 << 22)):
                        whole = np.abs(mine[x[part]] - theirs[y[part]]).sum(axis=1, dtype=np.int32)
                        near = part[9 * whole <= size[rows[x[part]]] + size[cols[y[part]]]]
                        left.append(sid[rows[x[near]]]), right.append(sid[cols[y[near]]]), far.append(whole[np.searchsorted(part, near)])
                at = to
    none = np.array([], np.int64)
    return tuple(np.concatenate(x) if x else none for x in (left, right, far))


def _across(nearest: bool):
    def run(_, table):
        """Of some pairs of blocks (g, i, j; column k: own block), the pairs of nodes that may be similar; `nearest`: one at most for each node, and g if a group has more."""
        give_back()
        g, i, j, sid, root, size, own = (table.column(c).to_numpy() for c in ("g", "i", "j", "sid", "root", "n", "k"))
        sketch = table.column("s").to_pylist()
        order = np.lexsort((sid, j, i, g))
        new = np.flatnonzero((np.diff(g[order], prepend=g[order[0]] - 1) != 0) | (np.diff(i[order], prepend=i[order[0]]) != 0) | (np.diff(j[order], prepend=j[order[0]]) != 0))
        low, high, more = [], [], []
        for at in np.split(order, new[1:]):
            a, b, far = _allowed(sid[at], root[at], size[at], own[at], [sketch[x] for x in at.tolist()], i[at[0]] == j[at[0]])
            if nearest and len(a):
                node, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
                o = np.lexsort((pair, far[pair], node))
                kept = np.unique(pair[o][np.diff(node[o], prepend=node[o[0]] - 1) != 0])
                if len(kept) < len(a):
                    more.append(int(g[at[0]]))
                a, b = a[kept], b[kept]
            low.append(np.minimum(a, b)), high.append(np.maximum(a, b))
        low, high = np.concatenate(low), np.concatenate(high)
        return pa.table({"a": pa.array([*low.tolist(), *[None] * len(more)], pa.int64()), "b": pa.array([*high.tolist(), *[None] * len(more)], pa.int64()), "g": pa.array([*[None] * len(low), *more], pa.int64())})

    return run


#: Rows of blocks to a call: a call for each pair of blocks would cost more than the comparison of small groups.
CALL = 16_384


def _blocks_of(split: DataFrame) -> DataFrame:
    """split (g, sid, root, ...) with i, j and k: every pair of nodes of a group in different components meets in a pair of blocks (i, j) of bounded size.

    The nodes of a group's largest component never compare with each other: their blocks (negative numbers) meet those of the others alone."""
    counts = split.groupBy("g", "root").count()
    sizes = counts.groupBy("g").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.max("count").alias("many"), F.sum("count").alias("all"))
    of = lambda c: F.ceil(c / TOGETHER).cast("int")
    sizes = sizes.select("g", "major", of(F.col("many")).alias("nm"), of(F.col("all") - F.col("many")).alias("nr"))
    placed = split.join(sizes, "g").withColumn("most", F.col("root") == F.col("major"))
    k = F.when(F.col("most"), -1 - F.pmod(F.xxhash64("sid"), "nm")).otherwise(F.pmod(F.xxhash64("sid"), "nr")).cast("int")
    rest, most = F.sequence(F.lit(0), F.col("nr") - 1), F.sequence(F.lit(-1), -F.col("nm"), F.lit(-1))
    pair = lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    partners = F.when(F.col("most"), F.transform(rest, lambda x: pair(F.col("k"), x))).otherwise(F.transform(F.concat(rest, most), lambda x: pair(F.col("k"), x)))
    return placed.withColumn("k", k).withColumn("p", F.explode(partners)).select("g", "p.i", "p.j", "k", "sid", "root", "n")


#: Shingles of the documents for each hash range: a range is one group of a task, which holds some 60 bytes for each of its signatures while it sorts them.
RANGE = 1 << 20


def _linked(rows: DataFrame, each: DataFrame, ranges: int | None) -> DataFrame:
    """(sid, d, root): every set with its smallest id, and the component that it belongs to (sets linked with none: their own)."""
    spark = rows.sparkSession
    total = each.agg(F.sum("n")).first()[0] or 0
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE)
    nodes = each.where("d is not null and n > 0").groupBy("sid").agg(F.min("d").alias("d"), F.min("n").alias("n"))
    found = staged(_signed(rows, ranges).groupBy("range").applyInArrow(_grouper(ranges), "g long, members array<long>, to int, pairs binary"), "found")
    pairs = found.where("to is not null").select("to", "pairs").groupBy("to").applyInArrow(_agreeing, "a long, b long")
    large = found.where("to is null").select("g", "members").dropDuplicates(["g"])
    groups = staged(large.unionAll(pairs.select(F.xxhash64("a", "b"), F.array("a", "b"))), "groups")
    members = groups.select("g", F.size("members").alias("m"), F.explode("members").alias("sid"))
    degrees = members.groupBy("sid").agg(F.sum("m").alias("degree"))
    known = staged(degrees.join(nodes, "sid"), "nodes")  # nodes with a candidate
    sketches = _held(rows, known, "sketch", "sketches")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The similar ones: by sketches first, which never lose one, then by whole sets, of which only those of pairs that are left move."""
        side = lambda c, x, m: sketches.select(F.col("sid").alias(c), F.col("s").alias(x), F.col("n").alias(m))
        both = pairs.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b")
        near = staged(both.select("a", "b", "x", "y", "m", "n").mapInArrow(_near, "a long, b long"), f"{name}-near")
        wanted = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(known.select("sid", "d"), "sid")
        sets = _held(rows, staged(wanted, f"{name}-wanted"), "set", f"{name}-sets")
        of = lambda c, x: sets.select(F.col("sid").alias(c), F.col("s").alias(x))
        return staged(near.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), f"{name}-links")

    # first: each node and its neighbour of the highest degree
    ranked = members.join(known.select("sid", "degree"), "sid")
    hub = ranked.groupBy("g").agg(F.max_by("sid", F.struct("degree", "sid")).alias("hub"), F.max(F.struct("degree", "sid")).alias("top"))
    best = members.join(hub, "g").where("sid <> hub").groupBy("sid").agg(F.max_by("hub", "top").alias("hub"))
    tried = staged(best.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct(), "tried")
    links = verified(tried, "tried")
    roots = connected_components(links, "roots")
    # then: pairs still apart; of a large group first each node and its nearest, which joins nearly all, then whatever is left
    pairs_of_two = groups.where(F.size("members") == 2).select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"))
    more = None
    for name, nearest in (("nearest", True), ("rest", False)):
        root = roots.select(F.col("node").alias("sid"), "root")
        wide = members.where(F.col("m") > 2) if nearest else members.join(more, "g", "left_semi")
        placed = wide.join(known.select("sid", "n"), "sid").join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        split = placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g")
        still = staged(placed.join(split, "g").select("g", "sid", "root", "n"), f"{name}-split")
        call = F.pmod(F.xxhash64("g", "i", "j"), F.lit(ranges + still.count() // CALL)).alias("call")
        apart = _blocks_of(still).join(sketches.select("sid", "s"), "sid").select("*", call)
        apart = staged(apart.groupBy("call").applyInArrow(_across(nearest), "a long, b long, g long"), f"{name}-apart")
        more, apart = apart.where("g is not null").select("g").distinct(), apart.where("g is null").select("a", "b")
        if nearest:
            apart = apart.unionAll(pairs_of_two)
        ends = [root.select(F.col("sid").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
        rest = apart.distinct().join(tried, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        rest = staged(rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), name)
        if rest.isEmpty():
            continue
        tried, links = tried.unionAll(rest), links.unionAll(verified(rest, name))
        roots = connected_components(links, f"{name}-roots")
    return nodes.select("sid", "d").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(key, n_shingles, component_id), a row for each row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("long").alias("d"), text_of(text).alias("t"))
    each = staged(_documents(rows), "documents")
    low = staged(_linked(rows, each, ranges), "linked")
    least = low.groupBy("root").agg(F.min("d").alias("component_id"))
    of = low.select("sid", "root").join(least, "root").select("sid", "component_id")
    linked = each.where("d is not null and n > 0").join(of, "sid").select(F.col("d").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
    alone = each.where("d is null or n = 0").select(F.col("d").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("d").cast(kind).alias("component_id"))
    return linked.unionAll(alone)


def _with_set(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with `out`, the hash of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, BLOCK):
            texts = pa.RecordBatch.from_arrays([b.column(text).fill_null("")], ["t"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_sets_of(texts)[2])], [*b.schema.names, out])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{out} long"]))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each component of texts: that with the smallest key stays. Rows that link nothing stay: null keys and texts without a word.

    Of equal rows one stays. Where a key stands on several rows, each is taken by its own text."""
    own, sid = docs.columns, spare(docs.columns, "__sid")
    rows = docs.select(F.col(key).cast("long").alias("d"), text_of(text).alias("t"))
    each = staged(_documents(rows), "documents")
    kept = staged(_linked(rows, each, None).groupBy("root").agg(F.min(F.struct("d", "sid")).alias("k")).select("k.d", "k.sid"), "kept")
    shared = staged(each.where("d is not null").groupBy("d").count().where("count > 1").select("d"), "shared")
    with_words = text_of(text).rlike(r"[^\x20\x09-\x0D]") & F.col(key).isNotNull()
    whole = docs.where(with_words)
    once = whole.join(kept.join(shared, "d", "left_anti").select(F.col("d").alias(key)), key, "left_semi")
    more = _with_set(whole.join(shared.select(F.col("d").alias(key)), key, "left_semi").select(*own), text, sid)
    more = more.join(kept.select(F.col("d").alias(key), F.col("sid").alias(sid)), [key, sid], "left_semi").dropDuplicates([key, sid])
    return once.select(*own).unionAll(more.select(*own)).unionAll(docs.where(~with_words).select(*own))
