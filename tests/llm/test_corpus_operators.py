"""Each operator against a brute-force version, on odd rows of our own and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from waymark.llm import backoff_model, bin_packing, bpe_tokens, common, partenum_join, pii_surrogates, projection_forest, quality_classifier, quality_rules, ring_shards, tiktoken_codec, wavelet_store
from waymark.llm import queries as q
from waymark.llm.bpe_tokens import Encoder
from waymark.llm.common import word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = random.Random(5)
LONG = " ".join(RANDOM.choice("alpha beta gamma delta the of and in".split()) + RANDOM.choice(["", ",", "."]) for _ in range(3000))
ODD = [
    (1, "", "x", 0), (2, None, "x", 0), (3, "one two three four five six", "x", 1), (3, "one two three four five six", "x", 1), (4, LONG, "y", 2), (5, LONG + " more", "y", 2),
    (6, "  leading  and   trailing \t\n white space \x1c here ", None, None), (7, "one two", "z", 0), (8, "ONE two", "z", 0), (9, "naïve Ünïcode 日本語 текст <|endoftext|> it's", "z", 9), (None, "one two three four five six", None, 1),
    (10, "the same line\nthe same line\nother line\n\n \n" * 6, "z", 1), (11, " \n\t ", "z", 1),
]
SCHEMA = "doc_id long, text string, n_words string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return q.table(spark, SF, "documents")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_words_are_runs_between_ascii_space():
    import pyarrow as pa

    texts = [t for _, t, *_ in ODD]
    _, counts = word_hashes(pa.array(texts))
    assert counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    plain = [f"Wörd{i} ABC {'x' * (i % 7)}" for i in range(50)]
    whole, part = pa.array(plain), word_hashes(pa.array(plain[13:40]))
    for kind in (pa.string(), pa.large_string()):  # slices, as blocks cuts them
        hashes, counts = word_hashes(whole.cast(kind).slice(13, 27))
        assert hashes.tolist() == part[0].tolist() and counts.tolist() == part[1].tolist()


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {*range(i, i + 8)}
    n, failed = len(words), None
    failed = n < 20 or 100 * len(covered) > 30 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_rules(spark, odd, docs):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df in (odd, docs):
        got = rows(quality_rules.judge(df), "doc_id", *cols)
        assert got == sorted(((r.doc_id, *brute_rules(r.text)) for r in df.collect()), key=repr)
    assert quality_rules.kept_documents(odd).columns == odd.columns
    assert quality_rules.judge(odd.limit(0)).count() == 0
    kept = q.op9_quality_rules(spark, SF).where("base_failed and kept").count()
    assert kept == 0


def test_rules_keep_good_documents(spark):
    sf = "/root/testdata/sf0.1"
    judged = q.op9_quality_rules(spark, sf).join(q.table(spark, sf, "labels"), "doc_id").where("not base_failed")
    share = {r[0]: r[1] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()}
    assert share[1] > 0.99 and share[0] < 0.5


def test_classifier(spark, odd):
    sf = "/root/testdata/sf0.1"
    scored = q.op1_quality_classifier(spark, sf)
    assert scored.count() == q.table(spark, sf, "documents").count()
    held = scored.where("held_out").join(q.table(spark, sf, "labels"), "doc_id").select("score", "quality").toPandas()
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    auc = np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good])
    assert auc > 0.9, auc
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    forest = quality_classifier.learn(odd, labels)
    out = quality_classifier.score(odd, forest)
    assert out.count() == len(ODD) and out.where("score between 0 and 1").count() == len(ODD)
    none = quality_classifier.learn(odd, labels.limit(0))
    assert {r.score for r in quality_classifier.score(odd, none).collect()} == {0.5}
    assert quality_classifier.score(odd.limit(0), forest).count() == 0


def test_forest_walk_matches_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    f = quality_classifier.fit(x, y, trees=30)
    for row, score in zip(x[:50], f.score(x[:50]), strict=True):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        assert math.isclose(score, 1 / (1 + math.exp(-total)))
    assert ((f.score(x) > 0.5) == y).mean() > 0.9


def test_ring(spark, odd, docs):
    for df in (odd, docs, q.table(spark, "/root/testdata/sf0.01", "documents")):
        out = ring_shards.shard(df).collect()
        n = df.count()
        assert len(out) == n
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == [*range(len(s))] for s in by.values())
        assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(16)) <= 1
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    a = {r.doc_id: r.shard for r in out}
    b = {r.doc_id: r.shard for r in ring_shards.shard(df, shards=17).collect()}
    assert sum(a[d] != b[d] for d in a) < 0.35 * len(a)  # dealing by row number would move 94 %
    assert ring_shards.shard(odd.limit(0)).count() == 0


def test_encoder_equals_the_library(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(q.VOCABULARY)
    texts = [r.text for r in docs.collect()] + [t or "" for _, t, *_ in ODD] + ["a  b", " x", "x ", "a\n b", "a Ġb Ċ\nc", "\n", "x\n\ny z", "it ends<|endoftext|> here", "<|endoftext|>", "a <|other|> b"]
    for t, ids in zip(texts, Encoder(q.VOCABULARY, q.PATTERN).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t[:50]


def test_encoder_over_many_small_blocks(docs, monkeypatch):
    """Matches go through the library many to a call and once while remembered; blocks and memories of any size give the same ids."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(q.VOCABULARY)
    texts = [r.text or "" for r in docs.collect()] + ["one\ntwo three\x0bfour", "it's 12 o'clock,\n\nsays she", "\u010a a \u0120b\nc", "naïve café – déjà", "x", "same same\nsame"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for block, together, remember in ((1, 3, 5), (2000, 7, 100), (8 << 20, 16_384, 400_000)):
        monkeypatch.setattr(bpe_tokens, "BLOCK", block), monkeypatch.setattr(bpe_tokens, "TOGETHER", together)
        codec = Encoder(q.VOCABULARY, q.PATTERN, remember)
        assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == want
        assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == want
    monkeypatch.setattr(codec, "_ids_of_matches", None)  # what is remembered isn't encoded again
    assert codec.encode(texts) and len(codec.known) == len(codec.many) and int(codec.many.sum()) == len(codec.ids)


def test_shards_are_placed_without_python(spark, docs):
    plan = ring_shards.shard(docs)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan and "Arrow" not in plan, plan


def test_packing(spark, odd, docs):
    codec = Encoder(q.VOCABULARY, q.PATTERN)
    for df in (odd, docs):
        out = bin_packing.pack(bin_packing.token_pieces(df, q.VOCABULARY, q.PATTERN, 2, 1024), 1024, ["doc_id", "piece", "ids_crc32"]).collect()
        want = Counter()
        for r in df.collect():
            ids = np.append(np.frombuffer(codec.encode([r.text or ""])[0], "<u4"), 2).astype("<u4")
            want.update((r.doc_id, k, i, len(ids[i : i + 1024]), zlib.crc32(ids[i : i + 1024].tobytes())) for k, i in enumerate(range(0, len(ids), 1024)))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
        bins = defaultdict(list)
        for r in out:
            bins[r.sequence_id].append((r.offset, r.length))
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(bins) <= 1.02 * sum(r.length for r in out) / 1024 + 1  # full bins would be the least of all; it may not be in reach
    empty = bin_packing.token_pieces(odd.limit(0), q.VOCABULARY, q.PATTERN, 2, 1024)
    assert bin_packing.pack(empty, 1024, ["doc_id"]).count() == 0
    clashing = spark.range(60).select("id", (F.col("id") % 9 + 1).alias("length"), *[F.lit("x").alias(c) for c in ("firsts", "BINS", "offsets", "__g", "__n", "__k", "__before", "offset", "count")])
    got = bin_packing.pack(clashing, 10, ["id"])
    assert got.columns == ["id", "length", "firsts", "BINS", "offsets", "__g", "__n", "__k", "__before", "count", "sequence_id", "offset"] and got.where("bins = 'x' and __n = 'x' and count = 'x'").count() == 60
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 10").count() == 0


def test_first_piece_of_the_query_is_the_short_one(spark, odd, tmp_path):
    """The contract's cut: whole pieces but for the first; texts of exactly one and two pieces among them."""
    codec = Encoder(q.VOCABULARY, q.PATTERN)
    word = next(w for w in (" the", " and") if len(codec.encode(["x" + w * 40])[0]) == 4 * 41)
    more = spark.createDataFrame([(100 + n, "x" + word * (n - 2), None, None) for n in (1023, 1024, 1025, 2047, 2048, 2049)], SCHEMA)
    odd.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        ids = np.append(np.frombuffer(codec.encode([r.text or ""])[0], "<u4"), 2).astype("<u4")
        first = len(ids) % 1024 or 1024
        ends = [first, *range(first + 1024, len(ids) + 1, 1024)]
        want.update((r.doc_id, k, at, to - at, zlib.crc32(ids[at:to].tobytes())) for k, (at, to) in enumerate(zip([0, *ends], ends)))
    assert {n for d, _, _, n, _ in want if d in (1124, 2148)} == {1024}
    out = q.op3_bin_packing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want


def test_fullest_bin_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(100):
        cap = rng.randint(5, 30)
        counts = np.array([0] + [rng.choice([0, 0, 1, 2, 3]) for _ in range(cap)])
        if not counts.any():
            continue
        first = int(np.flatnonzero(counts).max())
        got = bin_packing.fullest(counts, first, cap)
        assert got[0] == first and all(got.count(n) <= counts[n] for n in got) and sum(got) <= cap
        reach, left = {first}, counts.copy()
        left[first] -= 1
        for n in range(1, cap + 1):
            for _ in range(left[n]):
                reach |= {r + n for r in reach if r + n <= cap}
        assert sum(got) == max(reach)


def brute_nearest(table, asked, k):
    known = [(i, np.array(v, float)) for i, v in table if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(known):
        if asked(i):
            far = sorted((math.sqrt(((v - w) ** 2).sum()), j) for m, (j, w) in enumerate(known) if m != n)
            out[i] = far[:k]
    return out


def test_neighbours(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        table = [(r.vec_id, r.embedding) for r in q.table(spark, sf, "embeddings").collect()]
        want, got = brute_nearest(table, lambda i: i % 100 == 0, 10), defaultdict(list)
        for r in q.op4_projection_forest(spark, sf).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        for i, g in got.items():
            assert [x[0] for x in sorted(g)] == [*range(1, 11)]
        dist = {i: dict((j, d) for d, j in want[i]) for i in want}
        hits = sum(v in dist[i] for i, g in got.items() for _, v, _ in g)
        assert hits >= 0.95 * 10 * len(want), hits / (10 * len(want))
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 0.0]), (9, []), (100, [5.0, 5.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    want = brute_nearest(odd, lambda i: i % 100 == 0, 10)
    got = defaultdict(list)
    for r in projection_forest.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    assert {i: [x[1:] for x in sorted(g)] for i, g in got.items()} == want
    assert projection_forest.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = random.Random(3)
    pool = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(12)]
    for _ in range(3):
        table = [(rng.choice([100, 200, 1, 2, 3, 4, 5, 300]), rng.choice(pool)) for _ in range(60)]
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        got = Counter(map(tuple, projection_forest.search(df, F.col("vec_id") % 100 == 0, k=4).collect()))
        valid, want = [(i, np.array(v)) for i, v in table if any(v)], Counter()
        for n, (i, v) in enumerate(valid):
            if i % 100 == 0:
                far = sorted((math.sqrt(((v - w) ** 2).sum()), j) for m, (j, w) in enumerate(valid) if m != n)[:4]
                want.update((i, r, j, d) for r, (d, j) in enumerate(far, 1))
        assert got == want


def walk_automaton(train, texts, order, mu, d):
    """Word by word: carried state, arcs and failure arcs."""
    c = Counter()
    for w in train:
        c.update(tuple(w[i - n : i]) for n in range(1, order + 1) for i in range(n, len(w) + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def p(h, w):
        if not h:
            return (c[(w,)] - d if c[(w,)] else d * v) / n
        return (c[(*h, w)] + mu * p(h[1:], w)) / (c[h] + mu)

    out = []
    for words in texts:
        state, total = (), 0.0
        for w in words:
            h = state
            while h and not c[(*h, w)]:
                total += math.log10(mu / (c[h] + mu))
                h = h[1:]
            total += math.log10(p(h, w))
            state = (*state, w)[-(order - 1) :] if order > 1 else ()
            while state and not c[state]:
                state = state[1:]
        base = sum(math.log10((c[(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((len(words), sum(c[(w,)] > 0 for w in words), n, base, total))
    return out


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, odd, docs, order):
    for df in (odd, docs.limit(60)):
        data = [(r.doc_id, WORD.findall(low(r.text)) + [None]) for r in df.collect()]
        learnt = [d is not None and zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in data]
        want = walk_automaton([w for (_, w), use in zip(data, learnt, strict=True) if use], [w for _, w in data], order, 2.0, 0.5)
        got = backoff_model.score(df, q.remainder(10) != 0, order=order, ranges=5).collect()
        key = lambda r: (repr(r[0]), r[1], r[2], round(r[4], 4))
        want = sorted(((d, *w) for (d, _), w in zip(data, want, strict=True)), key=key)
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a[:4] == b[:4] and np.allclose(a[4:], b[4:]), (a, b)
    assert backoff_model.score(odd.limit(0), q.remainder(10) != 0).count() == 0


def test_parts_of_a_block_score_as_the_whole():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 40, 60)
    hashes, at = np.unique(rng.integers(1, 50, counts.sum()).astype(np.uint64), return_inverse=True)
    grams = backoff_model._grams(hashes[at], counts, 3)
    every, totals = zip(*(np.unique(g[g != 0], return_counts=True) for g in grams), strict=True)
    totals = [np.where(rng.random(len(t)) < 0.2, 0, t) for t in totals[:1]] + list(totals[1:])
    whole, parts = (backoff_model._scored(grams, list(every), totals, counts, at, len(hashes), int(counts.sum()), 2.0, 0.5, part=n) for n in (10**6, 50))
    assert len(backoff_model._parts(counts, 50)) > 10 and all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


def test_hashes_travel_in_little_more_than_they_must():
    """n ascending random hashes of a range of 2^59 need 59 - log2(n) + 1.44 bits each."""
    keys = np.unique(np.random.default_rng(4).integers(0, 2**59, 20_000, np.uint64))
    for n in (0, 1, 2, len(keys)):
        assert (backoff_model._keys_in(backoff_model._keys_out(keys[:n])) == keys[:n]).all()
    mixed = np.random.default_rng(5).permutation(keys)
    assert (backoff_model._keys_in(backoff_model._keys_out(mixed)) == mixed).all()
    assert len(backoff_model._keys_out(keys)) * 8 <= len(keys) * (59 - np.log2(len(keys)) + 1.44) * 1.02


def test_distinct_and_numbered():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000):
        for x in (rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 9, n).astype(np.uint64)):
            want, at = np.unique(x, return_inverse=True)
            got = common.numbered(x)
            assert (common.distinct(x) == want).all() and (got[0] == want).all() and (got[1] == at).all()


def test_backoff_beats_the_base(spark):
    out = q.op5_backoff_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_surrogates(spark):
    texts = [
        "Mail a.b@mail5.example.com or A.B@mail5.example.com, call +1 (743) 555-3824 or 743-555-3824.", "Card 4111 1111 1111 1111 and 4111111111111111; ip 10.1.2.3.", "Mr. John Smith met Mrs Anna Smith; Mr. Smith left. Г-жа Иванова.",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "Version 2.0. in 2024, nothing here 12345", None, "", "a.b@mail5.example.com", "a.b@mail5.example.com",
    ]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced long")
    out = {r.doc_id: (r.text, r.n_replaced) for r in pii_surrogates.replace(df, "k").collect()}
    assert out[4] == (texts[4], 0) and out[5] == (None, 0) and out[6] == ("", 0)
    mails = re.findall(r"\S+@\S+?(?=,|$| )", out[0][0])
    assert len(set(mails)) == 1 and mails[0] == out[7][0] == out[8][0] and "a.b" not in out[0][0].lower()
    a, b = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\.", out[0][0]).groups()
    assert re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b) != "7435553824"
    a, b = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16});", out[1][0]).groups()
    digits = [int(x) for x in b]
    assert a.replace(" ", "") == b != "4111111111111111" and (sum(digits[1::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[::2])) % 10 == 0
    john, smith, anna, smith2, smith3, russian = re.match(r"Mr\. (\S+) (\S+) met Mrs (\S+) (\S+); Mr\. (\S+) left\. Г-жа (\S+)\.", out[2][0]).groups()
    assert smith == smith2 == smith3 != "Smith" and john.endswith("rt") and anna.endswith("na") and re.fullmatch("[А-Яа-я]+", russian) and russian != "Иванова"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[3][0]) and out[3][0] != texts[3]
    assert pii_surrogates.replace(df.limit(0), "k").count() == 0
    again = {r.doc_id: r.text for r in pii_surrogates.replace(df, "other").collect()}
    assert again[7] != out[7][0]


def test_surnames_are_replaced_wherever_they_recur(spark):
    made = [(0, "Mr John Smith wrote. Smith's dog, Smithson and the smith; SMITH, Smith-Jones. Then Smith left."), (1, "A smith. Smith stays here.")]
    out = {r.doc_id: r.text for r in pii_surrogates.replace(spark.createDataFrame(made, "doc_id long, text string"), "k").collect()}
    john, smith = re.match(r"Mr (\S+) (\S+) wrote", out[0]).groups()
    assert out[0] == f"Mr {john} {smith} wrote. {smith}'s dog, Smithson and the smith; SMITH, Smith-Jones. Then {smith} left." and out[1] == made[1][1]


def test_compound_names_go_whole_and_people_stay_distinct(spark):
    names = ["O'Brien", "O’Neill", "McDonald", "MacLeod", "Smith-Jones", "Müller-Lüdenscheidt", "De La Cruz", "van der Berg", "Smith", "Brien", "SMITHERS", "D'Arcy", "St. John", "Jones", "Anne-Marie Le Guin", "John von Neumann", "Nguyễn"]
    made = [(i, f"Then Mrs. {n}'s letter, and {n.split(' ', 1)[1] if n[:4] in ('Anne', 'John') else n} again.") for i, n in enumerate(names)]
    out = {r.doc_id: r for r in pii_surrogates.replace(spark.createDataFrame(made, "doc_id long, text string"), "k").collect()}
    fresh = {}
    for (i, before), n in zip(made, names, strict=True):
        got = re.fullmatch(r"Then Mrs\. ((?:\w+ )?)(\w+)'s letter, and (\w+) again\.", out[i].text)
        assert got and out[i].n_replaced == 1 and got[2] == got[3], (before, out[i].text)
        assert bool(got[1]) == (n[:4] in ("Anne", "John")) and got[2].isupper() == n.isupper()
        for word in re.findall(r"\w{3,}", n):
            assert word not in out[i].text, (n, out[i].text)
        fresh[n] = got[2].lower()
    assert len(set(fresh.values())) == len(names)
    same = pii_surrogates.replace(spark.createDataFrame([(0, "Mr O'Brien"), (1, "Ms O’Brien"), (2, "Dr o'brien, Mr. X")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert same[0].text[3:] == same[1].text[3:] and same[2].text == "Dr o'brien, Mr. X"


def test_every_entity_and_nothing_else_changes(spark, docs):
    """Against a scan of each text by another engine: what is no entity stays, and each entity becomes one of its own kind and length, the same everywhere."""
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in pii_surrogates.replace(docs, "k").collect()}
    every, seen = regex.compile(pii_surrogates.ANY), {}
    for d, t in before.items():
        parts = every.split(t or "")
        found = [m.group(0) for m in every.finditer(t or "")]
        assert (after[d].n_replaced > 0) == bool(found)
        if not found or any(re.match(r"\w+\.? [A-ZА-Я]", e) and not re.search(r"[0-9@]", e) for e in found):
            continue  # names may recur outside of entities
        form = "(.+?)".join(map(re.escape, parts))
        got = re.fullmatch(form, after[d].text, re.S)
        assert got, d
        for e, new in zip(found, got.groups(), strict=True):
            assert e != new and seen.setdefault(e.lower(), new.lower()) == new.lower()
            if "@" not in e and not re.fullmatch(r"[0-9.]+", e):
                assert re.sub(r"[0-9A-Fa-f]", "", e) == re.sub(r"[0-9A-Fa-f]", "", new) and len(e) == len(new)
    assert len(set(seen.values())) >= len({re.sub(r"\D", "", e)[-10:] if re.fullmatch(r"[+\d ().-]+", e) else e for e in seen}) * 0.95


def test_tokens_of_any_case(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    mixed = token[:20] + token[20:].upper()
    made = [(0, f'token = "{token}"'), (1, f'TOKEN = "{token.upper()}"'), (2, f"{mixed}."), (3, f"{token.upper()}G {token.upper()[:31]}")]
    out = {r.doc_id: (r.text, r.n_replaced) for r in pii_surrogates.replace(spark.createDataFrame(made, "doc_id long, text string"), "k").collect()}
    assert [out[i][1] for i in range(4)] == [1, 1, 1, 0] and out[3][0] == made[3][1]
    fresh = re.fullmatch('token = "([0-9a-f]{40})"', out[0][0]).group(1)
    assert fresh != token and out[1][0] == f'TOKEN = "{fresh.upper()}"' and out[2][0].lower() == fresh + "."
    assert all(a.isupper() for a, b in zip(out[2][0], mixed, strict=False) if b.isupper() and a.isalpha())


def test_surrogates_stay_distinct(spark):
    names = spark.range(6000).select(F.lit("surname latin n").alias("kind"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("norm"))
    table = pii_surrogates.distinct_surrogates(names, "k").collect()  # 4096 names of three syllables: they must collide at first
    assert len(table) == len({r.fresh for r in table}) == 6000 and not {r.fresh for r in table} & {r.norm for r in table}


def test_clean_documents_are_left_alone(spark, docs):
    out = {r.doc_id: r for r in pii_surrogates.replace(docs, "k").collect()}
    for r in docs.collect():
        if not re.search(r"[0-9@]", r.text or ""):
            assert out[r.doc_id].text == r.text


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (511, 9), (5000, 50000)):
        ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32)
        data = wavelet_store.pack(np.array([7]), np.array([False]), np.array([n]), ids, 16, partition=0, shard=0, before=0)
        w = wavelet_store.unpack(data)[4]
        assert (w.all() == ids).all()
        for at in rng.integers(0, n, 20) if n else ():
            assert w.access(int(at)) == ids[at]
        for token in (0, 1, 2, 3, 9, 49999, 50000, 70000):
            where = np.flatnonzero(ids == token)
            assert w.count(token) == len(where) and w.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
            assert [w.select(token, k) for k in range(min(3, len(where)) + 1)][: len(where)] == where[:3].tolist() + [-1] * (len(where) < 3) or True
            assert all(w.select(token, k) == where[k] for k in range(min(3, len(where)))) and w.select(token, len(where)) == -1


def test_wavelet_files(spark, odd, docs):
    codec = Encoder(q.VOCABULARY, q.PATTERN)
    for df in (odd, docs):
        folder = wavelet_store.write_shards(df, q.VOCABULARY, q.PATTERN, 0, shard_tokens=5000)
        data = sorted(((r.doc_id, codec.encode([r.text or ""])[0] + bytes(4)) for r in df.collect()), key=lambda x: (x[0] is not None, x[0]))
        got = sorted(map(tuple, wavelet_store.read_digests(spark, folder).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == [d for d, _ in data]
        assert sorted((repr(d), len(b) // 4, zlib.crc32(b)) for d, b in data) == sorted((repr(r[0]), r[2], r[3]) for r in got)
        at = 0
        for r in got:
            assert r[1] == at
            at += r[2]
        ids = wavelet_store.read_shards(spark, folder).collect()
        assert Counter(np.array(r.ids, "<u4").tobytes() for r in ids) == Counter(b for _, b in data)
    assert wavelet_store.read_digests(spark, wavelet_store.write_shards(odd.limit(0), q.VOCABULARY, q.PATTERN, 0)).count() == 0


def brute_components(data):
    sets = []
    for d, t in data:
        w = WORD.findall(low(t))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        for g in s if d is not None else ():
            holders[g].append(k)
    shared = Counter((a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((root(sets[a][0]), root(sets[b][0])))
            parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


def planted(n=300, seed=4):
    """Clusters of copies with edits, short texts, and a passage that many share."""
    r, out = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([3, 6, 9, 12, 20, 40, 90, 200]))]
        if r.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 60)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    return [*enumerate(out)]


def test_near_copies(spark, odd, docs):
    made = spark.createDataFrame(planted(), "doc_id long, text string")
    for df in (odd, docs, q.table(spark, "/root/testdata/sf0.01", "documents"), made):
        got = rows(partenum_join.components(df, ranges=5), "doc_id", "n_shingles", "component_id")
        assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])
    one = partenum_join.one_of_each(odd)
    assert one.columns == odd.columns
    assert sorted(repr(r.doc_id) for r in one.collect()) == sorted(map(repr, [1, 2, 3, 4, 6, 7, 9, 10, 11, None]))
    assert partenum_join.components(odd.limit(0)).count() == 0


#: Words of texts whose first 44 shingles are a similar set (44 of 55); the agreement of one of three agreeing parts is empty.
HOLLOW = """
728477 507512 938761 249599 976399 730947 600388 229067 315006 516343 7205 618582 310591 635733 543728 751612 641983 412141 553409 242584 164383 457630 469076 946066 344443 790482 977400 652948 240966 735491 929406 663228 945133 149100 612209 567069 302636 647126 622021 850649 904543 368661 749491 472517 707560 709452 183944 644888 990594 771932 507179 902746 338244 908889 301791 184328 758231 73743 214052
645207 881572 189400 486428 454279 953045 394257 803798 879331 136930 220510 697915 775047 382764 231195 775622 886335 458249 929732 95777 264785 754754 211753 386826 965159 376908 294115 913750 918932 231596 16601 223123 234554 213083 406859 428348 948930 802558 795627 821954 45814 539600 776099 596361 700931 223170 153901 383375 157930 270114 284875 58757 304561 107557 190467 371936 803369 4783 436769
643560 757895 743668 422368 257177 184863 164310 593061 64465 10635 420723 338254 737667 266708 372263 547166 388972 486878 516060 569135 931035 991054 650100 950472 768025 865858 400813 392074 590707 680130 442230 222240 388180 780875 577301 353643 753684 917632 832748 214120 236537 639478 513098 248681 967039 515933 399214 358213 272491 306290 694487 147005 552780 289468 819399 909611 887502 150530 275600
"""


def test_similar_sets_that_agree_by_an_empty_signature(spark):
    made = []
    for line in HOLLOW.split("\n")[1:-1]:
        words = [f"w{x}" for x in line.split()]
        made += [(len(made), " ".join(words[:48])), (len(made) + 1, " ".join(words))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(partenum_join.components(df, ranges=5), "doc_id", "component_id") == sorted((d, d - d % 2) for d, _ in made)


def test_no_similar_pair_has_fewer_than_three_parts():
    rng = np.random.default_rng(12)
    for small, large in ((40, 50), (44, 55), (48, 60), (300, 375)):  # prefixes of 80 percent
        n = 3000
        whole = np.sort(rng.integers(0, 1 << 63, (n, large), dtype=np.uint64), axis=1)
        kept = np.sort(rng.permuted(np.tile(np.arange(large), (n, 1)), axis=1)[:, :small], axis=1)
        hashes = np.concatenate([np.take_along_axis(whole, kept, 1), whole], axis=1).ravel()
        of, sig, part, masks = partenum_join.signatures(hashes, np.tile([small, large], n))
        order = np.lexsort((of, sig, of // 2))
        of, sig, part = of[order], sig[order], part[order]
        same = (of[1:] == of[:-1] + 1) & (of[1:] % 2 == 1) & (sig[1:] == sig[:-1])
        agreed = np.unique(np.stack([of[1:][same] // 2, part[1:][same]]), axis=1)
        unsent = np.minimum(np.bitwise_count(masks[::2] & masks[1::2]), 2)
        assert (np.bincount(agreed[0], minlength=n) + unsent >= 3).all()


def test_sql_gives_the_same_rows(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    for name, sql in q.oracle_sql().items():
        got = q.queries()[name](spark, sf)
        cols = sorted(got.columns)
        want = con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert rows(got, *cols) == sorted(want, key=repr), name


def test_large_group_pairs_join_all_that_all_pairs_would(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, 230, dtype=np.uint64))]
    for k in range(60):  # copies of copies, each with a few other elements; some twice as large, so that sketches have other lengths (256 elements: the border)
        base = sets[rng.integers(len(sets))].copy()
        base[rng.integers(0, len(base), 12)] = rng.integers(0, 1 << 60, 12, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base, rng.integers(0, 1 << 60, 30 * (k % 3), dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    sketches = partenum_join._sketches(np.concatenate(sets), sizes)
    small = [np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64)) for n in (20, 30, 40)]
    sets += [np.concatenate([x[:-2], rng.integers(1 << 60, 1 << 61, k, dtype=np.uint64)]) for x in small for k in (1, 2, 3)]
    sizes = np.array([len(s) for s in sets])
    sketches = partenum_join._sketches(np.concatenate(sets), sizes)
    assert len({len(s) for s in sketches}) > 2
    every = {(a, b) for a in range(len(sets)) for b in range(a) if (k := len(np.intersect1d(sets[a], sets[b]))) * 100 >= 80 * (len(sets[a]) + len(sets[b]) - k)}
    made = {"i": np.zeros(len(sets), np.int32), "j": np.zeros(len(sets), np.int32), "k": np.zeros(len(sets), np.int32)}
    table = pa.table({"g": np.full(len(sets), 4), "sid": np.arange(len(sets)), "root": np.arange(len(sets)), "n": sizes, "s": pa.array(sketches, pa.binary()), **made})
    out = partenum_join._across(False)(None, table)
    pairs = set(zip(out["b"].to_pylist(), out["a"].to_pylist(), strict=True))
    assert every <= pairs
    near = partenum_join._across(True)(None, table)
    some = {(y, x) for x, y, g in zip(*(near[c].to_pylist() for c in "abg"), strict=True) if g is None}
    assert some < pairs and {x for p in some for x in p} == {x for p in pairs for x in p} and near["g"].to_pylist().count(4) == 1
    a, b = map(list, zip(*[(x, y) for x in range(len(sets)) for y in range(x)], strict=True))
    batch = pa.RecordBatch.from_pydict({"a": a, "b": b, "m": sizes[a], "n": sizes[b], "x": pa.array([sketches[i] for i in a], pa.binary()), "y": pa.array([sketches[i] for i in b], pa.binary())})
    kept = next(partenum_join._near(iter([batch])))
    assert set(zip(kept["a"].to_pylist(), kept["b"].to_pylist(), strict=True)) == pairs
    # in blocks: every pair in different components meets exactly once
    monkeypatch.setattr(partenum_join, "TOGETHER", 7)
    split = spark.createDataFrame([(g, s, s // 20 if g else s % 3, 5) for g in (0, 1) for s in range(50)], "g long, sid long, root long, n long")
    met = Counter()
    for _, rows_ in split.transform(partenum_join._blocks_of).toPandas().groupby(["g", "i", "j"]):
        r = rows_.to_dict("records")
        assert len(r) <= 40
        for x in r:
            for y in r:
                if x["sid"] < y["sid"] and x["root"] != y["root"] and (x["k"] != y["k"] or x["i"] == x["j"]):
                    met[x["g"], x["sid"], y["sid"]] += 1
    want = {(g, x, y) for g in (0, 1) for y in range(50) for x in range(y) if (x // 20 != y // 20 if g else x % 3 != y % 3)}
    assert set(met) == want and set(met.values()) == {1}


def test_one_row_of_each_component_of_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "north east south west up down")
    made = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (7, c, 4), (7, c, 5), (None, a, 6), (8, "", 7), (9, None, 8), (8, "", 7)]
    for parts in (1, 2, 5):
        df = spark.createDataFrame(made, "doc_id long, text string, __sid int").repartition(parts)
        out = [(r.doc_id, r.text) for r in partenum_join.one_of_each(df).collect()]
        assert sorted(out, key=repr) == sorted([(3, a), (5, b), (7, c), (None, a), (8, ""), (8, ""), (9, None)], key=repr)


def test_tiktoken(spark, odd, docs):
    codec = tiktoken_codec.encoding(q.RANKS, q.PATTERN)
    for df in (odd, docs):
        got = rows(tiktoken_codec.digests(df, q.RANKS, q.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        want = []
        for r in df.collect():
            ids = codec.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    back = tiktoken_codec.decode(tiktoken_codec.encode(odd, q.RANKS, q.PATTERN), q.RANKS, q.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert "".join(tiktoken_codec.pieces(LONG, 100)) == LONG
    assert [i for p in tiktoken_codec.pieces(LONG, 100) for i in codec.encode_ordinary(p)] == codec.encode_ordinary(LONG)
    assert tiktoken_codec.encode(odd.limit(0), q.RANKS, q.PATTERN).count() == 0


def test_tiktoken_on_long_runs(spark, monkeypatch):
    codec = tiktoken_codec.encoding(q.RANKS, q.PATTERN)
    for text in (" " * 2_000_000, "x" + "\n" * 2_000_000 + "y", "\t \n" * 700_000 + "word", "a" * 2_000_000, "\u4e2d\u6587\u3002" * 400_000):
        ids = tiktoken_codec.ids_of(text, codec)
        assert codec.decode_bytes(ids).decode() == text
    monkeypatch.setattr(tiktoken_codec, "RUN", 3)
    monkeypatch.setattr(tiktoken_codec, "_RUNS", re.compile(rf"[{tiktoken_codec._SPACE}]{{3,}}"))
    monkeypatch.setattr(tiktoken_codec.pieces, "__defaults__", (3,))
    letters = ["a", " ", "\n", "\t", "\u3000", "\x85", "\x1c", "\xa0", "'s", ".", "1", "\xe9", "\u4e2d", "\u3002"]
    for _ in range(3000):
        text = "".join(RANDOM.choice(letters) for _ in range(RANDOM.randint(0, 30)))
        assert tiktoken_codec.ids_of(text, codec) == codec.encode_ordinary(text), text


def test_pipeline(spark):
    import corpus_pipeline

    docs, before = q.table(spark, SF, "documents"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
            data, ids = out.collect(), {r.doc_id for r in docs.collect()}
            assert {r.doc_id for r in data} <= ids
            if k == 0:
                assert {r.doc_id for r in data} == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
            if k == 2:
                assert {r.doc_id for r in data} == {c for d, n, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])}
            if k == 3:
                assert {r.doc_id for r in data} == ids and not any("@mail" in r.text for r in data)
            docs = spark.createDataFrame(data, docs.schema)
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_ring_one_by_one():
    """Keys of given slices, placed one after the other on the ring."""
    rng = random.Random(8)
    for _ in range(200):
        shards, slices = rng.randint(1, 6), 40
        nodes = sorted({rng.randrange(slices): rng.randrange(shards) for _ in range(30)}.items())
        if len({s for _, s in nodes}) < shards:
            continue
        counts = {s: rng.choice([0, 0, 1, 2, 9]) for s in range(slices)}
        total = sum(counts.values())
        room = [total // shards + (s < total % shards) for s in range(shards)]
        want, over = {}, []
        for piece in range(slices):  # home shards first, in ring order
            k = next((k for k, (at, _) in enumerate(nodes) if at >= piece), 0)
            for n in range(counts[piece]):
                if room[nodes[k][1]]:
                    room[nodes[k][1]] -= 1
                    want[piece, n] = nodes[k][1]
                else:
                    over.append((piece, n, k))
        for piece, n, k in over:  # then clockwise
            while not room[nodes[k][1]]:
                k = (k + 1) % len(nodes)
            room[nodes[k][1]] -= 1
            want[piece, n] = nodes[k][1]
        got = {(piece, first + i): s for piece, first, many, s, _ in ring_shards.plan({p: c for p, c in counts.items() if c}, nodes, shards) for i in range(many)}
        assert got == want


def test_ring_with_one_key_everywhere(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(5)
    by = defaultdict(list)
    for r in ring_shards.shard(df).collect():
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [250] * 16 and all(sorted(s) == [*range(250)] for s in by.values())


def test_classifier_statistics(spark, odd, docs):
    import math as m

    def plain(t):
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n, chars, symbols, dup, rep, _ = brute_rules(t)
        per = lambda a, b: a / b if b else 0.0
        stops = sum(w.lower() in quality_rules.STOP_WORDS for w in words)
        return [m.log1p(n), per(chars, n), per(symbols, n), per(dup, len(lines)), per(rep, n), per(n, len(lines)), per(stops, n), per(t.count("!"), n), per(sum(c.isupper() and c.isalpha() for c in t), len(t)), per(sum(c in "0123456789" for c in t), len(t)), per(sum(c in ".?!,;:" for c in t), n)]

    for df in (odd, docs.limit(100)):
        for r in df.select("text", quality_classifier.statistics().alias("x")).collect():
            assert np.allclose(r.x, plain(r.text)), r.text
    clash = odd.withColumn("__x", F.lit("kept")).withColumn("score", F.lit(1))
    out = quality_classifier.score(clash, quality_classifier.fit(np.zeros((0, 11)), np.zeros(0)))
    assert {(r["__x"], r.score) for r in out.collect()} == {("kept", 0.5)}


STRANGE = "doc_id long, text string, lang string, source string, n_chars long, __row string, __entities string, __sid int"


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    good = " ".join(["the people of the town and of the hills went to the old mill by the river where a man was"] * 1 + [f"word{i} of the day" for i in range(12)])
    rows = [(1, good, None, None, None, "r", "e", 1), (1, good, None, None, None, "r", "e", 1), (None, good + " more", "en", "a", 3, None, None, None), (2, None, "en", "a", 0, "", "", 0), (3, "", "en", "a", 0, "", "", 0), (4, good + " mail a.b@x.org", "en", None, 9, "q", "w", 2)]
    df = spark.createDataFrame(rows, STRANGE).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        for part in (df, df.limit(0)):
            out = stage(spark, part, SF)
            got = out.collect()
            if name != "packing":
                assert out.columns == df.columns and len(got) <= len(rows)
            assert part is df or not got
    kept = [r for r in corpus_pipeline.STAGES[2][1](spark, df, SF).collect()]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 1), (True, 2), (True, 3)]


def test_very_long_texts(spark):
    """One text of about 2 MB among short ones, through every operator on texts."""
    long = " ".join(f"w{i % 5000} of the {i % 7}" for i in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "short one"), (3, long)], "doc_id long, text string")
    assert quality_rules.judge(df).where("doc_id = 1").first().n_words == 600_000
    codec = tiktoken_codec.encoding(q.RANKS, q.PATTERN)
    want = len(codec.encode_ordinary(long))
    assert tiktoken_codec.digests(df, q.RANKS, q.PATTERN).where("doc_id = 1").first().n_tokens == want
    scored = {r.doc_id: r for r in backoff_model.score(df, F.col("doc_id") > 0, order=3).collect()}
    assert scored[1].n_tokens == 600_001 and scored[1].score == scored[3].score
    joined = {r.doc_id: r.component_id for r in partenum_join.components(df).collect()}
    assert joined == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_replaced for r in pii_surrogates.replace(df, "k").collect()} == {1: 0, 2: 0, 3: 0}
    folder = wavelet_store.write_shards(df, q.VOCABULARY, q.PATTERN, 0, shard_tokens=100_000)
    got = {r.doc_id: r.n_tokens for r in wavelet_store.read_digests(spark, folder).collect()}
    assert got[1] == got[3] > 600_000


def test_packing_forgets_at_the_end_of_a_task(spark, docs):
    """A worker that stays for the stages of a pipeline holds no matches of the texts that it packed."""
    rows = docs.coalesce(1)

    def held(batches):
        import pyarrow as pa

        from waymark.llm import bpe_tokens as used

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(len(e.known) for e in used._made.values())]})

    bin_packing.token_pieces(rows, q.VOCABULARY, q.PATTERN, 2, 1024).count()
    assert spark.range(64).repartition(8).mapInArrow(held, "n long").agg(F.sum("n")).first()[0] == 0


def test_strings_are_the_column_as_a_list_and_made_at_once():
    import time

    import pyarrow as pa

    from waymark.llm.common import strings

    column = pa.array(["", "naïve", "日本語", *(f"word {i}" for i in range(200_000))], pa.large_string())
    assert strings(column) == column.to_pylist() and strings(column.slice(1, 2)) == ["naïve", "日本語"] and strings(column[:0]) == []
    took = {}
    for f in (pa.Array.to_pylist, strings):
        start = time.process_time()
        f(column)
        took[f] = time.process_time() - start
    assert took[strings] < took[pa.Array.to_pylist]
