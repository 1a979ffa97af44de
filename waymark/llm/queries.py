"""The query of each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_model, bin_packing, part_codes, partenum_join, pii_surrogates, projection_forest, quality_classifier, quality_rules, residual_codes, ring_shards, sort_means, tiktoken_codec, wavelet_store

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Key of the surrogates; a deployment sets its own.
SECRET = "set a secret of your own"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = quality_classifier.score(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op3_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bin_packing.token_pieces(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, end_id=2, capacity=1024, short_first=True)
    return bin_packing.pack(pieces, 1024, salt=["doc_id", "piece", "ids_crc32"])


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_backoff_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_model.score(table(spark, sf_dir, "documents"), remainder(10) != 0, order=3)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SECRET)


def op7_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = wavelet_store.write_shards(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, end_id=0)
    return wavelet_store.read_digests(spark, folder)


def op8_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.components(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_tiktoken_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiktoken_codec.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return sort_means.clusters(table(spark, sf_dir, "embeddings"), hashed, k=8, rounds=10, scale=1024, dim=64)


def op12_residual_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_codes.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def queries() -> dict:
    named = (op1_quality_classifier, op2_ring_shards, op3_bin_packing, op4_projection_forest, op5_backoff_model, op6_pii_surrogates, op7_wavelet_store, op8_partenum_join, op9_quality_rules, op10_tiktoken_codec, op11_sort_means, op12_residual_codes, op13_part_codes)
    return {f.__name__: f for f in named}


_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

RULES_SQL = rf"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
 a as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from d),
 g as (select rid, unnest(range(1, len(words) - 6)) i, words from a where len(words) >= 8),
 twice as (select rid, i from (select rid, i, count(*) over (partition by rid, array_to_string(words[i:i + 7], ' ')) c from g) where c > 1),
 gaps as (select rid, least(8, coalesce(lead(i) over (partition by rid order by i) - i, 8)) n from twice),
 r as (select rid, sum(n) n from gaps group by rid),
 s as (select doc_id, cast(len(words) as bigint) n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, cast(coalesce(r.n, 0) as bigint) n_repeat_words, len(lines) n_lines,
  len(list_filter(words, lambda w: lower(w) in ({_STOPS}))) n_stops, length(regexp_replace(t, '[^!]+', '', 'g')) n_exclaims from a left join r using (rid)),
 f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from s)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and word_chars / n_words between 2 and 14 and n_symbols / n_words <= 0.25::double
  and n_stops / n_words >= 0.03::double and n_dup_lines / n_lines <= 0.5::double and n_exclaims / n_words <= 0.5::double and n_repeat_words / n_words <= 0.3::double as kept from f"""

LINKS_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words from documents),
 sets as (select doc_id, case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) when len(words) > 0 then [array_to_string(words, ' ')] else [] end s from w),
 sized as (select doc_id, cast(len(s) as bigint) n from sets), each as (select doc_id, unnest(s) g from sets),
 pairs as (select a.doc_id x, b.doc_id y, count(*) n from each a join each b on a.g = b.g and a.doc_id <> b.doc_id group by all),
 links as (select x, y from pairs p join sized a on a.doc_id = x join sized b on b.doc_id = y where 100 * p.n >= 80 * (a.n + b.n - p.n)),
 reach(doc_id, c) as (select doc_id, doc_id from sized union select l.y, r.c from reach r join links l on l.x = r.doc_id)
 select doc_id, n as n_shingles, c as component_id from sized join (select doc_id, min(c) c from reach group by doc_id) using (doc_id)"""


_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"


def _floor(total: str, n: str) -> str:
    return f"({total} - (({total} % {n}) + {n}) % {n}) // {n}"


def _means_sql(k: int, rounds: int, scale: int, dim: int) -> str:
    """Every round scans all centroids of every vector."""
    near = lambda c: f"select rid, c, d from (select rid, c, sum((x.v - m.v) * (x.v - m.v)) d from x join {c} m using (p) group by rid, c) qualify row_number() over (partition by rid order by d, c) = 1"
    out = f"""with v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::hugeint) e from embeddings where {_FINITE} and len(embedding) = {dim}),
 x as materialized (select rid, unnest(range({dim})) p, unnest(e) v from v), f as (select row_number() over (order by sha256('3:' || vec_id), e) - 1 c, e from v where vec_id is not null qualify c < {k}), c0 as materialized (select c, unnest(range({dim})) p, unnest(e) v from f)"""
    for r in range(1, rounds + 1):
        out += f""",\n a{r} as materialized ({near(f"c{r - 1}")}), c{r} as materialized (select o.c, o.p, coalesce(n.v, o.v) v from c{r - 1} o left join (select c, p, {_floor("sum(v)", "count(*)")} v from a{r} join x using (rid) group by c, p) n using (c, p))"""
    return out + f""",\n l as materialized ({near(f"c{rounds}")}), i as (select c, sum(d) n from l group by c), h as (select c, sha256(string_agg(v::varchar, ',' order by p)) h from c{rounds} group by c)
 select vec_id, c::int as cluster, d::bigint as distance, i.n::bigint as cluster_inertia, (select sum(d) from l)::bigint as inertia, h as centroid_sha256 from l join v using (rid) join i using (c) join h using (c)"""


def _near_sql(threshold: float) -> str:
    """All pairs of a label; the operator's share of links is 1 here, as the tests measure."""
    return f"""with recursive a as materialized (select row_number() over () rid, vec_id, label, embedding::double[] e from embeddings), u as materialized (select * from a where label is not null and vec_id is not null and {_FINITE.replace("embedding", "e")} and len(list_filter(e, lambda x: x <> 0)) > 0),
 links as materialized (select x.rid x, y.rid y from u x join u y on x.label = y.label and x.rid <> y.rid and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= {threshold}),
 reach(rid, c) as (select rid, rid from a union select l.y, r.c from reach r join links l on l.x = r.rid), low as (select r.rid, min(a.vec_id) c from reach r join a on a.rid = r.c group by r.rid), n as (select x, count(*) n from links group by x)
 select vec_id, coalesce(n.n, 0)::bigint as n_links, c as component_id, vec_id is not distinct from c as kept from a join low using (rid) left join n on n.x = a.rid"""


def _codes_sql(parts: int, entries: int, rounds: int, scale: int, dim: int) -> str:
    """Every round goes over the parts of all vectors."""
    width = dim // parts
    near = lambda c: f"select rid, g, c, d from (select rid, x.g, c, sum((x.v - m.v) * (x.v - m.v)) d from x join {c} m using (p) group by rid, x.g, c) qualify row_number() over (partition by rid, g order by d, c) = 1"
    out = f"""with v as materialized (select row_number() over () rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::hugeint) e from embeddings where {_FINITE}),
 x as materialized (select rid, p, p // {width} g, v from (select rid, unnest(range({dim})) p, unnest(e) v from v)), f as (select row_number() over (order by vec_id, e) - 1 c, e from v where vec_id is not null qualify c < {entries}), c0 as materialized (select c, unnest(range({dim})) p, unnest(e) v from f)"""
    for r in range(1, rounds + 1):
        out += f""",\n a{r} as materialized ({near(f"c{r - 1}")}), c{r} as materialized (select o.c, o.p, coalesce(n.v, o.v) v from c{r - 1} o left join (select c, p, {_floor("sum(v)", "count(*)")} v from a{r} join x using (rid, g) group by c, p) n using (c, p))"""
    return out + f""",\n l as materialized ({near(f"c{rounds}")}), s as (select rid, string_agg(printf('%02x', c), '' order by g) code, sum(d) error from l group by rid)
 select vec_id, code, error::bigint as error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(v::varchar, ',' order by p // {width}, c, p)) from c{rounds}) as codebooks_sha256 from s join v using (rid)"""


def oracle_sql() -> dict[str, str]:
    """Exact SQL where an operator has one."""
    return {
        "op8_partenum_join": LINKS_SQL, "op9_quality_rules": RULES_SQL, "op11_sort_means": _means_sql(8, 10, 1024, 64), "op12_residual_codes": _near_sql(0.93), "op13_part_codes": _codes_sql(8, 16, 6, 4096, 64),
    }
