"""The registered queries of the corpus operators: each a thin digest of an operator's output, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm_index, hilbert, licenses, mixing, multiset_hash, quality, sentence_spans, simhash, toxicity, warc
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.schedule(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), repeats=3, budget=1.0)
    return planned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "start", F.col("copies").cast("long").alias("copies"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.assign(table(spark, sf_dir, "documents"), shards=24, law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    digest = F.sha2(F.concat_ws(",", F.array_sort("hit_items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("sentence")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op7_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs, least_sentences=3, least_words=20)


def op8_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_hilbert_sharding": op3_hilbert_sharding,
    "op4_fm_decontamination": op4_fm_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_sentence_span_dedup": op7_sentence_span_dedup,
    "op8_multiset_fingerprints": op8_multiset_fingerprints,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_quality": op10_quality,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, substr(md5('v' || doc_id || ':17'), 1, 15) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::double as weight from s),
o as (select *, source_size * 3.0 / weight as dry from w),
c as (select *, (sum(source_size) over () - coalesce(sum(source_size * 3.0) over (order by dry, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by dry, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0)) as cut from o),
t as (select source, source_size, least(weight * max(cut) over (), source_size * 3.0) as target from c),
p as (select doc_id, source, size, coalesce(sum(size) over (partition by source order by h, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from d),
j as (select p.*, t.source_size, t.target, round(t.target)::bigint as lim from p join t on p.source is not distinct from t.source),
k as (select *, greatest(least(lim - start, size), 0) as a, greatest(least(lim - source_size - start, size), 0) as b, greatest(least(lim - 2 * source_size - start, size), 0) as c from j)
select doc_id, size::bigint as size, source_size, round(target, 6) + 0.0 as target, (a + b + c)::bigint as taken, start,
  ((size > 0 and a * 2 >= size)::int + (size > 0 and b * 2 >= size)::int + (size > 0 and c * 2 >= size)::int)::bigint as copies from k""",
    "op4_fm_decontamination": f"""
with b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark where item_id is not null),
win as (select distinct item, least(10, len(w)) as l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as x from (select *, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
lens as (select distinct l from win),
d as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
p as (select doc_id, l, unnest(generate_series(1, len(w) - l + 1)) as i, unnest(list_transform(generate_series(1, len(w) - l + 1), lambda k : array_to_string(w[k:k + l - 1], ' '))) as x from d, lens where len(w) >= l),
occ as (select p.doc_id, p.i, p.l, win.item from p join win on win.l = p.l and win.x = p.x),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + l - 1)) as j from occ) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from occ) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)""",
    "op9_warc_round_trip": """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as first_id from p)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from g""",
}
