"""The thin queries that apply each operator to its whole table.

Operators that write steps on the way are condensed: their result is one step, all others are deleted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_chunks, iforest, langid, media, minhash_odd, mixing_lm, packing, pii, suffix_dedup, toxicity
from .common import condensed, documents, labels


def op1_minhash_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condensed(lambda: minhash_odd.near_duplicates(documents(spark, sf_dir)))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condensed(lambda: mixing_lm.score_documents(documents(spark, sf_dir)))


def op3_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iforest.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condensed(lambda: pii.personal_data(documents(spark, sf_dir)))


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_sniff(documents(spark, sf_dir))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condensed(lambda: packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op8_lyndon_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condensed(lambda: suffix_dedup.remove_repeats(documents(spark, sf_dir)))


def op9_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {
        "op1_minhash_odd_sketches": op1_minhash_odd_sketches,
        "op2_context_mixing": op2_context_mixing,
        "op3_isolation_forest": op3_isolation_forest,
        "op4_weak_supervision": op4_weak_supervision,
        "op5_string_kernel": op5_string_kernel,
        "op6_signature_sniffing": op6_signature_sniffing,
        "op7_sum_of_squares_packing": op7_sum_of_squares_packing,
        "op8_lyndon_suffix_sort": op8_lyndon_suffix_sort,
        "op9_language_bitmask": op9_language_bitmask,
        "op10_bpe_chunk_reuse": op10_bpe_chunk_reuse,
    }


#: Every column that these two return is defined exactly, so SQL can say the same on whole tables.
OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
numbers as (select doc_id, hash(g) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from numbers a join numbers b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id join least l on l.doc_id = d.doc_id
"""

#: Windows of 100 bytes as hexadecimal text, in pieces of 512 windows so that no long text is searched from its start each time.
OP8_SQL = r"""
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
pieces as (select doc_id, base, least(512, n - 99 - base) as m, substr(h, 2 * base + 1, 1222) as h from (select doc_id, h, n, unnest(range(0, n - 99, 512)) as base from raw)),
windows as (select doc_id, base + q as p, md5_number(substr(h, 2 * q + 1, 200)) as w from (select doc_id, base, h, unnest(range(0, m)) as q from pieces)),
firsts as (select w, arg_min((doc_id, p), (doc_id, p)) as f from windows group by w),
again as (select x.doc_id, x.p from windows x join firsts f on x.w = f.w where (x.doc_id, x.p) <> f.f),
marked as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 or lag(p) over (partition by doc_id order by p) is null then 1 else 0 end as fresh from again),
numbered as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as k from marked),
spans as (select doc_id, k, min(p) as a, max(p) + 100 as b from numbered group by doc_id, k),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
cut as (select g.doc_id, sum(g.b - g.a) as gone, count(*) as spans, max(g.b) as tail, string_agg(substr(r.h, 2 * g.before + 1, 2 * (g.a - g.before)), '' order by g.a) as kept
  from gaps g join raw r on r.doc_id = g.doc_id group by g.doc_id)
select r.doc_id, cast(r.n as bigint) as n_bytes, cast(coalesce(c.gone, 0) as bigint) as n_removed, cast(coalesce(c.spans, 0) as bigint) as n_spans,
  sha256(unhex(case when c.doc_id is null then r.h else c.kept || substr(r.h, 2 * c.tail + 1) end)) as kept_sha256
from raw r left join cut c on c.doc_id = r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The other operators learn, tokenise or read stored bytes back, which SQL can't express."""
    return {"op1_minhash_odd_sketches": OP1_SQL, "op8_lyndon_suffix_sort": OP8_SQL}
