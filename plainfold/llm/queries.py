"""The subpackage's queries over the driver's tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, warc
from .common import table
from .line_dedup import line_dedup
from .mixing import mixed
from .ngram_join import ngram_join
from .pii import KINDS, personal_data, written
from .quality import quality
from .suffix_dedup import suffix_dedup
from .topk import top_k


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), steps=True)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "term")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(table(spark, sf_dir, "pages")).drop("uri", "block")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.reconstruct(chat.log(table(spark, sf_dir, "conversations"))))


QUERIES = {"op1_warc": op1_warc, "op2_decontaminate": op2_decontaminate, "op3_quality": op3_quality, "op6_chat": op6_chat, "op4_top_k": op4_top_k, "op8_suffix_dedup": op8_suffix_dedup, "op7_ngram_join": op7_ngram_join, "op5_line_dedup": op5_line_dedup, "op9_mixing": op9_mixing, "op10_personal_data": op10_personal_data}
ORACLE = {
    "op1_warc": """
with p as (select page_id, coalesce(html, '') html from pages where page_id is not null),
d as (select page_id, octet_length(encode(html))::bigint payload_bytes, sha256(html) payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end first from d)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end record_type,
  case when first <> page_id then first end refers_to from f""",
    "op6_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e as (select *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) r, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) t from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(12 + r + 1 + t + 11)::bigint formatted_chars from e group by conv_id""",
    "op4_top_k": """
with v as (select vec_id, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) x from v),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint score from w q join w c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::integer rank, vec_id, score from r where rank <= 5""",
    "op5_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
o as (select k, min(doc_id) own from k where length(k) >= 10 group by k),
s as (select k.*, coalesce(length(k.k) < 10 or own = doc_id, true) stays from k left join o on k.k = o.k)
select doc_id, count(*) n_lines, count(*) filter (not stays) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (stays), '')) kept_sha256 from s group by doc_id""",
    "op9_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5('mix' || doc_id::varchar) place from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) rank from d group by source),
w as (select *, (rank - 1) % 3 + 1 weight from s),
f as (select *, 3 * source_size / weight::double "full" from w),
c as (select *, 3 * coalesce(sum(source_size) over (order by "full", rank rows between unbounded preceding and 1 preceding), 0) before,
  sum(weight) over (order by "full", rank rows between current row and unbounded following) open, sum(source_size) over () total from f),
v as (select *, max(case when (total - before)::double / open <= "full" then (total - before)::double / open end) over () level from c),
t as (select source, source_size, rank, least(coalesce(level * weight, 0), 3.0::double * source_size) target from v),
q as (select *, floor(target + 0.5)::bigint quota from t),
p as (select d.doc_id, d.size, q.rank, q.source_size, q.target, q.quota, coalesce(sum(d.size) over (partition by d.source order by d.place, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint a
  from d join q on d.source is not distinct from q.source),
n as (select coalesce(sum(quota), 0)::bigint total from q),
k as (select total, greatest(0, ceil(log2(greatest(1, total / 4096::double))))::bigint k from n),
b as (select total, k, (1::bigint << k) n, greatest(1, ceil(total::double / (1::bigint << k)))::bigint block from k),
e as (select q.rank, quota, coalesce(sum(quota) over (order by q.rank rows between unbounded preceding and 1 preceding), 0)::double before from q),
x as (select rank, quota, ceil(before / greatest(total, 1)::double * n::double)::bigint lo, least(ceil((before + quota) / greatest(total, 1)::double * n::double), n)::bigint hi from e, b),
j as (select j, list_sum(list_transform(range(k), lambda i: ((j >> i) & 1) << (k - 1 - i)))::bigint step from (select unnest(range(n)) j, k from b)),
o as (select rank, row_number() over (partition by rank order by coalesce(step, 0)) - 1 slot, coalesce(step, 0) step from x join j on j.j >= lo and j.j < hi
  union all select rank, greatest(hi - lo, 0), n + rank from x, b)
select p.doc_id, size, source_size, target,
  (greatest(least(quota, a + size) - a, 0) + greatest(least(quota, source_size + a + size) - source_size - a, 0) + greatest(least(quota, 2 * source_size + a + size) - 2 * source_size - a, 0))::bigint taken,
  (select min(o.step) from o, b, (select unnest([0, 1, 2]) e) r where o.rank = p.rank and p.size > 0 and e * p.source_size + p.a < p.quota
    and o.slot between (e * p.source_size + p.a) // b.block and (least(e * p.source_size + p.a + p.size, p.quota) - 1) // b.block)::bigint first_step
from p""",
}
