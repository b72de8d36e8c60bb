"""The registered queries of this package, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import (
    byte_pairs,
    fill_middle,
    license_scan,
    line_crf,
    merkle_manifest,
    piece_codec,
    quality_cascade,
    repair_shards,
    rotated_codes,
    simhash,
    source_mix,
    token_counts,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_line_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return line_crf.score(docs, line_crf.train(docs, table(spark, sf, "labels")))


@query
def op2_license_spans(spark, sf):
    return license_scan.scan(table(spark, sf, "documents"))


@query
def op3_token_files(spark, sf):
    return repair_shards.token_files(table(spark, sf, "documents"))


@query
def op4_quality_rules(spark, sf):
    return quality_cascade.judge(table(spark, sf, "documents"))


@query
def op5_piece_round_trip(spark, sf):
    return piece_codec.round_trip(table(spark, sf, "documents"))


@query
def op6_source_mix(spark, sf):
    return source_mix.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_simhash_duplicates(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op8_url_verdicts(spark, sf):
    return url_filter.judge_urls(table(spark, sf, "pages"))


@query
def op9_near_vectors(spark, sf):
    return rotated_codes.near_vectors(table(spark, sf, "embeddings"))


@query
def op10_token_counts(spark, sf):
    counted = token_counts.prefix_counts(table(spark, sf, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op11_byte_pairs(spark, sf):
    return byte_pairs.round_trip(table(spark, sf, "documents"))


@query
def op12_merkle_proofs(spark, sf):
    return merkle_manifest.tampered(table(spark, sf, "documents"))


@query
def op13_fill_middle(spark, sf):
    return fill_middle.digests(table(spark, sf, "documents"))


SPACE = r"[\x20\x09-\x0D]+"

OP4 = f"""
with w as (
  select doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as ws
  from documents
), win as (
  select doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] as g
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) as i from w where len(ws) >= 3)
), rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c >= 2
), cov as (
  select doc_id, count(distinct i + d) as n from rep, (values (0), (1), (2)) t(d) group by doc_id
), ln as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup
  from (select doc_id, unnest(string_split(text, chr(10))) as l from w)
  where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id
), m as (
  select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) as n_capitals,
         coalesce(ln.n_lines, 0) as n_lines, coalesce(ln.n_dup, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words
  from w left join ln using (doc_id) left join cov using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words
            or 2 * n_capitals > word_chars or (n_lines >= 5 and 10 * n_dup_lines > 7 * n_lines)
            or word_chars > 20 * n_words) as kept
from m
"""

OP6 = f"""
with d as (
  select doc_id, source, md5('6:' || coalesce(doc_id::varchar, '')) as mark,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')) as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by encode(source) nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
  from d group by source
), c as (
  -- Sources in the order in which they reach twice their size as all targets grow.
  select *, 1.5 * sum(source_size) over () as whole,
         coalesce(sum(2 * source_size) over ahead, 0) as full_before,
         sum(w) over () - coalesce(sum(w) over ahead, 0) as open_weight
  from s window ahead as (order by source_size / w, encode(source) nulls last rows between unbounded preceding and 1 preceding)
), k as (
  select *, (whole - full_before) * w / open_weight <= 2 * source_size as settled from c
), f as (
  select min(struct_pack(r := source_size / w, b := full_before, o := -open_weight)) as f from k where settled
), t as (
  select source, source_size,
         case when f.f is not null and source_size / w >= f.f.r and (whole - f.f.b) * w / -f.f.o <= 2 * source_size
              then ((whole - f.f.b) * w / -f.f.o)::double else (2 * source_size)::double end as target
  from k, f
), q as (
  select *, round_even(target, 0)::bigint as quota from t
), g as (
  select source, mark, sum(size)::bigint as words from d group by source, mark
), o as (
  select *, coalesce(sum(words) over (partition by source order by mark rows between unbounded preceding and 1 preceding), 0)
            + words / 2.0 as middle from g
)
select d.doc_id, d.size, q.source_size, q.target,
       d.size * ((o.middle < least(q.quota, q.source_size))::int + (o.middle < q.quota - q.source_size)::int) as taken
from d join q on d.source is not distinct from q.source
join o on o.source is not distinct from d.source and o.mark = d.mark
"""

OP8 = r"""
with p as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), r(verdict, h, s) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m as (
  select p.page_id, p.host, p.path, r.verdict, r.h || r.s as rule
  from p left join r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.s)
)
select page_id, host, path, arg_max(rule, length(rule)) as rule,
       coalesce(arg_max(verdict, length(rule)),
                case when list_has_any(string_split(host, '.'),
                     ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
                     then 'block' else 'allow' end) as verdict
from m group by page_id, host, path
"""

OP9 = """
with recursive v as (
  select vec_id, label, embedding::double[] as e,
         embedding is not null and label is not null and len(embedding) > 0
         and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
         and len(list_filter(embedding, lambda x: x <> 0)) > 0 as usable
  from embeddings
), l as (
  select a.vec_id as a, b.vec_id as b
  from (select * from v where usable) a join (select * from v where usable) b
    on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(id, other) as (
  select vec_id, vec_id from v union select r.id, l.b from reach r join l on l.a = r.other
), c as (
  select id, min(other) as component_id from reach group by id
), n as (
  select a, count(*) as n from l group by a
)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.id = v.vec_id left join n on n.a = v.vec_id
"""

OP12 = """
with recursive d as (
  select doc_id, source, lang, n_chars, text, encode(doc_id::varchar) as name from documents
), bits as (
  -- One entry a byte value: the remainder of eight shifts.
  select list(c order by b) as t from (
    select b, list_reduce([b::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(b))
), f as (
  select d.*, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') as i, coalesce(strlen(source) || ':' || source, '-') as s,
         coalesce(strlen(lang) || ':' || lang, '-') as l, coalesce(strlen(text) || ':' || text, '-') as x,
         coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1),
           lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0, false) as hit
  from d, bits
), leaf as (
  select doc_id, lang, sha256(i || s || l || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || x) as leaf,
         case when hit then sha256(i || s || l || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || x) end as claim
  from f
), ranked as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r,
         count(*) over (partition by lang) as n from leaf
), up as (
  select 0 as level, lang, r, n, leaf as h from ranked
  union all
  select level + 1, lang, r // 2, (n + 1) // 2, sha256(string_agg(h, '' order by r))
  from up where n > 1 group by level, lang, r // 2, n
), subs as (
  select lang, h as subroot, row_number() over (order by encode(lang) nulls first) - 1 as r, count(*) over () as n from up where n = 1
), crown as (
  select 0 as level, r, n, subroot as h from subs
  union all
  select level + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' order by r)) from crown where n > 1 group by level, r // 2, n
), steps as (
  -- Every leaf's siblings, level by level: in its own tree, then in that of the subroots.
  select k.lang, k.r, u.level, case when u.r % 2 = 1 then coalesce(v.h, '') else '' end as a,
         case when u.r % 2 = 0 then coalesce(v.h, '') else '' end as b
  from ranked k join up u on u.lang is not distinct from k.lang and u.n > 1 and u.r = k.r >> u.level
  left join up v on v.lang is not distinct from u.lang and v.level = u.level and v.r = xor(u.r, 1)
  union all
  select k.lang, k.r, 1000 + u.level, case when u.r % 2 = 1 then coalesce(v.h, '') else '' end,
         case when u.r % 2 = 0 then coalesce(v.h, '') else '' end
  from ranked k join subs s on s.lang is not distinct from k.lang join crown u on u.n > 1 and u.r = s.r >> u.level
  left join crown v on v.level = u.level and v.r = xor(u.r, 1)
), paths as (
  select lang, r, list(struct_pack(a := a, b := b) order by level) as p, string_agg(a || b, '' order by level) as proof
  from steps group by lang, r
), fold as (
  select k.doc_id, k.lang, k.r, k.leaf, coalesce(k.claim, k.leaf) as acc, coalesce(p, []) as p, coalesce(proof, '') as proof, 1 as pos
  from ranked k left join paths on paths.lang is not distinct from k.lang and paths.r = k.r
  union all
  select doc_id, lang, r, leaf, sha256(p[pos].a || acc || p[pos].b), p, proof, pos + 1 from fold where pos <= len(p)
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, acc as folded_root, acc = root as verified
from fold join subs on subs.lang is not distinct from fold.lang, (select h as root from crown where n = 1)
where pos = len(p) + 1
"""

OP13 = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents
), k as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as c1, ('0x' || h[9:16])::bigint % (len(u) + 1) as c2,
         case when text = '' or regexp_matches(text, '<[PSM]>') or ('0x' || h[17:24])::bigint % 100 >= 100 then 'plain'
              when ('0x' || h[25:32])::bigint % 100 < 50 then 'spm' else 'psm' end as form from d
), p as (
  select *, array_to_string(u[1:least(c1, c2)], '') as a, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as m,
         array_to_string(u[greatest(c1, c2) + 1:], '') as z from k
)
select doc_id, n, form, case when form <> 'plain' then length(a) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m
                        else '<S>' || z || '<P>' || a || '<M>' || m end) as output_sha256,
       sha256(case form when 'plain' then text else a || m || z end) as restored_sha256
from p
"""

ORACLES = {"op4_quality_rules": OP4, "op6_source_mix": OP6, "op8_url_verdicts": OP8, "op9_near_vectors": OP9, "op12_merkle_proofs": OP12, "op13_fill_middle": OP13}
