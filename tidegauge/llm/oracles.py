"""DuckDB SQL for the operators that SQL can express, straight from their definitions.

The suffix-array one has none: a row per byte is too slow on the whole table.
"""

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') ws from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.c)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.c) as component_id
from documents d left join n on n.doc_id = d.doc_id join r on r.doc_id = d.doc_id group by 1"""

PHRASE = f"""
with h as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') ws from documents),
b as (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from h),
w as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) s from b where i + 49 <= len(ws)),
f as (select s, min(doc_id) d from w group by 1),
m as (select w.doc_id, w.i from w join f using (s) where f.d < w.doc_id),
c as (select b.doc_id, b.i, ws[b.i] x, max(case when m.i is null then 0 else 1 end) over (partition by b.doc_id order by b.i rows 49 preceding) gone
  from b left join m on m.doc_id = b.doc_id and m.i = b.i),
o as (select doc_id, sum(gone) r, string_agg(x, ' ' order by i) filter (where gone = 0) kept from c group by 1)
select h.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(r, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from h left join o on o.doc_id = h.doc_id"""

EXACT = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5"""

MIX = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) size,
    md5(concat_ws('|', '17', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')))) m from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) - 1 r from d group by 1),
w as (select *, cast([5, 2, 1][r % 3 + 1] as double) weight, sum(source_size) over () * 1.5 goal, ceil(source_size / 16)::bigint blocks from s),
f as (select *, source_size * 2 / weight room, coalesce(sum(source_size * 2) over o, 0) filled, sum(weight) over () - coalesce(sum(weight) over o, 0) free,
  row_number() over (order by source_size * 2 / weight, source nulls last) nth
  from w window o as (order by source_size * 2 / weight, source nulls last rows between unbounded preceding and 1 preceding)),
g as (select *, arg_min((goal - filled) / free, nth) filter (where (goal - filled) / free <= room) over () lev from f),
t as (select source, source_size, weight, blocks, least(source_size * 2.0::double, weight * cast(lev as double)) target from g),
c as (select source, target / (2 * i + 1) quotient, i from (select source, target, unnest(range(0, cast(ceil(target / 16) as bigint) + 30)) i from t)),
q as (select source, count(*) won from (select source, row_number() over (order by quotient desc, source nulls last, i) n from c where quotient > 0) where n <= (select round(sum(target) / 16) from t) group by 1),
p as (select t.*, cast(least(coalesce(won, 0), blocks * 2) as bigint) quota, greatest(1, ceil(source_size / 1048576)::bigint) shards
  from t left join q on q.source is not distinct from t.source),
k as (select d.*, source_size, weight, target, quota, cast('0x' || substr(m, 1, 15) as bigint) h, cast('0x' || substr(m, 16, 8) as bigint) % shards shard
  from d join p on p.source is not distinct from d.source),
z as (select source, shard, any_value(quota) quota, sum(size) shard_size, sum(sum(size)) over (partition by source) words from k group by 1, 2),
i as (select source, shard, quota, shard_size / (2 * k + 1) quotient, k
  from (select source, shard, quota, shard_size, unnest(range(0, cast(ceil(quota * shard_size / greatest(words, 1)) as bigint) + 30)) k from z)),
y as (select source, shard, count(*) won from (select *, row_number() over (partition by source order by quotient desc, shard, k) n from i where quotient > 0) where n <= quota group by 1, 2),
g2 as (select z.source, z.shard, ceil(shard_size / 16)::bigint blocks, cast(least(coalesce(won, 0), ceil(shard_size / 16)::bigint * 2) as bigint) shard_quota
  from z left join y on y.source is not distinct from z.source and y.shard = z.shard),
e as (select doc_id, k.source, size, source_size, weight, target, quota, k.shard, shard_quota, blocks, shard_quota // greatest(blocks, 1) whole, shard_quota % greatest(blocks, 1) rest,
  cast('0x' || substr(md5('17|' || coalesce(k.source, '') || '|' || k.shard), 1, 15) as bigint) % greatest(blocks, 1) phase,
  cast(coalesce(sum(size) over (partition by k.source, k.shard order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) a
  from k join g2 on g2.source is not distinct from k.source and g2.shard = k.shard),
x as (select *, a + size b, (a // 16 * rest + phase) // greatest(blocks, 1) fa, ((a // 16 + 1) * rest + phase) // greatest(blocks, 1) ga,
  ((a + size) // 16 * rest + phase) // greatest(blocks, 1) fb, (((a + size) // 16 + 1) * rest + phase) // greatest(blocks, 1) gb from e)
select doc_id, source, cast(size as bigint) as size, cast(source_size as bigint) as source_size, weight, target, quota, cast(shard as bigint) as shard, shard_quota,
  cast(case when size > 0 then whole * size + (fb * 16 + b % 16 * (gb - fb)) - (fa * 16 + a % 16 * (ga - fa)) else 0 end as bigint) as taken from x"""

ORACLES = {"op3_jaccard_join": JACCARD, "op5_phrase_dedup": PHRASE, "op7_source_mixing": MIX, "op10_exact_search": EXACT}
