"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from sheaf.llm.chat_format import CONTROL, END, ROLE, TEXT

WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {WORDS}) w
  from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: list_aggregate(w[i:i+2], 'string_agg', ' ')))
  when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end s from w),
n as (select doc_id, len(s) n from s),
e as (select doc_id, unnest(s) g from s),
c as (select a.doc_id a, b.doc_id b, count(*) both_n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * both_n >= 85 * (na.n + nb.n - both_n)),
m as (select a, b from l union all select b, a from l),
r(doc_id, node) as (select doc_id, doc_id from n union select r.doc_id, m.b from r join m on m.a = r.node)
select n.doc_id, cast(n.n as bigint) n_shingles, min(r.node) component_id, n.doc_id = min(r.node) kept
from n join r using (doc_id) group by n.doc_id, n.n
"""

LINE_DEDUP = f"""
with l as (select doc_id, source, text, string_split(coalesce(text, ''), chr(10)) ls from documents),
e as (select doc_id, source, list_distinct(list_transform(list_filter(ls, lambda x: regexp_matches(x, {WORDS})), lambda x: md5(x))) ks
  from l),
k as (select doc_id, source, ks, unnest(ks) line from e),
o as (select doc_id, source, line, list_filter(ks, lambda x: x <> line) o from k),
h as (select doc_id, source, line, list_transform(o, lambda x: substr(x, 1, 16)) a, list_transform(o, lambda x: substr(x, 17)) b from o),
m as (select doc_id, source, line, unnest([1, 2, 3, 4]) k, unnest([coalesce(list_min(a), ''), coalesce(list_max(a), ''),
  coalesce(list_min(b), ''), coalesce(list_max(b), '')]) mark from h),
f as (select line, k, mark, min(doc_id) doc_id from m group by line, k, mark),
own as (select line, doc_id from f group by line, doc_id having count(distinct k) = 4),
w as (select line from own join documents using (doc_id) group by line having count(distinct source) >= 8),
b as (select line, min(doc_id) first_doc from k where line in (select line from w) group by line),
d as (select doc_id, list(line) dl from k join b using (line) where doc_id > first_doc group by doc_id),
r as (select l.*, dl, list_filter(ls, lambda x: not list_contains(dl, md5(x))) rest from l left join d using (doc_id))
select doc_id, cast(case when length(coalesce(text, '')) > 0 then len(ls) else 0 end as bigint) n_lines,
  cast(case when dl is not null then len(ls) - len(rest) else 0 end as bigint) n_removed,
  case when dl is not null then array_to_string(rest, chr(10)) else text end text from r
"""

MIXING = f"""
with recursive z as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {WORDS})) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size from z group by source),
w as (select source, source_size, cast(3 * source_size as double) cap,
  case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end w from s),
v(k, level) as (select 0, 0e0 union all select k + 1, (select (cast(sum(source_size) as double)
  - coalesce(sum(case when w * level > cap then cap end), 0e0)) / sum(case when w * level > cap then 0e0 else w end) from w) from v where k < 25),
t as (select source, source_size, case when w * level > cap then cap else w * level end target from w,
  (select level from v where k = 25)),
r as (select *, case when source_size > 0 then target / source_size else 0e0 end rate from t)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when
  cast(cast('0x' || substr(md5('mix:' || cast(doc_id as varchar)), 1, 8) as bigint) as double) / 4294967296e0 < rate - floor(rate)
  then 1 else 0 end) as bigint) taken
from z join r on z.source is not distinct from r.source
"""

CHAT_FORMAT = f"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (select conv_id, count(*) n_turns, string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x) told,
  coalesce(string_agg(x, '' order by turn, r, x) filter (where r = 'assistant'), '') loss,
  sum({len(ROLE + TEXT + END)} + length({_escaped('r')}) + length({_escaped('x')})) formatted_chars from t group by conv_id)
select conv_id, n_turns, sha256(told) turns_sha256, cast(length(loss) as bigint) loss_chars, sha256(loss) loss_sha256,
  cast(formatted_chars as bigint) formatted_chars from g
"""

EXACT_TOP_K = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select row_number() over () n, vec_id, e from v where vec_id % 50 = 0),
s as (select n, q.vec_id query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) score
  from q join v on len(q.e) = len(v.e) and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by n order by score desc, vec_id) place from s)
select query_id, cast(place as integer) "rank", vec_id, score from r where place <= 5
"""

ORACLES: dict[str, str] = {
    "op2_minhash_dedup": NEAR_DUPLICATES, "op6_line_dedup": LINE_DEDUP, "op7_mixing": MIXING, "op9_chat_format": CHAT_FORMAT,
    "op11_exact_top_k": EXACT_TOP_K}
