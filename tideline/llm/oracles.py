"""DuckDB SQL with the rows of the registered queries."""

OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 10
"""

OP2 = r"""
with t as (
  select cast(conv_id as bigint) conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\<#:]', '', 'g')) + length('### :  </turn>') + 1 n from t
)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(n) as bigint) formatted_chars, false rewrites_history
from e group by conv_id
"""

OP9 = r"""
with w as (
  select doc_id, row_number() over () rid, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from
    (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') text from documents)
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null
), bw as (
  select distinct item_id, len(w) n, w win from b where len(w) between 1 and 12
  union select item_id, 13, w[i:i + 12] from (select item_id, w, unnest(range(1, len(w) - 11)) i from b where len(w) >= 13)
), sizes as (select distinct n from bw
), dw as (select doc_id, rid, i, n, w[i:i + n - 1] win from (select doc_id, rid, w, n, unnest(range(1, len(w) - n + 2)) i from w, sizes where len(w) >= n)
), hit as (select rid, i, dw.n, item_id from dw join bw using (win)
), pos as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hit) group by rid
), its as (select rid, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct rid, cast(item_id as varchar) item from hit) group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from w left join pos using (rid) left join its using (rid)
""".replace("lower(text)", "text")

OP8 = r"""
with d as (
  select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), win as (select rid, doc_id, i, w[i:i + 12] win from (select *, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)
), least as (select win, min(doc_id) m from win group by win
), gone as (select distinct rid, unnest(range(i, i + 13)) p from win join least using (win) where doc_id > m
), word as (select rid, p, w[p] word from (select rid, w, unnest(range(1, len(w) + 1)) p from d)
), kept as (
  select rid, count(*) n, string_agg(word, ' ' order by p) s from word anti join gone using (rid, p) group by rid
)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(s, '')) kept_sha256
from d left join kept using (rid)
"""

OP10 = r"""
with recursive d as (
  select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), sh as (
  select distinct rid, w[i:i + 4] s from (select rid, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)
  union all select rid, w from d where len(w) between 1 and 4
), n as (select rid, count(*) n from sh group by rid
), common as (select a.rid a, b.rid b, count(*) c from sh a join sh b on a.s = b.s and a.rid < b.rid group by all
), half as (select a, b from common join n x on x.rid = a join n y on y.rid = b where 100 * c >= 75 * (x.n + y.n - c)
), link as (select a, b from half union all select b, a from half
), reach as (select rid, rid t from d union select r.rid, l.b from reach r join link l on l.a = r.t
)
select d.doc_id, coalesce(n.n, 0) n_shingles, min(o.doc_id) component_id
from d left join n using (rid) join reach r on r.rid = d.rid join d o on o.rid = r.t group by d.rid, d.doc_id, n.n
"""


def op3_sql() -> str:
    from tideline.llm.license_scan import TEMPLATES, THRESHOLD

    values = ", ".join(f"({i}, '{a}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (a, t) in enumerate(TEMPLATES))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    pairs = "list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end)"
    return rf"""
with t as (select i, license_id, {pairs} q from (select i, license_id, {words.format("t")} w from (values {values}) v(i, license_id, t))
), d as (select row_number() over () rid, doc_id, coalesce(text, '') text from documents
), u as (
  select rid, doc_id, unnest(string_split(text, chr(10))) unit from d
  union all select rid, doc_id, unit from (select rid, doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) unit from d) where contains(unit, chr(10))
), s as (select rid, doc_id, {pairs} p from (select rid, doc_id, {words.format("unit")} w from u) where len(w) between 1 and 1000
), x as (select rid, doc_id, license_id, 2 * len(list_intersect(p, q)) / (len(p) + len(q)) dice from s, t where len(p) <= 2 * len(q) and len(q) <= 2 * len(p))
select doc_id, license_id, count(*) n_units, round(max(dice), 6) dice from x where dice >= {THRESHOLD} group by rid, doc_id, license_id
"""


ORACLES = {"op1_topk_search": OP1, "op2_chat_format": OP2, "op3_license_scan": op3_sql(), "op8_substring_dedup": OP8, "op9_decontaminate": OP9, "op10_ngram_join": OP10}
