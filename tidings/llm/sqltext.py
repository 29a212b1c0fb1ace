"""SQL (DuckDB) for the rows of the operators that SQL can express."""

from __future__ import annotations

from tidings.llm import quality

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    """Distinct 5-word shingles per row of a table; a shorter text is one."""
    return f"""
    select {key}, unnest(list_distinct(case when len(w) >= 5
             then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
             when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle
    from (select {key}, {_WORDS.format(_LOWERED)} as w from {table})"""


OP3 = f"""
with d as ({_shingles('documents', 'doc_id')}), b as ({_shingles('benchmark', 'item_id')}),
size as (select item_id, count(*) as n from b group by item_id),
shared as (select doc_id, item_id, count(*) as n_shared from d join b using (shingle) group by doc_id, item_id)
select doc_id, item_id, n as n_item_shingles, n_shared from shared join size using (item_id) where 100 * n_shared >= 75 * n
"""

OP9 = f"""
with recursive s as materialized ({_shingles('documents', 'doc_id')}),
size as materialized (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b using (shingle) where a.doc_id <> b.doc_id group by 1, 2),
link as materialized (
  select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * pair.n >= 75 * (x.n + y.n - pair.n)),
reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
least_of as (select a, min(b) as m from reach group by a)
select doc_id, coalesce(size.n, 0) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) as kept
from documents left join size using (doc_id) left join least_of on a = doc_id
"""


def _quality() -> str:
    values = {
        "mean_word": "word_chars / n_words", "symbol_share": "n_symbols / word_chars", "upper_share": "n_upper / word_chars",
        "dup_line_share": "n_dup_lines / n_lines", "repeat_share": "n_repeat_words / n_words",
    }
    per_level, verdict = [], []
    for level, group in (("own", "lang, source"), ("lang", "lang"), ("overall", "")):
        columns = [group, "count(*) as n"] if group else ["count(*) as n"]
        for rule, (slack, both) in quality.RULES.items():
            q = {p: f"quantile_disc({rule}, {p})" for p in (0.25, 0.5, 0.75)}
            columns.append(f"{q[0.5]} + greatest({quality.WIDTH} * ({q[0.5]} - {q[0.25]}), {slack}) as {rule}_most")
            if both:
                columns.append(f"{q[0.5]} - greatest({quality.WIDTH} * ({q[0.75]} - {q[0.5]}), {slack}) as {rule}_least")
        per_level.append(f"{level} as (select {', '.join(columns)} from v {'group by ' + group if group else ''})")
    pick = lambda c: f"case when o.n >= {quality.MIN_GROUP} then o.{c} when l.n >= {quality.MIN_GROUP} then l.{c} else g.{c} end"
    for rule, (_, both) in quality.RULES.items():
        verdict.append(f"v.{rule} <= {pick(rule + '_most')}")
        if both:
            verdict.append(f"v.{rule} >= {pick(rule + '_least')}")
    return f"""
with t as (
  select doc_id, lang, source, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
win as (
  select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from t)),
dup as (select doc_id, p from (select *, count(*) over (partition by doc_id, k) as c from win) where c >= 2),
covered as (select doc_id, count(distinct p + d) as n from dup, (select unnest([0, 1, 2]) as d) group by doc_id),
c as (
  select t.doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_upper,
         len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from t join lines using (doc_id) left join covered using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
v as (select *, {', '.join(f'{x} as {n}' for n, x in values.items())} from f where n_words > 0),
{', '.join(per_level)},
good as (
  select v.doc_id, {' and '.join(verdict)} as good from v
  join own o on o.lang is not distinct from v.lang and o.source is not distinct from v.source
  join lang l on l.lang is not distinct from v.lang join overall g on true)
select f.doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and coalesce(good, false) as kept
from f left join good using (doc_id)
"""


OP2 = _quality()

#: The checksum of a text's bytes, one table look-up per byte.
_CRC = """
  xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode({text})), '..'),
      lambda h: ('0x' || h)::bigint)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295::bigint)"""
_CRC_TABLE = """
  select list(v order by n) as tbl from (
    select n, list_reduce(list_concat([n], list_transform(range(8), lambda i: 0::bigint)),
                          lambda c, i: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) as v
    from (select unnest(range(256)) as n))"""

OP5 = f"""
with crc as ({_CRC_TABLE}),
sized as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, {_CRC.format(text="coalesce(text, '')")} as text_crc32 from documents, crc),
placed as (
  select *, sum(size) over (order by doc_id, text_crc32, size rows unbounded preceding) - size as before, sum(size) over () as total from sized),
cut as (select *, least(7, ((2 * before + size) * 8) // (2 * total))::int as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot,
       null::int as grown_shard
from cut
"""

OP6 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes >= 1000) end as kept from p)
select page_id, payload_bytes, payload_digest, case when kept <> page_id then 'revisit' else 'response' end as record_type,
       case when kept <> page_id then kept end as refers_to
from m
"""

OP11 = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
pair as (
  select a.vec_id as anchor_id, a.label = o.label as same, o.vec_id as other, list_inner_product(a.q, o.q)::bigint as score
  from v a join v o on a.vec_id <> o.vec_id where a.vec_id % 100 = 0),
positive as (
  select anchor_id, other as positive_id, score as positive_score from pair where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over w as rank, other as negative_id, positive_score, score as negative_score
from positive join pair using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, other)
qualify row_number() over w <= 10
"""

_TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
with d as (select doc_id, {_TERMS.format(_LOWERED)} as w from documents),
f as (select sum((len(w) > 0)::int)::bigint as docs, sum(len(w))::bigint as total from d),
q as (select item_id, term, count(*) as repeats from (select item_id, unnest({_TERMS.format(_LOWERED)}) as term from benchmark) group by 1, 2),
t as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) group by 1, 2, 3),
df as (select term, count(*) as df from t group by term),
scored as (
  select item_id, doc_id, sum(repeats * floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint
         * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::bigint as score
  from q join t using (term) join df using (term), f group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

OP13 = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
part as (select doc_id, c, substr(h, 2 * c + 1, 698) as h from (select doc_id, h, unnest(range(0, length(h) // 2 - 49, 300)) as c from t)),
w as (select doc_id, c + p as p, substr(h, 2 * p + 1, 100) as s from (select doc_id, c, h, unnest(range(0, length(h) // 2 - 49)) as p from part)),
m as (select s, min(doc_id) as least_id from w group by s),
r as (select doc_id, p from w join m using (s) where least_id < doc_id),
b as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as f from r),
g as (select doc_id, p, sum(f) over (partition by doc_id order by p) as k from b),
span as (select doc_id, min(p) as a, max(p) + 50 as e from g group by doc_id, k),
gap as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as after from span),
kept as (
  select doc_id, count(*) as n_spans, sum(e - a)::bigint as n_removed, max(e) as last_end, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' order by a) as head
  from gap join t using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last_end + 1), h))) as kept_sha256
from t left join kept using (doc_id)
"""
