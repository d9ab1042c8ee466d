"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# reflected CRC-32 taken half a byte at a time; entry n is n divided by the reversed polynomial
_CRC_TABLE = """(select list(case when n & 8 = 8 then xor(xor(xor(xor(0, 3988292384),
  case when n & 4 = 4 then 1994146192 else 0 end), case when n & 2 = 2 then 997073096 else 0 end),
  case when n & 1 = 1 then 498536548 else 0 end) else xor(xor(case when n & 4 = 4 then 1994146192 else 0 end,
  case when n & 2 = 2 then 997073096 else 0 end), case when n & 1 = 1 then 498536548 else 0 end) end order by n)
  from range(16) t(n))"""

ORACLES["op1_sharding"] = f"""
with crc_table as (select {_CRC_TABLE} as entries),
sized as (
  select doc_id, (coalesce(octet_length(encode(text)), 0) + 16)::bigint as size,
    string_split(hex(text), '') as digits, text is null as missing, octet_length(encode(coalesce(text, ''))) as n
  from documents),
summed as (
  select doc_id, size, case when not missing then xor(list_reduce(
      list_transform(range(2 * n), lambda i: (instr('0123456789ABCDEF', digits[xor(i, 1) + 1]) - 1)::bigint),
      lambda c, d: xor(c >> 4, entries[(xor(c, d) & 15) + 1]::bigint), 4294967295::bigint), 4294967295) end as text_crc32
  from sized, crc_table),
placed as (
  select *, ((sum(size) over (order by doc_id) - size) * 40 // sum(size) over ())::int as shard,
    row_number() over (order by doc_id) as nth
  from summed)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  (row_number() over (partition by shard order by nth) - 1)::bigint as slot, null::int as grown_shard
from placed
"""

ORACLES["op10_quality"] = r"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
split as (
  select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts),
windows as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from split)),
covered as (
  select doc_id, count(distinct i + k) as n
  from (select doc_id, i from windows qualify count(*) over (partition by doc_id, gram) > 1), range(3) r(k)
  group by doc_id),
measured as (
  select split.doc_id, len(words)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{L}')))::bigint as n_alpha_words
  from split left join covered on covered.doc_id = split.doc_id),
ruled as (
  select *, (case when n_words < 50 then 1 else 0 end
    + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when n_words > 100000 then 4 else 0 end
    + case when word_chars < 2 * n_words then 8 else 0 end
    + case when word_chars > 15 * n_words then 16 else 0 end
    + case when 10 * n_symbols > n_words then 32 else 0 end
    + case when 10 * n_dup_lines > 3 * n_lines then 64 else 0 end
    + case when 10 * n_alpha_words < 6 * n_words then 128 else 0 end)::bigint as failed
  from measured)
select *, failed & 3 <> 0 as base_failed, failed = 0 as kept, 'v2' as policy from ruled
"""

ORACLES["op7_decontamination"] = r"""
with doc_words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
item_words as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
item_sized as (select item_id, w, least(10, len(w)) as size from item_words where len(w) > 0),
item_windows as (
  select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as said
  from (select *, unnest(range(1, len(w) - size + 2)) as i from item_sized)),
sizes as (select distinct size from item_sized),
doc_windows as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as said
  from (select doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) as i from doc_words, sizes)),
hits as (select doc_id, item_id, d.size, i from doc_windows d join item_windows using (size, said)),
words_hit as (select doc_id, count(distinct i + k) as n_hit from hits, range(10) r(k) where k < size group by doc_id),
items_hit as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join words_hit using (doc_id) left join items_hit using (doc_id)
"""

ORACLES["op5_chat"] = r"""
with convs as (
  select conv_id, list(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)) order by turn) as said,
    list('<|im_start|>' || case when trim(coalesce(role, '')) = '' then 'unknown' else replace(role, '<|', '< |') end || chr(10)
      || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' order by turn) as turns
  from conversations where conv_id is not null group by conv_id),
inside as (select distinct k, array_to_string(said[1 : k], chr(2)) as p from (select said, unnest(range(1, len(said))) as k from convs)),
whole as (
  select min(conv_id) as conv_id, count(*) as copies, len(any_value(said)) as n_turns, array_to_string(said, chr(2)) as p
  from convs group by said),
kept as (select * from whole where not exists (select 1 from inside where k = n_turns and inside.p = whole.p))
select conv_id, part::int as part, copies, n_turns::bigint as n_turns,
  array_to_string(turns[part * 512 + 1 : part * 512 + 512], chr(10)) as rendered
from kept join convs using (conv_id), lateral (select unnest(range(0, (n_turns + 511) // 512)) as part)
"""

# where the spans of a kind begin and end: lengths of the pieces between the matches and of the matches
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(value, '.'), lambda x: coalesce(try_cast(x as int), 999))) <= 255",
    "card": """length(digits) between 16 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i:
      case when i % 2 = 1 then substr(reverse(digits), i, 1)::int
        when substr(reverse(digits), i, 1)::int < 5 then 2 * substr(reverse(digits), i, 1)::int
        else 2 * substr(reverse(digits), i, 1)::int - 9 end)) % 10 = 0""",
    "phone": "length(digits) between 8 and 15",
}


def _spans(kind: str, number: int) -> str:
    return f"""
{kind}_found as (
  select doc_id, said, unnest(list_zip(range(1, len(found) + 1), pieces[1 : len(found)], found)) as z
  from (select doc_id, said, regexp_extract_all(said, '{_KINDS[kind]}') as found, string_split_regex(said, '{_KINDS[kind]}') as pieces from texts)),
{kind}_placed as (
  select doc_id, said, z[1] as nth, z[3] as value, regexp_replace(z[3], '[^0-9]', '', 'g') as digits,
    sum(length(z[2]) + length(z[3])) over (partition by doc_id order by z[1]) as stop
  from {kind}_found),
{kind}_spans as (
  select doc_id, said, {number} as kind_no, '{kind}' as kind, (stop - length(value))::int as start, stop::int as stop,
    '{kind}:' || {"lower(value)" if number < 3 else "digits"} as value
  from {kind}_placed where {_VALID[kind]})"""


ORACLES["op3_pii"] = (
    "with texts as (select doc_id, coalesce(text, '') as said from documents),"
    + ",".join(_spans(k, i) for i, k in enumerate(_KINDS, 1)) + """,
base as (""" + " union all ".join(f"select * from {k}_spans" for k in _KINDS) + r"""),
-- different texts, their terms, and eight numbers that near copies share
each_text as (select min(doc_id) as text_id, said, list_distinct(regexp_extract_all(lower(said), '[\p{L}\p{N}]{3,}')) as spoken from texts group by said),
term_counts as (select term, count(*) as n_term from (select unnest(spoken) as term from each_text) group by term),
held as (select distinct text_id, e.said, spoken, value from each_text e join base b on b.doc_id = e.text_id),
value_counts as (select value, count(*) as n_value from held group by value having count(*) >= 3),
judged as (select text_id, any_value(said) as said, any_value(spoken) as spoken, list(value) as wanted
  from held semi join value_counts using (value) group by text_id),
-- the text without its values: the pieces between spans, which may overlap
covered as (
  select doc_id, start, stop, max(stop) over (partition by doc_id order by start, stop desc rows between unbounded preceding and 1 preceding) as before
  from base where doc_id in (select text_id from judged)),
outside as (
  select text_id, string_agg(piece, ' ' order by place) as said
  from (select j.text_id, c.start as place, substr(j.said, coalesce(before, 0) + 1, greatest(c.start - coalesce(before, 0), 0)) as piece
    from judged j join covered c on c.doc_id = j.text_id where start >= coalesce(before, 0)
    union all select j.text_id, 2147483647, substr(j.said, (select max(stop) from covered c where c.doc_id = j.text_id) + 1) from judged j)
  group by text_id),
marked as (
  select j.text_id, wanted, list_transform(range(8), lambda k: list_min(list_transform(spoken_pairs, lambda w: md5(k || ':' || w)))) as marks,
    list_intersect(list_distinct(regexp_extract_all(lower(o.said), '[\p{L}\p{N}]{3,}')), spoken) as terms
  from (select *, list_transform(range(1, greatest(len(w), 2)), lambda i: concat_ws(' ', w[i], w[i + 1])) as spoken_pairs
    from (select *, regexp_extract_all(lower(said), '[\p{L}\p{N}]{3,}') as w from judged)) j
  join outside o using (text_id)),
pairs as (
  select value, term, count(*) as n_both, list_min(list_transform(range(1, 9), lambda k: len(list_distinct(list_transform(list(marks), lambda m: m[k]))))) as support
  from (select text_id, marks, value, unnest(terms) as term from (select text_id, marks, terms, unnest(wanted) as value from marked))
  group by value, term having count(*) >= 3),
posterior as (
  select value, term, n_value, n_both / n_term as q, support / (n_both / n_term) as m
  from pairs join value_counts using (value) join term_counts using (term) where support >= 3),
limits as (
  select *, (q + 1.645 * 1.645 / (2 * m) - 1.645 * sqrt(greatest(q * (1 - q) / m + 1.645 * 1.645 / (4 * m * m), 0))) / (1 + 1.645 * 1.645 / m) as p
  from posterior),
told as (
  select distinct term from limits, (select count(*) as n from texts)
  where n > n_value and p >= 0.5 and 1 + ln(p) / ln(n / n_value) >= 0.8),
-- a word is disclosing if it is one of the terms; words are found where letters and digits begin
flagged as (
  select distinct t.doc_id, t.said from texts t join (select distinct e.said from (select said, unnest(spoken) as term from each_text) e join told using (term)) using (said)),
term_found as (
  select doc_id, unnest(list_zip(range(1, len(found) + 1), pieces[1 : len(found)], found)) as z
  from (select doc_id, regexp_extract_all(said, '[\p{L}\p{N}]+') as found, string_split_regex(said, '[\p{L}\p{N}]+') as pieces from flagged)),
term_spans as (
  select doc_id, 5 as kind_no, 'term' as kind, (stop - length(value))::int as start, stop::int as stop
  from (select doc_id, z[3] as value, sum(length(z[2]) + length(z[3])) over (partition by doc_id order by z[1]) as stop from term_found)
  where lower(value) in (select term from told)),
every as (select doc_id, kind_no, kind, start, stop from base union all select * from term_spans),
joined as (
  select doc_id, string_agg(kind || ':' || start || ':' || stop, ',' order by kind_no, start) as spans,
    string_agg(kind || ':' || start || ':' || stop, ',' order by kind_no, start) filter (where kind_no < 5) as base_spans,
    count(*) filter (where kind_no = 1) as n_email, count(*) filter (where kind_no = 2) as n_ip, count(*) filter (where kind_no = 3) as n_card,
    count(*) filter (where kind_no = 4) as n_phone, count(*) filter (where kind_no = 5) as n_term
  from every group by doc_id)
select doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card,
  coalesce(n_phone, 0)::bigint as n_phone, sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_term, 0)::bigint as n_term
from texts left join joined using (doc_id)
""")

ORACLES["op11_minhash"] = r"""
with recursive texts as (
  select translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as said, min(doc_id) as class_id
  from documents group by said),
split as (
  select class_id, list_filter(string_split_regex(said, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from texts),
shingles as (
  select distinct class_id, array_to_string(words[i : i + 4], ' ') as shingle
  from (select class_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from split where len(words) > 0)),
sizes as (select class_id, count(*) as n from shingles group by class_id),
shared as (select a.class_id as u, b.class_id as v, count(*) as n_both
  from shingles a join shingles b on a.shingle = b.shingle and a.class_id < b.class_id
  join sizes x on x.class_id = a.class_id join sizes y on y.class_id = b.class_id
  where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) group by u, v),
links as (
  select u, v from shared join sizes a on a.class_id = u join sizes b on b.class_id = v
  where 100 * n_both >= 85 * (a.n + b.n - n_both)),
both_ways as (select u, v from links union all select v, u from links),
reached(node, other) as (
  select u, v from both_ways union select reached.node, both_ways.v from reached join both_ways on both_ways.u = reached.other),
roots as (select node, least(node, min(other)) as root from reached group by node)
select doc_id, coalesce(n, 0)::bigint as n_shingles, case when n is null then doc_id else coalesce(root, sizes.class_id) end as component_id,
  n is null or doc_id = coalesce(root, sizes.class_id) as kept
from documents
join texts on said = translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
left join sizes using (class_id) left join roots on roots.node = class_id
"""

# nearest centroid of every vector, and the floors of the means, a round at a time
_NEAREST = """
{out} as (
  select nth, arg_min(number, (distance, number)) as number, min(distance) as distance
  from (select v.nth, c.number, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance
    from kept v, {centroids} c) group by nth)"""
_MEANS = """
means_{r} as (
  select number, list(((total - ((total % held) + held) % held) // held)::bigint order by place) as x
  from (select a.number, place, sum(v.x[place]) as total, count(*) as held
    from near_{r} a join kept v using (nth), range(1, 65) d(place) group by a.number, place) group by number),
centroids_{n} as (select c.number, coalesce(m.x, c.x) as x from centroids_{r} c left join means_{r} m using (number))"""

ORACLES["op13_centroids"] = (
    """
with kept as (
  select row_number() over () as nth, vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
centroids_0 as (
  select (row_number() over (order by sha256('1:' || vec_id), x) - 1)::int as number, x
  from kept where vec_id is not null qualify number < 16),"""
    + ",".join(_NEAREST.format(out=f"near_{r}", centroids=f"centroids_{r}") + "," + _MEANS.format(r=r, n=r + 1) for r in range(3))
    + "," + _NEAREST.format(out="near_3", centroids="centroids_3") + """
select vec_id, number as cluster, distance, (sum(distance) over (partition by number))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from near_3 join kept using (nth) join centroids_3 c using (number)
"""
)
