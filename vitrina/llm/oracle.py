"""SQL for DuckDB of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

import hashlib

_OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_OP3 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(text, '([<\[])(\\*)(\||/s>|s>|INST\]|/INST\])', '\1\2\\\3', 'g') as shown,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(\||/s>|s>|INST\]|/INST\])', '\1\2\\\3', 'g') as shown_role
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length(shown_role) + 1 + length(shown) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from e group by conv_id
"""


def _op4() -> str:
    from vitrina.llm.licences import TEMPLATES

    rows = ", ".join(
        f"({i}, '{x.label}', '{x.text}', {x.base}, {x.gap}, {x.cover})" for i, x in enumerate(TEMPLATES)
    )
    return f"""
with about as (
  select *, string_split(phrase, ' ') as ws, len(string_split(phrase, ' ')) - 1 as grams
  from (values {rows}) as x(template, label, phrase, base, gap, cover)
), g as (
  select template, unnest(range(grams)) as t, ws from about
), d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), p as (
  select r, unnest(range(len(w) - 1)) as p, w from d where len(w) > 1
), m as (
  select distinct r, template, p - t as diagonal, t
  from p join g on w[p + 1] = ws[t + 1] and w[p + 2] = ws[t + 2]
), o as (
  select r, template, diagonal, t, gap,
    case when diagonal - lag(diagonal) over (partition by r, template order by diagonal, t) <= gap then 0 else 1 end as opens
  from m join about using (template)
), s as (
  select r, template, diagonal, t, sum(opens) over (partition by r, template order by diagonal, t) as span from o
), h as (
  select r, label, base, min(diagonal) as start, count(distinct t) / cast(any_value(grams) as double) as share, any_value(cover) as cover
  from s join about using (template) group by r, template, label, base, span
), a as (
  select r, count(*) filter (base and share >= cover) as n_base, min(start) filter (base and share >= cover) as first_word,
    max(start) filter (base and share >= cover) as last_word,
    array_to_string(list_sort(list_distinct(list(label) filter (base and share >= cover))), ',') as base_labels,
    array_to_string(list_sort(list_distinct(list(label) filter (share >= cover))), ',') as labels, max(share) as score
  from h group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word,
  cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from d left join a using (r)
"""


def _op8(shards: int = 128, slots: int = 16_381) -> str:
    """The table filled here by lists of preferences, shard after shard; look-ups in SQL."""
    names = [f"shard-{i:03d}" for i in range(shards)]
    turns = []
    for name in names:
        h = hashlib.md5(name.encode()).hexdigest()
        offset, skip = int(h[:8], 16) % slots, int(h[8:16], 16) % (slots - 1) + 1
        turns.append(iter([(offset + j * skip) % slots for j in range(slots)]))
    owner: dict[int, int] = {}
    while len(owner) < slots:
        for shard, turn in enumerate(turns):
            claimed = next((s for s in turn if s not in owner), None)
            if claimed is not None:
                owner[claimed] = shard
    table = "[" + ",".join(str(owner[s]) for s in range(slots)) + "]"
    return f"""
with d as (
  select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) % {slots} as slot from documents
)
select doc_id, slot, 'shard-' || lpad(cast({table}[slot + 1] as varchar), 3, '0') as shard from d
"""


_OP9 = """
with p as (
  select row_number() over (order by page_id nulls last) as r, page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), b as (
  select *, list_transform(range(8), lambda i: cast('0x' || substr(h, cast(5 * i + 1 as int), 5) as bigint)) as v from p
), c as (
  select *, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((x >> k) & 31 as int) + 1, 1)), '')), '') as payload_digest from b
), f as (
  select payload_digest, arg_min(page_id, r) as first_id, min(r) as first_r from c group by payload_digest
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when r = first_r then 'response' else 'revisit' end as record_type,
  case when r = first_r then null else first_id end as refers_to
from c join f using (payload_digest)
"""


_OP12 = """
with t as (
  select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id, strlen(coalesce(text, '')) as bytes,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p
  from conversations where conv_id is not null
), own as (
  select conv_id, list({'id': id, 'bytes': bytes} order by p) as l,
    list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end) as crc
  from t group by conv_id
), r as (
  select o.conv_id, list_concat(case when b.l is null then [] else b.l[1:h] end, o.l[h + 1:]) as l
  from (select *, xor(crc, 4294967295::bigint) % 9 as h from own) o left join own b on b.conv_id = o.conv_id - o.conv_id % 5
), p as (
  select conv_id, len(l) as n, unnest(range(len(l) + 1)) as d, list_transform(l, lambda x: x.id) as ids, list_transform(l, lambda x: x.bytes) as sizes from r
), m as (
  select d, array_to_string(ids[1:d], ',') as node, any_value(ids[1:d]) as path, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(any_value(sizes[d]), 0) as bytes, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = d) as ends
  from p group by 1, 2
), k as (
  select d - 1 as d, array_to_string(path[1:d - 1], ',') as node, count(*) as n_children from m where d > 0 group by 1, 2
), x as (
  select m.*, coalesce(n_children, 0) as n_children from m left join k using (d, node)
), s as (
  select up as d, array_to_string(path[1:up], ',') as node, sum(cast(n_children = 0 as bigint)) as n_leaves, sum((n_convs - 1) * bytes) as saved_tokens
  from (select *, unnest(range(d + 1)) as up from x) group by 1, 2
)
select x.conv_id, cast(x.d as bigint) as depth, u.conv_id as parent_conv_id, x.n_convs, x.n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(x.ends, '')) as ends_sha256
from x join s using (d, node) left join m u on u.d = x.d - 1 and u.node = array_to_string(x.path[1:x.d - 1], ',')
"""

_OP13 = r"""
with recursive b0 as (
  select page_id, coalesce(html, '') as html, case when coalesce(url, '') like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), b1 as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from b0
), rules(rhost, rpath, rverdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), b2 as (
  select row_number() over () as r, * from b1
), fits as (
  select r, arg_max(rhost || rpath, len(rhost || rpath)) as rule, arg_max(rverdict, len(rhost || rpath)) as known
  from b2 join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by r
), b as (
  select b2.*, rule, known, regexp_replace(lower(path), '\p{N}+', '0', 'g') as shape from b2 left join fits using (r)
), w as (
  select word, count(*) as n from (select unnest(regexp_extract_all(lower(regexp_replace(html,
    '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|[\p{L}\p{N}-]+\.[\p{L}\p{N}][\p{L}\p{N}.-]*', ' ', 'g')), '\p{L}+')) as word from b0) group by word
), total as (
  select greatest(coalesce(sum(n), 0), 10)::double as t from w
), labels as (
  select distinct host, string_split(lower(host), '.') as l from b
), hn as (
  select host, regexp_extract_all(array_to_string(case when len(l) > 1 then l[1:len(l) - 1] else l end, '.'), '\p{L}+') as names from labels
), names as (
  select distinct unnest(names) as name from hn
), cuts as (
  select name, i, unnest(range(i + 1, length(name) + 1)) as j from (select name, unnest(range(length(name))) as i from names)
), c as (
  select name, i, j, least(cast(round(ln(t / 10) * 1000000) as bigint) + (j - i) * cast(round(ln(10) * 1000000) as bigint),
    coalesce(case when j - i <= 24 then -cast(round(ln(n / t) * 1000000) as bigint) end, 9000000000000000)) as cost
  from cuts cross join total left join w on w.word = substr(name, i + 1, j - i)
), v as (
  select name, 0::bigint as j, [0::bigint] as costs, [0::bigint] as starts from names
  union all
  select v.name, v.j + 1, list_append(v.costs, struct_extract(min({'cost': c.cost + v.costs[c.i + 1], 'i': c.i}), 'cost')), list_append(v.starts, struct_extract(min({'cost': c.cost + v.costs[c.i + 1], 'i': c.i}), 'i'))
  from v join c on c.name = v.name and c.j = v.j + 1 group by v.name, v.j, v.costs, v.starts
), k as (
  select name, j, starts, []::varchar[] as words from v where j = length(name)
  union all
  select name, starts[j + 1], starts, list_prepend(substr(name, starts[j + 1] + 1, j - starts[j + 1]), words) from k where j > 0
), split as (
  select name, words from k where j = 0
), ht as (
  select host, flatten(list(words order by nr)) as tokens from (
    select host, unnest(names) as name, unnest(range(len(names))) as nr from hn) join split using (name) group by host
), st as (
  select distinct shape, list_transform(regexp_extract_all(shape, '\p{L}+|0'), lambda x: '/' || x) as tokens from b
), seen as (
  select token, sum(cast(known = 'allow' as bigint)) as a, sum(cast(known = 'block' as bigint)) as z from (
    select known, unnest(tokens) as token from b join ht using (host) where known is not null
    union all select known, unnest(tokens) from b join st using (shape) where known is not null) group by token
), sums as (
  select (sum(a) + count(*))::double as ta, (sum(z) + count(*))::double as tz from seen
), weights as (
  select token, cast(round(ln((a + 1) / ta / ((z + 1) / tz)) * 1000000) as bigint) as weight from seen cross join sums
), hs as (
  select host, sum(weight) as s from (select host, unnest(tokens) as token from ht) join weights using (token) group by host
), ss as (
  select shape, sum(weight) as s from (select shape, unnest(tokens) as token from st) join weights using (token) group by shape
), prior as (
  select cast(round((ln(count(*) filter (known = 'allow') + 1) - ln(count(*) filter (known = 'block') + 1)) * 1000000) as bigint) as p from b
), f as (
  select page_id, host, path, rule, known, coalesce(array_to_string(ht.tokens, ' '), '') as host_words, cast(p + coalesce(hs.s, 0) + coalesce(ss.s, 0) as bigint) as micro
  from b cross join prior left join ht using (host) left join hs using (host) left join ss using (shape)
)
select page_id, host, path, rule, coalesce(known, case when micro >= 0 then 'allow' else 'block' end) as verdict, host_words, micro / 1000000.0::double as score from f
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_prefix_trie": _OP12, "op13_urls": _OP13, "op1_topk": _OP1, "op4_licenses": _op4(), "op8_sharding": _op8(), "op9_warc": _OP9, "op3_chat": _OP3}
