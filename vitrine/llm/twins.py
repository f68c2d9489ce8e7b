"""DuckDB SQL for what the queries of this subpackage return, where SQL can express it."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of 35 words by its digest; the words under those that start twice go.
REPEATS = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
win as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as i from d)),
twice as (select h from win group by h having count(*) > 1),
gone as (select distinct r, i + unnest(range(35)) as i from win semi join twice using (h)),
n as (select r, count(*) as n, list(i) as gone from gone group by r),
word as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
kept as (select word.r, string_agg(x, ' ' order by word.i) as t from word anti join gone on gone.r = word.r and gone.i = word.i group by word.r)
select doc_id, len(w)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join n on n.r = d.r left join kept on kept.r = d.r"""

#: Equal word sequences are classes; classes are linked by shared shingles, and the smallest identifier spreads.
NEAR = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{WORDS}') as w from documents),
s as (select r, doc_id, array_to_string(w, ' ') as t,
      case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from d),
c as (select min(doc_id) as c, any_value(g) as g, len(any_value(g)) as n from s where len(g) > 0 group by t),
x as (select c, n, unnest(g) as h from c),
pairs as (select a.c as a, b.c as b, count(*) as shared from x a join x b on a.h = b.h and a.c < b.c and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 75 group by 1, 2),
link as (select a, b from pairs join c as ca on ca.c = a join c as cb on cb.c = b where 100 * shared >= 75 * (ca.n + cb.n - shared)),
edge as (select a, b from link union all select b, a from link),
reach(c, m) as (select c, c from c union select e.b, r.m from reach r join edge e on e.a = r.c),
low as (select c, min(m) as m from reach group by c),
text as (select t, min(doc_id) as c from s where len(g) > 0 group by t)
select doc_id, len(g)::bigint as n_shingles, case when len(g) > 0 then low.m else doc_id end as component_id,
       doc_id = case when len(g) > 0 then low.m else doc_id end as kept
from s left join text on text.t = s.t left join low on low.c = text.c"""

#: Base32 from the hexadecimal digest: 40 digits, eight groups of five for 20 bits each, four signs a group.
_signs = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> {}) % 32, 1)"
_url = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(?::[0-9]*)?([^#]*)"
ARCHIVES = f"""
with p as (select page_id, url, coalesce(html, '') as html, encode(coalesce(html, '')) as body, row_number() over () as r from pages),
g as (select html, max(page_id) as first from p group by html),
b as (select p.r, p.page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as hex, g.first, url from p join g using (html)),
v as (select r, string_agg(s, '' order by k) as digest from (
      select r, k, {" || ".join(_signs.format(n) for n in (15, 10, 5, 0))} as s from (
      select r, k, ('0x' || substr(hex, 1 + 5 * k, 5))::bigint as v from (select r, hex, unnest(range(8)) as k from b))) group by r)
select page_id, payload_bytes, digest as payload_digest, case when first is not distinct from page_id or first is null then 'response' else 'revisit' end as record_type,
       case when first is distinct from page_id then first end as refers_to, strftime(make_timestamp(coalesce(1704067200 + page_id, 0) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured,
       case when u is null then '' when not regexp_matches(u, '{_url}') then u
       else array_to_string(list_reverse(string_split(lower(regexp_extract(u, '{_url}', 1)), '.')), ',') || ')' || regexp_extract(u, '{_url}', 2) end as urlkey
from (select *, regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g') as u from b) b join v using (r)"""


#: Ten rounds of assigning and moving, one after the other; a mean's floor is that of exact integers.
_near = """
a{r} as (select v, c from (select v, c, row_number() over (partition by v order by d, c) as k from (
      select x.v, c.c, sum((x.x - c.x) * (x.x - c.x)) as d from x join c{r} c using (i) group by x.v, c.c)) where k = 1)"""
_move = """
m{r} as (select c, i, cast(sum(x) as bigint) as s, count(*) as n from x join a{r} using (v) group by c, i),
c{q} as (select c.c, c.i, case when n is null then c.x else (s - ((s % n) + n) % n) // n end as x from c{r} c left join m{r} m on m.c = c.c and m.i = c.i)"""
CLUSTERS = (
    """
with e as (select row_number() over () as v, vec_id, embedding::double[] as e from embeddings where len(embedding) = 64),
k as (select v, vec_id, list_transform(e, lambda y: cast(floor(1024 * y) as bigint)) as e from e
      where len(list_filter(e, lambda y: y is null or not isfinite(y))) = 0),
x as materialized (select v, unnest(range(64)) as i, unnest(e) as x from k),
f as (select v, row_number() over (order by sha256('3:' || cast(vec_id as varchar))) - 1 as c from k where vec_id is not null order by c limit 8),
c0 as (select c, i, x from f join x using (v)),"""
    + "".join(_near.format(r=r) + "," + _move.format(r=r, q=r + 1) + "," for r in range(10))
    + _near.format(r=10)
    + """,
d as (select v, c, cast(sum((x.x - c.x) * (x.x - c.x)) as bigint) as distance from x join a10 using (v) join c10 c using (c, i) group by v, c),
h as (select c, sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by i)) as centroid_sha256 from c10 group by c)
select vec_id, cast(c as int) as cluster, distance, cast(sum(distance) over (partition by c) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia, centroid_sha256
from d join h using (c) join k using (v)"""
)

#: CRC-32 of a string of ASCII characters: eight shifts for each.
_crc = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::ubigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint)"""

#: A node is its path, a list of turns; every rebuilt conversation is a member of each of its prefixes.
TRIE = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as p,
      {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as x from conversations where conv_id is not null),
h as (select distinct c, cast({_crc.format("cast(c as varchar)")} % 6 as bigint) as h from t),
r as (select h.c, 0 as part, p, x from h join t on t.c = h.c - h.c % 100 and p < h union all select h.c, 1, p, x from h join t on t.c = h.c and p >= h),
l as (select h.c, coalesce(list(x order by part, p) filter (x is not null), []) as l from h left join r on r.c = h.c group by h.c),
m as (select c, l, unnest(range(len(l) + 1)) as depth from l),
n as (select l[:depth] as path, depth, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (depth = len(l)), '')) as ends_sha256 from m group by 1, 2),
k as (select n.path, n.depth, n.conv_id, n.n_convs, n.ends_sha256, count(b.path) as n_children from n left join n b on b.depth = n.depth + 1 and b.path[:n.depth] = n.path group by all),
s as (select a.path, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * case when b.depth > 0 then length(b.path[b.depth].t) else 0 end) as saved
      from k a join k b on b.path[:a.depth] = a.path group by a.path)
select k.conv_id, k.depth, up.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, cast(saved as bigint) as saved_tokens, k.ends_sha256
from k join s on s.path = k.path left join k up on up.depth = k.depth - 1 and up.path = k.path[:k.depth - 1]"""
