"""DuckDB statements for the text queries that SQL can express."""

from __future__ import annotations

OP10 = r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
           md5(concat_ws(':', 'mix-1', coalesce(doc_id::varchar, 'null'), md5(coalesce(text, '')))) as digest
    from documents
),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
    select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
    from s
),
l as (
    select *,
           sum(source_size) over () * 1.5::double - coalesce(sum(source_size) over f, 0) * 2 as room,
           sum(weight) over () - coalesce(sum(weight) over f, 0) as open,
           row_number() over (order by source_size::double / weight, source asc nulls last) as place
    from w
    window f as (order by source_size::double / weight, source asc nulls last rows between unbounded preceding and 1 preceding)
),
v as (
    select arg_min(room::double / open, place) filter (where room::double / open * weight <= source_size * 2) as level from l
),
t as (
    select source, source_size, least(source_size * 2.0::double, coalesce(v.level * weight, source_size * 2.0::double)) as target
    from l, v
),
r as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end as base from t
),
n as (
    select d.source, len(bin(d.size)) as weight, any_value(r.target - r.base * r.source_size) as lacks, sum(d.size)::bigint as n
    from d join r on d.source is not distinct from r.source group by 1, 2 having sum(d.size) > 0
),
h as (
    select *, coalesce(sum(n) over (partition by source order by weight desc rows between unbounded preceding and 1 preceding), 0) as heavier,
           sum(weight * n) over (partition by source order by weight desc rows between current row and unbounded following) as mass
    from n
),
c as (
    select source, max_by((lacks - heavier::double) / mass::double, weight) as chance, max_by(heavier, weight) as certain
    from h where lacks > 0 and (lacks - heavier::double) / mass::double * weight < 1 group by source
),
p as (
    select d.*, r.source_size, r.target, r.base, r.target - r.base * r.source_size - coalesce(c.certain, 0) as lacks,
           case when r.target - r.base * r.source_size > 0 then coalesce(c.chance * len(bin(d.size)), 1.0::double) else 0 end as p,
           ((('0x' || d.digest[:12])::bigint)::double + 0.5) / 281474976710656.0::double as u
    from d join r on d.source is not distinct from r.source left join c on d.source is not distinct from c.source
),
k as (
    select *, case when p > 0 and p < 1 then (u / (1 - u)) / (p / (1 - p)) end as rank from p
),
o as (
    select *, sum(size) over (partition by source, rank is null order by rank, digest rows unbounded preceding) as with_it from k
)
select doc_id, size::bigint as size, source_size, target,
       (size * (base + case when p >= 1 or (rank is not null and with_it - lacks <= lacks - (with_it - size)) then 1 else 0 end))::bigint as taken
from o
"""

#: Levels of the trees that the statement spells out: 16**6 rows a source, 16**3 sources.
_LEVELS, _CROWN = 6, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fields(text: str) -> str:
    values = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


def _tree(name: str, of: str, levels: int) -> str:
    """CTEs {name}0.. of (s, n, pos, h), each level made of the one before, from ``of``; runs {name}r0.. hold the digests of each run."""
    out = [f"{name}0 as (select s, n, pos, h from {of})"]
    for k in range(levels):
        out.append(f"{name}r{k} as (select s, any_value(n) as n, pos // 16 as up, list(h order by pos) as run from {name}{k} group by s, pos // 16)")
        out.append(f"{name}{k + 1} as (select s, (n + 15) // 16 as n, up as pos, case when n = 1 then run[1] else sha256(array_to_string(run, '')) end as h from {name}r{k})")
    return ",\n".join(out)


def _climb(name: str, of: str, levels: int) -> str:
    """CTEs {name}f0.. that fold column ``v`` of ``of`` (s, pos, v, proof) upward level by level."""
    out, last = [], of
    for k in range(levels):
        left, right = f"array_to_string(run[1:pos % 16], '')", "array_to_string(run[pos % 16 + 2:], '')"
        out.append(
            f"{name}f{k} as (select f.* replace (pos // 16 as pos, case when r.n = 1 then v else sha256({left} || v || {right}) end as v, "
            f"case when r.n = 1 then proof else proof || {left} || {right} end as proof) from {last} f join {name}r{k} r on f.s = r.s and f.pos // 16 = r.up)"
        )
        last = f"{name}f{k}"
    return ",\n".join(out)


OP12 = f"""
with d as (
    select *, sha256({_fields("text")}) as leaf,
           xor(list_reduce(
               [4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))
           ), 4294967295) as crc
    from documents
),
e as (
    select *, case when crc % 5 = 0 then sha256({_fields(f"translate(text, '{_UPPER}', '{_LOWER}')")}) else leaf end as shown,
           dense_rank() over (order by source nulls first) - 1 as s, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
           count(*) over (partition by source) as n
    from d
),
l as (select s, n, pos, leaf as h from e),
{_tree("t", "l", _LEVELS)},
c as (select 0 as s, (select count(*) from t{_LEVELS}) as n, s as pos, h from t{_LEVELS}),
{_tree("u", "c", _CROWN)},
b as (select doc_id, leaf, s, pos, s as place, shown as v, '' as proof from e),
{_climb("t", "b", _LEVELS)},
g as (select f.doc_id, f.leaf, t.h as subroot, 0 as s, f.place as pos, f.v, f.proof from tf{_LEVELS - 1} f join t{_LEVELS} t on f.s = t.s),
{_climb("u", "g", _CROWN)}
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, v as folded_root, v = r.h as verified
from uf{_CROWN - 1}, u{_CROWN} r
"""

OP13 = r"""
with t as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
g as (
    select lang, m, array_to_string(w[s:s + m - 1], ' ') as phrase
    from (select lang, w, unnest(range(1, len(w) + 1)) as s from p) x, (select unnest([1, 2, 3, 4]) as m) y where s + m - 1 <= len(w)
),
f as (select lang, m, phrase, count(*) as f from g group by all having count(*) >= 30),
n as (select lang, count(*) as n from g where m = 1 group by lang),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1),
k as (select *, unnest(range(1, m)) as k from c),
s as (
    select k.lang, k.phrase, a, k, x.f as l, y.f as r, (2000000::hugeint * a // (x.f + y.f))::bigint as score
    from k join f x on x.lang = k.lang and x.phrase = array_to_string(w[1:k], ' ') join f y on y.lang = k.lang and y.phrase = array_to_string(w[k + 1:], ' ')
),
b as (select lang, phrase, any_value(a) as a, min({'score': score, 'k': k, 'l': l, 'r': r}) as least from s group by lang, phrase),
h as (
    select lang, array_to_string(w[s:s + v - 1], ' ') as phrase, max(a) as longer
    from (select *, unnest(range(1, m)) as s from c) x, (select unnest([2, 3]) as v) y where v < m and s + v - 1 <= m group by 1, 2
),
z as (
    select b.lang, b.phrase, b.a, least.l as l, least.r as r, least.score as score
    from b left join h on h.lang = b.lang and h.phrase = b.phrase where h.longer is null or 100::hugeint * h.longer < 80::hugeint * b.a
),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select o.lang, rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op10_mixing": OP10,
    "op12_merkle": OP12,
    "op13_phrases": OP13,
}
