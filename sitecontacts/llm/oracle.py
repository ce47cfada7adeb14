"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

from sitecontacts.llm.mixing import WEIGHTS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '')"

OP8 = rf"""
with d as (
  select doc_id, row_number() over () as k, coalesce(text, '') as body, {_WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) as ls
  from documents),
p as (select k, len(w) as n, unnest(w) as x, generate_subscripts(w, 1) as i from d),
g as (select k, i, n, case when i <= n - 2 then concat_ws(' ', x,
    lead(x) over (partition by k order by i), lead(x, 2) over (partition by k order by i)) end as g from p),
c as (select k, i, (g is not null and count(*) over (partition by k, g) > 1)::int as r from g),
v as (select k, count(*) as n from (select k, greatest(r, coalesce(lag(r) over o, 0), coalesce(lag(r, 2) over o, 0)) as r
    from c window o as (partition by k order by i)) where r = 1 group by k),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(v.n, 0)::bigint as n_repeat_words,
    len(ls)::bigint as n_lines, length(regexp_replace(body, '\P{{Lu}}', '', 'g'))::bigint as n_upper
  from d left join v using (k)),
b as (select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 10 * n_symbols > n_words then 4 else 0 end
    + case when n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 14 * n_words then 32 else 0 end
    + case when 100 * n_upper > 40 * word_chars then 64 else 0 end as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 as base_failed,
  bits = 0 as kept, bits::bigint as fail_bits from b
"""



def _shares(name: str, source: str, parent: list[str], weights: dict[str, int]) -> str:
    """CTE `name`: the budgets of the children in `source` (parent columns, child, c, b)."""
    child = {"doms": "domain", "langs": "l", "srcs": "s"}[name]
    group = f"partition by {', '.join(parent)}" if parent else ""
    weight = " ".join(f"when '{k}' then {w}" for k, w in weights.items())
    kept = ", ".join([*parent, child])
    return f"""{name}_w as (select *, case {child} {weight} else 10 end as w from ({source})),
{name}_o as (select *, coalesce(sum(c) over ({group} order by c::double / w, {child} rows between unbounded preceding and 1 preceding), 0) as before,
  sum(w) over ({group} order by c::double / w, {child} rows between current row and unbounded following) as open from {name}_w),
{name}_f as (select *, c * open <= (b - before) * w as is_full from {name}_o),
{name} as (select {kept}, case when is_full then c else (b - min(case when not is_full then before end) over ({group})) * w
  // max(case when not is_full then open end) over ({group}) end as b from {name}_f)"""


OP6 = rf"""
with d as (select doc_id, lang, source, coalesce(lang, '') as l, coalesce(source, '') as s,
    len({_WORDS})::bigint as n, md5('17:0:' || coalesce(doc_id::varchar, '')) as k,
    case when regexp_matches(source, '[0-9]{{1,9}}$') then 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::bigint % 4) else 'd3' end as domain
  from documents),
leaf as (select domain, l, s, sum(n) as c from d group by all),
{_shares("doms", "select domain, sum(c) as c, (sum(sum(c)) over ()) * 50 // 100 as b from leaf group by domain", [], dict(WEIGHTS["domain"]))},
{_shares("langs", "select domain, l, sum(c) as c, any_value(b) as b from leaf join doms using (domain) group by domain, l", ["domain"], dict(WEIGHTS["lang"]))},
{_shares("srcs", "select domain, l, s, c, b from leaf join langs using (domain, l)", ["domain", "l"], dict(WEIGHTS["source"]))},
r as (select d.*, b, sum(n) over (partition by domain, l, s order by k) as total from d join srcs using (domain, l, s))
select doc_id, domain, lang, source, n as n_tokens, 0 as epoch from r where total <= b
"""

def _crc32(digits: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor({c}, x), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))".format(c="c")
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({digits}, ''), lambda d: ascii(d)::bigint)), lambda c, x: {byte}), 4294967295)"


OP11 = rf"""
with d as (select doc_id, row_number() over () as k, {_WORDS} as w, {_crc32("doc_id::varchar")} as h from documents),
e as (select doc_id, k, w, len(w)::bigint as n, case when h % 10 = 0 and len(w) > 0 then h // 10 end as g from d),
m as (select doc_id, k, n, case when g is null then w else
    list_transform(range(n), lambda i: w[case when i < g % n then i else g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) end + 1]) end as w from e),
p as (select k, unnest(w) as x, generate_subscripts(w, 1)::bigint - 1 as i from m),
q as (select a.k, a.i, b.i - a.i as q from p a join p b on a.k = b.k and a.x = b.x and a.i < b.i),
j as (select *, i - row_number() over (partition by k, q order by i) as island from q),
l as (select k, q, min(i) as s, count(*) + q as len from j group by k, q, island),
r as (select k, s, len, min(q) as q from l where len >= 12 and len >= 2 * q group by k, s, len),
t as (select k, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as listed,
    min_by({{'s': s, 'len': len, 'q': q}}, {{'a': -len, 'b': s, 'c': q}}) as b from r group by k),
z as (select k, string_agg(x, ' ' order by i) as kept from p
    where not exists (select 1 from r where r.k = p.k and p.i >= r.s + r.q and p.i < r.s + r.len) group by k)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.len::bigint as length, b.q::bigint as period,
  (1000 * b.len // b.q)::bigint as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from m left join t using (k) left join z using (k)
"""

#: Levels that the SQL of the Merkle tree climbs; enough for 3^13 leaves a source.
_CLIMB = 13


def _climb(name: str, leaves: str) -> str:
    """CTEs of all levels over `leaves` (grp, i, dig), and `name`_p: the siblings of every leaf per level."""
    out = [f"{name}_0 as ({leaves})"]
    for h in range(_CLIMB):
        node = "case when any_value(n) = 1 then any_value(dig) else sha256(string_agg(dig, '' order by i)) end"
        out.append(f"""{name}_c{h} as (select *, count(*) over (partition by grp) as n from {name}_{h}),
{name}_{h + 1} as (select grp, i // 3 as i, {node} as dig from {name}_c{h} group by grp, i // 3)""")
    steps = " union all ".join(
        f"select a.grp, a.i, {h} as h, coalesce(string_agg(b.dig, '' order by b.i) filter (b.i < a.i // {3**h}), '') as lo, "
        f"coalesce(string_agg(b.dig, '' order by b.i) filter (b.i > a.i // {3**h}), '') as hi "
        f"from {name}_0 a join {name}_c{h} b on a.grp = b.grp and b.i // 3 = a.i // {3**(h + 1)} and b.n > 1 group by a.grp, a.i"
        for h in range(_CLIMB)
    )
    return ",\n".join(out) + f",\n{name}_p as (select grp, i, list({{'lo': lo, 'hi': hi}} order by h) as steps from ({steps}) group by grp, i)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP13 = f"""
with d as (select doc_id, coalesce('s' || source, '-') as grp, sha256({_HEAD} || {_field("text")}) as dig,
    case when {_crc32("doc_id::varchar")} % 2 = 0 then sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) end as bad from documents),
l as (select *, row_number() over (partition by grp order by doc_id nulls first, dig) - 1 as i from d),
{_climb("a", "select grp, i, dig from l")},
s as (select grp as name, dig as subroot, row_number() over (order by grp) - 1 as i from a_{_CLIMB}),
{_climb("b", "select '' as grp, i, subroot as dig from s")},
r as (select l.doc_id, l.dig as leaf, s.subroot, b_{_CLIMB}.dig as root, coalesce(l.bad, l.dig) as start,
    list_concat(coalesce(a_p.steps, []), coalesce(b_p.steps, [])) as steps
  from l join s on s.name = l.grp cross join b_{_CLIMB} left join a_p on a_p.grp = l.grp and a_p.i = l.i left join b_p on b_p.i = s.i),
f as (select *, sha256(array_to_string(list_transform(steps, lambda x: x.lo || x.hi), '')) as proof_sha256,
    list_reduce(list_prepend({{'lo': start, 'hi': ''}}, steps), lambda acc, x: {{'lo': sha256(x.lo || acc.lo || x.hi), 'hi': ''}}).lo as folded_root from r)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f
"""

ORACLES: dict[str, str] = {"op6_mixing": OP6, "op8_quality_rules": OP8, "op11_periodic_runs": OP11, "op13_merkle_manifest": OP13}
