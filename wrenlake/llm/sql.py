"""SQL with the same result for the operators that SQL can express."""

from __future__ import annotations

from .rules import GRID, LEAST_GOOD, LEAST_WORDS, MOST_REPEATED, RULES


def quality_rules_sql(risk: float = 0.08, fail: float = 0.05) -> str:
    """The rules in plain SQL: windows are compared as text, the binomial sum uses log gamma."""
    p = risk / len(RULES)

    def ratio(rule: str) -> str:
        top, below = RULES[rule]
        return f"coalesce(cast(floor(10000 * ({top}) / nullif(({below})::DOUBLE, 0)) as BIGINT), 0)"

    tests = ", ".join(f"count(*) filter (where {ratio(r)} > {c})::BIGINT as {r}_{c}" for r in RULES for c in GRID)
    long = " union all ".join(f"select stratum, n, '{r}' as rule, {i} as i, {c} as cut, {r}_{c} as k from per" for r in RULES for i, c in enumerate(GRID))
    cuts = ", ".join(f"max(case when rule = '{r}' then cut end) as cut_{r}" for r in RULES)
    bad = {r: f"coalesce({ratio(r)} > cut_{r}, false)" for r in RULES}
    names = ", ".join(f"case when {x} then '{r}' end" for r, x in bad.items())
    return f"""
with d as (select doc_id, coalesce('=' || lang, 'null') as stratum, coalesce(text, '') as t from documents),
w as (select doc_id, stratum, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + o)::BIGINT as n_repeat_words from twice, (select unnest([0, 1, 2]) as o) group by doc_id),
s0 as (select w.doc_id, stratum, len(w)::BIGINT as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT as word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT as n_symbols, len(regexp_extract_all(t, '[!?]'))::BIGINT as n_marks,
      len(regexp_extract_all(t, '[A-Z]'))::BIGINT as n_capitals, len(ls)::BIGINT as n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT as n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT as n_repeat_words from w left join cov on cov.doc_id = w.doc_id),
s as (select * replace (case when stratum in (select stratum from s0 where doc_id in (select doc_id from labels where quality = 1) group by stratum having count(*) >= {LEAST_GOOD}) then stratum else '' end as stratum) from s0),
per as (select stratum, count(*)::BIGINT as n, {tests} from s where doc_id in (select doc_id from labels where quality = 1) group by stratum),
lg as ({long}),
tail as (select stratum, rule, i, n, k, sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p}::DOUBLE) + (n - j) * ln(1 - {p}::DOUBLE))) as tail
         from (select *, unnest(range(0, k + 1)) as j from lg where k <= {p}::DOUBLE * n) group by stratum, rule, i, n, k),
ok as (select lg.*, coalesce(tail.tail, 1) <= {fail}::DOUBLE / ({len(RULES)} * (select count(*) from per)) as ok
       from lg left join tail on tail.stratum = lg.stratum and tail.rule = lg.rule and tail.i = lg.i),
stop as (select stratum, rule, coalesce(min(case when not ok then i end), {len(GRID)}) as stop from ok group by stratum, rule),
chosen as (select stop.stratum, stop.rule, ok.cut from stop left join ok on ok.stratum = stop.stratum and ok.rule = stop.rule and ok.i = stop.stop - 1),
cuts as (select stratum, {cuts} from chosen group by stratum),
f as (select s.*, cuts.* exclude (stratum), n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from s left join cuts on cuts.stratum = s.stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({" or ".join(bad.values())}) as kept,
       concat_ws(',', {names}) as failed_rules from f"""


def centroids_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Rounds written out: nearest centroid of each vector, then floors of the means."""
    parts = [
        f"""
kept as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) as v from embeddings
      where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), vec_id) - 1 as c, v from kept qualify row_number() over (order by sha256('{seed}:' || vec_id), vec_id) <= {k})"""
    ]
    for t in range(rounds + 1):
        parts.append(f"""
a{t} as materialized (select i, min_by(c, d * 64 + c) as c, min(d) as d from (select i, c,
      list_sum(list_transform(range(1, 65), lambda q: (kept.v[q] - c{t}.v[q]) * (kept.v[q] - c{t}.v[q])))::BIGINT as d from kept, c{t}) group by i)""")
        if t < rounds:
            parts.append(f"""
s{t} as (select c, q, sum(v[q])::BIGINT as s, count(*)::BIGINT as n from a{t} join kept using (i), (select unnest(range(1, 65)) as q) group by c, q),
m{t} as (select c, list((s - ((s % n) + n) % n) // n order by q) as v from s{t} group by c),
c{t + 1} as materialized (select c{t}.c, coalesce(m{t}.v, c{t}.v) as v from c{t} left join m{t} using (c))""")
    return f"""
with {",".join(parts)}
select vec_id, a.c::INTEGER as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::BIGINT as cluster_inertia, (sum(a.d) over ())::BIGINT as inertia,
       sha256(array_to_string(m.v, ',')) as centroid_sha256 from a{rounds} a join kept using (i) join c{rounds} m on m.c = a.c"""


def mixing_sql(seed: int = 42) -> str:
    """Levels by closed form over the sources in order of the level at which they are full; one pass after another along a checksum's order."""
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size, substr(sha256('{seed}:' || doc_id), 1, 32) as h from documents),
s as (select source, sum(size)::BIGINT as n, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source),
o as (select *, 2 * n / w::DOUBLE as full_at, 1.5::DOUBLE * sum(n) over () - coalesce(sum(2 * n) over (order by 2 * n / w::DOUBLE, source nulls last rows between unbounded preceding and 1 preceding), 0)::DOUBLE as rest,
      sum(w) over (order by 2 * n / w::DOUBLE, source nulls last rows between current row and unbounded following)::DOUBLE as ws from s),
l as (select rest, ws from o where rest / ws <= full_at order by full_at limit 1),
t as (select o.source, n, case when w * l.rest / l.ws > 2 * n then 2 * n else w * l.rest / l.ws end::DOUBLE as target from o, l),
p as (select *, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::BIGINT as a from d)
select doc_id, size, n as source_size, target, (greatest(0, least(a + size, floor(target)) - a) + greatest(0, least(n + a + size, floor(target)) - n - a))::BIGINT as taken
from p join t on t.source is not distinct from p.source"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules_sql(), "op11_centroid_clustering": centroids_sql(), "op12_source_mixing": mixing_sql()}
