"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .jaccard_join import SHINGLE, THRESHOLD
from .quality_rules import MIN_WORDS, REPEAT_PERCENT, RULES, STRATA
from .substring_dedup import LINE_WORDS, PASSAGE_WORDS

_BLANK = r"'[\x20\x09-\x0D]+'"
_TRIM = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"


def quality_rules(total_alpha: float = 0.08, delta: float = 0.05) -> str:
    alpha, level = total_alpha / len(RULES), delta / (len(RULES) * (len(STRATA) + 1))
    stratum = "case " + " ".join(f"when n_words < {b} then {i}" for i, b in enumerate(STRATA)) + f" else {len(STRATA)} end"
    ratio = {r: f"coalesce({over}::double / nullif({under}, 0), 0)" for r, (over, under, _) in RULES.items()}
    tests = " union all ".join(f"select stratum, '{r}' as rule, {i} as step, {c}::double as cutoff, count(*) as n, count(case when {ratio[r]} > {c} then 1 end) as k from good group by stratum" for r in RULES for i, c in enumerate(RULES[r][2]))
    failed = " or ".join(f"coalesce({ratio[r]} > (select cutoff from cuts where cuts.stratum = s.stratum and cuts.rule = '{r}'), false)" for r in RULES)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))))"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, {_BLANK}), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_TRIM}) <> '') as l from d),
win as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) > 3)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
rep as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from dup) group by rid),
s0 as (select w.rid, doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines from w left join rep on w.rid = rep.rid),
s as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed, {stratum} as stratum from s0),
good as (select s.* from s join labels on s.doc_id = labels.doc_id where labels.quality = 1 and not base_failed),
tests as ({tests}),
judged as (select *, {tail} <= {level} as passed from tests),
stops as (select stratum, rule, min(case when not passed then step end) as stop from judged group by stratum, rule),
cuts as (select j.stratum, j.rule, min(cutoff) as cutoff from judged j join stops on j.stratum = stops.stratum and j.rule = stops.rule where stop is null or step < stop group by j.stratum, j.rule)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({failed}) as kept from s"""


LINE_DEDUP = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
l0 as (select doc_id, length(t) as n, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from d),
l as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as bol, list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> '') as w from l0),
bl as (select *, sum(case when len(w) = 0 then 1 else 0 end) over (partition by doc_id order by k) as block from l),
q as (select 'q' || string_agg(array_to_string(w, ' '), ' ' order by k) as u, doc_id, min(bol) as a, max(least(bol + length(line) + 1, n)) as b from bl where len(w) > 0 group by doc_id, block having count(*) > 1 and sum(len(w)) >= {LINE_WORDS}),
p0 as (select doc_id, regexp_extract_all(t, '\\s*\\S+') as p from d),
p1 as (select doc_id, list_transform(p, lambda x: lower(regexp_replace(x, '^\\s+', ''))) as w, list_transform(p, lambda x: length(regexp_replace(x, '^\\s+', ''))) as wl, list_transform(p, lambda x: length(x)) as pl from p0 where len(p) >= {PASSAGE_WORDS}),
p2 as (select doc_id, w, wl, unnest(range(1, len(w) + 1)) as i, unnest(pl) as one from p1),
p3 as (select doc_id, w, i, wl[i] as wl, sum(one) over (partition by doc_id order by i)::bigint as e from p2),
p4 as (select 'p' || array_to_string(w[i:i + {PASSAGE_WORDS - 1}], ' ') as u, doc_id, e - wl as a, lead(e, {PASSAGE_WORDS - 1}) over (partition by doc_id order by i) as b from p3),
u as (select 'l' || array_to_string(w, ' ') as u, doc_id, bol as a, least(bol + length(line) + 1, n) as b from l where len(w) >= {LINE_WORDS} union all select * from q union all select * from p4 where b is not null),
r as (select *, row_number() over o as r, first_value(doc_id) over o as d1, first_value(b) over o as b1 from u window o as (partition by u order by doc_id, a)),
g as (select doc_id, case when d1 = doc_id then greatest(a, b1) else a end as a, b from r where r > 1 and (d1 <> doc_id or b > b1)),
m as (select *, max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) as before from g),
i as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by doc_id order by a, b rows unbounded preceding) as island from m),
x as (select doc_id, min(a) as a, max(b) as b from i group by doc_id, island),
y as (select x.*, d.t, coalesce(lag(b) over (partition by x.doc_id order by a), 0) as prior from x join d on x.doc_id = d.doc_id),
z as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(a || ':' || b, ',' order by a) as spans, string_agg(substr(t, prior + 1, a - prior), '' order by a) || substr(any_value(t), max(b) + 1) as text from y group by doc_id)
select d.doc_id, length(d.t)::bigint as n_chars, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, coalesce(spans, '') as spans, coalesce(z.text, d.t) as text from d left join z on d.doc_id = z.doc_id"""

JACCARD_JOIN = f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as w from documents),
k as (select doc_id, w, array_to_string(w, ' ') as key from d),
c as (select key, min(doc_id) as copy_id, count(*) as members, any_value(w) as w from k where len(w) > 0 group by key),
sh as (select distinct copy_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as g from (select copy_id, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) as i from c)),
n as (select copy_id, count(*) as n from sh group by copy_id),
p as (select a.copy_id as a, b.copy_id as b, count(*) as common from sh a join sh b on a.g = b.g and a.copy_id < b.copy_id group by 1, 2),
e as (select a, b from p join n na on p.a = na.copy_id join n nb on p.b = nb.copy_id where common >= {THRESHOLD} * (na.n + nb.n - common) - 1e-6),
e2 as (select a, b from e union all select b, a from e),
r(a, b) as (select a, b from e2 union select r.a, e2.b from r join e2 on r.b = e2.a),
root as (select a, min(least(a, b)) as class_id from r group by a),
lk as (select e2.a, sum(c.members) as links from e2 join c on e2.b = c.copy_id group by e2.a)
select k.doc_id, coalesce(root.class_id, c.copy_id, k.doc_id) as class_id, coalesce(c.copy_id, k.doc_id) as copy_id, coalesce(c.members, 1)::bigint as n_copies, (coalesce(lk.links, 0) + coalesce(c.members, 1) - 1)::bigint as n_links
from k left join c on k.key = c.key and len(k.w) > 0 left join root on c.copy_id = root.a left join lk on c.copy_id = lk.a"""
