"""SQL that gives the rows of the registered queries, over the ``events`` table. A logical second is a minute there."""

from __future__ import annotations

US = 60_000_000
DAY = 86_400_000_000

FEEDS = f"""
with base as (select event_id, epoch_us(ts) as t, case when user_id % 2 = 0 then 'btc' else 'eth' end as sym, event_type as et, user_id,
    100.0::double + value / 100.0::double as price, cast(json_extract(props, '$.k') as bigint) as k from events),
trades as (select event_id as trade_id, sym, t, event_id as seq, case when et = 'purchase' then 'buy' else 'sell' end as side, case when et = 'purchase' then 1 else -1 end as s,
    price, cast((1 + k) * 20 as double) as amount, price * cast((1 + k) * 20 as double) as notional, least(price * cast((1 + k) * 20 as double), 100000.0::double) as w
    from base where et in ('purchase', 'click')),
bbo as (select sym, t, event_id as seq, ((price - 0.01::double) + (price + 0.01::double)) / 2 as mid, (price + 0.01::double) - (price - 0.01::double) as spread,
    price - 0.01::double as bid_price, price + 0.01::double as ask_price, cast(1 + k as double) as bid_amount, cast(1 + event_id % 50 as double) as ask_amount from base where et = 'view'),
ends as (select sym, min(t) as first_t, max(t) as last_t from bbo group by sym),
liq as (select sym, case when et = 'error' then 'binance' else 'bybit' end as venue, t + case when et = 'signup' then 12000000 else 0 end as t, t as raw_t, event_id as seq,
    case when event_id % 2 = 0 then 'buy' else 'sell' end as side, case when event_id % 2 = 0 then 1 else -1 end as sgn, price, cast(1 + k as double) as amount,
    price * cast(1 + k as double) as notional, case when event_id % 2 = 0 then 1 else -1 end * (price * cast(1 + k as double)) as signed from base where et in ('error', 'signup'))
"""

SPLIT = "case " + " ".join(f"when t >= epoch_us(timestamp '{a}') and t < epoch_us(timestamp '{b}') - {300 * US} then '{n}'" for n, a, b in (("train", "2024-01-01", "2024-01-16"), ("val", "2024-01-16", "2024-01-24"), ("test", "2024-01-24", "2024-01-31"))) + " else 'other' end"


def rd(x: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0.0::double"


def _mid(name: str, source: str, key: str, offset: float, time: str = "t") -> str:
    """A CTE with ``key`` and the mid as of ``time + offset`` seconds."""
    return f"{name} as (select q.{key}, case when q.qt <= e.last_t then b.mid end as m from (select {key}, sym, {time} + {int(offset * US)} as qt from {source}) q asof left join bbo b on q.sym = b.sym and q.qt >= b.t left join ends e on q.sym = e.sym)"


def _pnl(taus=(30, 120, 300)) -> str:
    parts = [_mid(f"m{t}", "trades", "trade_id", t) for t in taus]
    cols = ", ".join(f"-s * (m{t}.m - price) / price * 1e4::double + 0.5::double as pnl_{t}" for t in taus)
    joins = " ".join(f"join m{t} on tr.trade_id = m{t}.trade_id" for t in taus)
    return FEEDS + ", " + ", ".join(parts) + f", pnl as (select tr.*, {cols} from trades tr {joins})"


def _tall(source: str, taus=(30, 120, 300), cols: str = "*") -> str:
    return " union all ".join(f"select {cols}, {t} as tau, pnl_{t} as pnl from {source}" for t in taus)


_WINDOW = "(select coalesce(sum(l.{v}), 0) from liq l where l.sym = tr.sym and l.venue = '{venue}' and l.t > tr.t - {w} and l.t <= tr.t)"


def _wins(venue: str, w: int) -> str:
    """A subquery with trade_id and net, abs and count of a venue over (t - w, t]."""
    return f"(select tr.trade_id, coalesce(sum(l.signed), 0) as net, coalesce(sum(l.notional), 0) as abs, count(l.t) as cnt from trades tr left join liq l on l.sym = tr.sym and l.venue = '{venue}' and l.t > tr.t - {w * US} and l.t <= tr.t group by tr.trade_id)"


def _rule() -> str:
    return _pnl() + f", rule as (select p.*, p.s * x.net as score, {SPLIT} as split from pnl p join {_wins('bybit', 300)} x on p.trade_id = x.trade_id)"


def markout(tau: int) -> str:
    return _pnl((tau,)) + f" select trade_id, sym, {rd(f'pnl_{tau}')} as pnl_{tau} from pnl"


BASELINES = _pnl() + f", tall as ({_tall('pnl', cols=f'sym, t, w, {SPLIT} as split')}) select sym, split, tau, count(pnl) as n, count(distinct t // {DAY}) as n_days, {rd('sum(w * pnl) / sum(case when pnl is not null then w end)')} as pnl_all, {rd(f'sum(case when pnl is not null then w end) / count(distinct t // {DAY})', 0)} as turnover_per_day, {rd('sum(case when pnl is not null then w end)')} as turnover from tall where split <> 'other' group by sym, split, tau"


def _metrics(by: str, source: str) -> str:
    """Metrics of the filter ``f`` over a table with t, w, pnl, f."""
    agg = f"select {by}, count(pnl) as n, count(distinct t // {DAY}) as n_days, sum(case when pnl is not null then w end) as sw, sum(w * pnl) as swp, sum(case when f = 0 and pnl is not null then w end) as kw, sum(case when f = 0 then w * pnl end) as kwp, sum(case when f = 1 and pnl is not null then w end) as fw, sum(case when f = 1 then w * pnl end) as fwp, count(case when f = 1 then pnl end) as fn from {source} group by {by}"
    return f"select {by}, swp / sw as pnl_all, kwp / kw as pnl_kept, fwp / fw as pnl_filtered, kwp / kw - swp / sw as score, coalesce(kw, 0) / n_days as turnover_per_day, coalesce(kw, 0) / n_days >= 500000 as constraint_ok, coalesce(fw, 0) / sw as frac_w, fn::double / nullif(n, 0) as frac_n, n, n_days, kw from ({agg})"


def _round(names: str, digits: int = 4) -> str:
    return ", ".join(f"{rd(n, digits)} as {n}" for n in names.split())


SCORE_KEEPALL = _pnl() + f", tall as ({_tall('pnl', cols='sym, t, w, 0 as f')}), m as ({_metrics('sym, tau', 'tall')}) select sym, tau, {_round('pnl_all pnl_kept score frac_w frac_n')}, {_round('turnover_per_day', 2)}, constraint_ok, n, n_days from m"
SCORE_RULE = _rule() + f", tall as ({_tall('rule', cols='sym, split, t, w, case when score < 0 then 1 else 0 end as f')}), m as ({_metrics('sym, split, tau', 'tall')}) select sym, split, tau, {_round('pnl_all pnl_kept pnl_filtered score frac_w frac_n')}, {_round('turnover_per_day', 2)}, constraint_ok, n, n_days from m"
SPLIT_COUNTS = FEEDS + f" select sym, {SPLIT} as split, count(*) as n, {rd('sum(w)')} as w from trades group by 1, 2"
ASOF_MID = FEEDS + "," + _mid("m0", "trades", "trade_id", 0) + f" select trade_id, {rd('m', 6)} as mid from m0"
BOOK_STATE = FEEDS + f""", f0 as (select sym, arg_min(spread, t) as spread, arg_min(bid_amount, t) as ba, arg_min(ask_amount, t) as aa from bbo group by sym),
 x as (select q.trade_id, case when q.t <= e.last_t then b.mid end as mid, case when b.t is null then f0.spread else b.spread end as spread, case when b.t is null then f0.ba else b.bid_amount end as bid_amount, case when b.t is null then f0.aa else b.ask_amount end as ask_amount
 from trades q asof left join bbo b on q.sym = b.sym and q.t >= b.t left join ends e on q.sym = e.sym left join f0 on q.sym = f0.sym)
 select trade_id, {_round('mid spread bid_amount ask_amount', 6)}, {rd('(bid_amount - ask_amount) / (bid_amount + ask_amount)', 6)} as obi from x"""
MOMENTUM = FEEDS + "," + ", ".join(_mid(f"m{w}", "trades", "trade_id", -w) for w in (0, 1, 5, 30)) + " select tr.trade_id, " + ", ".join(f"{rd(f's * (m0.m - m{w}.m) / m{w}.m * 1e4::double')} as ret_{w}" for w in (1, 5, 30)) + " from trades tr join m0 on tr.trade_id = m0.trade_id " + " ".join(f"join m{w} on tr.trade_id = m{w}.trade_id" for w in (1, 5, 30))
LIQ_WINDOW = FEEDS + " select tr.trade_id, " + ", ".join(f"{rd(f'{p}{w}.{k}::double')} as {p}_{k}_{w}" for p in "ab" for w in (30, 300) for k in ("net", "abs", "cnt")) + " from trades tr " + " ".join(f"join {_wins(v, w)} {p}{w} on tr.trade_id = {p}{w}.trade_id" for p, v in (("a", "binance"), ("b", "bybit")) for w in (30, 300))
_SINCE = "(select tr.trade_id, (tr.t - l.t) / 60000000.0::double as since from trades tr asof left join (select * from liq where venue = '{v}') l on tr.sym = l.sym and tr.t >= l.t)"
LIQ_RECENCY = FEEDS + f" select a.trade_id, {rd('a.since')} as binance, {rd('b.since')} as bybit, {rd('a.since - b.since')} as lead from {_SINCE.format(v='binance')} a join {_SINCE.format(v='bybit')} b on a.trade_id = b.trade_id"
_STREAK = ", ch as (select *, case when lag(sgn) over (partition by venue, sym order by t, seq) = sgn then 0 else 1 end as new from liq), isl as (select *, sum(new) over (partition by venue, sym order by t, seq rows unbounded preceding) as island from ch)"
LIQ_RUNLEN = FEEDS + _STREAK + " select venue, sym, seq as event_id, cast(sgn * row_number() over (partition by venue, sym, island order by t, seq) as bigint) as runlen from isl"
LIQ_ZSCORE = FEEDS + f" select venue, sym, seq as event_id, {rd('case when count(*) over w >= 20 then (notional - avg(notional) over w) / nullif(stddev_samp(notional) over w, 0) end')} as z from liq window w as (partition by venue, sym order by t, seq rows between 199 preceding and current row)"
BASIS = FEEDS + "," + _mid("m0", "trades", "trade_id", 0) + f", x as (select tr.trade_id, tr.t - l.t as since, l.price as lp, m0.m as mid from trades tr asof left join (select * from liq where venue = 'bybit') l on tr.sym = l.sym and tr.t >= l.t join m0 on tr.trade_id = m0.trade_id) select trade_id, {rd(f'coalesce(case when since <= {300 * US} then (lp - mid) / mid * 1e4::double end, 0)')} as basis_bps from x"
_SEC = f"(t // {US})"
SEASONALITY = FEEDS + f", x as (select trade_id, cast((t // {3600 * US}) % 24 as double) as hour, case when (t // {86400 * US} + 3) % 7 >= 5 then 1.0::double else 0.0::double end as is_weekend, cast((28800 - {_SEC} % 28800) % 28800 as double) / 60 as m from trades) select trade_id, hour, is_weekend, m as min_to_funding, case when m <= 5 or m >= 475 then 1.0::double else 0.0::double end as in_funding_window from x"
_GRID = f", g as (select sym, t // {US} as sec, sum(s * amount) as signed_vol, sum(amount) as tot_vol, count(*) as cnt from trades group by 1, 2), ge as (select sym, min(sec) as s0, max(sec) as s1 from g group by sym), sp as (select sym, unnest(generate_series(s0, s1)) as sec from ge), dg as (select sp.sym, sp.sec, coalesce(signed_vol, 0) as signed_vol, coalesce(tot_vol, 0) as tot_vol, coalesce(cnt, 0)::integer as cnt from sp left join g on sp.sym = g.sym and sp.sec = g.sec)"
FLOW_GRID = FEEDS + _GRID + f" select sym, sec, {_round('signed_vol tot_vol')}, cnt from dg"


STREAM_FLOW_GRID = FEEDS + _GRID + f" select sym, sec, {_round('signed_vol tot_vol')}, cnt::integer as cnt from g"


def _flow() -> str:
    out = []
    for w in (30, 300):
        a = f"rows between {w} preceding and 1 preceding"
        out.append(f"w{w} as (select tr.trade_id, tr.s, x.net, x.tot, x.n from trades tr join (select sym, sec, case when sec - min(sec) over (partition by sym) >= {w} then sum(signed_vol) over (partition by sym order by sec {a}) end as net, case when sec - min(sec) over (partition by sym) >= {w} then sum(tot_vol) over (partition by sym order by sec {a}) end as tot, case when sec - min(sec) over (partition by sym) >= {w} then sum(cnt) over (partition by sym order by sec {a}) end as n from dg) x on tr.sym = x.sym and tr.t // {US} = x.sec)")
    cols = []
    for w in (30, 300):
        tfi = f"case when w{w}.net is not null then case when w{w}.tot > 0 then w{w}.net / w{w}.tot else 0 end end"
        cols += [f"{rd(tfi)} as tfi_{w}s", f"{rd(f'w{w}.s * ({tfi})')} as tfi_aligned_{w}s", f"{rd(f'w{w}.n / {w}.0::double')} as trade_intensity_{w}s", f"{rd(f'abs({tfi})')} as flow_imbalance_mag_{w}s", f"{rd(f'w{w}.s * w{w}.net')} as signed_vol_mom_{w}s"]
    return FEEDS + _GRID + ", " + ", ".join(out) + f" select w30.trade_id, {', '.join(cols)} from w30 join w300 on w30.trade_id = w300.trade_id"


FLOW_FEATURES = _flow()
_MIDS = f", pm as (select sym, t // {US} as sec, arg_max(mid, t) as mid from bbo group by 1, 2), me as (select sym, min(sec) as s0, max(sec) as s1 from pm group by sym), ms as (select sym, unnest(generate_series(s0, s1)) as sec from me), mg as (select ms.sym, ms.sec, pm.mid from ms asof left join pm on ms.sym = pm.sym and ms.sec >= pm.sec)"
MID_GRID = FEEDS + _MIDS + f" select sym, sec // 1440 as day, count(*) as n, {rd('sum(mid)')} as total, {rd('min(mid)')} as lo, {rd('max(mid)')} as hi from mg group by 1, 2"


def rolling(names: list[str]) -> str:
    def one(name: str) -> str:
        kind, w = name.split("_")
        o = f"over (partition by sym order by sec rows between {int(w) - 1} preceding and current row)"
        full = f"count(r) {o} = {w}"
        if kind == "rv":
            return f"case when {full} then stddev_samp(r) {o} * 1e4::double end"
        if kind == "ampl":
            return f"case when count(mid) {o} = {w} then (max(mid) {o} - min(mid) {o}) / mid * 1e4::double end"
        if kind == "rskew":
            return f"case when {full} and var_pop(r) {o} > 1e-20 then skewness(r) {o} end"
        return f"case when {full} and count(r10) {o} = {w} then var_samp(r10) {o} / nullif(10 * var_samp(r) {o}, 0) end"

    cols = ", ".join(f"{one(n)} as {n}" for n in names)
    out = ", ".join(f"count({n}) as n_{n}, {rd(f'sum({n})', 3)} as {n}" for n in names)
    return FEEDS + _MIDS + f", rr as (select *, ln(mid / lag(mid) over (partition by sym order by sec)) as r, ln(mid / lag(mid, 10) over (partition by sym order by sec)) as r10 from mg), x as (select sym, sec, {cols} from rr) select sym, sec // 1440 as day, {out} from x group by 1, 2"


BOOK_DYNAMICS = FEEDS + f", c as (select sym, t, mid, lag(mid) over (partition by sym order by t, seq) as p from bbo), ch as (select sym, t from c where p is not null and p <> mid), a as (select tr.trade_id, (tr.t - ch.t) / {US}.0::double as age from trades tr asof left join ch on tr.sym = ch.sym and tr.t >= ch.t), n as (select tr.trade_id, count(ch.t) as n from trades tr left join ch on ch.sym = tr.sym and ch.t > tr.t - {30 * US} and ch.t <= tr.t group by 1) select a.trade_id, {rd('age')} as book_age_s, {rd('n / 30.0::double')} as book_chg_rate_30s from a join n on a.trade_id = n.trade_id"
XEXCH = FEEDS + " select tr.trade_id, " + ", ".join(f"{rd(f'b{w}.net - a{w}.net')} as press_{w}, {rd(f'tr.s * (b{w}.net - a{w}.net)')} as align_{w}" for w in (30, 300)) + " from trades tr " + " ".join(f"join {_wins(v, w)} {p}{w} on tr.trade_id = {p}{w}.trade_id" for p, v in (("a", "binance"), ("b", "bybit")) for w in (30, 300))


def _breaks(x: str, n: int, by: str = "sym", source: str = "rule", where: str = "true") -> str:
    points = ", ".join(str(k / n) for k in range(1, n))
    return f"(select {by}, list_distinct(quantile_cont({x}, [{points}])) as breaks from {source} where {x} is not null and {where} group by {by})"


def conditional(n: int) -> str:
    return _rule() + f", b as (select r.*, len(list_filter(q.breaks, lambda z: z < r.score)) as bucket from rule r join {_breaks('score', n)} q on r.sym = q.sym) select sym, cast(bucket as bigint) as bucket, {rd('min(score)')} as lo, {rd('max(score)')} as hi, {rd('sum(w * pnl_30) / sum(case when pnl_30 is not null then w end)')} as wpnl, count(*) as n from b group by sym, bucket"


CALIBRATION = _rule() + f", b as (select r.*, len(list_filter(q.breaks, lambda z: z < r.score)) as bucket from rule r join {_breaks('score', 10, where='pnl_120 is not null')} q on r.sym = q.sym where pnl_120 is not null) select sym, cast(bucket as bigint) as bucket, {rd('avg(score)')} as mean_score, {rd('sum(w * pnl_120) / sum(w)')} as wpnl, count(*) as n from b group by sym, bucket"
REGIME = _rule() + f", r2 as (select *, strftime(make_timestamp(t), '%Y-%m') as month from rule), b as (select r.*, len(list_filter(q.breaks, lambda z: z < r.score)) as bucket from r2 r join {_breaks('score', 5, 'sym, month', 'r2')} q on r.sym = q.sym and r.month = q.month), bm as (select sym, month, bucket, sum(w * pnl_30) / sum(case when pnl_30 is not null then w end) as wp from b group by all), ed as (select sym, month, max(case when bucket = 4 then wp end) - max(case when bucket = 0 then wp end) as edge from bm group by all) select r2.sym, r2.month, count(*) as n, {rd('median(notional)')} as median_vol, {rd('sum(w * pnl_30) / sum(case when pnl_30 is not null then w end)')} as pnl_all_30, {rd('any_value(edge)')} as edge_30 from r2 join ed on r2.sym = ed.sym and r2.month = ed.month group by r2.sym, r2.month"
_COV = "sum(w * x * y) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * y) / sum(w))"
KEEP_BEST = _rule() + f", tr0 as (select sym, score as x, pnl_30 as y, w from rule where split = 'train'), d as (select sym, case when {_COV} >= 0 then 1 else -1 end as direction from tr0 where y is not null group by sym), c as (select tr0.sym, d.direction, quantile_cont(d.direction * x, 0.5) as cut from tr0 join d on tr0.sym = d.sym group by 1, 2), v as (select r.sym, t, w, pnl_30 as pnl, case when c.direction * score < c.cut then 1 else 0 end as f from rule r join c on r.sym = c.sym where split = 'val'), m as ({_metrics('sym', 'v')}) select m.sym, c.direction, {rd('c.cut')} as cut, {_round('pnl_all pnl_kept score')}, n from m join c on m.sym = c.sym"
THRESHOLD_CURVE = _rule() + f", k as (select * from rule where pnl_30 is not null), q as (select sym, unnest(list_distinct(quantile_cont(score, [{', '.join(str(i / 50) for i in range(50))}]))) as thr from k group by sym), v as (select k.sym, q.thr, t, w, pnl_30 as pnl, case when score < thr then 1 else 0 end as f from k join q on k.sym = q.sym), m as ({_metrics('sym, thr', 'v')}) select sym, {_round('thr pnl_kept score frac_w')}, n from m"


def _cv(where: str = "true", tau: int = 30) -> str:
    """CTEs ending in ``best``: sym, thr, cv of the purged threshold search over the rows of the rule."""
    return f"""k as (select sym, t, w, pnl_{tau} as pnl, score, row_number() over (partition by sym order by t, seq) - 1 as i, count(*) over (partition by sym) as n from rule where pnl_{tau} is not null and {where}),
 bl as (select *, {' + '.join(f'case when i >= floor(n * {j} / 5.0) then 1 else 0 end' for j in range(1, 5))} as blk from k),
 en as (select *, min(t) over (partition by sym, blk) as t0, max(t) over (partition by sym, blk) as t1 from bl),
 pu as (select * from en where (blk = 0 or t - t0 >= {300 * US}) and (blk = 4 or t1 - t >= {300 * US})),
 cu as (select sym, unnest(list_distinct(quantile_cont(score, [{', '.join(str(j * 0.99 / 59) for j in range(60))}]))) as thr from k group by sym),
 gr as (select pu.sym, cu.thr, blk, count(*) as nb, greatest(count(distinct t // {DAY}), 1) as days, sum(w) as sw, sum(w * pnl) as swp, sum(case when score >= thr then w end) as kw, sum(case when score >= thr then w * pnl end) as kwp, count(case when score >= thr then 1 end) as nk from pu join cu on pu.sym = cu.sym group by 1, 2, 3),
 sc as (select sym, thr, avg(kwp / kw - swp / sw) as cv, min(case when kw / days >= 500000 and nk / nb >= 0.05 and kw > 0 then 1 else 0 end) as ok from gr group by 1, 2),
 rk as (select sym, thr, case when ok = 1 then cv else '-infinity'::double end as cv, row_number() over (partition by sym order by case when ok = 1 then cv else '-infinity'::double end desc, thr) as rn from sc),
 best as (select sym, thr, cv from rk where rn = 1)"""


THRESHOLD_CV = _rule() + ", " + _cv() + f" select sym, {rd('thr')} as thr, {rd('cv')} as cv from best"
_BARS = ", bars as (select sym, t // 60000000 as minute, count(*) as n, sum(amount) as amount, sum(notional) as notional, count(case when side = 'buy' then 1 end) as buy_n, coalesce(sum(case when side = 'buy' then notional end), 0) as buy_notional, arg_min(price, t) as px_first, arg_max(price, t) as px_last, min(price) as px_min, max(price) as px_max from trades group by 1, 2)"
MINUTE_TRADES = FEEDS + _BARS + f" select sym, minute, n, buy_n, {_round('amount notional buy_notional px_first px_last px_min px_max')} from bars"
MINUTE_BBO = FEEDS + f", b as (select sym, t // 60000000 as minute, count(*) as n, count(case when bid_price >= ask_price then 1 end) as crossed, count(case when bid_price = ask_price then 1 end) as locked, arg_min(mid, t) as mid_first, arg_max(mid, t) as mid_last, min(mid) as mid_min, max(mid) as mid_max, avg(spread) as spread, avg(spread / mid) as rel_spread, avg(bid_amount) as bid_amount, avg(ask_amount) as ask_amount from bbo group by 1, 2) select sym, minute, n, crossed, locked, {_round('mid_first mid_last mid_min mid_max spread rel_spread bid_amount ask_amount', 6)} from b"
LOG_HIST = FEEDS + f", h as (select sym, cast(floor(log10(notional) * 10) as bigint) as bin, count(*) as n from trades where notional > 0 group by 1, 2) select sym, bin, n, {rd('pow(10.0::double, bin / 10.0::double)')} as bin_lo, {rd('pow(10.0::double, (bin + 1) / 10.0::double)')} as bin_hi from h"
SPREAD_HIST = FEEDS + " select sym, cast(floor(greatest(0.0::double, least(spread / mid * 1e4::double, 50.0::double)) * 10 + 0.5::double) as bigint) as bin, count(*) as n from bbo group by 1, 2"
STATS = FEEDS + f" select sym, count(*) as n, {rd('avg(notional)')} as mean, {rd('stddev_samp(notional)')} as std, {rd('min(notional)')} as lo, {rd('max(notional)')} as hi, {rd('sum(case when notional > 100000 then 1.0::double else 0.0::double end)')} as capped, min(t) as first_t, max(t) as last_t from trades group by sym"
QUANTILES = FEEDS + ", x as (select *, row_number() over (partition by sym order by t, seq) - 1 as i from trades) select sym, " + ", ".join(f"{rd(f'quantile_cont(notional, {p})')} as q{n}" for p, n in ((0.01, "010"), (0.5, "500"), (0.99, "990"))) + " from x where i % 3 = 0 group by sym"
SAMPLE_TRADES = FEEDS + ", x as (select *, row_number() over (partition by sym order by t, seq) - 1 as i, greatest(1, (select count(*) from trades) // 1000) as step from trades) select trade_id, sym, t, cast(step as bigint) as step from x where i % step = 0"
MISSING_MINUTES = FEEDS + _BARS + ", e as (select sym, min(minute) as a, max(minute) as b from bars group by sym), s as (select sym, unnest(generate_series(a, b)) as minute from e) select s.sym, s.minute // 1440 as day, count(*) as missing, min(s.minute) as first_missing from s left join bars on s.sym = bars.sym and s.minute = bars.minute where bars.minute is null group by 1, 2"
ANOMALIES = FEEDS + ", e as (select sym, venue, t, count(*) as c, count(distinct (side, price, amount)) as d from liq group by 1, 2, 3) select sym, venue, cast(sum(c) as bigint) as n, cast(sum(c - 1) as bigint) as collisions, cast(sum(c - d) as bigint) as duplicates, any_value(backward) as backward from e join (select sym, venue, count(case when t < before then 1 end) as backward from (select *, lag(t) over (partition by sym, venue order by seq) as before from liq) group by 1, 2) using (sym, venue) group by 1, 2"
HOURLY = FEEDS + _BARS + f" select sym, (minute // 60) % 24 as hour, {rd('avg(n)')} as mean_n, {rd('avg(notional)')} as mean_notional from bars group by 1, 2"
DAILY = FEEDS + _BARS + f" select sym, minute // 1440 as day, cast(sum(n) as bigint) as n, {rd('sum(notional)')} as notional, {rd('sum(buy_notional) / sum(notional)')} as buy_frac from bars group by 1, 2"
BURST = FEEDS + _BARS + f" select sym, min(n) as min_n, {rd('median(n)')} as median_n, {rd('quantile_cont(n, 0.99)')} as p99_n, max(n) as max_n from bars group by sym"
DAILY_LIQ = FEEDS + f""" select sym, venue, raw_t // {DAY} as day, count(*) as n, {rd('sum(notional)')} as notional, {rd("avg(case when side = 'buy' then 1.0::double else 0.0::double end)")} as buy_frac from liq group by 1, 2, 3"""
VENUE_CORR = FEEDS + f", p as (select sym, raw_t // 60000000 as minute, sum(case when venue = 'binance' then notional else 0 end) as a, sum(case when venue = 'bybit' then notional else 0 end) as b from liq group by 1, 2), e as (select sym, min(minute) as lo, max(minute) as hi from p group by sym), s as (select sym, unnest(generate_series(lo, hi)) as minute from e), d as (select s.sym, coalesce(a, 0) as a, coalesce(b, 0) as b from s left join p on s.sym = p.sym and s.minute = p.minute) select sym, {rd('corr(ln(1 + a), ln(1 + b))')} as corr, count(*) as minutes from d group by sym"


def _moves(horizons) -> str:
    hs = (0, *horizons)
    return FEEDS + "," + ", ".join(_mid(f"m{h}", "liq", "seq", h) for h in hs) + ", mv as (select l.*, " + ", ".join(f"sgn * (m{h}.m - m0.m) / m0.m * 1e4::double as ret_{h}" for h in horizons) + " from liq l " + " ".join(f"join m{h} on l.seq = m{h}.seq" for h in hs) + ")"


LIQ_MARKOUT = _moves((30, 120, 300)) + ", tl as (" + " union all ".join(f"select venue, sym, side, notional, {h} as h, ret_{h} as ret from mv" for h in (30, 120, 300)) + f") select venue, sym, coalesce(side, 'ALL') as side, cast(h as bigint) as h, count(ret) as n, {rd('sum(notional * ret) / sum(case when ret is not null then notional end)')} as mean_ret from tl group by grouping sets ((venue, sym, side, h), (venue, sym, h))"
IMPACT_BY_SIZE = _moves((30, 120)) + ", tl as (" + " union all ".join(f"select (case when notional >= 2000 then 1 else 0 end) + (case when notional >= 5000 then 1 else 0 end) + (case when notional >= 8000 then 1 else 0 end) as size, {h} as \"offset\", ret_{h} as move from mv" for h in (30, 120)) + f") select cast(size as bigint) as size, cast(\"offset\" as bigint) as \"offset\", count(move) as n, {rd('avg(move)')} as mean from tl group by 1, 2 having count(move) >= 50"


def liq_profile(offsets) -> str:
    values = ", ".join(f"({float(o)}::double, {int(o * US)}::bigint)" for o in offsets)
    return FEEDS + f", offs(o, d) as (values {values}), q as (select seq, venue, sym, side, raw_t, o, raw_t + d as qt from liq cross join offs), " + _mid("m0", "liq", "seq", 0, "raw_t") + f", x as (select q.venue, q.sym, q.side, q.o, ((case when q.qt <= e.last_t then b.mid end) - m0.m) / m0.m * 1e4::double as move from q asof left join bbo b on q.sym = b.sym and q.qt >= b.t left join ends e on q.sym = e.sym join m0 on q.seq = m0.seq) select venue, sym, side, {rd('o')} as \"offset\", count(move) as n, {rd('avg(move)')} as mean, {rd('median(move)')} as median from x group by venue, sym, side, o having count(move) > 0"


def trade_impact(offsets, shown=rd) -> str:
    values = ", ".join(f"({float(o)}::double, {int(o * US)}::bigint)" for o in offsets)
    return FEEDS + f", offs(o, d) as (values {values}), q as (select trade_id, sym, side, s, o, t + d as qt from trades cross join offs), " + _mid("m0", "trades", "trade_id", 0) + f", x as (select q.sym, q.side, q.o, q.s * ((case when q.qt <= e.last_t then b.mid end) - m0.m) / m0.m * 1e4::double as move from q asof left join bbo b on q.sym = b.sym and q.qt >= b.t left join ends e on q.sym = e.sym join m0 on q.trade_id = m0.trade_id) select sym, side, {rd('o')} as \"offset\", count(move) as n, {shown('avg(move)')} as mean from x group by sym, side, o"


def impact_normalised(offsets) -> str:
    return f"select sym, side, \"offset\", {rd('mean / nullif(avg(case when \"offset\" < 0 then mean end) over (partition by sym, side), 0)')} as mean from ({trade_impact(offsets, str)})"


_ORDER = "order by t, seq * 2 + case when venue = 'bybit' then 1 else 0 end"
_CASCADES = f", gp as (select *, t - lag(t) over (partition by sym {_ORDER}) as gap from liq), sn as (select *, sum(case when gap is null or gap > {10 * US} then 1 else 0 end) over (partition by sym {_ORDER} rows unbounded preceding) as sid from gp), cs as (select sym, sid, min(t) as begin_t, max(t) as end_t, count(*) as n, case when sum(sgn) >= 0 then 1 else -1 end as sgn, count(case when side = 'sell' then 1 end) as n_sell from sn group by 1, 2 having count(*) >= 5)"
CASCADES = FEEDS + _CASCADES + " select sym, begin_t, end_t, n, cast(sgn as bigint) as sgn, n_sell from cs"
STREAM_SESSIONS = FEEDS + _CASCADES.replace("having count(*) >= 5", "") + " select sym, begin_t, end_t, n, n_sell from cs"
_VALID = _CASCADES + ", vc as (select c.*, b.mid as m0 from cs c asof left join bbo b on c.sym = b.sym and c.begin_t >= b.t join ends e on c.sym = e.sym where b.mid is not null and c.begin_t <= e.last_t)"
CASCADE_META = FEEDS + _VALID + f", ow as (select sn.sym, sn.sid, least(floor((sn.t - vc.begin_t) / {5 * US}.0::double), 59) as bin, sum(notional) as v from sn join vc on sn.sym = vc.sym and sn.sid = vc.sid where sn.t - vc.begin_t <= {300 * US} group by 1, 2, 3), tp as (select sym, sid, bin, row_number() over (partition by sym, sid order by v desc, bin) as rn from ow) select vc.sym, count(*) as n, {rd('avg(case when sgn < 0 then 1.0::double else 0.0::double end)')} as sell_share, {rd(f'median((end_t - begin_t) / {US}.0::double)')} as median_span, {rd('median(bin * 5 + 2.5::double)')} as median_climax from vc join tp on vc.sym = tp.sym and vc.sid = tp.sid and rn = 1 group by vc.sym"


def around(points, closed: bool) -> str:
    """Figures around cascades at (name, centre, from, to); ``closed``: the last range of notional is closed, and notional is a mean."""
    last = points[-1][0]
    values = ", ".join(f"('{n}', {int(c * US)}::bigint, {lo}, {hi}, {str(closed and n == last).lower()})" for n, c, lo, hi in points)
    mean = " / n" if closed else ""
    return FEEDS + _GRID + _VALID + f""", pt(point, d, lo, hi, cl) as (values {values}),
 q as (select vc.sym, vc.sid, vc.sgn, vc.m0, vc.begin_t, pt.*, vc.begin_t + d as qt, vc.begin_t // {US} as bs from vc cross join pt),
 bk as (select q.*, b.mid, b.spread, b.bid_amount, b.ask_amount, case when q.qt <= e.last_t then q.sgn * (b.mid - q.m0) / q.m0 * 1e4::double end as mv from q asof left join bbo b on q.sym = b.sym and q.qt >= b.t join ends e on q.sym = e.sym),
 ba as (select sym, point, avg(mv) as move, avg(spread / mid * 1e4::double) as spread_bps, avg((bid_amount + ask_amount) * mid) as depth_usd, avg(sgn * (bid_amount - ask_amount) / greatest(bid_amount + ask_amount, 1e-9)) as obi_signed, count(*) as n from bk group by 1, 2),
 fl as (select q.sym, q.point, sum(coalesce(g.cnt, 0) / (q.hi - q.lo)::double) as tr, sum(q.sgn * coalesce(g.signed_vol, 0) / (q.hi - q.lo)) as fl from q left join g on q.sym = g.sym and g.sec >= q.bs + q.lo and g.sec < q.bs + q.hi group by 1, 2),
 ow as (select q.sym, q.point, sum(case when sn.venue = 'binance' then sn.notional end) as binance, sum(case when sn.venue = 'bybit' then sn.notional end) as bybit from q join sn on q.sym = sn.sym and q.sid = sn.sid where sn.t - q.begin_t >= q.lo * {US}::bigint and (sn.t - q.begin_t < q.hi * {US}::bigint or (q.cl and sn.t - q.begin_t = q.hi * {US}::bigint)) group by 1, 2)
 select ba.sym, ba.point, {_round('move spread_bps obi_signed')}, {rd('depth_usd', 2)} as depth_usd, {rd('tr / n')} as trade_rate, {rd('fl / n')} as flow_signed, {rd(f'coalesce(binance, 0){mean}')} as binance, {rd(f'coalesce(bybit, 0){mean}')} as bybit from ba join fl on ba.sym = fl.sym and ba.point = fl.point left join ow on ba.sym = ow.sym and ba.point = ow.point"""


_OVER = "over (partition by mg.sym order by mg.sec rows between 299 preceding and current row)"
_PHASE_FEATURES = _MIDS + f", rx as (select mg.sym, mg.sec, mg.mid, ln(mg.mid / lag(mg.mid) over (partition by mg.sym order by mg.sec)) as r, me.s1 from mg join me on mg.sym = me.sym), gx as (select mg.sym, mg.sec, mg.s1, case when count(r) {_OVER} = 300 then stddev_samp(r) {_OVER} * 1e4::double end as rv_300, case when count(mid) {_OVER} = 300 then (max(mid) {_OVER} - min(mid) {_OVER}) / mid * 1e4::double end as ampl_300 from rx mg)"
PHASE_TAGS = _pnl((120,)) + _CASCADES + f", a as (select p.*, c.begin_t from pnl p asof left join cs c on p.sym = c.sym and p.t >= c.begin_t), b as (select a.*, n.begin_t as next_t from a asof left join cs n on a.sym = n.sym and a.t <= n.begin_t), x as (select *, case when next_t - t <= {30 * US} then 'pre' when t - begin_t >= 0 and t - begin_t < {5 * US} then 'begin' when t - begin_t >= {5 * US} and t - begin_t < {12 * US} then 'middle' when t - begin_t >= {12 * US} and t - begin_t < {30 * US} then 'end' when t - begin_t >= 0 and t - begin_t < {300 * US} then 'after' else 'quiet' end as phase from b) " + _PHASE_FEATURES + f" select x.sym, phase, count(*) as n, {', '.join(f'{rd(f"avg({c})", d)} as {c}' for c, d in (('pnl_120', 4), ('rv_300', 4), ('ampl_300', 4), ('binance_abs_300', 2), ('bybit_abs_300', 2)))} from x left join gx on x.sym = gx.sym and least(x.t // {US}, gx.s1) = gx.sec join (select trade_id, abs as binance_abs_300 from {_wins('binance', 300)}) wa on x.trade_id = wa.trade_id join (select trade_id, abs as bybit_abs_300 from {_wins('bybit', 300)}) wb on x.trade_id = wb.trade_id group by 1, 2"
WCORR = _rule() + f", k as (select sym, split, score as x, pnl_30 as y, w from rule where pnl_30 is not null), z as (select sym, split, {_COV} as c, sqrt(greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)), 0)) as sx, sqrt(greatest(sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) * (sum(w * y) / sum(w)), 0)) as sy from k group by 1, 2) select sym, split, {rd('c / (sx * sy + 1e-12)', 6)} as corr, cast(case when c >= 0 then 1 else -1 end as bigint) as direction from z"
MISSINGNESS = _pnl() + " ".join(f"{'union all' if i else ''} select sym, 'pnl_{t}' as feature, {rd(f'avg(case when pnl_{t} is null then 1.0::double else 0.0::double end)', 6)} as missing from pnl group by sym" for i, t in enumerate((30, 120, 300)))
WF_SUMMARY = _rule() + f", v as (select sym, (t - epoch_us(timestamp '2024-01-01')) // {10 * DAY} as fold, t, w, pnl_30 as pnl, case when score < 0 then 1 else 0 end as f from rule), m as ({_metrics('sym, fold', 'v')}) select sym, {rd('avg(score)')} as mean_score, {rd('stddev_samp(score)')} as std_score, {rd('min(score)')} as min_score, count(*) as n_folds, bool_and(constraint_ok) as all_ok from m group by sym"
TRADES = FEEDS + f" select trade_id, sym, t, side, cast(s as bigint) as s, {_round('price notional w')} from trades"
INVENTORY = FEEDS + f", a as (select 'trades' as feed, sym, t from trades union all select 'bbo', sym, t from bbo union all select venue, sym, raw_t from liq) select feed, sym, count(*) as n, min(t) as first_t, max(t) as last_t, {rd(f'(max(t) - min(t)) / {DAY}.0::double')} as days from a group by 1, 2"


def _edges(name: str, source: str, by: str) -> str:
    on = " and ".join(f"r.{c} = q.{c}" for c in by.split(", "))
    return f"{name}b as (select r.*, len(list_filter(q.breaks, lambda z: z < r.score)) as bucket from {source} r join {_breaks('score', 5, by, source)} q on {on}), {name}m as (select {by}, bucket, sum(w * pnl_120) / sum(case when pnl_120 is not null then w end) as wp from {name}b group by all), {name} as (select {by}, max(case when bucket = 4 then wp end) - max(case when bucket = 0 then wp end) as edge, case when count(wp) = 5 then corr(bucket, wp) end as trend from {name}m group by {by})"


EDGE = _rule() + ", " + _edges("ea", "rule", "sym") + ", tr1 as (select * from rule where split = 'train'), " + _edges("et", "tr1", "sym") + ", mo as (select *, strftime(make_timestamp(t), '%Y-%m') as month from rule), " + _edges("em", "mo", "sym, month") + f" select ea.sym, {rd('any_value(ea.edge)')} as edge, {rd('any_value(ea.trend)')} as trend, count(*) as months, count(case when sign(em.edge) = sign(et.edge) then 1 end) as survived from ea join et on ea.sym = et.sym join em on em.sym = ea.sym group by ea.sym"
RECENCY = FEEDS + f" select sym, t // {DAY} as day, {rd(f'sum(w * exp(-(((select max(t) from trades) - t) / {DAY}.0::double) / 10.0::double))', 2)} as w from trades group by 1, 2"


def _report(tau: int = 30, names: tuple[str, ...] = ("keep_all", "sign", "best_half", "fitted"), keep: float = 0.5) -> str:
    ways = {"keep_all": "0", "sign": "case when r.score < 0 then 1 else 0 end", "best_half": "case when c.direction * r.score < c.cut then 1 else 0 end", "fitted": "case when r.score < b.thr then 1 else 0 end"}
    union = " union all ".join(f"select '{n}' as method, r.sym, r.split, r.t, r.w, r.pnl_{tau} as pnl, {f} as f from rule r join c on r.sym = c.sym join best b on r.sym = b.sym where r.split in ('val', 'test')" for n, f in zip(names, ways.values(), strict=True))
    half = f"tr0 as (select sym, score as x, pnl_{tau} as y, w from rule where split = 'train'), dr as (select sym, case when {_COV} >= 0 then 1 else -1 end as direction from tr0 where y is not null group by sym), c as (select tr0.sym, dr.direction, quantile_cont(dr.direction * x, {1 - keep}) as cut from tr0 join dr on tr0.sym = dr.sym group by 1, 2)"
    cv = _cv("split = 'train'", tau)
    shown = f"{_round('pnl_all pnl_kept score frac_w')}, n, n_days" if tau == 30 and keep == 0.5 else f"{tau}::bigint as tau, {_round('pnl_all pnl_kept score frac_n')}, constraint_ok, n, n_days"
    return _rule() + ", " + half + ", " + cv + f", v as ({union}), m as ({_metrics('method, sym, split', 'v')}) select method, sym, split, {shown} from m"


REPORT = _report()
REPORT_ALL = " union all ".join(f"select * from ({_report(tau, ('keep_all', 'expected_value', 'reference', 'score_max'), 0.1)})" for tau in (30, 120, 300))
MONTHLY = _rule() + f", tall as ({_tall('rule', cols="sym, strftime(make_timestamp(t), '%Y-%m') as month, t, w, case when score < 0 then 1 else 0 end as f")}), m as ({_metrics('sym, month, tau', 'tall')}) select sym, month, tau::bigint as tau, {_round('pnl_all pnl_kept score frac_n')}, n, n_days from m"


def walk_forward(days: tuple[int, ...]) -> str:
    """Folds that train up to a day, less the embargo, and test on the ten days from it."""
    first, parts = "epoch_us(timestamp '2024-01-01')", []
    for i, d in enumerate(days):
        for tau in (30, 300):
            inside = f"t >= {first} + {d * DAY}::bigint and t < {first} + {(d + 10) * DAY}::bigint"
            one = _rule() + ", " + _cv(f"t >= {first} and t < {first} + {d * DAY - 300 * US}::bigint", tau) + f", v as (select r.sym, r.t, r.w, r.pnl_{tau} as pnl, case when r.score < coalesce(b.thr, 0) then 1 else 0 end as f from rule r left join best b on r.sym = b.sym where {inside}), m as ({_metrics('sym', 'v')}) select 'rule' as spec, sym, {tau}::bigint as tau, {i}::bigint as fold, {_round('pnl_all pnl_kept score frac_n')}, n, n_days from m"
            parts.append(f"select * from ({one})")
    return " union all ".join(parts)


MUTUAL = _rule() + f", kn as (select * from rule where pnl_30 is not null), c as (select r.sym, len(list_filter(qa.breaks, lambda z: z < r.score)) as a, len(list_filter(qb.breaks, lambda z: z < r.pnl_30)) as b, count(*)::double as n from kn r join {_breaks('score', 10, source='kn')} qa on r.sym = qa.sym join {_breaks('pnl_30', 10, source='kn')} qb on r.sym = qb.sym group by 1, 2, 3), s as (select *, sum(n) over (partition by sym) as al, sum(n) over (partition by sym, a) as la, sum(n) over (partition by sym, b) as lb from c) select sym, {rd('sum(n / al * ln(n * al / (la * lb)))')} as mi from s group by sym"
