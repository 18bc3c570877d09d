"""SQL twins of the engine's tables, as named common table expressions that a query draws on."""

from __future__ import annotations

from tickloom.config import GIVEN as G
from tickloom.config import HOURLY as S
from tickloom.config import SIGNALS

D = S.detect
_IS = (S.is_end_ms - S.start_ms) // S.bar_ms + 1
_T = [
    ("trades", """select 'SYN' as symbol, event_id as agg_trade_id, 1000.0 + cast(json_extract(props, '$.k') as double) as price, value as quantity,
      (epoch_us(ts) // 1000) as transact_time, (user_id % 2 = 1) as is_buyer_maker from events"""),
    ("keyed", f"""select *, transact_time - transact_time % {S.bar_ms} as bar_ts_ms, cast(floor(price / {S.delta}) as bigint) as level,
      case when not is_buyer_maker then quantity else 0.0 end as bought, case when is_buyer_maker then quantity else 0.0 end as sold,
      transact_time // 86400000 as day from trades"""),
    ("partial_bars", """select symbol, bar_ts_ms, arg_min(price, (transact_time, agg_trade_id)) as open, max(price) as high, min(price) as low,
      arg_max(price, (transact_time, agg_trade_id)) as close, sum(quantity) as volume, sum(bought) - sum(sold) as delta, count(*) as trade_count
      from keyed group by symbol, bar_ts_ms"""),
    ("grid", f"select 'SYN' as symbol, i as bar_index, {S.start_ms} + i * {S.bar_ms} as bar_ts_ms from range({S.n_bars}) t(i)"),
    ("filled", """select g.symbol, g.bar_index, g.bar_ts_ms, p.open, p.high, p.low, p.volume, p.delta, p.trade_count,
      last_value(p.close ignore nulls) over (order by g.bar_index rows between unbounded preceding and current row) as close
      from grid g left join partial_bars p on g.symbol = p.symbol and g.bar_ts_ms = p.bar_ts_ms"""),
    ("bars", """select symbol, bar_index, make_timestamp(bar_ts_ms * 1000) as bar_ts, bar_ts_ms, coalesce(open, close) as open, coalesce(high, close) as high,
      coalesce(low, close) as low, close, coalesce(volume, 0.0) as volume, coalesce(delta, 0.0) as delta, coalesce(trade_count, 0) as trade_count,
      sum(coalesce(delta, 0.0)) over (order by bar_index rows between unbounded preceding and current row) as cumulative_delta from filled"""),
    ("buckets", f"""select symbol, (bar_ts_ms - {S.start_ms}) // {S.bar_ms} as bar_index, bar_ts_ms, level, level * {S.delta}::double as bucket_px,
      sum(bought) as buy_vol, sum(sold) as sell_vol, count(*) as trade_count from keyed group by symbol, bar_ts_ms, level"""),
    ("extremes", f"""select *, coalesce(close = case when count(*) over w = {D.high_window} then max(close) over w end, false) as is_high,
      coalesce(close = case when count(*) over w = {D.high_window} then min(close) over w end, false) as is_low from bars
      window w as (order by bar_index rows between {D.high_window - 1} preceding and current row)"""),
    ("cums", f"""select *, case when count(*) over w = {D.cum_window} then sum(delta) over w end as cum from extremes
      window w as (order by bar_index rows between {D.cum_window - 1} preceding and current row)"""),
    ("sigmas", f"""select *, case when count(cum) over w = {D.sigma_window} then stddev_samp(cum) over w end as sigma,
      max(case when is_high then bar_index end) over p as high_index, max(case when is_low then bar_index end) over p as low_index from cums
      window w as (order by bar_index rows between {D.sigma_window} preceding and 1 preceding),
      p as (order by bar_index rows between unbounded preceding and 1 preceding)"""),
    ("diverging", """select s.*, h.cum as cum_high, l.cum as cum_low from sigmas s left join cums h on s.high_index = h.bar_index left join cums l on s.low_index = l.bar_index"""),
    ("h1", f"""select symbol, bar_index, bar_ts, 'H1' as signal, -1 as direction, abs(cum - cum_high) / nullif(sigma, 0) as magnitude from diverging
      where is_high and cum < cum_high - {D.margin} * sigma
      union all select symbol, bar_index, bar_ts, 'H1', 1, abs(cum - cum_low) / nullif(sigma, 0) from diverging where is_low and cum > cum_low + {D.margin} * sigma"""),
    ("pool", f"""select b.bar_index, list_sort(list(k.buy_vol + k.sell_vol)) as v from bars b join buckets k
      on k.bar_index between b.bar_index - {D.volume_window} and b.bar_index - 1 group by b.bar_index"""),
    ("pooled", """select b.*, v[least(floor(len(v) * 0.25), len(v) - 1)::int + 1] as p25, v[least(floor(len(v) * 0.5), len(v) - 1)::int + 1] as p50
      from bars b left join pool using (bar_index)"""),
    ("h2_rows", f"""select k.symbol, k.bar_index, p.bar_ts, k.buy_vol + k.sell_vol as vol, p.p50,
      k.bucket_px <= p.low + {D.edge} * (p.high - p.low) and k.sell_vol >= {D.dominance} * (k.buy_vol + k.sell_vol) and p.close >= k.bucket_px + {S.delta} as bull,
      k.bucket_px >= p.high - {D.edge} * (p.high - p.low) and k.buy_vol >= {D.dominance} * (k.buy_vol + k.sell_vol) and p.close <= k.bucket_px - {S.delta} as bear
      from buckets k join pooled p using (symbol, bar_index) where p.p50 > 0 and k.buy_vol + k.sell_vol >= {D.multiple} * p.p50"""),
    ("h2", """select symbol, bar_index, bar_ts, 'H2' as signal, 1 as direction, max(vol / p50) as magnitude from h2_rows where bull group by all
      union all select symbol, bar_index, bar_ts, 'H2', -1, max(vol / p50) from h2_rows where bear group by all"""),
    ("diagonal", f"""select k.symbol, k.bar_index, p.bar_ts, k.level, k.buy_vol, k.sell_vol, p.p25, b.sell_vol as below, a.buy_vol as above
      from buckets k join pooled p using (symbol, bar_index)
      left join buckets b on b.bar_index = k.bar_index and b.level = k.level - 1 and b.level >= floor(p.low / {S.delta})
      left join buckets a on a.bar_index = k.bar_index and a.level = k.level + 1 and a.level <= floor(p.high / {S.delta})
      where p.p25 > 0 and floor(p.high / {S.delta}) > floor(p.low / {S.delta}) and k.level between floor(p.low / {S.delta}) and floor(p.high / {S.delta})"""),
    ("ratios", f"""select symbol, bar_index, bar_ts, 1 as direction, level, buy_vol / below as ratio from diagonal where below >= p25 and below > 0 and buy_vol / below >= {D.ratio}
      union all select symbol, bar_index, bar_ts, -1, level, sell_vol / above from diagonal where above >= p25 and above > 0 and sell_vol / above >= {D.ratio}"""),
    ("islands", """select *, level - row_number() over (partition by bar_index, direction order by level) as island from ratios"""),
    ("runs", f"""select symbol, bar_index, bar_ts, direction, island, count(*) as n, avg(ratio) as mean, sum(ratio) as total from islands group by all having count(*) >= {D.stack}"""),
    ("h3", """select symbol, bar_index, bar_ts, 'H3' as signal, direction, arg_max(total, (n, mean)) as magnitude from runs group by symbol, bar_index, bar_ts, direction"""),
    ("climaxes", f"""select *, case when count(*) over w = {D.climax_window} then list_sort(list(volume) over w)[{int((D.climax_window - 1) * D.climax_quantile + 0.5) + 1}] end as climax from extremes
      window w as (order by bar_index rows between {D.climax_window} preceding and 1 preceding)"""),
    ("ends", """select c.symbol, c.bar_index, c.bar_ts, c.volume, c.climax, c.is_high, c.is_low, k.buy_vol - k.sell_vol as lean,
      row_number() over (partition by c.bar_index order by k.level desc) as top, row_number() over (partition by c.bar_index order by k.level) as bottom
      from climaxes c join buckets k using (symbol, bar_index) where c.climax > 0 and c.volume >= c.climax and (c.is_high or c.is_low)"""),
    ("leans", """select symbol, bar_index, bar_ts, volume, climax, is_high, is_low, sum(lean) filter (top <= 2) as top2, sum(lean) filter (bottom <= 2) as bottom2 from ends group by all"""),
    ("h6", """select symbol, bar_index, bar_ts, 'H6' as signal, -1 as direction, volume / climax * abs(top2) as magnitude from leans where is_high and top2 < 0
      union all select symbol, bar_index, bar_ts, 'H6', 1, volume / climax * abs(bottom2) from leans where is_low and bottom2 > 0"""),
    ("raw_events", "select * from h1 union all select * from h2 union all select * from h3 union all select * from h6"),
    ("windows", f"select 'SYN' as symbol, {S.start_ms} + i * 86400000 * 5 + 1800000 as start_ms, {S.start_ms} + i * 86400000 * 5 + 9000000 as end_ms from range(6) t(i)"),
    ("clear_events", f"""select * from raw_events e where not exists (select 1 from windows w where w.symbol = e.symbol
      and epoch_ms(e.bar_ts) < w.end_ms and epoch_ms(e.bar_ts) + {S.bar_ms} > w.start_ms)"""),
    ("warm_events", f"select * from clear_events where bar_index >= {S.warmup}"),
    ("keeping", f"""select symbol, signal, direction, min(bar_index) as bar_index from warm_events group by symbol, signal, direction
      union all select k.symbol, k.signal, k.direction, (select min(e.bar_index) from warm_events e where e.symbol = k.symbol and e.signal = k.signal and e.direction = k.direction and e.bar_index - k.bar_index > {S.gap})
      from keeping k where k.bar_index is not null"""),
    ("events_kept", "select e.* from warm_events e join keeping k using (symbol, signal, direction, bar_index)"),
    ("aheads", "select symbol, bar_index, " + ", ".join(f"ln(lead(open, {1 + h}) over w / lead(open, 1) over w) as f_{h}" for h in S.horizons) + f", lead(bar_ts_ms, {1 + max(S.horizons)}) over w as last_ms from bars window w as (order by bar_index)"),
    ("returned", "select e.*, " + ", ".join(f"e.direction * a.f_{h} as r_{h}" for h in S.horizons) + f""",
      case when epoch_ms(e.bar_ts) <= {S.is_end_ms} then 'IS' else 'OOS' end as segment,
      coalesce(a.last_ms is not null and (epoch_ms(e.bar_ts) <= {S.is_end_ms}) = (a.last_ms <= {S.is_end_ms}), false) as purge_ok
      from events_kept e join aheads a using (symbol, bar_index)"""),
    ("nulled", "select symbol, bar_index, bar_ts, signal, direction, magnitude, segment, purge_ok, " + ", ".join(f"""case when not exists (select 1 from windows w where w.symbol = r.symbol
      and {S.start_ms} + (r.bar_index + 1) * {S.bar_ms} < w.end_ms and {S.start_ms} + (r.bar_index + 2 + {h}) * {S.bar_ms} > w.start_ms) then r_{h} end as r_{h}""" for h in S.horizons) + " from returned r"),
    ("long_rows", " union all ".join(f"select symbol, signal, {h} as h, bar_index, bar_ts, epoch_ms(bar_ts) // 86400000 as day, magnitude, r_{h} as r from nulled where segment = 'IS' and purge_ok and r_{h} is not null" for h in S.horizons)),
    ("klines_a", "select day, sum(quantity) as volume from keyed group by day"),
    ("klines", "select day, case when day % 5 = 0 then volume * 1.01 else volume end as volume from klines_a where day % 7 <> 3 union all select 19800, 1.0"),
    ("reconciled", """select coalesce(a.day, b.day) as day, a.volume as a, b.volume as b, case when a.day is null then 'right' when b.day is null then 'left' else 'both' end as side,
      case when a.day is not null and b.day is not null then abs((a.volume - b.volume) / b.volume * 100) end as pct from klines_a a full outer join klines b on a.day = b.day"""),
    ("spearman_ranks", """select *, rank() over (partition by symbol, signal, h order by magnitude) + (count(*) over (partition by symbol, signal, h, magnitude) - 1) / 2.0 as rx,
      rank() over (partition by symbol, signal, h order by r) + (count(*) over (partition by symbol, signal, h, r) - 1) / 2.0 as ry from long_rows"""),
    ("agreements", f"""select symbol, signal, h, greatest(count(*) filter (s > 0), count(*) filter (s < 0)) >= 2 as agree from (
      select symbol, signal, h, case {" ".join(f"when epoch_ms(bar_ts) between {a} and {b} then {i}" for i, (a, b) in enumerate(S.stretches))} end as part, sign(avg(r)) as s from long_rows group by all)
      where part is not null group by symbol, signal, h"""),
    # draws by arithmetic: day `pick` of a cell's days stands at `place` of replicate `rep`
    ("cell_days", """select symbol, signal, h, day, sum(r) as total, count(*) as n, row_number() over (partition by symbol, signal, h order by day) - 1 as i, count(*) over (partition by symbol, signal, h) as days
      from long_rows group by symbol, signal, h, day"""),
    ("draws", f"""select c.symbol, c.signal, c.h, rep, (rep * place * 1103515 + rep * 48271 + place * 69621 + 12345) // 1009 % days as pick
      from (select distinct symbol, signal, h, days from cell_days) c, range({G.reps}) x(rep), range(400) y(place) where place < days"""),
    ("given_stats", "select d.symbol, d.signal, d.h, d.rep, sum(c.total) / sum(c.n) as stat from draws d join cell_days c on d.symbol = c.symbol and d.signal = c.signal and d.h = c.h and d.pick = c.i group by all"),
    ("given_cells", """select m.*, least(1, 2 * least(g.below, g.above)) as p_value, g.ci_low, g.ci_high from (select symbol, signal, h, avg(r) as mean, count(*) as n from long_rows group by symbol, signal, h) m join (
      select symbol, signal, h, avg((stat <= 0)::int) as below, avg((stat >= 0)::int) as above, quantile_cont(stat, 0.025) as ci_low, quantile_cont(stat, 0.975) as ci_high from given_stats group by all) g using (symbol, signal, h)"""),
    ("ic_rows", f"""select d.symbol, d.signal, d.h, d.rep, l.magnitude, l.r from draws d join cell_days c on d.symbol = c.symbol and d.signal = c.signal and d.h = c.h and d.pick = c.i
      join long_rows l on l.symbol = c.symbol and l.signal = c.signal and l.h = c.h and l.day = c.day where d.rep < {G.ic_reps}"""),
    ("ic_ranks", """select *, rank() over (partition by symbol, signal, h, rep order by magnitude) + (count(*) over (partition by symbol, signal, h, rep, magnitude) - 1) / 2.0 as rx,
      rank() over (partition by symbol, signal, h, rep order by r) + (count(*) over (partition by symbol, signal, h, rep, r) - 1) / 2.0 as ry from ic_rows"""),
    ("given_ic_stats", "select symbol, signal, h, rep, case when min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end as stat from ic_ranks group by all"),
    ("given_ics", """select * from (select symbol, signal, h, case when count(*) >= 2 and min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end as ic from spearman_ranks group by all) left join (
      select symbol, signal, h, quantile_cont(stat, 0.025) as ic_low, quantile_cont(stat, 0.975) as ic_high from given_ic_stats where stat is not null group by all) using (symbol, signal, h)"""),
    ("given_ranked", f"""select f.symbol, f.signal, f.h, coalesce(c.n, 0) as n, c.mean, c.p_value, c.ci_low, c.ci_high, i.ic, i.ic_low, i.ic_high, row_number() over (partition by f.symbol order by c.p_value nulls last, f.signal, f.h) as rank,
      count(*) over (partition by f.symbol) as cells from (select distinct symbol, signal, h from (select distinct symbol from given_cells) cross join (select unnest({list(SIGNALS)}) as signal) cross join (select unnest({list(S.horizons)}) as h)) f
      left join given_cells c using (symbol, signal, h) left join given_ics i using (symbol, signal, h)"""),
    ("given_family", f"""select *, abs(p_value - threshold) <= 3 * mc_se as straddle from (select *, rank / cells * {S.q} as threshold, coalesce(rank <= max(case when p_value <= rank / cells * {S.q} then rank end) over (partition by symbol) and p_value is not null, false) as significant,
      (ci_high - ci_low) / 3.92 as se, mean / nullif((ci_high - ci_low) / 3.92, 0) as t, sqrt(p_value * (1 - p_value) / {G.reps}) as mc_se from given_ranked)"""),
    ("given_eligible", f"select f.*, a.agree, significant and h >= {S.material_horizon} as material, significant and h >= {S.material_horizon} and mean * 10000 >= {S.min_bp} as able from given_family f left join agreements a using (symbol, signal, h)"),
    ("given_gates", f"""select symbol, signal, max(n) >= {S.min_events} as g1, count(*) filter (significant) >= 2 and count(*) filter (material) >= 1 as g2, count(*) filter (able) > 0 as g3,
      coalesce(arg_max(agree, (abs(t), h)) filter (able), false) as g4, coalesce(list_sort(list(h) filter (able)), []) as eligible, arg_max(h, (abs(t), h)) filter (able) as h_star from given_eligible group by all"""),
    ("given_significant", "select symbol, coalesce(list_sort(list({'signal': signal, 'h': h}) filter (significant)), []) as significant from given_family group by all"),
    ("shifts", f"""select e.symbol, e.signal, e.direction, rep, (e.bar_index + {S.min_shift} + (rep * 37) % ({_IS} - 2 * {S.min_shift} + 1)) % {_IS} as t
      from nulled e cross join range({G.placebo_reps}) x(rep) where e.segment = 'IS' and e.purge_ok"""),
    ("shifted", f"""select s.*, a.bar_index is not null as ok, {", ".join(f"s.direction * a.f_{h} as r_{h}" for h in S.horizons)} from shifts s left join (select * from aheads where bar_index >= {S.warmup} and bar_index + {1 + max(S.horizons)} < {_IS}
      and not exists (select 1 from windows w where w.symbol = aheads.symbol and {S.start_ms} + bar_index * {S.bar_ms} < w.end_ms and {S.start_ms} + (bar_index + {max(S.horizons) + 2}) * {S.bar_ms} > w.start_ms)) a on a.symbol = s.symbol and a.bar_index = s.t"""),
    ("shift_means", " union all ".join(f"select symbol, signal, {h} as h, rep, avg(r_{h}) as m, avg(ok::int) as admitted from shifted group by all" for h in S.horizons)),
    ("given_placebo", """select s.symbol, s.signal, s.h, o.observed, count(*) filter (abs(m) >= abs(observed)) / nullif(count(m), 0) as placebo_p, count(m) as n_valid, avg(admitted) as mean_admitted
      from shift_means s join (select symbol, signal, h, avg(r) as observed from long_rows group by symbol, signal, h) o using (symbol, signal, h) group by all"""),
]
CTES = dict(_T)


def twin(select: str) -> str:
    """select with every common table expression that it needs, in order."""
    needed: set[str] = set()
    todo = [select]
    names = list(CTES)
    while todo:
        text = todo.pop()
        for n in names:
            if n not in needed and _mentions(text, n):
                needed.add(n)
                todo.append(CTES[n])
    if not needed:
        return select
    return "with recursive " + ",\n".join(f"{n} as ({CTES[n]})" for n in names if n in needed) + "\n" + select


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(from|join)\s+{name}\b", text) is not None
