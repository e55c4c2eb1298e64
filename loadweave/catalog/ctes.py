"""SQL fragments that the oracle texts are assembled from."""

from __future__ import annotations

from collections.abc import Mapping

from loadweave.config import CITIES, POPULATION
from loadweave.sources.adapters import STATION_EVENTS, rebased_population

FOLD_ROWS = [(i + 1, 1997 + i) for i in range(4)]
TRAIN_END = "2000-12-25 06:00:00"
TEST_START = "2001-01-01 06:00:00"


def local(ts: str) -> str:
    return f"timezone('America/Chicago', timezone('UTC', {ts}))"


def population_case(year: str, city: str, anchors: Mapping[int, Mapping[str, int]]) -> str:
    ys = sorted(anchors)
    whens = [f"when {year} <= {ys[0]} then {float(anchors[ys[0]][city])}"]
    for a, b in zip(ys, ys[1:]):
        slope = (anchors[b][city] - anchors[a][city]) / (b - a)
        whens.append(f"when {year} < {b} then {slope!r} * ({year} - {a}) + {float(anchors[a][city])}")
    return f"(case {' '.join(whens)} else {float(anchors[ys[-1]][city])} end)"


def weight(year: str, city: str, anchors: Mapping[int, Mapping[str, int]] = POPULATION) -> str:
    total = " + ".join(population_case(year, c, anchors) for c in CITIES)
    return f"({population_case(year, city, anchors)} / ({total}))"


CENTS = "cast(round(value * 100) as bigint)"
_CITY = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATION_EVENTS.items()) + " end"
_KINDS = ", ".join(f"'{k}'" for k in STATION_EVENTS)

FRAGMENTS: dict[str, str] = {
    "hl": f"""select event_type as series_id, date_trunc('hour', ts) as timestamp,
        sum({CENTS})::double / 100.0 as actual_load_mw from events group by 1, 2""",
    "ml": f"""select cast(user_id as varchar) as series_id, date_trunc('hour', ts) as timestamp,
        sum({CENTS})::double / 100.0 as actual_load_mw from events group by 1, 2""",
    "sys": f"""select 'system' as series_id, date_trunc('hour', ts) as timestamp,
        sum({CENTS})::double / 100.0 as actual_load_mw from events group by 1, 2""",
    "sw": f"""select date_trunc('hour', ts) as timestamp, {_CITY} as city,
        sum({CENTS})::double / count(*) / 200.0 - 5.0 as temp_c,
        sum(cast(json_extract_string(props, '$.k') as bigint))::double / count(*) as humidity_pct,
        sum(greatest({CENTS} - 10000, 0))::double / count(*) / 100.0 as precip_mm
        from events where event_type in ({_KINDS}) group by 1, 2""",
    "wide": "select a.timestamp, " + ", ".join(
        f"{t}.{f} as {f}_{c}" for t, c in zip("abcd", CITIES) for f in ("temp_c", "humidity_pct", "precip_mm"))
        + f" from (select * from sw where city = '{CITIES[0]}') a" + "".join(
            f" join (select * from sw where city = '{c}') {t} on {t}.timestamp = a.timestamp"
            for t, c in zip("bcd", CITIES[1:])),
    "ww": "select timestamp, " + ", ".join(
        " + ".join(f"{f}_{c} * {weight('year(timestamp)', c)}" for c in CITIES) + f" as {f}"
        for f in ("temp_c", "humidity_pct", "precip_mm")) + " from wide",
    "wx": f"""select ww.*, max(temp_c) over d as tmax, min(temp_c) over d as tmin, avg(temp_c) over d as tavg
        from ww window d as (partition by cast({local('timestamp')} as date))""",
    "hj": f"""select series_id, hl.timestamp, {local('hl.timestamp')} as timestamp_central, actual_load_mw,
        temp_c, humidity_pct, precip_mm, tmax, tmin, tavg from hl join wx on hl.timestamp = wx.timestamp""",
    "dl": """select o_orderpriority as series_id, o_orderdate as timestamp,
        sum(cast(round(o_totalprice * 100) as bigint))::double / 100.0 as actual_load_mw from orders group by 1, 2""",
    "dwp": """select l_shipdate as timestamp, l_returnflag, count(*) as n, sum(cast(l_quantity as bigint)) as q,
        sum(case when l_linestatus = 'O' then cast(l_quantity as bigint) end) as q_o,
        count(*) filter (where l_linestatus = 'O') as n_o,
        sum(cast(round(l_tax * 100) as bigint)) as tax, sum(cast(round(l_discount * 100) as bigint)) as disc
        from lineitem group by 1, 2""",
    "dw": """select timestamp, sum(q_o)::double / nullif(sum(n_o), 0)::double as temp_c,
        sum(tax)::double * 10.0 / sum(n)::double as humidity_pct, sum(disc)::double / sum(n)::double as precip_mm,
        max(q::double / n::double) as tmax, min(q::double / n::double) as tmin,
        sum(q)::double / sum(n)::double as tavg from dwp group by 1""",
    "dj": f"""select series_id, dl.timestamp, {local('dl.timestamp')} as timestamp_central, actual_load_mw,
        temp_c, humidity_pct, precip_mm, tmax, tmin, tavg from dl join dw on dl.timestamp = dw.timestamp""",
    "yrs": "select y from range(1990, 2031) t(y)",
    "hol": """select case isodow(d) when 6 then d - 1 when 7 then d + 1 else d end as holiday_date, nm as holiday_name
        from (select make_date(y::int, m, dd) as d, nm, since from yrs, (values
            (1, 1, 'New Year''s Day', date '1900-01-01'),
            (6, 19, 'Juneteenth National Independence Day', date '2021-06-18'),
            (7, 4, 'Independence Day', date '1900-01-01'),
            (11, 11, 'Veterans Day', date '1900-01-01'),
            (12, 25, 'Christmas Day', date '1900-01-01')) v(m, dd, nm, since)) where d >= since
        union all
        select (f + ((wd - isodow(f) + 7) % 7)::int)::date, nm
        from (select make_date(y::int, m, dd) as f, wd, nm from yrs, (values
            (1, 15, 1, 'Birthday of Martin Luther King, Jr.'),
            (2, 15, 1, 'Washington''s Birthday'),
            (5, 25, 1, 'Memorial Day'),
            (9, 1, 1, 'Labor Day'),
            (10, 8, 1, 'Columbus Day'),
            (11, 22, 4, 'Thanksgiving Day')) v(m, dd, wd, nm))""",
}


def _core(src: str, unit: str, short: int, long: int) -> dict[str, str]:
    cal = "timestamp_central"
    return {
        f"{src}lag": f"""select j.*, a.actual_load_mw as load_lag_24, b.actual_load_mw as load_lag_168 from {src} j
            left join {src} a on a.series_id = j.series_id and a.timestamp = j.timestamp - interval {short} {unit}
            left join {src} b on b.series_id = j.series_id and b.timestamp = j.timestamp - interval {long} {unit}""",
        f"{src}span": f"select series_id, min({cal}) as a, max({cal}) as z from {src} group by 1",
        f"{src}core": f"""select c.series_id, timestamp, {cal}, actual_load_mw, temp_c, humidity_pct, precip_mm,
            tmax, tmin, tavg, cast(hour({cal}) as int) as hour, cast(isodow({cal}) - 1 as int) as dayofweek,
            cast(month({cal}) as int) as month, cast(isodow({cal}) in (6, 7) as int) as is_weekend,
            cast(h.holiday_date is not null as int) as is_holiday, load_lag_24, load_lag_168
            from {src}lag c join {src}span s on s.series_id = c.series_id
            left join hol h on h.holiday_date = cast({cal} as date)
                and cast(h.holiday_date as timestamp) between s.a and s.z
            where actual_load_mw is not null and load_lag_24 is not null and load_lag_168 is not null""",
    }


FRAGMENTS |= _core("hj", "hour", 24, 168)
FRAGMENTS |= _core("dj", "day", 1, 7)


def _base(src: str, window: int, minimum: int, back: int) -> str:
    return f"""select * from (select *,
        (epoch_us(timestamp) - min(epoch_us(timestamp)) over (partition by series_id))::double / 1e6 / 31536000.0
            as trend_idx,
        hour * temp_c as hour_x_temp,
        case when count(temp_c) over w >= {minimum} then stddev_samp(temp_c) over w end as temp_c_roll_std_72,
        temp_c - lag(temp_c, {back}) over (partition by series_id order by timestamp) as temp_change_vs_lag24
        from {src} window w as (partition by series_id order by timestamp
            rows between {window - 1} preceding and current row))"""


FRAGMENTS["dall"] = _base("djcore", 28, 7, 1)
FRAGMENTS["dbase"] = "select * from dall where temp_c_roll_std_72 is not null and temp_change_vs_lag24 is not null"
FRAGMENTS["tspan"] = f"""select series_id, min(timestamp_central) as a, max(timestamp_central) as z
    from dbase where timestamp <= timestamp '{TRAIN_END}' group by 1"""
FRAGMENTS["dnamed"] = """select b.*, h.holiday_name from dbase b left join tspan s on s.series_id = b.series_id
    left join hol h on h.holiday_date = cast(timestamp_central as date)
        and cast(h.holiday_date as timestamp) between s.a and s.z"""
FRAGMENTS["dtrain"] = f"select * from dnamed where timestamp <= timestamp '{TRAIN_END}'"
FRAGMENTS["dtest"] = f"select * from dnamed where timestamp >= timestamp '{TEST_START}'"
FRAGMENTS["folds"] = "select * from (values " + ", ".join(
    f"({i}, timestamp '1995-01-01', timestamp '{y - 1}-12-24', timestamp '{y}-01-01', timestamp '{y}-12-31')"
    for i, y in FOLD_ROWS) + ") f(fold_id, tr_start, tr_end, val_start, val_end)"
FRAGMENTS["ftrain"] = "select t.*, fold_id from dtrain t join folds on timestamp between tr_start and tr_end"
FRAGMENTS["fval"] = "select t.*, fold_id from dtrain t join folds on timestamp between val_start and val_end"
FRAGMENTS["fthr"] = """select series_id, fold_id, quantile_cont(tmax, 0.95) as heat, quantile_cont(tmin, 0.05) as cold,
    quantile_cont(precip_mm, 0.95) as precip from ftrain group by 1, 2"""
FRAGMENTS["ftrend"] = """select series_id, fold_id, regr_slope(actual_load_mw, trend_idx) as slope,
    regr_intercept(actual_load_mw, trend_idx) as intercept from ftrain group by 1, 2"""
FRAGMENTS["fmean"] = "select series_id, fold_id, avg(actual_load_mw) as mean_load from ftrain group by 1, 2"
FRAGMENTS["oof"] = """select v.series_id, timestamp, m.model, v.fold_id, actual_load_mw as y_true,
    case m.model when 'constant' then mean_load when 'persistence' then load_lag_24
        else slope * trend_idx + intercept end as y_pred
    from fval v join fmean a on a.series_id = v.series_id and a.fold_id = v.fold_id
    join ftrend t on t.series_id = v.series_id and t.fold_id = v.fold_id,
    (values ('constant'), ('persistence'), ('trend')) m(model)"""
FRAGMENTS["oofw"] = """select series_id, timestamp, max(y_true) as y_true,
    max(y_pred) filter (where model = 'constant') as constant,
    max(y_pred) filter (where model = 'persistence') as persistence,
    max(y_pred) filter (where model = 'trend') as trend from oof group by 1, 2"""
FRAGMENTS["dstate"] = """select series_id, regr_slope(actual_load_mw, trend_idx) as slope,
    regr_intercept(actual_load_mw, trend_idx) as intercept, quantile_cont(tmax, 0.95) as heat,
    quantile_cont(tmin, 0.05) as cold, quantile_cont(precip_mm, 0.95) as precip from dtrain group by 1"""
FRAGMENTS["dorigin"] = "select series_id, min(timestamp) as origin from djcore group by 1"
FRAGMENTS["dfreq"] = """select series_id, holiday_name, count(*)::double / sum(count(*)) over (partition by series_id)
    as holiday_freq from dtrain where holiday_name is not null group by 1, 2"""
FRAGMENTS["eng"] = """select t.series_id, t.timestamp as target_timestamp, temp_c, humidity_pct, precip_mm, tmax, tmin, tavg,
    hour, dayofweek, month, is_weekend, is_holiday, load_lag_24, load_lag_168, hour_x_temp, temp_c_roll_std_72,
    coalesce(cast(tmax > heat as int), 0) as is_extreme_heat_event,
    coalesce(cast(tmin < cold as int), 0) as is_extreme_cold_event,
    is_holiday * greatest(coalesce(cast(tmax > heat as int), 0), coalesce(cast(tmin < cold as int), 0))
        as is_holiday_x_extreme,
    temp_change_vs_lag24, coalesce(cast(precip_mm > precip as int), 0) as is_high_precip_event,
    coalesce(q.holiday_freq, 0.0) as holiday_freq,
    (epoch_us(t.timestamp) - epoch_us(origin))::double / 1e6 / 31536000.0 as trend_idx, slope, intercept
    from dtest t join dstate s on s.series_id = t.series_id join dorigin o on o.series_id = t.series_id
    left join hol h on h.holiday_date = cast(t.timestamp_central as date)
    left join dfreq q on q.series_id = t.series_id and q.holiday_name = h.holiday_name"""

_ORDER = list(FRAGMENTS)
_USES: dict[str, list[str]] = {}


def _needs(name: str) -> list[str]:
    import re
    if name not in _USES:
        words = set(re.findall(r"[a-z_]+", FRAGMENTS[name]))
        _USES[name] = [f for f in _ORDER if f != name and f in words and re.search(rf"(from|join|,)\s+{f}\b", FRAGMENTS[name])]
    return _USES[name]


def sql(body: str, *sources: str) -> str:
    """``with`` clause holding the named fragments and what they need, then the body."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for n in _needs(name):
                add(n)

    for s in sources:
        add(s)
    ctes = ", ".join(f"{n} as ({FRAGMENTS[n]})" for n in _ORDER if n in wanted)
    return f"with {ctes} {body}" if ctes else body


REBASED = rebased_population()

