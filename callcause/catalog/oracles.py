"""SQL that computes the named queries from the raw tables, for a check in another engine.

The statements work on ``k`` directly: they never build or parse the messages the
Spark side decodes, and they use plain whole-key windows and theta joins.
"""

from __future__ import annotations

import re

from callcause import schemas as S

# Fixed values that the profile of the queries uses.
DIGITS, RSRP, SINR, BLER, GAP = 6, -110, 0, 60, 5

_EVENTS = """
ev as (select event_id, ts, user_id as wo, user_id // 2 as dev, event_type, value,
              cast(json_extract(props, '$.k') as bigint) as k
       from events)"""

_PROBES = """
pr as (select dev, wo, ts, event_type, value, k from ev where event_type in ('view', 'click'))"""


def _windows(marker: str) -> str:
    kept = "event_type = 'error'" + (" and k % 2 = 0" if marker == "Traffic Fail" else "")
    return f"""
mk as (select dev, wo, ts, event_type, k, event_id, lag(ts) over (partition by wo order by ts, event_id) as s
       from ev where event_type in ('signup', 'purchase') or ({kept})),
w as (select dev, wo, row_number() over (partition by wo order by ts, event_id) as n,
             case when k % 2 = 0 then 'Data Drop, Traffic Fail' else 'Data Drop' end as typ, s, ts as e
      from mk where {kept})"""


_KEY = 'w.dev as "Device", w.wo as "WorkOrderId", w.n as "Failed_Event_Number"'
_SPAN = ('w.typ as "Failed_Event_Type", w.s as "Event_Analysis_Start_Time", '
         'w.e as "Event_Analysis_End_Time"')

# One row per signalling row: its kind, and the fields a decoded message would give.
_SIGNALLING = """
han as (select *, unnest(case when k % 6 = 0 then [0, 3, 6] else [0] end) as off
        from ev where event_type = 'click' and k % 3 = 0),
raw as (
  select dev, wo, ts as t, k, event_id, value, 'setup' as kind, k % 10 as pci from ev where event_type = 'signup'
  union all select dev, wo, ts, k, event_id, value, 'info', k % 10 from ev where event_type = 'purchase' and k % 2 = 0
  union all select dev, wo, ts, k, event_id, value, 'report', (k + 1) % 10 from ev where event_type = 'view'
  union all select dev, wo, ts + to_seconds(off), k, event_id, value, 'sync', (k + 1) % 10 from han
  union all select dev, wo, ts + to_seconds(off + 1), k, event_id, value, 'complete',
                   case when k % 6 = 0 then k % 10 else (k + 5) % 10 end from han
  union all select dev, wo, ts + to_seconds(off + 2), k, event_id, value, 'sib', k % 10 from han
  union all select dev, wo, ts, k, event_id, value, 'config', (k + 1) % 10 from ev where event_type = 'click' and k % 3 = 1
  union all select dev, wo, ts, k, event_id, value, 'request', (k + 1) % 10 from ev where event_type = 'click' and k % 3 = 2
  union all select dev, wo, ts + interval 1 second, k, event_id, value,
                   case k % 4 when 1 then 'resetup' when 2 then 'reest' else 'setupdone' end, (k + 1) % 10
            from ev where event_type = 'click' and k % 3 = 2 and k % 4 > 0
  union all select dev, wo, ts + interval 2 second, k, event_id, value, 'reestdone', (k + 1) % 10
            from ev where event_type = 'click' and k % 3 = 2 and k % 4 = 2),
sig as (select *,
    case kind when 'setup' then '5GNR rrcSetupRequest'
              when 'report' then '5GNR measurementReport'
              when 'sync' then '5GNR rrcReconfiguration' when 'config' then '5GNR rrcReconfiguration'
              when 'complete' then '5GNR rrcReconfigurationComplete'
              when 'sib' then 'BCCH systemInformationBlockType1'
              when 'request' then '5GNR rrcReestablishmentRequest'
              when 'resetup' then '5GNR rrcSetup' when 'reest' then '5GNR rrcReestablishment'
              when 'reestdone' then '5GNR rrcReestablishmentComplete'
              when 'setupdone' then '5GNR rrcSetupComplete'
              else 'NR5G System Information: PLMN id, MCC : 310 MNC : ' || k || ' ' ||
                   case when k % 4 = 0 then 'T-Mobile' when k % 3 = 0 then 'AT&T' else 'Home' end end as event,
    case when kind = 'report' and k % 4 <> 0 then 'Check1' when kind = 'sync' then 'Check2' end as chk,
    case when kind = 'sync' then k % 10 end as target,
    case when kind = 'sync' then 5000 + k % 2 end as target_freq,
    case when kind = 'config' and k % 2 = 1 then k % 8 end as a3
  from raw),
sigc as (select *, case when kind in ('report', 'sync', 'config')
                        then coalesce(chk, '') || case when chk is not null and a3 is not null then '_' else '' end
                             || coalesce(cast(a3 as varchar), '') end as cls from sig),
sw as (select w.dev, w.wo, w.n, w.s, w.e, g.t, g.k, g.kind, g.event, g.pci, g.chk, g.target, g.a3, g.cls
       from w join sigc g on g.wo = w.wo and g.t between w.s and w.e)"""

_MEASUREMENTS = f"""
ms as (select wo, ts as t, 1000 + k % 3 as ch, k % 4 as pci,
              case when k % 13 <> 0 then -value - 60.0 end as rsrp,
              case when k % 13 <> 0 then cast(k as double) - 20.0 end as sinr
       from ev where event_type in ('view', 'click')),
rf as (select w.dev, w.wo, w.n, w.s, w.e,
              coalesce(string_agg(distinct cast(ch as varchar), ', ' order by cast(ch as varchar)), '') as chs,
              coalesce(string_agg(distinct cast(pci as varchar), ', ' order by cast(pci as varchar)), '') as pcis,
              round(avg(rsrp), {DIGITS}) as rsrp_avg, round(min(rsrp), {DIGITS}) as rsrp_min,
              round(avg(sinr), {DIGITS}) as sinr_avg, round(min(sinr), {DIGITS}) as sinr_min,
              min(case when rsrp < {RSRP} or sinr < {SINR} then t end) as poor_t
       from w left join ms on ms.wo = w.wo and ms.t between w.s and w.e
       group by w.dev, w.wo, w.n, w.s, w.e)"""

_POOR = f"coalesce(rsrp_avg < {RSRP}, false) or coalesce(sinr_avg < {SINR}, false)"
_LOST = "rsrp_avg is null and sinr_avg is null"

_RADIO_OUT = ('chs as "NR5G_PCC_NARFCN", pcis as "NR5G_PCC_PCI", rsrp_avg as "NR5G_PCC_RSRP_Avg", '
              'rsrp_min as "NR5G_PCC_RSRP_Min", sinr_avg as "NR5G_PCC_SINR_Avg", '
              'sinr_min as "NR5G_PCC_SINR_Min"')


def _signal_facts(counts_empty: bool) -> str:
    other = "cls <> 'Check1'" if counts_empty else "cls <> 'Check1' and cls <> ''"
    return f"""
sf as (select dev, wo, n, s, e, count(*) as rows,
              string_agg(distinct substring(event, 35, 37), ', ' order by substring(event, 35, 37))
                filter (where contains(event, 'MCC :')) as codes,
              min(t) filter (where contains(event, 'T-Mobile') or contains(event, 'AT&T')) as roam_t,
              min(t) filter (where chk = 'Check1') as first_report,
              max(t) filter (where cls = 'Check1') as last_report,
              coalesce(bool_or({other}), false) as other,
              min(t) filter (where chk = 'Check2') as first_sync,
              min(t) filter (where kind = 'request') as ask_t,
              bool_or(kind in ('resetup', 'reest')) as answered,
              bool_or(kind in ('reestdone', 'setupdone')) as done
       from sw group by dev, wo, n, s, e)"""


_HANDOVER = """
ho as (select *, lead(pci, 1) over x as p1, lead(pci, 2) over x as p2
       from sw where kind in ('sync', 'config', 'complete', 'sib')
       window x as (partition by wo, n order by t)),
ok as (select distinct dev, wo, n from ho where target = p1 and target = p2)"""

_PINGPONG = f"""
st as (select *, lead(kind, 1) over x as k1, lead(kind, 2) over x as k2
       from sw where kind in ('sync', 'complete', 'sib') window x as (partition by wo, n order by t)),
hs as (select dev, wo, n, t from st where kind = 'sync' and k1 = 'complete' and k2 = 'sib'),
hg as (select *, lead(t, 1) over x as t1, lead(t, 2) over x as t2 from hs
       window x as (partition by wo, n order by t)),
pp as (select distinct dev, wo, n from hg
       where epoch(t1) - epoch(t) <= {GAP} and epoch(t2) - epoch(t1) <= {GAP})"""

_LAST = f"""
lf as (select f.dev, f.wo, f.n, f.last_report, f.first_report, f.other,
              coalesce(string_agg(distinct cast(pci as varchar), ', ' order by cast(pci as varchar)), '') as pcis,
              count(distinct pci) as cells, round(avg(rsrp), {DIGITS}) as rsrp_l, round(avg(sinr), {DIGITS}) as sinr_l,
              avg(rsrp) as rsrp_x, avg(sinr) as sinr_x
       from sf f left join ms on ms.wo = f.wo and ms.t between f.last_report and f.e
       where f.last_report is not null
       group by f.dev, f.wo, f.n, f.last_report, f.first_report, f.other)"""

_POOR_LAST = f"(coalesce(rsrp_l < {RSRP}, false) or coalesce(sinr_l < {SINR}, false))"
_POOR_EXACT = f"(coalesce(rsrp_x < {RSRP}, false) or coalesce(sinr_x < {SINR}, false))"

_RACH = """
ra as (select w.dev, w.wo, w.n, bool_or(k % 3 = 0) as asked, bool_or(k % 3 = 2) as answered,
              bool_or(k % 3 = 1) as neither, min(ts) filter (where k % 3 = 0) as ask_t
       from w join pr on pr.wo = w.wo and pr.ts between w.s and w.e group by w.dev, w.wo, w.n)"""

_BLER = f"""
bl as (select w.dev, w.wo, w.n, round(avg(value), {DIGITS}) as bler,
              min(ts) filter (where value > {BLER}) as bler_t
       from w join pr on pr.wo = w.wo and pr.ts between w.s and w.e
       where k % 9 <> 0 group by w.dev, w.wo, w.n)"""

_CONTEXT_OUT = ('{a}.k % 3 as "NetworkModeId", {a}.k % 7 as "BandId", {a}.k % 5 as "CarrierId", '
                '{a}.k % 4 as "SectorId", {a}.dev as "DeviceId", {a}.k % 11 as "FileId", '
                "'d' || {a}.k as \"DimensionColumnsId\", {a}.k as \"Epoch\", {a}.event_id as \"MsgId\", "
                '{a}.value as "Latitude", -{a}.value as "Longitude"')


def _with(*parts: str) -> str:
    return "with " + ",".join(part.strip("\n") for part in parts)


def _base(marker: str = "Drop") -> str:
    return _with(_EVENTS, _PROBES, _windows(marker))


def _signal(marker: str = "Drop", counts_empty: bool = False) -> str:
    return ",".join([_base(marker), _SIGNALLING, _signal_facts(counts_empty)])


def _plus(base: str, *parts: str) -> str:
    return ",".join([base, *parts])


_ROW_OUT = 'pr.ts as "Time", pr.event_type, pr.value, pr.k'


def _window_rows(how: str, key: str = "wo") -> str:
    return (f"{_base()} select {_KEY}, {_SPAN}, {_ROW_OUT} from w {how} join pr "
            f"on pr.{key} = w.{key} and pr.ts between w.s and w.e")


def _facts(marker: str, counts_empty: bool) -> str:
    return _plus(_signal(marker, counts_empty), _MEASUREMENTS, _HANDOVER, _PINGPONG, _LAST, _RACH, _BLER, f"""
al as (select w.dev, w.wo, w.n, w.typ, w.s, w.e, ev.k, ev.event_id, ev.value,
              rf.chs, rf.pcis, rf.rsrp_avg, rf.rsrp_min, rf.sinr_avg, rf.sinr_min, rf.poor_t,
              sf.rows, sf.codes, sf.roam_t, sf.first_report, sf.last_report, sf.first_sync,
              sf.ask_t, sf.answered, sf.done,
              lf.pcis as pcis_l, lf.rsrp_l, lf.sinr_l, bl.bler, bl.bler_t, ra.ask_t as rach_t,
              ok.n is not null as handed, pp.n is not null as pingpong,
              ({_POOR}) as poor, ({_LOST}) as lost,
              coalesce(ra.asked and ra.neither and not ra.answered, false) as rach,
              coalesce(not lf.other and lf.cells <= 1 and {_POOR_LAST}, false) as stuck,
              coalesce(not lf.other and lf.cells <= 1 and {_POOR_EXACT}, false) as stuck_exact,
              coalesce(bl.bler > {BLER}, false) as high
       from w
       join rf on rf.wo = w.wo and rf.n = w.n
       left join ev on ev.wo = w.wo and ev.ts = w.e
       left join sf on sf.wo = w.wo and sf.n = w.n
       left join lf on lf.wo = w.wo and lf.n = w.n
       left join ok on ok.wo = w.wo and ok.n = w.n
       left join pp on pp.wo = w.wo and pp.n = w.n
       left join ra on ra.wo = w.wo and ra.n = w.n
       left join bl on bl.wo = w.wo and bl.n = w.n)""")


_HEAD = ('n as "Failed_Event_Number", typ as "Failed_Event_Type", s as "Event_Analysis_Start_Time", '
         'e as "Event_Analysis_End_Time", e as "Time", dev as "Device", wo as "WorkOrderId", '
         + _CONTEXT_OUT.format(a="al"))


def _diagnosis_v2(marker: str = "Drop", where: str = "true", counts_empty: bool = False, pingpong: bool = True) -> str:
    tags = [
        ("poor", "poor_t", "Poor RF condition"),
        ("lost", "s", "Lost UE"),
        ("rows is null", "s", "Missing Signalling"),
        ("roam_t is not null", "roam_t", "UE on Roaming"),
        ("stuck and not handed", "first_report", "Handover failure"),
        ("rach", "rach_t", "RACH failure"),
        ("pingpong", "first_sync", "PingPong Handover"),
        ("ask_t is not null and not done", "ask_t", "rrcReestablishment Failure"),
        ("ask_t is not null and answered and done", "ask_t", "rrcReestablishment"),
        ("stuck_exact", "first_report", "Missing neighbor relation"),
        ("high", "bler_t", "High Physical DL BLER"),
    ]
    found = " union all ".join(
        f"select dev, wo, n, {time} as t, {rank} as r, '{tag}' as tag from al where {condition}"
        for rank, (condition, time, tag) in enumerate(tags) if pingpong or condition != "pingpong")
    radio = ", ".join(f'case when poor then {c} end as "{name}"' for c, name in [
        ("chs", "NR5G_PCC_NARFCN"), ("pcis", "NR5G_PCC_PCI"), ("rsrp_avg", "NR5G_PCC_RSRP_Avg"),
        ("rsrp_min", "NR5G_PCC_RSRP_Min"), ("sinr_avg", "NR5G_PCC_SINR_Avg"), ("sinr_min", "NR5G_PCC_SINR_Min")])
    last = ", ".join(f'case when stuck and not handed then {c} end as "{name}"' for c, name in [
        ("pcis_l", "NR5G_PCC_PCI_Last"), ("rsrp_l", "NR5G_PCC_RSRP_Last"), ("sinr_l", "NR5G_PCC_SINR_Last")])
    return _plus(_facts(marker, counts_empty), f"""
tg as ({found}),
an as (select wo as awo, n as an, string_agg(tag, ', ' order by t nulls first, r) as tags from tg group by wo, n)
select {_HEAD}, {radio}, case when roam_t is not null then codes end as "MCC_MNC", {last},
       case when high then bler end as "PHYDL_NR5G_PCC_BLER_Avg",
       coalesce(tags, 'Unidentified') as "Analysis"
from al left join an on an.awo = al.wo and an.an = al.n where {where}""")


def _diagnosis_v1(marker: str = "Drop") -> str:
    last = ", ".join(f'case when not handed then {c} end as "{name}"' for c, name in [
        ("pcis_l", "NR5G_PCC_PCI_Last"), ("rsrp_l", "NR5G_PCC_RSRP_Last"), ("sinr_l", "NR5G_PCC_SINR_Last")])
    tags = ", ".join(f"case when {condition} then '{tag}' end" for condition, tag in [
        ("poor", "Poor RF condition"), ("lost and not poor", "Lost UE"),
        ("roam_t is not null", "UE on Roaming"), ("rows is null", "Missing Signalling"),
        ("stuck and not handed", "Handover failure"), ("rach", "RACH failure"),
        ("pingpong", "Ping_Pong Handover"),
        ("ask_t is not null and not done", "rrcReestablishment Failure"),
        ("ask_t is not null and answered and done", "rrcReestablishment")])
    return (f'{_facts(marker, True)} select {_HEAD}, {_RADIO_OUT}, codes as "MCC_MNC", {last}, '
            f"coalesce(nullif(concat_ws(', ', {tags}), ''), 'Unidentified') as \"Analysis\" from al")


def _finding(source: str, alias: str, time: str, tag: str, extra: str = "", where: str = "true") -> str:
    return (f'{source} select {alias}.dev as "Device", {alias}.wo as "WorkOrderId", '
            f'{alias}.n as "Failed_Event_Number", {extra} {time} as "Tag_Time", \'{tag}\' as "Tag_Name" '
            f"from {alias} where {where}")


# --- relations: the row-by-row formulation on whole keys ---------------------------

_TOKENS = """
tok as (select dev, wo, t, k, event_id, value, kind, pci, 4000 + k % 2 as freq, target, target_freq,
               case kind when 'setup' then 'rrcSetupRequest' when 'report' then 'measurementReport'
                    else 'rrcReconfiguration' end as event,
               case when kind = 'report' then k % 4 + 1 end as meas_id
        from sig where kind in ('setup', 'report', 'sync', 'config')),
ses as (select *, sum(case when kind = 'setup' then 1 end)
                    over (partition by wo order by t, event_id rows unbounded preceding) as session from tok),
dec as (select *, lead(target) over x as nt, lead(target_freq) over x as nf
        from ses where kind <> 'report' or k % 4 <> 0 window x as (partition by wo order by t, event_id)),
suc as (select distinct dev, wo, pci as s_pci, freq as s_freq, nt as t_pci, nf as t_freq
        from dec where kind = 'report' and nt is not null),
fai as (select * from dec where not (kind = 'report' and nt is not null)),
cnt as (select *, count(meas_id) over (partition by wo, session) as ids from fai),
kep as (select * from cnt where ids > 0),
grp as (select *, sum(case when kind in ('sync', 'config') then 0 else 1 end)
                    over (partition by wo order by t, event_id rows unbounded preceding) as g,
               lead(meas_id) over (partition by wo order by t, event_id) as next_id from kep),
car as (select *, last_value(next_id ignore nulls) over (partition by wo, g order by t, event_id
                    rows between unbounded preceding and unbounded following) as carried from grp),
obj as (select *, case when kind = 'config' then case carried when 1 then 1 when 2 then 2 when 3 then 1 end end
                    as o from car),
ob2 as (select *, last_value(o ignore nulls) over (partition by wo, g order by t, event_id
                    rows between unbounded preceding and unbounded following) as go from obj),
frq as (select *, case when kind = 'config' then case go when 1 then 5000 + k % 2 when 2 then 6000 + k % 3 end end
                    as f from ob2),
fr2 as (select *, last_value(f ignore nulls) over (partition by wo, g order by t, event_id
                    rows between unbounded preceding and unbounded following) as gf from frq),
shi as (select *, lag(gf) over (partition by wo order by t, event_id) as t_freq from fr2),
rep as (select * from shi where kind = 'report'),
exl as (select *, unnest([k % 10, (k + 3) % 10]) as t_pci from rep),
oth as (select * from exl where t_pci <> pci),
run as (select *, last_value(t_freq ignore nulls) over (partition by wo order by t, event_id
                    rows between unbounded preceding and current row) as so_far from oth),
fil as (select * exclude (t_freq), last_value(so_far) over (partition by wo, t order by event_id
                    rows between unbounded preceding and unbounded following) as t_freq from run)"""

_PLACE = 'dev as "Device", wo as "WorkOrderId", t as "Time", event as "RRC_NR5G_event"'


def _relation(select: str) -> str:
    return _plus(_signal(), _TOKENS) + " " + select


def _lists(column: str, text: str) -> str:
    return f"case when kind = 'config' then {text} else '' end as {column}"


def _hourly(sql: str) -> str:
    """The same over events whose times are cut to the hour."""
    return sql.replace("select event_id, ts, ", "select event_id, date_trunc('hour', ts) as ts, ", 1)


def _crowded(sql: str) -> str:
    """The hourly form with a third of all users as one."""
    user = "(case when user_id % 3 = 0 then 0 else user_id end)"
    return _hourly(sql).replace("user_id as wo, user_id // 2 as dev", f"{user} as wo, {user} // 2 as dev", 1)


def _digits(sql: str, digits: int) -> str:
    """The same with averages and minima rounded to other digits."""
    return re.sub(rf"(round\((?:avg|min)\(\w+\), ){DIGITS}\)", rf"\g<1>{digits})", sql)


def _shifted(sql: str) -> str:
    """The same over values off the hundredths."""
    return sql.replace("event_type, value,", "event_type, value + 0.0012345::double as value,", 1)


def _by_device(sql: str) -> str:
    """The same with rows of all work orders of a device in its windows."""
    for strict, wide in [("g.wo = w.wo and g.t", "g.dev = w.dev and g.t"), ("ms as (select wo, ts", "ms as (select dev, ts"),
                         ("ms.wo = w.wo", "ms.dev = w.dev"), ("ms.wo = f.wo", "ms.dev = f.dev"), ("pr.wo = w.wo", "pr.dev = w.dev")]:
        sql = sql.replace(strict, wide)
    return sql


def _broken(sql: str) -> str:
    """The same with every fifth message unreadable: its text still names its kind, its fields are unknown."""
    for whole, lost in [("case when kind = 'sync' then k % 10 end", "case when kind = 'sync' and k % 5 <> 0 then k % 10 end"),
                        ("case when kind = 'sync' then 5000", "case when kind = 'sync' and k % 5 <> 0 then 5000"),
                        ("'config' and k % 2 = 1 then", "'config' and k % 2 = 1 and k % 5 <> 0 then"),
                        ("case when kind = 'report' then k % 4 + 1", "case when kind = 'report' and k % 5 <> 0 then k % 4 + 1"),
                        ("where kind <> 'report' or k % 4 <> 0", "where kind <> 'report' or (k % 4 <> 0 and k % 5 <> 0)"),
                        ("case when kind = 'config' then case", "case when kind = 'config' and k % 5 <> 0 then case")]:
        sql = sql.replace(whole, lost)
    return sql


def _stored(sql: str, pattern: str, *times: str) -> str:
    """The rows as they are stored: whole numbers narrow, times as text."""
    texts = [f"strftime(\"{name}\", '{pattern}') as \"{name}\"" for name in times]
    numbers = [f'cast("{f.name}" as integer) as "{f.name}"' for f in S.MISSING_RELATION
               if f.dataType.simpleString() == "int" and f'"{f.name}"' in sql]
    return f"select * replace ({', '.join(texts + numbers)}) from ({sql})"


_MICROSECONDS = "%Y-%m-%d %H:%M:%S.%f"
_SPAN_TIMES = ("Event_Analysis_Start_Time", "Event_Analysis_End_Time", "Time")


def oracle_sql() -> dict[str, str]:
    key = 'dev as "Device", wo as "WorkOrderId", n as "Failed_Event_Number"'
    sig, rad = _signal(), _plus(_base(), _MEASUREMENTS)
    handover = _plus(sig, _MEASUREMENTS, _HANDOVER, _LAST)
    last = ('last_report as "Last_Report_Time", pcis as "NR5G_PCC_PCI_Last", rsrp_l as "NR5G_PCC_RSRP_Last", '
            f'sinr_l as "NR5G_PCC_SINR_Last", cells <= 1 as "One_Cell", {_POOR_LAST} as "Poor_Last"')
    window = f"{_base()} select {_KEY}, {_SPAN} from w"
    suspected = _relation(f"""
        select t as "Time", dev as "Device", wo as "WorkOrderId", {_CONTEXT_OUT.format(a="fil")},
               pci as "S_PCI", freq as "S_Freq", t_pci as "T_PCI", t_freq as "T_Freq"
        from fil where not exists (select 1 from suc where suc.wo = fil.wo and suc.dev = fil.dev
            and suc.s_pci = fil.pci and suc.s_freq = fil.freq and suc.t_pci = fil.t_pci
            and suc.t_freq is not distinct from fil.t_freq)""")
    failure = _finding(
        handover, "lf", "first_report", "Handover failure",
        'pcis as "NR5G_PCC_PCI_Last", rsrp_l as "NR5G_PCC_RSRP_Last", sinr_l as "NR5G_PCC_SINR_Last",',
        f"not other and cells <= 1 and {_POOR_LAST} "
        "and not exists (select 1 from ok where ok.wo = lf.wo and ok.n = lf.n)")
    neighbour = _finding(handover, "lf", "first_report", "Missing neighbor relation",
                                  where=f"not other and cells <= 1 and {_POOR_EXACT}")
    devices_of_two = "dev % 3 in (0, 1)"
    text_time = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f') as \"{n}\""
    return {
        "failure_windows": window,
        "failure_windows_sliced": window,
        "failure_windows_cut": window,
        "failure_windows_tied": _hourly(window),
        "failure_windows_traffic_fail": f"{_base('Traffic Fail')} select {_KEY}, {_SPAN} from w",
        "window_rows_left": _window_rows("left"),
        "window_rows_inner": _window_rows("inner"),
        "window_rows_bucketed": _window_rows("left"),
        "window_rows_keyed": _window_rows("inner"),
        "window_rows_linear": _window_rows("inner"),
        "window_rows_linear_sliced": _window_rows("inner"),
        "window_rows_by_device": _window_rows("inner", "dev"),
        "window_rows_dense": _window_rows("inner"),
        "window_rows_hot": _crowded(_window_rows("inner")),
        "window_rows_linear_tied": _crowded(_window_rows("inner")),
        "window_rows_linear_by_device": _window_rows("inner", "dev"),
        "event_messages": f"""{_base()} select {_KEY}, {_SPAN}, ev.ts as "Time",
            case when event_type = 'signup' then '"Setup Start"' when event_type = 'purchase' then '"Call End"'
                 when event_type = 'error' and k % 2 = 0 then 'Data Drop, Traffic Fail'
                 when event_type = 'error' then 'Data Drop' else event_type end as "Event_CallEvent"
            from w left join ev on ev.wo = w.wo and ev.ts between w.s and w.e""",
        "radio_condition": _finding(rad, "rf", "poor_t", "Poor RF condition", _RADIO_OUT + ",", _POOR),
        "radio_condition_v1": f"""{rad} select {key}, {_RADIO_OUT},
            case when {_POOR} then 'Poor RF condition' when {_LOST} then 'Lost UE' end as "Tag_Name" from rf""",
        "lost_signal": _finding(rad, "rf", "s", "Lost UE", where=_LOST),
        "missing_signalling": _finding(sig, "w", "s", "Missing Signalling", where=
            "not exists (select 1 from sig where sig.wo = w.wo and sig.t between w.s and w.e)"),
        "roaming": _finding(sig, "sf", "roam_t", "UE on Roaming", 'codes as "MCC_MNC",', "roam_t is not null"),
        "roaming_v1": f"""{sig} select {key}, codes as "MCC_MNC",
            case when roam_t is not null then 'UE on Roaming' end as "Tag_Name" from sf""",
        "message_class": f'{sig} select {_PLACE}, chk as "Check" from sigc',
        "event_a3_config": f"""{sig} select dev as "Device", wo as "WorkOrderId", t as "Time",
            target as "Target_PCI", a3 as "A3_Offset", cls as "Message_Class" from sigc""",
        "handover_success": f"{_plus(sig, _HANDOVER)} select {key} from ok",
        "handovers": f'{_plus(sig, _PINGPONG)} select {key}, t as "Time" from hs',
        "last_report_subwindow": f"""{sig} select {key}, last_report as "Last_Report_Time",
            e as "Event_Analysis_End_Time" from sf where last_report is not null""",
        "subwindow_radio": f"{handover} select {key}, {last} from lf where cells <= 1 or {_POOR_LAST}",
        "subwindow_radio_v1": f"{handover} select {key}, {last} from lf",
        "handover_failure": failure,
        "handover_failure_tens": _digits(failure, -1),
        "missing_neighbour": neighbour,
        "missing_neighbour_tens": _digits(neighbour, -1),
        "rach_failure": _finding(_plus(_base(), _RACH), "ra", "ask_t", "RACH failure",
                                 where="asked and neither and not answered"),
        "pingpong_handover": _finding(
            _plus(sig, _PINGPONG), "sf", "first_sync", "PingPong Handover",
            where="exists (select 1 from pp where pp.wo = sf.wo and pp.n = sf.n)"),
        "reestablish_failure": _finding(sig, "sf", "ask_t", "rrcReestablishment Failure",
                                        where="ask_t is not null and not done"),
        "reestablish_success": _finding(sig, "sf", "ask_t", "rrcReestablishment",
                                        where="ask_t is not null and answered and done"),
        "high_bler": _finding(_plus(_base(), _BLER), "bl", "bler_t", "High Physical DL BLER",
                              'bler as "PHYDL_NR5G_PCC_BLER_Avg",', f"bler > {BLER}"),
        "reference_columns": f"""{_base()} select {_KEY}, ev.ts as "Time", {_CONTEXT_OUT.format(a="ev")}
            from w join ev on ev.wo = w.wo and ev.ts = w.e""",
        "diagnosis_v2": _diagnosis_v2(),
        "diagnosis_v2_sliced": _diagnosis_v2(),
        "diagnosis_v2_two_digits": _digits(_shifted(_diagnosis_v2()), 2),
        "diagnosis_v2_tens": _digits(_diagnosis_v2(), -1),
        "diagnosis_v2_by_device": _by_device(_diagnosis_v2()),
        "diagnosis_v2_broken": _broken(_diagnosis_v2()),
        "diagnosis_v2_decoded": _diagnosis_v2(),
        "diagnosis_v2_stored_devices": _diagnosis_v2(where=devices_of_two),
        "diagnosis_v2_cut": _diagnosis_v2(),
        "diagnosis_v1": _diagnosis_v1(),
        "diagnosis_v2_traffic_fail": _diagnosis_v2("Traffic Fail"),
        "diagnosis_v1_traffic_fail": _diagnosis_v1("Traffic Fail"),
        "multi_device_union": _diagnosis_v2(where=devices_of_two),
        "multi_device_stacked": _diagnosis_v2(where=devices_of_two),
        "event_token": _relation(f"select {_PLACE} from tok"),
        "rrc_sessions": _relation(f'select {_PLACE}, cast(session as bigint) as "Session" from ses'),
        "decode_reports": _relation(f"""select {_PLACE}, meas_id as report_meas_id,
            case when kind = 'report' then (k % 10) || ',' || ((k + 3) % 10) else '' end as neighbours from dec"""),
        "decode_reconfig": _relation(f"""select {_PLACE}, target as target_pci, target_freq as target_frequency,
            {_lists("meas_ids", "'1,2,3'")}, {_lists("meas_object_ids", "'1,2,1'")},
            {_lists("object_ids", "'1,2'")},
            {_lists("object_frequencies", "(5000 + k % 2) || ',' || (6000 + k % 3)")} from tok"""),
        "relation_success": _relation("""select dev as "Device", wo as "WorkOrderId", s_pci as "S_PCI",
            s_freq as "S_Freq", t_pci as "T_PCI", t_freq as "T_Freq",
            concat_ws('_', wo, dev, s_pci, s_freq, t_pci, t_freq) as "Relation" from suc"""),
        "session_has_report": _relation(f'select {_PLACE}, cast(session as bigint) as "Session" from kep'),
        "report_groups": _relation(f'select {_PLACE}, cast(g as bigint) as "Report_Group" from grp'),
        "carry_back_meas_id": _relation(f"""select {_PLACE}, cast(g as bigint) as "Report_Group",
            carried as "Carried_MeasId" from car"""),
        "config_lookup": _relation("""select dev as "Device", wo as "WorkOrderId",
            cast(g as bigint) as "Report_Group", max(gf) as "T_Freq" from fr2 where gf is not null
            group by dev, wo, g"""),
        "shift_to_report": _relation(f'select {_PLACE}, t_freq as "T_Freq" from rep'),
        "explode_neighbours": _relation(f"""select {_PLACE}, pci as "RRC_NR5G_pci", t_pci as "T_PCI"
            from (select *, unnest([k % 10, (k + 3) % 10]) as t_pci from dec where kind = 'report')
            where t_pci <> pci"""),
        "forward_fill": f"""{_with(_EVENTS)} select dev as "Device", wo as "WorkOrderId", ts as "Time",
            case when event_type = 'signup' then '"Setup Start"' when event_type = 'purchase' then '"Call End"'
                 when event_type = 'error' and k % 2 = 0 then 'Data Drop, Traffic Fail'
                 when event_type = 'error' then 'Data Drop' else event_type end as "Event_CallEvent",
            last_value(case when event_type = 'purchase' then value end ignore nulls)
              over (partition by wo order by ts range between unbounded preceding and current row) as "T_Freq"
            from ev""",
        "forward_fill_tied": _hourly(f"""{_with(_EVENTS)},
            run as (select *, last_value(case when event_type = 'purchase' then value end ignore nulls)
              over (partition by wo order by ts, event_id rows between unbounded preceding and current row) as r from ev)
            select dev as "Device", wo as "WorkOrderId", ts as "Time", event_id as "MsgId",
            case when event_type = 'signup' then '"Setup Start"' when event_type = 'purchase' then '"Call End"'
                 when event_type = 'error' and k % 2 = 0 then 'Data Drop, Traffic Fail'
                 when event_type = 'error' then 'Data Drop' else event_type end as "Event_CallEvent",
            last_value(r) over (partition by wo, ts order by event_id
              rows between unbounded preceding and unbounded following) as "T_Freq" from run"""),
        "array_lookup": """
            with l as (select l_orderkey, l_partkey, l_linenumber, l_quantity,
                              row_number() over (partition by l_orderkey
                                                 order by l_partkey, l_linenumber, l_quantity) as r from lineitem),
            third as (select l_orderkey, max(case when r = 3 then l_partkey end) as l_partkey
                      from l group by l_orderkey),
            f as (select third.l_orderkey, third.l_partkey, min(r) as r from third left join l
                  on l.l_orderkey = third.l_orderkey and l.l_partkey = third.l_partkey group by 1, 2)
            select f.l_orderkey, f.l_partkey, l.l_linenumber, l.l_quantity
            from f left join l on l.l_orderkey = f.l_orderkey and l.r = f.r""",
        "suspected_missing_relations": suspected,
        "suspected_missing_relations_sliced": suspected,
        "suspected_missing_relations_broken": _broken(suspected),
        "suspected_missing_relations_decoded": suspected,
        "suspected_missing_relations_cut": suspected,
        "suspected_missing_relations_tied": _hourly(suspected),
        "table_scan": "select o_orderkey, o_custkey, o_orderpriority from orders",
        "device_lookup": """select event_id, user_id, event_type, value from events
            where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
        "device_lookup_first": """select o_orderkey, o_custkey from orders
            where o_custkey = (select min(c_custkey) from customer where c_mktsegment = 'BUILDING')""",
        "output_projection": f"""{rad} select n as "Failed_Event_Number", typ as "Failed_Event_Type",
            {text_time.format(c="rf.s", n="Event_Analysis_Start_Time")},
            {text_time.format(c="rf.e", n="Event_Analysis_End_Time")},
            cast(wo as integer) as "WorkOrderId", cast(dev as integer) as "Device",
            rsrp_avg as "NR5G_PCC_RSRP_Avg", pcis as "NR5G_PCC_PCI" from rf join w using (dev, wo, n)""",
        "output_projection_v1": f"""{_base()} select {_KEY}, typ as "Failed_Event_Type",
            strftime(s, '%Y-%m-%d') as "Event_Analysis_Start_Time",
            strftime(e, '%Y-%m-%d') as "Event_Analysis_End_Time" from w""",
        "diagnosis_v2_counting_empty_checks": _diagnosis_v2(counts_empty=True),
        "diagnosis_v2_without_pingpong": _diagnosis_v2(pingpong=False),
        "diagnosis_v2_one_cell_by_text": _diagnosis_v2().replace("lf.cells <= 1", "length(lf.pcis) < 5"),
        "diagnosis_v2_low_bler_ceiling": _diagnosis_v2().replace(f"> {BLER}", "> 10"),
        "output_table_v2": _stored(_diagnosis_v2(), _MICROSECONDS, *_SPAN_TIMES),
        "output_table_v1": _stored(_diagnosis_v1(), "%Y-%m-%d", *_SPAN_TIMES),
        "output_table_relations": _stored(suspected, _MICROSECONDS, "Time"),
        "sink_roundtrip": window,
        "sink_renewed_days": f"""select *, strftime("Event_Analysis_End_Time", '%Y-%m-%d') as "Failure_Day" from ({_diagnosis_v2()})""",
        "sink_roundtrip_csv": f"""{_base()} select {_KEY}, typ as "Failed_Event_Type",
            {text_time.format(c="s", n="Event_Analysis_Start_Time")},
            {text_time.format(c="e", n="Event_Analysis_End_Time")} from w""",
    }
