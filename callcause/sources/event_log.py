"""Probe tables derived from a plain event log.

The log has ``event_id, ts, user_id, event_type, value, props`` with
``props = {"k": n}``. A user plays a work order, two users share a device, and
type and ``k`` of an event decide which probe rows it makes. With this the whole
analysis runs on ordinary event data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callcause import schemas as S
from callcause.plans.diagnosis import ProbeTables

_KEYS = ("Time", "WorkOrderId", "Device")
_PROBE = "event_type in ('view', 'click')"
_CONTEXT = (
    "k % 3 as NetworkModeId", "k % 7 as BandId", "k % 5 as CarrierId", "k % 4 as SectorId",
    "Device as DeviceId", "k % 11 as FileId", "concat('d', k) as DimensionColumnsId",
    "k as Epoch", "event_id as MsgId", "value as Latitude", "-value as Longitude",
)


def _base(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "cast(ts as timestamp) as Time", "user_id as WorkOrderId", "user_id div 2 as Device",
        "event_id", "event_type", "value", "cast(get_json_object(props, '$.k') as bigint) as k")


def hourly(events: DataFrame) -> DataFrame:
    """The log with times cut to the hour."""
    return events.withColumn("ts", F.date_trunc("hour", "ts"))


def shifted(events: DataFrame) -> DataFrame:
    """The log with values off the hundredths, so that no average lies half way between two of them."""
    return events.withColumn("value", F.col("value") + F.lit(0.0012345))


def crowded(events: DataFrame) -> DataFrame:
    """The hourly log with a third of all users as one, so that one key is hot and instants are shared."""
    return hourly(events).withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))


def call_events(events: DataFrame) -> DataFrame:
    """Sign-ups set calls up, purchases end them, errors drop them (half of them as traffic failures)."""
    return _base(events).selectExpr(*_KEYS, """
        case when event_type = 'signup' then '"Setup Start"'
             when event_type = 'purchase' then '"Call End"'
             when event_type = 'error' and k % 2 = 0 then 'Data Drop, Traffic Fail'
             when event_type = 'error' then 'Data Drop'
             else event_type end as Event_CallEvent""", *_CONTEXT)


def probe_rows(events: DataFrame) -> DataFrame:
    """Views and clicks as they are."""
    return _base(events).filter(_PROBE).selectExpr(*_KEYS, "event_type", "value", "k")


def device_services(events: DataFrame) -> DataFrame:
    """A device dimension: every third device downloads, every third uploads, the others talk."""
    return _base(events).selectExpr("Device", """
        case Device % 3 when 0 then 'IPERF3_DL' when 1 then 'IPERF3_UL' else 'VOICE' end
        as ServiceName""").distinct()


def measurements(events: DataFrame) -> DataFrame:
    """One radio sample per view or click; some have a value missing."""
    return _base(events).filter(_PROBE).selectExpr(
        *_KEYS, "1000 + k % 3 as MEAS_NR5G_PCC_NARFCN", "k % 4 as MEAS_NR5G_PCC_PCI",
        "case when k % 13 <> 0 then -value - 60.0D end as MEAS_NR5G_PCC_RSRP_AVG",
        "case when k % 13 <> 0 then cast(k as double) - 20.0D end as MEAS_NR5G_PCC_SNR_AVG")


def rach(events: DataFrame) -> DataFrame:
    """One random-access row per view or click: a request, a result, or neither."""
    return _base(events).filter(_PROBE).selectExpr(
        *_KEYS, "k as RACHT_NR5G_CRNTI",
        "case when k % 3 = 0 then 0 end as RACHT_NR5G_RACHReason",
        "k % 5 as RACHA_NR5G_numAttmpt",
        "case when k % 3 = 2 then 0 when k % 6 = 1 then 1 end as RACHA_NR5G_RACHResult")


def physical(events: DataFrame) -> DataFrame:
    """One block-error sample per view or click; some are missing."""
    return _base(events).filter(_PROBE).selectExpr(
        *_KEYS, "case when k % 9 <> 0 then value end as PHYDL_NR5G_PCC_bler")


def _nested(path: str, body: str) -> str:
    """JSON text of an object at the end of a path of single keys."""
    steps = path.split(".")
    return "".join(f'{{"{step}":' for step in steps) + body + "}" * len(steps)


def _filled(template: str, *numbers: str) -> str:
    """SQL text that fills the ``%d`` places of a template in turn."""
    first, *rest = template.split("%d")
    parts = [f"'{first}'"]
    for number, text in zip(numbers, rest, strict=True):
        parts += [f"({number})", f"'{text}'"]
    return f"concat({', '.join(parts)})"


def _report_message() -> str:
    """A report of two cells, or, for every fourth k, of none."""
    cells = ('{"measResultListNR":[{"MeasResultNR":{"physCellId":%d}},'
             '{"MeasResultNR":{"physCellId":%d}}]}')
    full = _nested(S.UPLINK_ROOT, '{"measId":%d,"measResultNeighCells":' + cells + "}")
    bare = _nested(S.UPLINK_ROOT, '{"measId":%d}')
    return (f"case when k % 4 = 0 then {_filled(bare, 'k % 4 + 1')} "
            f"else {_filled(full, 'k % 4 + 1', 'k % 10', '(k + 3) % 10')} end")


def _sync_message() -> str:
    """A handover command to cell k mod 10."""
    cell = ('{"physCellId":%d,"downlinkConfigCommon":{"frequencyInfoDL":'
            '{"absoluteFrequencySSB":%d}}}')
    path = S.DOWNLINK_PATHS["target_pci"].removesuffix(".physCellId")
    return _filled(_nested(f"{S.DOWNLINK_ROOT}.{path}", cell), "k % 10", "5000 + k % 2")


def _config_message() -> str:
    """Measurement lists; even k have one report configuration, odd k a second one with an A3 offset."""
    ids = ",".join('{"MeasIdToAddMod":{"measId":%s,"measObjectId":%s,"reportConfigId":1}}' % pair
                   for pair in ((1, 1), (2, 2), (3, 1)))
    objects = ",".join('{"MeasObjectToAddMod":{"measObjectId":%s,"measObject":'
                       '{"measObjectNR":{"ssbFrequency":%%d}}}}' % number for number in (1, 2))
    report = ('{"ReportConfigToAddMod":{"reportConfigId":%s,"reportConfig":{"reportConfigNR":'
              '{"reportType":{"eventTriggered":{"eventId":%s}}}}}}')
    first = report % (1, '{"eventA2":{"a2-Threshold":{"rsrp":61}}}')
    second = report % (2, '{"eventA3":{"a3-Offset":{"rsrp":%d}}}')
    lists = ('{"measIdToAddModList":[' + ids + '],"measObjectToAddModList":[' + objects
             + '],"reportConfigToAddModList":[')
    path = f"{S.DOWNLINK_ROOT}.measConfig"
    one = _nested(path, lists + first + "]}")
    two = _nested(path, lists + first + "," + second + "]}")
    frequencies = ("5000 + k % 2", "6000 + k % 3")
    return (f"case when k % 2 = 0 then {_filled(one, *frequencies)} "
            f"else {_filled(two, *frequencies, 'k % 8')} end")


def _row(seconds: int, event: str, cell: str, message: str = "cast(null as string)") -> str:
    return (f"named_struct('seconds', {seconds}, 'RRC_NR5G_event', {event}, "
            f"'RRC_NR5G_pci', {cell}, 'RRC_NR5G_message', {message})")


def _signalling_rows() -> str:
    serving, target = "(k + 1) % 10", "k % 10"
    network = ("concat('NR5G System Information: PLMN id, MCC : 310 MNC : ', k, ' ', "
               "case when k % 4 = 0 then 'T-Mobile' when k % 3 = 0 then 'AT&T' else 'Home' end)")
    request = _row(0, f"'{S.REESTABLISH_REQUEST}'", serving)

    def handover(start: int) -> list[str]:
        return [_row(start, f"'{S.RECONFIGURATION}'", serving, _sync_message()),
                _row(start + 1, f"'{S.RECONFIGURATION_COMPLETE}'",
                     f"case when k % 6 = 0 then {target} else (k + 5) % 10 end"),
                _row(start + 2, "'BCCH systemInformationBlockType1'", target)]

    def rows(condition: str, *found: str) -> str:
        return f"when {condition} then array({', '.join(found)})"

    return " ".join([
        "case",
        rows("event_type = 'signup'", _row(0, "'5GNR rrcSetupRequest'", target)),
        rows("event_type = 'purchase' and k % 2 = 0", _row(0, network, target)),
        rows("event_type = 'view'", _row(0, f"'{S.REPORT}'", serving, _report_message())),
        rows("event_type = 'click' and k % 6 = 0", *handover(0), *handover(3), *handover(6)),
        rows("event_type = 'click' and k % 3 = 0", *handover(0)),
        rows("event_type = 'click' and k % 3 = 1",
             _row(0, f"'{S.RECONFIGURATION}'", serving, _config_message())),
        rows("event_type = 'click' and k % 4 = 0", request),
        rows("event_type = 'click' and k % 4 = 1", request, _row(1, "'5GNR rrcSetup'", serving)),
        rows("event_type = 'click' and k % 4 = 2", request,
             _row(1, "'5GNR rrcReestablishment'", serving),
             _row(2, f"'{S.REESTABLISH_COMPLETE}'", serving)),
        rows("event_type = 'click'", request, _row(1, "'5GNR rrcSetupComplete'", serving)),
        "end",
    ])


def signalling(events: DataFrame) -> DataFrame:
    """RRC rows of sign-ups, purchases, views and clicks; a click makes up to nine, a second apart.

    Every sixth k brings three handovers in a row, so that some windows go to and fro.
    """
    # The outer form keeps Spark from testing the built rows once more in a filter below.
    return (_base(events).selectExpr("*", f"{_signalling_rows()} as _rows")
            .selectExpr("*", "inline_outer(_rows)").filter("RRC_NR5G_event is not null")
            .selectExpr("Time + make_dt_interval(0, 0, 0, seconds) as Time", "WorkOrderId", "Device",
                        *_CONTEXT, "RRC_NR5G_pci", "4000 + k % 2 as RRC_NR5G_frequency",
                        "RRC_NR5G_event", "RRC_NR5G_message"))


def broken_signalling(events: DataFrame) -> DataFrame:
    """The same with the end of every fifth message lost, so that it cannot be parsed."""
    text = F.col("RRC_NR5G_message")
    return signalling(events).withColumn(
        "RRC_NR5G_message", F.when(F.col("Epoch") % 5 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text))


def probe_tables(events: DataFrame) -> ProbeTables:
    return ProbeTables(call_events(events), measurements(events), signalling(events),
                       rach(events), physical(events))
