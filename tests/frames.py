"""Small literal frames. Times are seconds after an origin; device and work order are 1 unless given."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from callcause import schemas as S
from callcause.operators import windows as W

ORIGIN = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else ORIGIN + timedelta(seconds=seconds)


def seconds(moment):
    return None if moment is None else (moment - ORIGIN).total_seconds()


def _frame(spark, rows, columns, width):
    shaped = []
    for row in rows:
        row = tuple(row)
        values, place = row[:width], row[width:] or (1, 1)
        work_order, device = (*place, 1)[:2]
        shaped.append((at(values[0]), work_order, device, *values[1:]))
    return spark.createDataFrame(shaped, f"Time timestamp, WorkOrderId int, Device int, {columns}")


def events(spark, rows):
    """(seconds, text[, work order[, device]])"""
    return _frame(spark, rows, "Event_CallEvent string", 2)


def events_with_context(spark, rows):
    """(seconds, text, message id, latitude[, ...])"""
    frame = _frame(spark, rows, "Event_CallEvent string, MsgId int, Latitude double", 4)
    return frame.selectExpr(
        "*", "MsgId % 3 as NetworkModeId", "1 as BandId", "2 as CarrierId", "3 as SectorId",
        "4 as DeviceId", "5 as FileId", "'d' as DimensionColumnsId", "6 as Epoch", "-Latitude as Longitude")


def samples(spark, rows):
    """(seconds, channel, cell, rsrp, sinr[, ...])"""
    return _frame(spark, rows, "MEAS_NR5G_PCC_NARFCN int, MEAS_NR5G_PCC_PCI int, "
                               "MEAS_NR5G_PCC_RSRP_AVG double, MEAS_NR5G_PCC_SNR_AVG double", 5)


def signals(spark, rows):
    """(seconds, event, cell, message[, ...])"""
    return _frame(spark, rows, "RRC_NR5G_event string, RRC_NR5G_pci int, RRC_NR5G_message string", 4)


def wide_signals(spark, rows):
    """(seconds, event, cell, frequency, message[, ...])"""
    frame = _frame(spark, rows, "RRC_NR5G_event string, RRC_NR5G_pci int, RRC_NR5G_frequency int, "
                                "RRC_NR5G_message string", 5)
    return frame.selectExpr("*", "1 as BandId", "7 as MsgId", "0.5D as Latitude")


def accesses(spark, rows):
    """(seconds, reason, result[, ...])"""
    return _frame(spark, rows, "RACHT_NR5G_RACHReason int, RACHA_NR5G_RACHResult int", 3)


def blers(spark, rows):
    """(seconds, bler[, ...])"""
    return _frame(spark, rows, "PHYDL_NR5G_PCC_bler double", 2)


SETUP, END, DROP = '"Setup Start"', '"Call End"', "Data Drop"


def one_window(spark, profile, end=100):
    return W.failure_windows(events(spark, [(0, SETUP), (end, DROP)]), profile)


def _nest(path, body):
    for step in reversed(path.split(".")):
        body = {step: body}
    return body


def report(meas_id=3, cells=(40, 41)):
    results = {"measId": meas_id}
    if cells is not None:
        results["measResultNeighCells"] = {
            "measResultListNR": [{"MeasResultNR": {"physCellId": cell}} for cell in cells]}
    return json.dumps(_nest(S.UPLINK_ROOT, results))


def sync(target, frequency=129870):
    path = f"{S.DOWNLINK_ROOT}.{S.DOWNLINK_PATHS['target_pci']}".removesuffix(".physCellId")
    return json.dumps(_nest(path, {
        "physCellId": target,
        "downlinkConfigCommon": {"frequencyInfoDL": {"absoluteFrequencySSB": frequency}}}))


def config(ids=((2, 1), (3, 1)), objects=((1, 129870),), offset=6, with_sync=False):
    reports = [{"ReportConfigToAddMod": {"reportConfigId": 1, "reportConfig": {"reportConfigNR": {
        "reportType": {"eventTriggered": {"eventId": {"eventA2": {"a2-Threshold": {"rsrp": 61}}}}}}}}}]
    if offset is not None:
        reports.append({"ReportConfigToAddMod": {"reportConfigId": 2, "reportConfig": {"reportConfigNR": {
            "reportType": {"eventTriggered": {"eventId": {"eventA3": {"a3-Offset": {"rsrp": offset}}}}}}}}})
    body = {"measConfig": {
        "measIdToAddModList": [{"MeasIdToAddMod": {"measId": i, "measObjectId": o, "reportConfigId": 1}}
                               for i, o in ids],
        "measObjectToAddModList": [{"MeasObjectToAddMod": {"measObjectId": o, "measObject": {
            "measObjectNR": {"ssbFrequency": f}}}} for o, f in objects],
        "reportConfigToAddModList": reports}}
    if with_sync:
        body["nonCriticalExtension"] = {"masterCellGroup": {"CellGroupConfig": {"spCellConfig": {
            "reconfigurationWithSync": {"spCellConfigCommon": {"physCellId": 11}}}}}}
    return json.dumps(_nest(S.DOWNLINK_ROOT, body))
