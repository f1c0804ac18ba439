"""Input and output schemas, tag texts and message paths."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: input tables ------------------------------------------------

CONTEXT_COLUMNS = (
    "NetworkModeId", "BandId", "CarrierId", "SectorId", "DeviceId", "FileId",
    "DimensionColumnsId", "Epoch", "MsgId", "Latitude", "Longitude",
)

EVENT_COLUMNS = ("Time", "WorkOrderId", "Device", "Event_CallEvent", *CONTEXT_COLUMNS)
MEASUREMENT_COLUMNS = (
    "Time", "WorkOrderId", "Device", "MEAS_NR5G_PCC_NARFCN", "MEAS_NR5G_PCC_PCI",
    "MEAS_NR5G_PCC_RSRP_AVG", "MEAS_NR5G_PCC_SNR_AVG",
)
SIGNALLING_COLUMNS = (
    "Time", "WorkOrderId", "Device", "RRC_NR5G_event", "RRC_NR5G_pci", "RRC_NR5G_message",
)
WIDE_SIGNALLING_COLUMNS = (
    "Time", "WorkOrderId", "Device", *CONTEXT_COLUMNS,
    "RRC_NR5G_pci", "RRC_NR5G_frequency", "RRC_NR5G_event", "RRC_NR5G_message",
)
RACH_COLUMNS = (
    "Time", "WorkOrderId", "Device", "RACHT_NR5G_CRNTI", "RACHT_NR5G_RACHReason",
    "RACHA_NR5G_numAttmpt", "RACHA_NR5G_RACHResult",
)
PHYSICAL_COLUMNS = ("Time", "WorkOrderId", "Device", "PHYDL_NR5G_PCC_bler")

# --- fixed values: output tables -----------------------------------------------

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
          "text": T.StringType(), "time": T.TimestampType()}


def _schema(spec: str) -> T.StructType:
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


DIAGNOSIS_V1 = _schema("""
    Failed_Event_Number:long Failed_Event_Type:text
    Event_Analysis_Start_Time:time Event_Analysis_End_Time:time
    Time:time WorkOrderId:int NetworkModeId:int BandId:int CarrierId:int SectorId:int
    Device:int DeviceId:int FileId:int DimensionColumnsId:text Epoch:int MsgId:int
    Latitude:double Longitude:double
    NR5G_PCC_NARFCN:text NR5G_PCC_PCI:text
    NR5G_PCC_RSRP_Avg:double NR5G_PCC_RSRP_Min:double
    NR5G_PCC_SINR_Avg:double NR5G_PCC_SINR_Min:double
    MCC_MNC:text NR5G_PCC_PCI_Last:text NR5G_PCC_RSRP_Last:double NR5G_PCC_SINR_Last:double
    Analysis:text
""")

DIAGNOSIS_V2 = T.StructType(
    DIAGNOSIS_V1.fields[:-1]
    + [T.StructField("PHYDL_NR5G_PCC_BLER_Avg", T.DoubleType(), True), DIAGNOSIS_V1["Analysis"]]
)

MISSING_RELATION = _schema("""
    Time:time WorkOrderId:int Device:int
    NetworkModeId:int BandId:int CarrierId:int SectorId:int DeviceId:int FileId:int
    DimensionColumnsId:text Epoch:int MsgId:int Latitude:double Longitude:double
    S_PCI:int S_Freq:int T_PCI:int T_Freq:int
""")

# --- fixed values: tags, in the order that breaks ties of one instant -----------

POOR_RADIO = "Poor RF condition"
LOST_SIGNAL = "Lost UE"
MISSING_SIGNALLING = "Missing Signalling"
ROAMING = "UE on Roaming"
HANDOVER_FAILURE = "Handover failure"
RACH_FAILURE = "RACH failure"
PINGPONG = "PingPong Handover"
REESTABLISH_FAILURE = "rrcReestablishment Failure"
REESTABLISH_SUCCESS = "rrcReestablishment"
MISSING_NEIGHBOUR = "Missing neighbor relation"
HIGH_BLER = "High Physical DL BLER"
UNIDENTIFIED = "Unidentified"

# --- fixed values: RRC event texts ----------------------------------------------

REPORT = "5GNR measurementReport"
RECONFIGURATION = "5GNR rrcReconfiguration"
RECONFIGURATION_COMPLETE = "5GNR rrcReconfigurationComplete"
SYSTEM_INFORMATION = "systemInformationBlockType1"
REESTABLISH_REQUEST = "5GNR rrcReestablishmentRequest"
REESTABLISH_ANSWERS = ("5GNR rrcSetup", "5GNR rrcReestablishment")
REESTABLISH_COMPLETE = "5GNR rrcReestablishmentComplete"
SETUP_COMPLETE = "rrcSetupComplete"
NEIGHBOURS_IN_TEXT = "measResultNeighCells"
SYNC_IN_TEXT = "reconfigurationWithSync"
ROAMING_OPERATORS = "T-Mobile|AT&T"
NETWORK_CODE_IN_TEXT = "MCC :"
NETWORK_CODE_START, NETWORK_CODE_LENGTH = 35, 37
SETUP_TOKEN = "rrcSetupRequest"
RECONFIGURATION_TOKEN = "rrcReconfiguration"
REPORT_TOKEN = "measurementReport"

# --- fixed values: message paths ("[]" marks an array) ----------------------------

DOWNLINK_ROOT = ("DL-DCCH-Message.message.c1.rrcReconfiguration"
                 ".criticalExtensions.rrcReconfiguration")
_SYNC = "nonCriticalExtension.masterCellGroup.CellGroupConfig.spCellConfig.reconfigurationWithSync"
_IDS = "measConfig.measIdToAddModList[].MeasIdToAddMod"
_OBJECTS = "measConfig.measObjectToAddModList[].MeasObjectToAddMod"
_REPORTS = "measConfig.reportConfigToAddModList[].ReportConfigToAddMod"
DOWNLINK_PATHS = {
    "target_pci": f"{_SYNC}.spCellConfigCommon.physCellId",
    "target_frequency": f"{_SYNC}.spCellConfigCommon.downlinkConfigCommon"
                        ".frequencyInfoDL.absoluteFrequencySSB",
    "meas_ids": f"{_IDS}.measId",
    "meas_object_ids": f"{_IDS}.measObjectId",
    "meas_report_ids": f"{_IDS}.reportConfigId",
    "object_ids": f"{_OBJECTS}.measObjectId",
    "object_frequencies": f"{_OBJECTS}.measObject.measObjectNR.ssbFrequency",
    "report_ids": f"{_REPORTS}.reportConfigId",
    "a3_offsets": f"{_REPORTS}.reportConfig.reportConfigNR.reportType.eventTriggered"
                  ".eventId.eventA3.a3-Offset.rsrp",
}

UPLINK_ROOT = ("UL-DCCH-Message.message.c1.measurementReport"
               ".criticalExtensions.measurementReport.measResults")
UPLINK_PATHS = {
    "report_meas_id": "measId",
    "neighbour_pcis": "measResultNeighCells.measResultListNR[].MeasResultNR.physCellId",
}
