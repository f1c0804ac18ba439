"""Detectors on RRC signalling rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callcause import schemas as S
from callcause.functions.messages import decode_downlink, decode_uplink
from callcause.functions.values import (empty_to_null, ever, first_time, is_true, last_time,
                                        second_word, set_text)
from callcause.operators.radio import LAST_REPORT, TAG, TAG_TIME
from callcause.operators.windows import END, START, Keep, window_rows
from callcause.profile import Profile

CHECK, CLASS, TARGET, OFFSET = "Check", "Message_Class", "Target_PCI", "A3_Offset"
REPORT_CHECK, SYNC_CHECK = "Check1", "Check2"
NETWORK_CODES = "MCC_MNC"


def message_class(signalling: DataFrame, profile: Profile) -> DataFrame:
    """Add the kind of a row: report with neighbours, reconfiguration with sync, or null."""
    event, text = F.col(profile.columns.rrc_event), F.col(profile.columns.rrc_message)
    kind = (F.when((event == S.REPORT) & text.contains(S.NEIGHBOURS_IN_TEXT), REPORT_CHECK)
            .when((event == S.RECONFIGURATION) & text.contains(S.SYNC_IN_TEXT), SYNC_CHECK))
    return signalling.withColumn(CHECK, kind)


def event_a3_config(signalling: DataFrame, profile: Profile) -> DataFrame:
    """Add target cell and A3 offset of reconfigurations, and the class text of the row.

    The class of reports and reconfigurations joins kind and offset (``Check1``,
    ``Check2``, ``Check2_6``, ``6`` or empty); other rows have none. The message
    text ends here, so that it is not shuffled.
    """
    c = profile.columns
    event = F.col(c.rrc_event)
    decoded = decode_downlink(message_class(signalling, profile), c.rrc_message,
                              event == S.RECONFIGURATION, ["target_pci", "a3_offsets"])
    offset = F.get(F.col("a3_offsets"), F.lit(1))
    text = F.when(event.isin(S.REPORT, S.RECONFIGURATION), F.concat_ws("_", CHECK, OFFSET))
    return (decoded.withColumn(OFFSET, offset).withColumnRenamed("target_pci", TARGET)
            .withColumn(CLASS, text).drop("a3_offsets", c.rrc_message))


# What a row's message holds, for both jobs; a table that has these is decoded already.
DECODED = ("report_meas_id", "neighbour_pcis", "target_pci", "target_frequency", "meas_ids", "meas_object_ids",
           "object_ids", "object_frequencies", OFFSET)


def is_decoded(signalling: DataFrame) -> bool:
    return {CHECK, *DECODED} <= set(signalling.columns)


def decode(signalling: DataFrame, profile: Profile) -> DataFrame:
    """All columns but the message text, with its fields (DECODED) and the kind of the row.

    A stored table of this kind serves the diagnosis and the relations, and no
    message is parsed again.
    """
    c = profile.columns
    event, token = F.col(c.rrc_event), second_word(F.col(c.rrc_event))
    rows = decode_uplink(message_class(signalling, profile), c.rrc_message, (event == S.REPORT) | (token == S.REPORT_TOKEN))
    rows = decode_downlink(rows, c.rrc_message, (event == S.RECONFIGURATION) | (token == S.RECONFIGURATION_TOKEN),
                           [*DECODED[2:-1], "a3_offsets"])
    return rows.withColumn(OFFSET, F.get(F.col("a3_offsets"), F.lit(1))).drop("a3_offsets", c.rrc_message)


def _from_decoded(decoded: DataFrame, profile: Profile) -> DataFrame:
    c = profile.columns
    event = F.col(c.rrc_event)
    target, offset = (F.when(event == S.RECONFIGURATION, F.col(name)) for name in ("target_pci", OFFSET))
    text = F.when(event.isin(S.REPORT, S.RECONFIGURATION), F.concat_ws("_", CHECK, offset))
    return decoded.select(*profile.keys, c.time, *profile.ties_of(decoded), c.rrc_event, c.rrc_cell, CHECK,
                          target.alias(TARGET), offset.alias(OFFSET), text.alias(CLASS))


def narrow(signalling: DataFrame, profile: Profile) -> DataFrame:
    """The columns the detectors need, messages already decoded."""
    if is_decoded(signalling):
        return _from_decoded(signalling, profile)
    c = profile.columns
    slim = signalling.select(*profile.keys, c.time, *profile.ties_of(signalling), c.rrc_event, c.rrc_cell, c.rrc_message)
    return event_a3_config(slim, profile)


def tagged_signalling(windows: DataFrame, signalling: DataFrame, profile: Profile, keep: Keep = None) -> DataFrame:
    """Decoded signalling rows next to the window they fall into; ``keep`` as in ``window_rows``."""
    return window_rows(windows.select(*profile.event_key, START, END),
                       narrow(signalling, profile), profile, keep=keep)


def signalling_facts(tagged: DataFrame, profile: Profile) -> DataFrame:
    """Everything that needs no row order, in one aggregate per window with signalling."""
    c = profile.columns
    event, kind = F.col(c.rrc_event), F.col(CLASS)
    code = F.when(event.contains(S.NETWORK_CODE_IN_TEXT),
                  F.substring(event, S.NETWORK_CODE_START, S.NETWORK_CODE_LENGTH))
    other = kind != REPORT_CHECK
    if profile.skips_empty_checks:
        other = other & (kind != "")
    request = event == S.REESTABLISH_REQUEST
    return tagged.groupBy(*profile.event_key).agg(
        F.count(F.lit(1)).alias("Signalling_Rows"),
        empty_to_null(set_text(F.collect_set(code))).alias(NETWORK_CODES),
        first_time(event.rlike(S.ROAMING_OPERATORS), c.time).alias("Roaming_Time"),
        first_time(F.col(CHECK) == REPORT_CHECK, c.time).alias("First_Report_Time"),
        last_time(kind == REPORT_CHECK, c.time).alias(LAST_REPORT),
        ever(other).alias("Other_Class"),
        first_time(F.col(CHECK) == SYNC_CHECK, c.time).alias("First_Sync_Time"),
        first_time(request, c.time).alias("Reestablish_Time"),
        ever(event.isin(*S.REESTABLISH_ANSWERS)).alias("Reestablish_Answered"),
        ever((event == S.REESTABLISH_COMPLETE) | event.rlike(S.SETUP_COMPLETE))
        .alias("Reestablish_Done"),
    )


def missing_signalling(windows: DataFrame, facts: DataFrame, profile: Profile) -> DataFrame:
    """Windows without a signalling row, tagged at their start."""
    key = list(profile.event_key)
    return windows.join(facts.select(*key), key, "left_anti").select(
        *key, F.col(START).alias(TAG_TIME), F.lit(S.MISSING_SIGNALLING).alias(TAG))


def roaming(facts: DataFrame, profile: Profile) -> DataFrame:
    """Foreign operator seen. v2 keeps those windows; v1 keeps all and the network codes they name."""
    seen = F.col("Roaming_Time").isNotNull()
    if profile.version == "v1":
        return facts.select(*profile.event_key, NETWORK_CODES, F.when(seen, S.ROAMING).alias(TAG))
    return facts.filter(seen).select(
        *profile.event_key, NETWORK_CODES, F.col("Roaming_Time").alias(TAG_TIME),
        F.lit(S.ROAMING).alias(TAG))


def last_report_subwindow(windows: DataFrame, facts: DataFrame, profile: Profile) -> DataFrame:
    """From the last neighbour report of a window to its failure."""
    key = list(profile.event_key)
    found = facts.filter(F.col(LAST_REPORT).isNotNull()).select(*key, LAST_REPORT)
    return windows.select(*key, END).join(found, key, "inner")


def only_reports() -> Column:
    """The classes of the window are exactly the neighbour report."""
    return F.col(LAST_REPORT).isNotNull() & ~is_true(F.col("Other_Class"))


def is_reestablish_failure() -> Column:
    return F.col("Reestablish_Time").isNotNull() & ~is_true(F.col("Reestablish_Done"))


def is_reestablish_success() -> Column:
    return (F.col("Reestablish_Time").isNotNull() & is_true(F.col("Reestablish_Answered"))
            & is_true(F.col("Reestablish_Done")))


def _reestablish(facts: DataFrame, profile: Profile, condition: Column, tag: str) -> DataFrame:
    return facts.filter(condition).select(
        *profile.event_key, F.col("Reestablish_Time").alias(TAG_TIME), F.lit(tag).alias(TAG))


def reestablish_failure(facts: DataFrame, profile: Profile) -> DataFrame:
    """Asked for, perhaps answered, never completed."""
    return _reestablish(facts, profile, is_reestablish_failure(), S.REESTABLISH_FAILURE)


def reestablish_success(facts: DataFrame, profile: Profile) -> DataFrame:
    """Asked for, answered and completed."""
    return _reestablish(facts, profile, is_reestablish_success(), S.REESTABLISH_SUCCESS)
