"""All facts about every window from one tagged stream: one exchange, no join.

Events and probe rows of all tables lie in one frame, by key and time. Windows
of a key lie end to end, so a row finds its windows by looking at the markers of
its own instant and at the next marker after it. From there on every step keeps
the distribution by key: row sequences inside a window, partial aggregates by
window, cell, channel and network code, and sets made from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callcause import schemas as S
from callcause.functions.values import empty_to_null, is_true, set_text
from callcause.operators import radio as R, signalling as G
from callcause.operators.windows import END, KIND, NUMBER, START
from callcause.profile import Profile

_EVENT, _RADIO, _SIGNAL, _ACCESS, _BLER = "_event", "_radio", "_signal", "_access", "_bler"
_STREAMS = (_EVENT, _RADIO, _SIGNAL, _ACCESS, _BLER)
_SEGMENT = "_segment"


def _events(events: DataFrame, profile: Profile) -> DataFrame:
    """Call events: their text, whether they are markers or failures, and their context in the order that decides."""
    c = profile.columns
    text = F.col(c.call_event)
    failed = is_true(text.contains(profile.marker))
    names = [n for n in S.CONTEXT_COLUMNS if n in events.columns and n not in profile.keys]
    order = [F.col(c.message_id).isNull().alias("_unnumbered"), F.col(c.message_id)] if c.message_id in events.columns else []
    rest = [F.col(n) for n in names if n != c.message_id]
    return events.select(*profile.keys, c.time, *profile.ties_of(events, c.call_event), F.struct(
        text.alias("text"), (failed | is_true(text.isin(profile.setup_text, profile.end_text))).alias("marker"),
        failed.alias("failed"), F.struct(*order, *rest, F.lit(0).alias("_some")).alias("context")).alias(_EVENT))


def _signals(signalling: DataFrame, profile: Profile) -> DataFrame:
    """Decoded signalling rows; what their text tells is taken from it here, codes included."""
    c = profile.columns
    rows = G.narrow(signalling, profile)
    event = F.col(c.rrc_event)
    complete, information = event == S.RECONFIGURATION_COMPLETE, event.rlike(S.SYSTEM_INFORMATION)
    step = (F.when(F.col(G.CHECK) == G.SYNC_CHECK, "sent").when(complete, "received").when(information, "completed"))
    code = F.when(event.contains(S.NETWORK_CODE_IN_TEXT), F.substring(event, S.NETWORK_CODE_START, S.NETWORK_CODE_LENGTH))
    return rows.select(*profile.keys, c.time, *profile.ties_of(rows), F.struct(
        event.alias("event"), F.col(c.rrc_cell).cast("long").alias("cell"), F.col(G.CHECK).alias("check"),
        F.col(G.TARGET).alias("target"), F.col(G.CLASS).alias("kind"), code.alias("code"), step.alias("step"),
        is_true((event == S.RECONFIGURATION) | complete | information).alias("handover"),
        is_true(event.rlike(S.ROAMING_OPERATORS)).alias("roams"), is_true(event == S.REESTABLISH_REQUEST).alias("asks"),
        is_true(event.isin(*S.REESTABLISH_ANSWERS)).alias("answers"),
        is_true((event == S.REESTABLISH_COMPLETE) | event.rlike(S.SETUP_COMPLETE)).alias("done")).alias(_SIGNAL))


def merged_rows(tables, profile: Profile) -> DataFrame:
    """The tagged stream: keys, time, tie columns, and one filled struct a row. Messages are decoded here, once."""
    c, keys = profile.columns, profile.keys

    def stream(rows: DataFrame, name: str, *columns: Column) -> DataFrame:
        return rows.filter(F.col(c.time).isNotNull()).select(*keys, c.time, F.struct(*columns).alias(name))

    meas, rach = tables.measurements, tables.rach
    parts = [
        _events(tables.events, profile),
        stream(meas, _RADIO, F.col(c.channel).alias("channel"), F.col(c.cell).alias("cell"),
               F.col(c.rsrp).alias("rsrp"), F.col(c.sinr).alias("sinr")),
        _signals(tables.signalling, profile).filter(F.col(c.time).isNotNull()),
        stream(rach, _ACCESS, is_true(F.col(c.rach_reason) == 0).alias("asks"), is_true(F.col(c.rach_result) == 0).alias("answers")),
    ]
    if profile.version == "v2" and tables.physical is not None:
        known = tables.physical.filter(F.col(c.bler).isNotNull())
        parts.append(stream(known, _BLER, F.col(c.bler).alias("bler")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def in_windows(merged: DataFrame, profile: Profile) -> DataFrame:
    """Rows next to each window they fall into; event rows next to the windows that close on their instant.

    Every failure has its own row among these, so no window is missing.
    """
    c, keys = profile.columns, list(profile.keys)
    time, ties = c.time, profile.ties_of(merged)
    marker, failed = is_true(F.col(f"{_EVENT}.marker")), is_true(F.col(f"{_EVENT}.failed"))
    forward = Window.partitionBy(*keys).orderBy(time, *ties, _EVENT)
    before, so_far = forward.rowsBetween(Window.unboundedPreceding, -1), forward.rowsBetween(Window.unboundedPreceding, 0)
    instant = Window.partitionBy(*keys, time)
    rows = merged.withColumns({
        "_start": F.last(F.when(marker, F.struct(time)), ignorenulls=True).over(before)[time],
        "_number": F.sum(failed.cast("long")).over(so_far)})
    window = F.struct(F.col("_number").alias(NUMBER), F.col(f"{_EVENT}.text").alias(KIND),
                      F.col("_start").alias(START), F.col(time).alias(END))
    # Of the markers of one instant only the first begins before it.
    leads = marker & (F.col("_start").isNull() | (F.col("_start") < F.col(time)))
    later = Window.partitionBy(*keys).orderBy(F.col("_micros").desc()).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_micros": F.unix_micros(time),
        "_closing": F.collect_list(F.when(failed, window)).over(instant),
        "_context": F.when(failed & F.col(time).isNotNull(), F.min(F.col(f"{_EVENT}.context")).over(instant)),
    }).withColumn("_next", F.last(F.when(leads, F.struct(failed.alias("failed"), window.alias("window"))), ignorenulls=True).over(later))
    ahead = F.when(is_true(F.col("_next.failed")), F.array("_next.window")).otherwise(F.array().cast("array<struct<"
        f"{NUMBER}:bigint,{KIND}:string,{START}:timestamp,{END}:timestamp>>"))
    around = F.filter(F.concat("_closing", ahead), lambda w: w[START].isNotNull() & (w[START] <= F.col(time)))
    found = rows.withColumn("_window", F.explode(F.when(F.col(_EVENT).isNotNull(), F.col("_closing")).otherwise(around)))
    streams = [name for name in _STREAMS if name in merged.columns and name != _EVENT]
    return found.select(*keys, "_window.*", time, *ties, *streams, "_context")


def _lead(name: str, offset: int, place: str) -> Column:
    return F.expr(f"lead({name}, {offset}) ignore nulls over ({place})")


def _sequences(rows: DataFrame, profile: Profile) -> DataFrame:
    """Add what needs the order of rows: handovers that worked, ping-pongs, and the last report before or at a row."""
    c = profile.columns
    key = ", ".join(f"`{n}`" for n in profile.event_key)
    order = ", ".join(f"`{n}`" for n in (c.time, *profile.ties_of(rows), _SIGNAL))
    place = f"partition by {key} order by {order}"
    signal = F.col(_SIGNAL)
    reported = F.when(signal.kind == G.REPORT_CHECK, F.col(c.time))
    so_far = Window.partitionBy(*profile.event_key).orderBy(c.time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "_cell": F.when(is_true(signal.handover), F.struct(signal.cell.alias("cell"))), "_step": signal.step})
    rows = rows.withColumns({f"_{name}{k}": _lead(f"_{name}", k, place) for name in ("cell", "step") for k in (1, 2)})
    done = (F.col("_step") == "sent") & (F.col("_step1") == "received") & (F.col("_step2") == "completed")
    rows = rows.withColumns({"_done": F.when(done, F.col(c.time)), _SEGMENT: F.max(reported).over(so_far)})
    rows = rows.withColumns({f"_done{k}": _lead("_done", k, place) for k in (1, 2)})

    def short(later: str, earlier: str) -> Column:
        return F.col(later).cast("double") - F.col(earlier).cast("double") <= profile.pingpong_seconds

    return rows.withColumns({
        "_handed": is_true(signal.handover & (signal.target == F.col("_cell1.cell")) & (signal.target == F.col("_cell2.cell"))),
        "_pingpong": is_true(short("_done1", "_done") & short("_done2", "_done1"))})


def _partial(rows: DataFrame, profile: Profile) -> DataFrame:
    """Sums, extremes and flags by window, stretch between reports, cell, channel and network code."""
    time = F.col(profile.columns.time)
    radio, signal, access = F.col(_RADIO), F.col(_SIGNAL), F.col(_ACCESS)
    other = signal.kind != G.REPORT_CHECK
    if profile.skips_empty_checks:
        other = other & (signal.kind != "")
    flags = {"Other_Class": other, "Reestablish_Answered": signal.answers, "Reestablish_Done": signal.done,
             "Handed_Over": F.col("_handed"), "Pingpong": F.col("_pingpong"), "Rach_Asked": access.asks & ~access.answers,
             "Rach_Answered": access.answers, "Rach_Other": ~access.asks & ~access.answers}
    first = {"Poor_Time": R.poor_radio(radio.rsrp, radio.sinr, profile), "Roaming_Time": signal.roams,
             "First_Report_Time": signal.check == G.REPORT_CHECK, "First_Sync_Time": signal.check == G.SYNC_CHECK,
             "Reestablish_Time": signal.asks, "Rach_Time": access.asks}
    measures = [F.count(signal.event).alias("_signals"), F.count(F.when(signal.isNotNull(), 1)).alias("Signalling_Rows"),
                F.max(F.when(signal.kind == G.REPORT_CHECK, time)).alias(R.LAST_REPORT)]
    for name in ("rsrp", "sinr"):
        measures += [F.sum(radio[name]).alias(f"_{name}_sum"), F.count(radio[name]).alias(f"_{name}_n"),
                     F.min(radio[name]).alias(f"_{name}_min")]
    if _BLER in rows.columns:
        bler = F.col(_BLER).bler
        first["Bler_Time"] = bler > profile.bler_ceiling
        measures += [F.sum(bler).alias("_bler_sum"), F.count(bler).alias("_bler_n")]
    measures += [F.max(is_true(condition).cast("int")).alias(name) for name, condition in flags.items()]
    measures += [F.min(F.when(condition, time)).alias(name) for name, condition in first.items()]
    return rows.groupBy(*profile.event_key, KIND, START, END, _SEGMENT, "_context", radio.channel.alias("_channel"),
                        radio.cell.alias("_of_cell"), signal.code.alias("_code")).agg(*measures)


_SUMS = ("Signalling_Rows", "_rsrp_sum", "_rsrp_n", "_sinr_sum", "_sinr_n", "_bler_sum", "_bler_n")
_LEAST = ("_rsrp_min", "_sinr_min", "Poor_Time", "Roaming_Time", "First_Report_Time", "First_Sync_Time", "Reestablish_Time",
          "Rach_Time", "Bler_Time")
_MOST = (R.LAST_REPORT, "Other_Class", "Reestablish_Answered", "Reestablish_Done", "Handed_Over", "Pingpong", "Rach_Asked",
         "Rach_Answered", "Rach_Other")
_FLAGS = _MOST[1:]
_SETS = {"_channels": "_channel", "_cells": "_of_cell", "_codes": "_code"}


def _again(rows: DataFrame) -> list[Column]:
    """Partial results of several groups in one."""
    found = []
    for names, merge in ((_SUMS, F.sum), (_LEAST, F.min), (_MOST, F.max), (("_context",), F.min)):
        found += [merge(name).alias(name) for name in names if name in rows.columns]
    return found


def merged_facts(merged: DataFrame, profile: Profile) -> DataFrame:
    """One row per window with all facts that a diagnosis needs, from the tagged stream."""
    key = [*profile.event_key, KIND, START, END]
    partial = _partial(_sequences(in_windows(merged, profile), profile), profile)
    stretches = partial.groupBy(*key, _SEGMENT).agg(
        *_again(partial), *[F.collect_set(value).alias(name) for name, value in _SETS.items()])
    last = F.struct("_cells", "_rsrp_sum", "_rsrp_n", "_sinr_sum", "_sinr_n")
    facts = stretches.groupBy(*key).agg(
        *_again(stretches), F.max_by(last, _SEGMENT).alias("_last"),
        *[F.array_distinct(F.flatten(F.collect_list(name))).alias(name) for name in _SETS])

    def average(name: str, place: str = "") -> Column:
        return F.when(F.col(f"{place}_{name}_n") > 0, F.col(f"{place}_{name}_sum") / F.col(f"{place}_{name}_n"))

    digits = profile.digits
    columns = {
        R.CHANNELS: set_text(F.col("_channels")), R.CELLS: set_text(F.col("_cells")),
        R.RSRP_AVG: F.round(average("rsrp"), digits), R.RSRP_MIN: F.round("_rsrp_min", digits),
        R.SINR_AVG: F.round(average("sinr"), digits), R.SINR_MIN: F.round("_sinr_min", digits),
        G.NETWORK_CODES: empty_to_null(set_text(F.col("_codes"))),
        "Signalling_Rows": F.nullif("Signalling_Rows", F.lit(0).cast("long")),
        R.CELL_COUNT_LAST: F.coalesce(F.size("_last._cells"), F.lit(0)), R.CELL_LAST: set_text(F.col("_last._cells")),
        R.RSRP_LAST_EXACT: average("rsrp", "_last."), R.SINR_LAST_EXACT: average("sinr", "_last."),
        **{name: F.nullif(F.col(name) > 0, F.lit(False)) if name in ("Handed_Over", "Pingpong") else F.col(name) > 0
           for name in _FLAGS},
        profile.columns.time: F.when(F.col("_context").isNotNull(), F.col(END)),
    }
    if "_bler_n" in facts.columns:
        columns[R.BLER_AVG] = F.round(average("bler"), digits)
    facts = facts.withColumns(columns).withColumns({
        R.RSRP_LAST: F.round(R.RSRP_LAST_EXACT, digits), R.SINR_LAST: F.round(R.SINR_LAST_EXACT, digits)})
    context = [n for n in S.CONTEXT_COLUMNS if n in merged.schema[_EVENT].dataType["context"].dataType.names]
    facts = facts.withColumns({name: F.col(f"_context.{name}") for name in context})
    return facts.drop(*[name for name in facts.columns if name.startswith("_")])
