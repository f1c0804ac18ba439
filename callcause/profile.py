"""Settings of an analysis: column names, marker texts, thresholds and switches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from callcause.operators.cuts import Cuts, find_cuts
from callcause.operators.sequence import Series

AUTO = "auto"


@dataclass(frozen=True)
class Columns:
    """Names of the columns the detectors read (fixed values of the input tables)."""

    time: str = "Time"
    device: str = "Device"
    work_order: str = "WorkOrderId"
    call_event: str = "Event_CallEvent"
    message_id: str = "MsgId"
    channel: str = "MEAS_NR5G_PCC_NARFCN"
    cell: str = "MEAS_NR5G_PCC_PCI"
    rsrp: str = "MEAS_NR5G_PCC_RSRP_AVG"
    sinr: str = "MEAS_NR5G_PCC_SNR_AVG"
    rrc_event: str = "RRC_NR5G_event"
    rrc_cell: str = "RRC_NR5G_pci"
    rrc_frequency: str = "RRC_NR5G_frequency"
    rrc_message: str = "RRC_NR5G_message"
    rach_reason: str = "RACHT_NR5G_RACHReason"
    rach_result: str = "RACHA_NR5G_RACHResult"
    bler: str = "PHYDL_NR5G_PCC_bler"


@dataclass(frozen=True)
class Profile:
    """One analysis. The defaults are the time-ordered ("v2") drop analysis.

    ``keys`` cut a call log into independent series. ``join_keys`` decide which
    probe rows may fall into a window: the same keys (strict), or the device
    alone, so that rows of its other work orders count too.

    ``tie`` names columns that order rows of one instant, where a table has
    them; its other columns follow, so the order is always total.
    ``slice_seconds`` is the time slice by which rows and windows meet in
    interval joins; a few times the usual length of a window is a good width.
    ``chunk_seconds`` cuts all series into time slices of one width (see
    ``operators.sequence``). ``"auto"`` leaves the cuts to the analyses, which
    count the series of a stored table once: those of more than
    ``max_series_rows`` rows get borders of their own (``cuts``, see
    ``operators.cuts``), so that a device with a large share of all rows is
    spread over many tasks and all others stay whole. Single operators work on
    whole series unless ``cuts`` are given.

    ``max_slice_rows`` splits the time slices of interval joins in the same way:
    a slice of one key with more probe rows than that is cut at their times, and
    rows of one instant are dealt over several tasks. None counts nothing.
    """

    marker: str = "Drop"
    setup_text: str = '"Setup Start"'
    end_text: str = '"Call End"'
    keys: tuple[str, ...] = ("Device", "WorkOrderId")
    join_keys: tuple[str, ...] = ("Device", "WorkOrderId")
    tie: tuple[str, ...] = ("MsgId",)
    slice_seconds: int = 900
    chunk_seconds: int | str | None = "auto"
    max_series_rows: int = 1_000_000
    max_slice_rows: int | None = None
    cuts: Cuts | None = None
    rsrp_floor: float = -110.0
    sinr_floor: float = 0.0
    bler_ceiling: float = 10.0
    pingpong_seconds: float = 5.0
    digits: int = 2
    version: str = "v2"
    # None takes the habit of the version: v2 ignores rows without a class, v1 counts them.
    ignore_empty_checks: bool | None = None
    # True reads "one serving cell" as "the joined text is shorter than five characters".
    legacy_single_pci: bool = False
    # True leaves the ping-pong tag out of a v2 diagnosis.
    legacy_pingpong_v2: bool = False
    columns: Columns = field(default_factory=Columns)

    def __post_init__(self) -> None:
        if self.version not in ("v1", "v2"):
            raise ValueError(f"version must be v1 or v2, not {self.version!r}")
        if not set(self.join_keys) <= set(self.keys):
            raise ValueError("join_keys must be a subset of keys")

    def series(self, keys: tuple[str, ...] | None = None) -> Series:
        """How rows of one key, or of the given keys, follow each other."""
        keys = keys or self.keys
        cuts = self.cuts if self.cuts is not None and self.cuts.keys == tuple(keys) else None
        return Series(keys, self.columns.time, self.tie, self.fixed_slice, cuts)

    @property
    def fixed_slice(self) -> int | None:
        return None if self.chunk_seconds == AUTO else self.chunk_seconds

    def sized(self, stored: DataFrame, keep: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] | None = None) -> "Profile":
        """With the cuts that the series of a stored table ask for; counts them if the width is left open."""
        if self.chunk_seconds != AUTO:
            return self
        keys = keys or self.keys
        order = (self.columns.time, *[n for n in self.tie if n in stored.columns and n not in keys])
        return self.with_(cuts=find_cuts(stored, keys, order, self.max_series_rows, keep))

    def ties_of(self, rows: DataFrame, *known: str) -> list[str]:
        """The tie columns that a frame has, less keys, time and those that are known."""
        return [n for n in self.tie if n in rows.columns and n not in (*self.keys, self.columns.time, *known)]

    @property
    def event_key(self) -> tuple[str, ...]:
        """Columns that identify one failed event."""
        return (*self.keys, "Failed_Event_Number")

    @property
    def skips_empty_checks(self) -> bool:
        if self.ignore_empty_checks is None:
            return self.version == "v2"
        return self.ignore_empty_checks

    @property
    def pingpong_tag(self) -> str:
        return "PingPong Handover" if self.version == "v2" else "Ping_Pong Handover"

    def with_(self, **changes) -> "Profile":
        return replace(self, **changes)


DATA_DROP = Profile()
TRAFFIC_FAIL = Profile(marker="Traffic Fail")
DATA_DROP_V1 = Profile(version="v1")
TRAFFIC_FAIL_V1 = Profile(marker="Traffic Fail", version="v1")
