"""Diagnosis of the devices that run given services."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from callcause.plans.diagnosis import ProbeTables, diagnose
from callcause.profile import Profile
from callcause.session import settle
from callcause.sources.tables import find_devices, of_devices


def diagnose_services(tables: ProbeTables, devices: DataFrame, services: Sequence[str],
                      profile: Profile, stacked: bool = False,
                      keep: Callable[[DataFrame], DataFrame] | None = settle) -> DataFrame:
    """One run over the devices of all services; ``stacked`` runs each service and unites the results.

    Both give the same rows, because the device is part of every key.
    """
    if stacked:
        parts = [diagnose(of_devices(tables, find_devices(devices, name)), profile, keep) for name in services]
        return reduce(DataFrame.unionByName, parts)
    chosen = devices.filter(F.col("ServiceName").isin(*services)).select("Device").distinct()
    return diagnose(of_devices(tables, chosen), profile, keep)
