"""Command-line jobs: read the probe tables, analyse, write one result table.

    python -m callcause.jobs drop --tables DIR --out DIR
    python -m callcause.jobs relations --tables DIR --out DIR --format csv
    python -m callcause.jobs drop --tables SCHEMA --source jdbc --read-option url=URL --read-option driver=CLASS --out DIR

``spark.checkpoint.dir`` must name a folder that all executors share; what a job keeps there goes when it ends.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from callcause import schemas as S
from callcause.operators.relations import suspected_missing_relations
from callcause.plans import updates
from callcause.plans.diagnosis import diagnose
from callcause.plans.services import diagnose_services
from callcause.profile import DATA_DROP, DATA_DROP_V1, TRAFFIC_FAIL, TRAFFIC_FAIL_V1, Profile
from callcause.session import settle, workspace
from callcause.sources import sinks, tables

Keep = Callable[[DataFrame], DataFrame]

PROFILES = {name: profile.with_(max_slice_rows=1_000_000) for name, profile in {
    "drop": DATA_DROP, "fail": TRAFFIC_FAIL, "drop-v1": DATA_DROP_V1, "fail-v1": TRAFFIC_FAIL_V1}.items()}


def diagnosis_job(spark: SparkSession, folder: str, profile: Profile, source: str = "parquet",
                  services: Sequence[str] = (), options: Mapping[str, str] | None = None,
                  keep: Keep = settle) -> DataFrame:
    """Diagnosis in its output schema; with services, of their devices alone."""
    probes = tables.read_probe_tables(spark, folder, source, profile.version, profile.tie, options)
    if services:
        devices = tables.read_table(spark, tables.place_of(folder, "Devices", source),
                                    ["ServiceName", "Device"], source, **(options or {}))
        found = diagnose_services(probes, devices, services, profile, keep=keep)
    else:
        found = diagnose(probes, profile, keep)
    schema = S.DIAGNOSIS_V2 if profile.version == "v2" else S.DIAGNOSIS_V1
    return sinks.nan_to_null(sinks.conform(found, schema))


def relations_job(spark: SparkSession, folder: str, profile: Profile = DATA_DROP,
                  source: str = "parquet", options: Mapping[str, str] | None = None, keep: Keep = settle) -> DataFrame:
    """Suspected missing relations of all devices in their output schema."""
    rows = tables.read_table(spark, tables.place_of(folder, "Signalling", source), S.WIDE_SIGNALLING_COLUMNS, source,
                             profile.tie, **(options or {}))
    return sinks.nan_to_null(sinks.conform(suspected_missing_relations(rows, profile, keep), S.MISSING_RELATION))


def _pairs(texts: Sequence[str]) -> dict[str, str]:
    return dict(text.split("=", 1) for text in texts)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("job", choices=[*PROFILES, "relations"])
    parser.add_argument("--tables", required=True, help="folder with the probe tables")
    parser.add_argument("--out", required=True, help="folder of the result")
    parser.add_argument("--source", default="parquet", help="format of the probe tables")
    parser.add_argument("--format", default="parquet", help="format of the result")
    parser.add_argument("--services", default="", help="comma separated services; all devices without")
    parser.add_argument("--text-times", action="store_true", help="write times as text")
    parser.add_argument("--by-day", action="store_true",
                        help="lay a diagnosis by day of the failure; days that it does not hold stay as they are")
    parser.add_argument("--read-option", action="append", default=[], metavar="NAME=VALUE", help="option of the source")
    parser.add_argument("--write-option", action="append", default=[], metavar="NAME=VALUE", help="option of the result")
    parser.add_argument("--show", type=int, default=0, help="print this many rows as well")
    chosen = parser.parse_args(arguments)

    spark = (SparkSession.builder.appName(f"callcause-{chosen.job}")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    read, write = _pairs(chosen.read_option), _pairs(chosen.write_option)
    with workspace(spark) as keep:
        if chosen.job == "relations":
            version, result = "v2", relations_job(spark, chosen.tables, DATA_DROP, chosen.source, read, keep)
        else:
            profile = PROFILES[chosen.job]
            services = [name for name in chosen.services.split(",") if name]
            version = profile.version
            result = diagnosis_job(spark, chosen.tables, profile, chosen.source, services, read, keep)
        layout = {}
        if chosen.by_day and chosen.job != "relations":
            result = updates.by_day(result)
            layout, write = {"partition_by": [updates.DAY]}, {"partitionOverwriteMode": "dynamic", **write}
        if chosen.text_times:
            result = sinks.times_as_text(result, sinks.MICROSECOND_TEXT if version == "v2" else sinks.DATE_TEXT)
        if chosen.format == "csv":
            write = {"header": "true", **write}
        sinks.write_table(result, chosen.out, chosen.format, **layout, **write)
    if chosen.show:
        sinks.preview(tables.read_table(spark, chosen.out, result.columns, chosen.format, **write), chosen.show)


if __name__ == "__main__":
    main()
