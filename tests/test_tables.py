import math
import os
import shutil
from datetime import datetime

import pytest
from frames import DROP, SETUP, accesses, at, blers, config, events_with_context, report, samples, wide_signals

from callcause import jobs, schemas as S
from callcause.session import new_path, settle, shared_folder, workspace
from callcause.sources import sinks, tables


def test_conform_gives_names_order_and_types(spark):
    frame = spark.range(1).selectExpr("7L as Device", "'x' as Analysis", "1 as Extra")
    shaped = sinks.conform(frame, S.DIAGNOSIS_V2)
    assert [(f.name, f.dataType) for f in shaped.schema] == [(f.name, f.dataType) for f in S.DIAGNOSIS_V2]
    assert (shaped.first().Device, shaped.first().MsgId) == (7, None)


def test_nan_becomes_null_and_times_become_text(spark):
    frame = spark.createDataFrame([(math.nan, at(1.5), "s"), (2.0, None, "t")], "d double, Time timestamp, s string")
    clean = sinks.times_as_text(sinks.nan_to_null(frame)).collect()
    assert [tuple(r) for r in clean] == [(None, "2024-01-01 00:00:01.500000", "s"), (2.0, None, "t")]
    assert sinks.times_as_text(frame, sinks.DATE_TEXT).first().Time == "2024-01-01"


def test_files_and_catalog_tables_give_the_rows_back(spark, tmp_path):
    frame = spark.range(10).selectExpr("id", "id % 2 as half", "concat('v', id) as text")
    for target in ("parquet", "orc", "json"):
        place = str(tmp_path / target)
        sinks.write_table(frame, place, target, partition_by=["half"])
        back = spark.read.schema(frame.schema).format(target).load(place).select(*frame.columns)
        assert back.exceptAll(frame).count() == 0 and back.count() == 10
    sinks.write_csv(frame, str(tmp_path / "csv"))
    assert tables.read_table(spark, str(tmp_path / "csv"), ["text"], "csv", header=True).count() == 10


def test_devices_of_a_service(spark):
    devices = spark.createDataFrame([("DL", 5), ("DL", 2), ("DL", 2), ("UL", 9)], "ServiceName string, Device int")
    rows = spark.createDataFrame([(2, "a"), (5, "b"), (9, "c")], "Device int, v string")
    everyone = tables.find_devices(devices, "DL")
    assert sorted(r.v for r in tables.only_devices(rows, everyone).collect()) == ["a", "b"]
    first = tables.find_devices(devices, "DL", first_only=True)
    assert [r.v for r in tables.only_devices(rows, first).collect()] == ["a"]
    assert tables.only_devices(rows, tables.find_devices(devices, "none", first_only=True)).count() == 0


def test_jdbc_reads_ranges_of_the_time_column():
    class Reader:
        def jdbc(self, *args, **options):
            self.asked = (args, options)
            return self

        def select(self, *columns):
            self.columns = columns
            return self

    class Session:
        read = Reader()

    found = tables.read_jdbc(Session(), "jdbc:x", "t", ["a"], datetime(2024, 1, 1), datetime(2024, 2, 1), 8, driver="d")
    assert found.columns == ("a",) and found.asked[0] == ("jdbc:x", "t")
    assert found.asked[1] == dict(column="Time", lowerBound="2024-01-01 00:00:00", upperBound="2024-02-01 00:00:00",
                                  numPartitions=8, properties={"driver": "d"})


def test_jdbc_options_reach_reader_and_writer():
    asked = {}

    class Io:
        def format(self, name):
            asked["format"] = name
            return self

        def mode(self, name):
            asked["mode"] = name
            return self

        def options(self, **given):
            asked.update(given)
            return self

        def option(self, name, value):
            asked[name] = value
            return self

        def save(self):
            asked["saved"] = True

    class Frame:
        write = Io()

    sinks.write_table(Frame(), "out.t", "jdbc", url="jdbc:x", driver="d")
    assert asked == {"format": "jdbc", "mode": "overwrite", "url": "jdbc:x", "driver": "d", "dbtable": "out.t", "saved": True}
    assert tables.place_of("probes", "Event_NR", "jdbc") == "probes.Event_NR"
    assert tables.place_of("/data/", "Event_NR", "parquet") == "/data/Event_NR"


def test_times_without_zone_and_spare_tie_columns(spark, tmp_path):
    frame = spark.sql("select timestamp_ntz'2024-01-01 00:00:05' as Time, 1 as Device, 4 as MsgId, 'x' as other")
    frame.write.parquet(str(tmp_path / "naive"))
    found = tables.read_table(spark, str(tmp_path / "naive"), ["Time", "Device"], more=["MsgId", "none"])
    assert found.columns == ["Time", "Device", "MsgId"]
    assert dict(found.dtypes)["Time"] == "timestamp" and found.first().Time == at(5)


def test_settled_frames_live_in_the_checkpoint_folder(spark):
    frame = settle(spark.range(5))
    (file, *_) = frame.inputFiles()
    assert shared_folder(spark).removeprefix("file:") in file and frame.count() == 5
    assert new_path(spark, "a") != new_path(spark, "a")


def test_a_workspace_leaves_nothing(spark):
    with workspace(spark) as keep:
        frame = keep(spark.range(7))
        (file, *_) = frame.inputFiles()
        assert frame.count() == 7
    assert not os.path.exists(os.path.dirname(file.removeprefix("file:").replace("///", "/")))


def test_no_folder_is_made_up():
    class Unset:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        shared_folder(Unset)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("probes")
    spare = "'0' as DimensionColumnsId"
    signalling = wide_signals(spark, [
        (1, "5GNR rrcSetupRequest", 40, 7, None), (2, S.RECONFIGURATION, 40, 7, config()),
        (3, S.REPORT, 40, 7, report())]).selectExpr(
            "*", "1 as NetworkModeId", "1 as CarrierId", "1 as SectorId", "1 as DeviceId", "1 as FileId", spare,
            "1 as Epoch", "double('nan') as Longitude")
    frames = {
        "Event_NR": events_with_context(spark, [(0, SETUP, 1, 0.5), (9, DROP, 2, 1.5)]),
        "MEAS_NR": samples(spark, [(5, 1, 1, -120.0, 1.0)]),
        "Signalling": signalling,
        "RACH_NR": accesses(spark, [(1, 1, 1)]).selectExpr("*", "1 as RACHT_NR5G_CRNTI", "1 as RACHA_NR5G_numAttmpt"),
        "PHYDL_NR": blers(spark, [(1, 1.0)]),
        "Devices": spark.createDataFrame([("DL", 1), ("UL", 2)], "ServiceName string, Device int"),
    }
    for name, frame in frames.items():
        frame.write.parquet(str(folder / name))
    return str(folder)


def test_jobs_read_and_write(spark, stored, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.builder), "getOrCreate", lambda self: spark)
    jobs.main(["drop", "--tables", stored, "--out", str(tmp_path / "drop"), "--services", "DL,UL", "--show", "1"])
    row = spark.read.parquet(str(tmp_path / "drop")).first()
    assert row.Analysis == "Poor RF condition"
    assert row.Failed_Event_Number == 1 and row.NR5G_PCC_RSRP_Avg == -120.0
    for _ in range(2):  # the second run rewrites the same days
        jobs.main(["drop", "--tables", stored, "--out", str(tmp_path / "days"), "--services", "DL,UL", "--by-day"])
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.drop("Failure_Day").exceptAll(spark.read.parquet(str(tmp_path / "drop"))).count() == 0
    assert days.count() == spark.read.parquet(str(tmp_path / "drop")).count() > 0
    # v1 has no use for block errors, and the table may be missing.
    shutil.move(os.path.join(stored, "PHYDL_NR"), str(tmp_path / "away"))
    jobs.main(["drop-v1", "--tables", stored, "--out", str(tmp_path / "v1"), "--text-times", "--format", "csv"])
    old = spark.read.csv(str(tmp_path / "v1"), header=True).first()
    assert old.Event_Analysis_End_Time == "2024-01-01" and "PHYDL_NR5G_PCC_BLER_Avg" not in old
    jobs.main(["relations", "--tables", stored, "--out", str(tmp_path / "rel")])
    found = spark.read.parquet(str(tmp_path / "rel"))
    assert found.columns == [f.name for f in S.MISSING_RELATION]
    assert [(r.T_PCI, r.T_Freq, r.Longitude) for r in found.collect()] == [(41, 129870, None)]


def test_example_of_the_readme(spark, stored, tmp_path):
    from callcause.plans.diagnosis import diagnose
    from callcause.profile import Profile
    from callcause.sources.tables import read_probe_tables

    if not os.path.exists(os.path.join(stored, "PHYDL_NR")):
        blers(spark, [(1, 1.0)]).write.parquet(os.path.join(stored, "PHYDL_NR"))
    probes = read_probe_tables(spark, stored)
    assert "MsgId" in probes.signalling.columns
    with workspace(spark) as keep:
        diagnose(probes, Profile(marker="Drop"), keep).write.parquet(str(tmp_path / "diagnosis"))
    assert spark.read.parquet(str(tmp_path / "diagnosis")).first().Analysis == "Poor RF condition"
