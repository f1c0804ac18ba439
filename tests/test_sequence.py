"""Sliced scans against a plain reading of the definition."""

import random

import pytest
from frames import at
from pyspark.sql import functions as F

from callcause.operators.sequence import (Following, LastKnown, NextKnown, Previous, RunningSum,
                                          Series, scan)
from callcause.operators.cuts import find_cuts, position
from callcause.session import settle

NAMES = ["previous", "next1", "next2", "next3", "total", "last", "ahead"]


def steps():
    value = F.col("v")
    return dict(zip(NAMES, [Previous(value), Following(value), Following(value, 2), Following(value, 3),
                            RunningSum(value), LastKnown(value), NextKnown(value)]))


def expected(rows):
    """By definition, one key at a time."""
    out = []
    for key in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        values = [r[3] for r in own]
        for i, row in enumerate(own):
            def pick(j):
                return values[j] if 0 <= j < len(own) else None
            known = [v for v in values[:i + 1] if v is not None]
            later = [v for v in values[i + 1:] if v is not None]
            out.append((key, row[1], row[2], pick(i - 1), pick(i + 1), pick(i + 2), pick(i + 3),
                        sum(known) if known else None, known[-1] if known else None,
                        later[0] if later else None))
    return out


def make(seed, count=120):
    source = random.Random(seed)
    # One key holds most rows; times repeat, so the tie column matters; gaps leave slices empty.
    return [("hot" if source.random() < 0.7 else source.choice("abc"),
             source.choice([source.randrange(0, 60), source.randrange(500, 520)]), i,
             source.choice([None, source.randrange(100)])) for i in range(count)]


@pytest.mark.parametrize("seed,chunk", [(1, 1), (2, 7), (3, 10_000), (4, None)])
def test_scan_equals_the_definition(spark, seed, chunk):
    rows = make(seed)
    frame = spark.createDataFrame([(k, at(t), n, v) for k, t, n, v in rows],
                                  "k string, t timestamp, n int, v long").repartition(5)
    series = Series(("k",), "t", ("n",), chunk)
    found = scan(frame, series, steps())
    assert set(found.columns) == {"k", "t", "n", "v", *NAMES}
    got = sorted(((r.k, (r.t - at(0)).total_seconds(), r.n, *[r[s] for s in NAMES])
                  for r in found.collect()), key=lambda r: r[:3])
    assert got == expected(rows)


def test_peers_share_the_last_known_value(spark):
    frame = spark.createDataFrame([(at(1), 1, 5), (at(2), 2, None), (at(2), 3, 7), (at(9), 4, None)],
                                  "t timestamp, n int, v long").withColumn("k", F.lit(1))
    for chunk in (None, 1):
        series = Series(("k",), "t", (), chunk)
        found = scan(frame, series, {"last": LastKnown(F.col("v"), peers=True)}).collect()
        assert {r.n: r["last"] for r in found} == {1: 5, 2: 7, 3: 7, 4: 7}


@pytest.mark.parametrize("chunk", [None, 1])
def test_peers_share_with_a_tie_column_too(spark, chunk):
    frame = spark.createDataFrame([(at(1), 1, None), (at(1), 2, 7), (at(1), 3, 9), (at(1), 4, None), (at(2), 5, None)],
                                  "t timestamp, n int, v long").withColumn("k", F.lit(1))
    found = scan(frame, Series(("k",), "t", ("n",), chunk), {"last": LastKnown(F.col("v"), peers=True)}).collect()
    assert {r.n: r["last"] for r in found} == {1: 9, 2: 9, 3: 9, 4: 9, 5: 9}


@pytest.mark.parametrize("chunk", [None, 3])
def test_rows_of_one_instant_have_an_order_without_tie_columns(spark, chunk):
    rows = [(k, at(t), n, v) for k, t, n, v in make(6)]
    source, answers = random.Random(0), []
    for parts in (1, 5):
        source.shuffle(rows)
        frame = spark.createDataFrame(rows, "k string, t timestamp, n int, v long").repartition(parts)
        found = scan(frame, Series(("k",), "t", (), chunk), steps()).collect()
        answers.append(sorted((tuple(r[c] for c in ("k", "t", "n", *NAMES)) for r in found), key=lambda r: r[:3]))
    assert answers[0] == answers[1]


def test_a_scan_runs_no_job(spark):
    frame = spark.range(1000).selectExpr("id % 2 as k", "timestamp_seconds(id) as t", "id as v")
    spark.sparkContext.setJobGroup("scan", "scan")
    try:
        scan(frame, Series(("k",), "t", (), 10), {"total": RunningSum(F.col("v"))})
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("scan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("seed,longest,tie", [(1, 10, ("n",)), (2, 3, ("n",)), (3, 25, ()), (5, 1, ("n",))])
def test_a_scan_with_cuts_equals_the_definition(spark, seed, longest, tie):
    rows = make(seed)
    frame = settle(spark.createDataFrame([(k, at(t), n, v) for k, t, n, v in rows],
                                         "k string, t timestamp, n int, v long").repartition(5))
    cuts = find_cuts(frame, ("k",), ("t", *tie), longest, settle)
    found = scan(frame, Series(("k",), "t", ("n",), None, cuts), steps())
    assert set(found.columns) == {"k", "t", "n", "v", *NAMES}
    got = sorted(((r.k, (r.t - at(0)).total_seconds(), r.n, *[r[s] for s in NAMES])
                  for r in found.collect()), key=lambda r: r[:3])
    assert got == expected(rows)


def test_peers_share_across_cuts(spark):
    frame = settle(spark.createDataFrame([(at(1), n, n if n % 3 else None) for n in range(20)] + [(at(2), 30, None)],
                                         "t timestamp, n int, v long").withColumn("k", F.lit(1)))
    cuts = find_cuts(frame, ("k",), ("t", "n"), 4, settle)
    found = scan(frame, Series(("k",), "t", ("n",), None, cuts), {"last": LastKnown(F.col("v"), peers=True)}).collect()
    assert {r["last"] for r in found} == {19} and len(found) == 21


def test_only_long_series_are_cut_and_no_slice_is_long(spark):
    """A burst within one second, even one instant, is split; quiet keys stay whole."""
    burst = spark.range(1000).selectExpr("1 as k", "timestamp_seconds(3600) as t", "id as n")
    quick = spark.range(500).selectExpr("2 as k", "timestamp_micros(id) as t", "0L as n")
    quiet = spark.range(90).selectExpr("cast(null as int) as k", "timestamp_seconds(id * 100000) as t", "id as n")
    frame = settle(burst.union(quick).union(quiet))
    assert find_cuts(frame, ("k",), ("t", "n"), 1000, settle) is None
    cuts = find_cuts(frame, ("k",), ("t", "n"), 100, settle)
    placed = cuts.place(frame).withColumn("slice", position(F.col("_borders"), F.struct(F.col("t").alias("o0"), F.col("n").alias("o1"))))
    counts = {(r.k, r.slice): r["count"] for r in placed.groupBy("k", "slice").count().collect()}
    assert {key[0] for key in counts} == {1, 2, None} and counts[None, None] == 90
    assert max(counts.values()) <= 100 and len(counts) >= 16
    # By time alone the thousand rows of one instant are one slice, and known to need several parts.
    splits = {r.k: max(r._splits) for r in find_cuts(frame, ("k",), ("t",), 100, settle).frame.collect()}
    assert splits[1] >= 10 and splits[2] == 1


def test_a_sliced_scan_shuffles_by_key_and_slice(spark):
    frame = spark.range(100).selectExpr("id % 2 as k", "timestamp_seconds(id) as t", "id as v")
    found = scan(frame, Series(("k",), "t", (), 10), {"total": RunningSum(F.col("v"))})
    assert "hashpartitioning(k" in found._jdf.queryExecution().toString()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(k#" in line and "_slice" in line for line in text.splitlines())
