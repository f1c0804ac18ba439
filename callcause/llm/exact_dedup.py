"""Exact duplicates by digest, with frequent digests kept out of the shuffle.

Misra-Gries summaries of every task name the digests that may be frequent. Their
exact counts are taken, and the few winners are broadcast: their rows are
answered where they are read. All other digests meet in an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from callcause.llm.common import Kept, without

# A digest is frequent from one part in FREQUENT of the rows; a task's summary has COUNTERS counters.
FREQUENT = 512
COUNTERS = 8_192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: Column) -> Column:
    """SHA-256 (hex) of a text after lower-casing A-Z only; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER).cast("binary"), 256)


def summarise(rows: Iterator[pd.DataFrame], counters: int = COUNTERS) -> Iterator[pd.DataFrame]:
    """Misra-Gries over the digests of a task: at most ``counters`` digests with lower bounds of
    their counts, and one row without a digest that says by how much any count may be too low."""
    held: dict[bytes, int] = {}
    lost = 0
    for batch in rows:
        for value, count in batch["_digest"].value_counts().items():
            held[value] = held.get(value, 0) + int(count)
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            lost += cut
            held = {value: count - cut for value, count in held.items() if count > cut}
    yield pd.DataFrame({"_digest": [*held, None], "n": [*held.values(), lost]})


def frequent_digests(digests: DataFrame, frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """Digests that may reach one part in ``frequent`` of all rows; never misses one that does.

    With ``counters`` at least twice ``frequent`` there are at most 2 * ``frequent`` + 1 of them.
    """
    if counters < 2 * frequent:
        raise ValueError("counters must be at least twice frequent")
    summaries = digests.select("_digest").mapInPandas(
        lambda rows: summarise(rows, counters), "_digest binary, n long")
    merged = summaries.groupBy("_digest").agg(F.sum("n").alias("n"))
    total = digests.count()
    lost = merged.filter("_digest is null").agg(F.sum("n")).first()[0] or 0
    least = max(total / frequent - lost, 1)
    return merged.filter(F.col("_digest").isNotNull() & (F.col("n") >= least)).select("_digest")


def mark_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id",
                    frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: its id, ``_row``, keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id stays; a null id is smaller than
    any other, and of rows that repeat an id one stays. Null and empty texts are
    equal. An empty table gives an empty result. ``_row`` numbers the rows of
    the kept digests and has no other meaning.
    """
    kept = Kept(docs.sparkSession)
    digests = kept.keep(docs.select(
        F.col(id_column).alias("_id"), F.unhex(digest(F.col(text))).alias("_digest"),
        F.monotonically_increasing_id().alias("_row")), "digests")
    found = kept.keep(frequent_digests(digests, frequent, counters), "frequent")

    best = F.max(F.struct(F.col("_id"), F.col("_row")))
    summary = (best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    # At most 2 * frequent + 1 rows by the bound above: safe to broadcast.
    winners = kept.keep(digests.join(F.broadcast(found), "_digest").groupBy("_digest").agg(*summary), "winners")
    marked = digests.join(F.broadcast(winners), "_digest", "left")
    hot = marked.filter(F.col("_best").isNotNull())
    rest = marked.filter(F.col("_best").isNull()).select("_id", "_digest", "_row")
    cold = rest.join(rest.groupBy("_digest").agg(*summary), "_digest")
    return hot.unionByName(cold).select(
        F.col("_id").alias(id_column), "_row", F.col("_best._id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text one stays."""
    marks = mark_duplicates(docs, text, id_column)
    lost = marks.filter(~F.col("kept"))
    stays = marks.filter("kept").select(F.col(id_column).alias("_keep"), F.col("text_sha256").alias("_hash"))
    mine = docs.withColumn("_hash", digest(F.col(text)))
    left = mine.join(stays, mine["_hash"].eqNullSafe(stays["_hash"]) & mine[id_column].eqNullSafe(stays["_keep"]),
                     "left_semi").drop("_hash")
    # Only rows that repeat both id and text are left to part; look for them by id before paying for it.
    repeats = lost.filter(F.col(id_column).eqNullSafe(F.col("keep_id"))).limit(1).count()
    if not repeats:
        return left
    keyed = left.withColumn("_hash", digest(F.col(text)))
    return keyed.dropDuplicates([id_column, "_hash"]).drop("_hash")


def query(documents: DataFrame) -> DataFrame:
    marks = mark_duplicates(without(documents, RESULTS))
    return marks.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
  from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from d
"""
