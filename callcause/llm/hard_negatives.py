"""Hard negatives of anchor vectors, with score bounds carried along a spanning tree of the anchors.

Anchors are dealt into blocks of near ones, and a minimum spanning tree joins
the anchors of a block. A candidate's score at an anchor lies within edge length
times the candidate's norm of its score, or of its bounds, at the anchor's
parent. So only candidates whose bounds overlap a window of wanted scores are
scored anew; the window shrinks as better candidates are found. Scores are
integers and exact, so bounds only save work and never decide.

Every block meets all rows in one pass over them: the tasks keep the best of
each window and Spark ranks what they found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from callcause.llm.common import Kept, without

# Anchors in a block, and candidate rows that meet them at once.
BLOCK, STEP = 2_048, 2_048
POSITIVES, NEGATIVES = 5, 10
SCALE, LOW_PERCENT, HIGH_PERCENT = 256, 30, 90
EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
# Integers up to here are exact as doubles.
_EXACT = 2.0 ** 53
_LONG = 2 ** 63
# More than the rounding of the bounds' own arithmetic.
_SLACK = 1e-9


def participants(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
                 mislabel: int | None = SHIFT_EVERY) -> DataFrame:
    """(id, label, v) of the rows that take part: id, label and vector known, all components known and finite.

    ``mislabel`` moves the label of ids divisible by it one further, modulo
    LABELS; None leaves labels as they are.
    """
    x = F.col(vector)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    label_, id_ = F.col(label).cast("long"), F.col(id_column).cast("long")
    if mislabel is not None:
        label_ = F.when(id_ % mislabel == 0, (label_ + 1) % LABELS).otherwise(label_)
    return (vectors.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & sound)
            .select(id_.alias("id"), label_.alias("label"), x.cast("array<double>").alias("v")))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Integer components of vectors, one row each; shorter vectors end in zeros, longer ones are cut to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    values = np.nan_to_num(values)  # beyond doubles: the largest of them
    width = max(int(sizes.max(initial=0)), 1) if width is None else width
    if (sizes == width).all():
        return values.reshape(-1, width)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    out[row[place < width], place[place < width]] = values[place < width]
    return out


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * (1 + _SLACK)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for the root, row 0) of each vector in a minimum spanning tree, and the length of the edge to it."""
    n = len(vectors)
    parent, near = np.full(n, -1), np.full(n, np.inf)
    edge, open_ = np.zeros(n), np.ones(n, bool)
    here = 0
    for _ in range(n - 1):
        open_[here] = False
        apart = _lengths(vectors - vectors[here])
        closer = open_ & (apart < near)
        near[closer], parent[closer] = apart[closer], here
        here = int(np.argmin(np.where(open_, near, np.inf)))
        edge[here] = near[here]
    return parent, edge


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """The rows of a tree by their distance from the root."""
    depth = np.full(len(parent), -1)
    found, here = [], np.flatnonzero(parent < 0)
    while len(here):
        depth[here] = len(found)
        found.append(here)
        here = np.flatnonzero(np.isin(parent, here) & (depth < 0))
    return found


@dataclass
class Block:
    """Anchors, their tree, and for each anchor windows of wanted scores (low > high: none)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Search:
    """The best ``count`` rows of each window of a block, of the anchor's own label or of others."""

    def __init__(self, block: Block, count: int, same: bool):
        self.block, self.count, self.same = block, count, same
        self.low = block.low.copy()
        self.best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.levels = levels(block.parent)
        self.reach = np.abs(block.vectors).max(initial=0.0) * block.vectors.shape[1]
        self.scored = self.met = 0

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Let candidates meet all anchors of the block."""
        block = self.block
        if self.reach * np.abs(vectors).max(initial=0.0) >= _EXACT:
            return self._meet_large(ids, labels, vectors)
        norms = _lengths(vectors)
        least, most = np.empty((len(block.ids), len(ids))), np.empty((len(block.ids), len(ids)))
        for depth, anchors in enumerate(self.levels):
            if depth:
                width = block.edge[anchors][:, None] * norms[None, :]
                width += _SLACK * (width + np.abs(most[block.parent[anchors]]) + 1)
                least[anchors] = least[block.parent[anchors]] - width
                most[anchors] = most[block.parent[anchors]] + width
            else:
                least[anchors], most[anchors] = -np.inf, np.inf
            related = (block.labels[anchors][:, None] == labels[None, :]) == self.same
            related &= block.ids[anchors][:, None] != ids[None, :]
            wanted = np.zeros(related.shape, bool)
            for w in range(self.low.shape[1]):
                wanted |= (most[anchors] >= self.low[anchors, w, None]) & (least[anchors] <= block.high[anchors, w, None])
            wanted &= related
            if not depth:  # the root is scored for all, as a place to start from
                rows, columns = np.arange(len(anchors)), np.arange(len(ids))
            else:
                rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
            self.met += wanted.size
            self.scored += len(rows) * len(columns)
            if not len(rows):
                continue
            grid = np.ix_(anchors[rows], columns)
            scores = block.vectors[anchors[rows]] @ vectors[columns].T
            least[grid] = most[grid] = scores
            self._take(anchors[rows], ids[columns], scores, wanted[np.ix_(rows, columns)])

    def _meet_large(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """The same in whole numbers of any size, for components that doubles cannot multiply exactly."""
        block = self.block
        to_int = np.frompyfunc(int, 1, 1)
        scores = to_int(block.vectors).astype(object) @ to_int(vectors).astype(object).T
        scores = np.clip(scores, -_LONG, _LONG - 1)
        wanted = (block.labels[:, None] == labels[None, :]) == self.same
        wanted &= block.ids[:, None] != ids[None, :]
        self._take(np.arange(len(block.ids)), ids, scores, wanted)

    def _take(self, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            good = wanted & (scores >= self.low[anchors, w, None]) & (scores <= self.block.high[anchors, w, None])
            for k in np.flatnonzero(good.any(axis=1)):
                at = np.flatnonzero(good[k])
                if len(at) > self.count:
                    at = at[np.lexsort((ids[at], -scores[k, at]))[:self.count]]
                place = (int(anchors[k]), w)
                found = self.best.get(place, []) + [(-int(s), int(i)) for s, i in zip(scores[k, at], ids[at])]
                found = self.best[place] = sorted(found)[:self.count]
                if len(found) == self.count and (self.low.dtype == object or abs(found[-1][0]) < _EXACT):
                    self.low[place] = max(self.low[place], -found[-1][0])

    def found(self) -> pa.RecordBatch:
        rows = [(int(self.block.ids[k]), w, i, -s) for (k, w), best in self.best.items() for s, i in best]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                          names=["anchor_id", "w", "id", "score"])


def _search(rows: DataFrame, block: Block, count: int, same: bool) -> DataFrame:
    """(anchor_id, w, id, score): what each task found for the windows of a block."""
    def run(batches):
        search = Search(block, count, same)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                search.meet(part.column("id").to_numpy(), part.column("label").to_numpy(),
                            _matrix(part.column("v"), block.vectors.shape[1]))
        yield search.found()

    return rows.mapInArrow(run, "anchor_id long, w int, id long, score long")


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The best of each group; Spark ranks within each task before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _blocks(rows: DataFrame, kept: Kept, anchor: Column, block: int) -> tuple[DataFrame, list[tuple[tuple, tuple]]]:
    """Anchors in pieces (part, cut), near ones together, and the first and last piece of each block of at most ``block``.

    Of rows with an anchor's id the one of least label and vector is the anchor.
    """
    anchors = kept.keep(rows.filter(anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a"))
                        .select("id", "a.label", "a.v"), "anchors")
    parts = -(-anchors.count() // block)
    if not parts:
        return anchors, []
    # Neighbours by label, then along a fixed direction; the id parts equal ones.
    along = F.aggregate("v", F.lit(0.0), lambda s, x: s * 0.9 + x)
    order = F.monotonically_increasing_id()
    placed = (anchors.withColumn("along", along).repartitionByRange(parts, "label", "along", "id")
              .sortWithinPartitions("label", "along", "id").select(
                  "id", "label", "v", F.shiftright(order, 33).alias("part"),
                  F.floor(order.bitwiseAND(F.lit((1 << 33) - 1)) / block).alias("cut")))
    placed = kept.keep(placed, "blocks")
    blocks, room = [], 0  # neighbouring pieces go together while they fit
    for part, cut, count in placed.groupBy("part", "cut").count().orderBy("part", "cut").collect():
        if count > room:
            blocks.append([])
            room = block
        blocks[-1].append((part, cut))
        room -= count
    return placed, [(pieces[0], pieces[-1]) for pieces in blocks]


def _place(piece: tuple[int, int]) -> Column:
    return F.struct(F.lit(piece[0]).cast("long").alias("part"), F.lit(piece[1]).cast("long").alias("cut"))


def mine(rows: DataFrame, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         block: int = BLOCK) -> DataFrame:
    """Hard negatives of (id, label, v) rows: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` tells which rows are anchors (None: ids divisible by EVERY). Scores are inner products of the
    components, each times SCALE and rounded down. Best first, ties by smaller
    id. An anchor's positives are its best rows of the same label and another
    id; a positive's negatives are the best rows of other labels whose score is
    LOW_PERCENT to HIGH_PERCENT of the positive's.

    Rows of one id count as often as they stand, but never for the anchor of
    that id. Of vectors of different lengths the missing components count as
    zero. Scores beyond a long are held at its ends. Anchors without positives,
    and positives without negatives, have no rows, as has an empty table.
    """
    kept = Kept(rows.sparkSession)
    anchor = F.col("id") % EVERY == 0 if anchor is None else anchor
    rows = kept.keep(rows.select("id", "label", "v"), "rows")
    anchors, numbers = _blocks(rows, kept, anchor, block)
    best, hard = None, None
    for first, last in numbers:
        place = F.struct("part", "cut")
        members = anchors.filter((place >= _place(first)) & (place <= _place(last))).select("id", "label", "v").toArrow()
        vectors = _matrix(members.column("v"))
        parent, edge = spanning_tree(vectors)
        all_scores = np.full((len(vectors), 1), np.inf)
        whole = Block(members.column("id").to_numpy(), members.column("label").to_numpy(), vectors, parent, edge,
                      -all_scores, all_scores)
        mine_ = kept.keep(_first(_search(rows, whole, positives, True), ["anchor_id"], positives)
                          .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                          "positives")
        # Positives of equal score share a window; at most ``positives`` windows an anchor.
        where = {int(i): k for k, i in enumerate(whole.ids)}
        low, high = np.full((len(vectors), positives), np.inf), np.full((len(vectors), positives), -np.inf)
        windows, used = [], np.zeros(len(vectors), int)
        wanted = sorted({(r[0], r[2]) for r in mine_.collect()})
        if any(abs(score) >= _EXACT for _, score in wanted):  # ends that doubles would round
            low, high = low.astype(object), high.astype(object)
        for anchor_id, score in wanted:
            k = where[anchor_id]
            low[k, used[k]] = -(-LOW_PERCENT * score // 100)
            high[k, used[k]] = HIGH_PERCENT * score // 100
            windows.append((anchor_id, int(used[k]), score))
            used[k] += 1
        if not windows:
            continue
        found = _search(rows, Block(whole.ids, whole.labels, vectors, parent, edge, low, high), negatives, False)
        ranked = _first(found, ["anchor_id", "w"], negatives)
        named = rows.sparkSession.createDataFrame(windows, "anchor_id long, w int, positive_score long")
        negatives_ = kept.keep(ranked.join(F.broadcast(named), ["anchor_id", "w"]).select(
            "anchor_id", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
            "negatives")
        best = mine_ if best is None else best.unionByName(mine_)
        hard = negatives_ if hard is None else hard.unionByName(negatives_)
    if hard is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                     "positive_score long, negative_score long")
    return best.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(embeddings: DataFrame) -> DataFrame:
    return mine(participants(without(embeddings, ("id", "v"))))


SQL = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
           cast(list_inner_product(a.v, b.v) as bigint) as score
    from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 10
"""
