"""Quality of texts, by a sparse ensemble of rules over statistics of the text.

Shallow boosted trees propose conjunctions of thresholds, every path from a root
to a node being one; a lasso logistic regression keeps few of them; and the kept
rules become one Spark expression, so scoring runs inside the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from callcause.llm.byte_gru import held_out

# Labelled rows that the fit sees at most, chosen by the hash of their id.
TRAIN_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTY = 0.002
THRESHOLD = 0.3
RESULTS = ("score", "predicted")
_BUCKETS = 1_000_003


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; all are 0 or so for an empty one."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[ \t\r\n\x0B\f]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")

    def share(left_over: str) -> Column:
        return F.length(F.regexp_replace(text, left_over, "")) / chars

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "upper": share(r"[^\p{Lu}]++"),
        "symbols": share(r"[^#$%&*@^~<>={}\[\]_+/\\|]++"),
        "bars": share(r"[^|]++"),
        "shouts": share(r"[^!?]++"),
        "digits": share(r"[^0-9]++"),
        "stops": share(r"[^.,;:]++"),
        "spaces": share(r"[^ \t\r\n]++"),
        "word_chars": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": n_words / n_lines,
    }


@dataclass(frozen=True)
class Rule:
    """All of its conditions: (statistic, whether above, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        found = F.lit(True)
        for name, above, at in self.conditions:
            found = found & ((F.col(name) > at) if above else (F.col(name) <= at))
        return found

    def holds(self, names: list[str], x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for name, above, at in self.conditions:
            found &= (x[:, names.index(name)] > at) == above
        return found


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; the score is the logistic function of their sum."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _split(x: np.ndarray, g: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float] | None:
    """The cut that takes most squared error off the gradients of these rows."""
    best = None
    total, n = g[rows].sum(), len(rows)
    for k, places in enumerate(cuts):
        if not len(places):
            continue
        which = np.searchsorted(places, x[rows, k], "left")  # value <= place from that index on
        sums = np.cumsum(np.bincount(which, g[rows], len(places) + 1))[:-1]
        counts = np.cumsum(np.bincount(which, minlength=len(places) + 1))[:-1]
        fine = (counts >= 5) & (counts <= n - 5)
        if fine.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fine, sums**2 / counts + (total - sums) ** 2 / (n - counts), -np.inf)
            at = int(gain.argmax())
            if best is None or gain[at] > best[0] + 1e-12:
                best = (float(gain[at]), k, float(places[at]))
    return best if best and best[0] > total**2 / n + 1e-9 else None


def propose_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH,
                  seed: int = 5) -> list[Rule]:
    """The paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(column, np.linspace(0.01, 0.99, 64)))[:-1] for column in x.T]
    found: dict[Rule, None] = {}
    margin = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        half = rng.permutation(len(x))[:max(len(x) // 2, min(len(x), 20))]
        usable = [c if rng.random() < 0.7 else c[:0] for c in cuts]
        open_: list[tuple[np.ndarray, np.ndarray, tuple]] = [(half, np.arange(len(x)), ())]
        for level in range(depth):
            after = []
            for rows, everyone, path in open_:
                best = _split(x, g, rows, usable) if len(rows) >= 10 else None
                if best is None:
                    after.append((rows, everyone, path))
                    continue
                _, k, at = best
                for above in (False, True):
                    mine = rows[(x[rows, k] > at) == above]
                    all_mine = everyone[(x[everyone, k] > at) == above]
                    longer = path + ((names[k], above, at),)
                    found[Rule(longer)] = None
                    after.append((mine, all_mine, longer))
            open_ = after
        for rows, everyone, _ in open_:
            if len(rows):
                margin[everyone] += 0.5 * g[rows].sum() / (h[rows].sum() + 1)
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean logistic loss plus penalty * sum |weight|, by accelerated proximal steps."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    ones = np.concatenate([x, np.ones((n, 1))], axis=1)
    v = np.random.default_rng(0).standard_normal(k + 1)
    for _ in range(30):  # largest eigenvalue, for the step length
        v = ones.T @ (ones @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(v @ (ones.T @ (ones @ v))), 1e-9)
    now = ahead = np.append(w, b)
    t = 1.0
    for _ in range(steps):
        gradient = ones.T @ (1 / (1 + np.exp(-ones @ ahead)) - y) / n
        new = ahead - rate * gradient
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - now)
        now, t = new, t_new
    return now[:k], float(now[k])


def fit(names: list[str], x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Ensemble:
    """An ensemble for labels 0 and 1; without any row it scores 0.5."""
    if not len(y):
        return Ensemble((), (), 0.0)
    if y.min() == y.max():
        return Ensemble((), (), 4.0 if y[0] else -4.0)
    rules = propose_rules(names, x, y)
    if not rules:
        return Ensemble((), (), float(np.log(y.mean() / (1 - y.mean()))))
    holds = np.stack([r.holds(names, x) for r in rules], axis=1).astype(float)
    weights, intercept = lasso_logistic(holds, y, penalty)
    stays = np.flatnonzero(np.abs(weights) > 1e-3)
    return Ensemble(tuple(rules[i] for i in stays), tuple(float(weights[i]) for i in stays), intercept)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality",
          train_rows: int = TRAIN_ROWS) -> Ensemble:
    """Fit on at most about ``train_rows`` labelled rows; null labels, ids and texts of unknown documents do not count."""
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
    total = known.count()
    draw = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(_BUCKETS)) / F.lit(float(_BUCKETS))
    chosen = known.filter(draw < min(1.0, train_rows / max(total, 1))).limit(2 * train_rows)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    stats = statistics(F.col("_read"))
    # At most 2 * train_rows ids with a label each.
    rows = (docs.select(F.col(id_column).alias("_id"), whole.alias("_read")).join(F.broadcast(chosen), "_id")
            .select("_y", *[c.alias(n) for n, c in stats.items()]).limit(4 * train_rows).toPandas())
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return fit(list(stats), rows[list(stats)].to_numpy(float), rows["_y"].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns with score (0 to 1) and predicted. Null counts as empty. Input columns of the result's names give way."""
    stats = statistics(F.col("_read"))
    others = [c for c in docs.columns if c not in RESULTS]
    clash = {n: f"_stat_{n}" for n in stats}
    renamed = Ensemble(tuple(Rule(tuple((clash[n], a, t) for n, a, t in r.conditions)) for r in ensemble.rules),
                       ensemble.weights, ensemble.intercept)
    read = docs.withColumn("_read", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return (read.withColumns({clash[n]: c for n, c in stats.items()}).withColumn("score", renamed.column())
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*others, "score", "predicted"))


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    apart = held_out(F.col("doc_id"))
    ensemble = train(documents, labels.filter(~apart))
    return score(documents.select("doc_id", apart.alias("held_out"), "text"), ensemble).select(
        "doc_id", "held_out", "score", "predicted")
