"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learned by cyclic boosting: round after round, feature after feature, a
tree of three leaves is fitted to the gradient of the logistic loss and a small share of it is added to the table. Then
the pairs whose joint bins explain most of what is left get tables of their own, boosted the same way. A score is the
sum of one entry per table: bins by binary search, then additions, vectorised over the rows of an Arrow batch.

The fit reads a bounded sample (see ``_stats.labelled``) on the driver; scoring runs over every whole text in Spark.
Defined results: null and empty texts are scored like any text (all statistics 0); without labelled rows every score is
0.5; repeated rows are scored each; a null id is carried through and counts as not held out; inputs are statistics of
the text alone; a very long text is read whole, alone in its chunk; a value on the edge of a bin (a tie) belongs to the upper one, and a
score of exactly 0.5 is predicted 1; an empty table of documents gives no rows and a constant model; other columns, whatever
their names, are left out by ``classify`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _stats
from ._bytes import chunks, mapped

BINS, PAIR_BINS = 48, 8
ROUNDS, PAIR_ROUNDS, RATE = 250, 120, 0.1
PAIRS = 8
LEAST_IN_LEAF = 15
SMOOTH = 1.0


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values near the quantiles; the ends of the range get finer ones, where junk sits."""
    share = np.concatenate([np.linspace(0, 1, bins + 1)[1:-1], [0.002, 0.005, 0.01, 0.99, 0.995, 0.998]])
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    at = np.clip(np.searchsorted(values, np.quantile(x, np.sort(share))), 1, len(values) - 1)
    return np.unique((values[at] + values[at - 1]) / 2)


def _leaf(g: float, h: float) -> float:
    return g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values by bin of the tree of up to three leaves that fits the gradient best."""

    def split(a: int, b: int) -> tuple[float, int]:
        cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
        gain = cg[:-1] ** 2 / (ch[:-1] + SMOOTH) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + SMOOTH) - cg[-1] ** 2 / (ch[-1] + SMOOTH)
        gain[(cn[:-1] < LEAST_IN_LEAF) | (cn[-1] - cn[:-1] < LEAST_IN_LEAF)] = 0
        if not len(gain) or gain.max() <= 0:
            return 0.0, 0
        return float(gain.max()), a + int(gain.argmax()) + 1

    leaves = [(0, len(g))]
    for _ in range(2):
        best = max((split(a, b) + (a, b) for a, b in leaves), default=(0.0, 0, 0, 0))
        if best[0] <= 0:
            break
        leaves.remove(best[2:])
        leaves += [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def learn(x: np.ndarray, good: np.ndarray) -> Model:
    if not len(x) or len(set(good.tolist())) < 2:
        return Model()
    rate = np.clip(good.mean(), 1e-6, 1 - 1e-6)
    model = Model(float(np.log(rate / (1 - rate))))
    model.edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    total = np.full(len(x), model.intercept)
    count = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(bins[f], good - p, len(table)), np.bincount(bins[f], p * (1 - p), len(table)), count[f])
            table += step
            total += step[bins[f]]
    # Pairs: the gain of the best constant per joint bin on what the tables leave.
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]
    p = 1 / (1 + np.exp(-total))
    worth = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            cell = coarse[a] * width[b] + coarse[b]
            g, h = np.bincount(cell, good - p, width[a] * width[b]), np.bincount(cell, p * (1 - p), width[a] * width[b])
            worth.append((float((g * g / (h + SMOOTH)).sum()), -a, -b))
    model.pairs = [(-a, -b) for _, a, b in sorted(worth, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((width[a], width[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            # Two shallow trees: one along each side of the pair, within the better half of the other.
            cell = coarse[a] * width[b] + coarse[b]
            g, h, n = (np.bincount(cell, w, width[a] * width[b]).reshape(width[a], width[b]) for w in (good - p, p * (1 - p), None))
            best = None
            for cut in range(1, width[a]):
                parts = [_tree(g[s].sum(0), h[s].sum(0), n[s].sum(0)) for s in (slice(0, cut), slice(cut, None))]
                gain = sum(float((t * g[s].sum(0) - 0.5 * t * t * h[s].sum(0)).sum()) for t, s in zip(parts, (slice(0, cut), slice(cut, None)), strict=True))
                if best is None or gain > best[0]:
                    best = gain, cut, parts
            if best is None:
                continue
            step = np.vstack([np.tile(best[2][0], (best[1], 1)), np.tile(best[2][1], (width[a] - best[1], 1))]) * RATE
            table += step
            total += step[coarse[a], coarse[b]]
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            score = model.score(_stats.features(_stats.counts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = _stats.documents(df, id_col, text_col).transform(mapped, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text the model doesn't reject."""

    rest = [c for c in df.columns if c != text_col]
    inner = df.select(df[text_col].alias("text"), F.struct(F.lit(0).alias("_"), *[df[c] for c in rest]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array(model.score(_stats.features(_stats.counts(batch.column("text")))) >= 0.5))

    out = inner.transform(mapped, run, inner.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = _stats.SAMPLE) -> Model:
    return learn(*_stats.labelled(_stats.documents(df, id_col, text_col), labels, sample))
