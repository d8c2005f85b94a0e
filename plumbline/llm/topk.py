"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

Vectors are scaled to integers, floor(1024 * x). For a query q and a row x, ``2 * <q, x> = |q|^2 + |x|^2 - |q - x|^2``,
and cut into segments of m components, ``|q - x|^2 >= sum of m * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)``.
Levels of 1, 2, 4, ... segments give ever closer lower bounds of the distance, so upper bounds of the score; a row
survives a level if its bound reaches the query's k-th best score so far, and survivors of all levels get exact scores.

The query set (every row whose id is divisible by ``every``) grows with the table, so it stays in Spark. Rows are dealt once to
blocks of up to ``ROW_BYTES`` of vectors, which a task holds with their statistics, and every query passes by each block, in
batches: a copy of a query a block is what an exact search has to ship, so blocks are as large as memory allows (but at least
``LEAST_BLOCKS`` while rows are enough, so that tasks share the work). A block returns a query's best k rows only if they
reach its threshold. Thresholds come from earlier, smaller searches: of one in STEP rows, and before that of one in
STEP * STEP, down to ``SAMPLE`` rows; the k-th best score of any part of the rows is no more than that of all. So about STEP * k rows come
back a query and search, whatever the number of blocks. Nothing but two counts passes through the driver, and nothing is broadcast.

Doubles are exact while ``|q| * |x|`` is below 2**53. Where it may not be, products in doubles with a bound of their
rounding only pick the pairs that can be among the best, and these are scored in integers of any length.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, nor does a null id;
a score beyond a long is given as the nearest long and still ranked by its exact value; vectors of different lengths aren't compared; repeated rows each count as candidates;
ties go to the smaller id; a query row that is repeated is one query; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import mapped
from pyspark.sql import types as T

K = 10
EVERY = 100
SCALE = 1024
#: Bytes of vectors (8 a component) that a task holds; rows that make a block of their own as long as there are few blocks.
ROW_BYTES, ROW_BLOCK, LEAST_BLOCKS = 96 << 20, 8192, 64
#: A search is prepared by one of every STEP-th row, by hash, if that leaves SAMPLE rows or more.
STEP, SAMPLE = 64, 16_384
#: Rows and queries of one step of the search in a task.
ROWS, QUERIES = 2048, 256
#: Kinds of vectors: products of two PLAIN ones (scaled, shorter than 2**26) are exact in doubles, those of LARGE ones are
#: near, and HUGE ones (a component beyond HUGE_FROM, whose products can leave the range of a double) are kept as integers.
PLAIN, LARGE, HUGE = range(3)
HUGE_FROM = 2.0**390
SCHEMA = "query_id long, vec_id long, score long, beyond binary"
_LEAST, _MOST = -(2**63), 2**63 - 1


def scaled(column: pa.Array, ids: pa.Array) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By length and kind: ids and the integer vectors (as doubles, of the huge kind as objects) of the rows that take part."""
    groups: dict[tuple[int, int], tuple[list, list]] = {}
    for i, v in zip(ids.to_pylist(), column, strict=True):
        if i is None or not v.is_valid or v.values.null_count or not len(v.values):
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        most = np.abs(x).max()
        if not np.isfinite(most):
            continue
        if most > HUGE_FROM:
            kind, x = HUGE, np.array([int(c) * SCALE if abs(c) > 2.0**53 else math.floor(SCALE * c) for c in x.tolist()], object)
        else:
            x = np.floor(SCALE * x)
            kind = PLAIN if x @ x < 2.0**52 else LARGE
        at = groups.setdefault((len(x), kind), ([], []))
        at[0].append(i)
        at[1].append(x)
    return {n: (np.array(a, np.int64), np.stack(b)) for n, (a, b) in groups.items()}


def _below(score: int | float) -> float:
    """A double that isn't above the score."""
    try:
        near = float(score)
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else -math.inf
    return near if near <= score else math.nextafter(near, -math.inf)


def _long(score: int) -> tuple[int, bytes]:
    """The nearest long, and bytes that order the scores which share one of its ends."""
    if _LEAST < score <= _MOST:
        return score, b""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (_MOST, raw) if score > 0 else (_LEAST, bytes(255 - x for x in raw))


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; a level is worth its cost only while it is far smaller than the vector."""
    out, n = [], 1
    while n <= dim // 4:
        out.append(n)
        n *= 4
    return out or [1]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row sqrt(m) * (means, deviations): half-open segments of near-equal length; distances of these bound |q - x|."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, dev]) * np.sqrt(np.tile(size, 2))


def row_statistics(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    return (x * x).sum(1), [statistics(x, n) for n in levels(x.shape[1])]


class Block:
    """Queries of one length and kind with their statistics and the best k so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, kind: int = PLAIN, least: np.ndarray | None = None):
        self.ids, self.x, self.k, self.kind = ids, x, k, kind
        if kind != HUGE:
            self.norm = (x * x).sum(1)
        if kind == PLAIN:
            self.stats = [statistics(x, n) for n in levels(x.shape[1])]
        self.least = np.full(len(ids), -np.inf) if least is None else least  # no more than the k-th best score
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-score, id), in order

    def search(self, ids: np.ndarray, x: np.ndarray, kind: int = PLAIN, known: tuple | None = None) -> None:
        """``known``: what row_statistics gives for the rows."""
        if max(kind, self.kind) == PLAIN:
            self._search_plain(ids, x, *(known or row_statistics(x)))
        elif max(kind, self.kind) == LARGE:
            self._search_large(ids, x)
        else:
            for at in range(len(self.ids)):
                self._keep_exact(at, ids, x, np.flatnonzero(ids != self.ids[at]))

    def _search_large(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Doubles and a bound of their rounding pick the pairs that are scored exactly."""
        size = np.sqrt((x * x).sum(1))
        for a in range(0, len(self.ids), QUERIES):
            part = slice(a, a + QUERIES)
            near = self.x[part] @ x.T
            off = (x.shape[1] + 8) * 2.0**-52 * np.sqrt(self.norm[part, None]) * size
            high = near + off
            high = high + np.abs(high) * 2.0**-50
            for r in np.flatnonzero((high >= self.least[part, None]).any(1)):
                j = np.flatnonzero((high[r] >= self.least[a + r]) & (ids != self.ids[a + r]))
                if len(j) > self.k:  # the k-th best is no less than this
                    low = near[r, j] - off[r, j]
                    low = low - np.abs(low) * 2.0**-50
                    j = j[high[r, j] >= np.partition(low, len(j) - self.k)[len(j) - self.k]]
                self._keep_exact(a + r, ids, x, j)

    def _keep_exact(self, at: int, ids: np.ndarray, x: np.ndarray, j: np.ndarray) -> None:
        if not len(j):
            return
        q = [int(c) for c in self.x[at].tolist()]
        found = [(-sum(map(mul, q, map(int, x[i].tolist()))), int(ids[i])) for i in j]
        self._settle(at, found)

    def _search_plain(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, stats: list[np.ndarray]) -> None:
        for a in range(0, len(self.ids), QUERIES):
            part = slice(a, a + QUERIES)
            half = (self.norm[part, None] + norm) / 2
            slack = 1e-9 * half + 1e-6  # of rounding in the bounds
            alive = np.ones(half.shape, bool)
            for mine, theirs in zip(self.stats, stats, strict=True):
                q = mine[part]
                apart = (q * q).sum(1)[:, None] + (theirs * theirs).sum(1) - 2 * (q @ theirs.T)
                alive &= half - apart / 2 + slack >= self.least[part, None]
                if not alive.any():
                    break
            rows = np.flatnonzero(alive.any(1))
            if not len(rows):
                continue
            if alive[rows].mean() > 0.2:  # a dense product is cheaper than picking pairs
                score = self.x[part][rows] @ x.T
                score[~alive[rows]] = -np.inf
            else:
                score = np.full((len(rows), len(x)), -np.inf)
                i, j = np.nonzero(alive[rows])
                score[i, j] = np.einsum("ij,ij->i", self.x[part][rows[i]], x[j])
            for r, s in zip(rows, score, strict=True):
                self._keep(a + r, ids, s)

    def _keep(self, at: int, ids: np.ndarray, score: np.ndarray) -> None:
        if np.isfinite(self.least[at]):
            j = np.flatnonzero(score >= self.least[at])
        else:
            j = np.flatnonzero(np.isfinite(score))
        j = j[ids[j] != self.ids[at]]
        if not len(j):
            return
        if len(j) > self.k:  # ties with the k-th stay
            j = j[score[j] >= np.partition(score[j], len(j) - self.k)[len(j) - self.k]]
            j = j[np.lexsort((ids[j], -score[j]))[: self.k]]
        self._settle(at, list(zip((-score[j]).tolist(), ids[j].tolist(), strict=True)))

    def _settle(self, at: int, found: list[tuple[float, int]]) -> None:
        best = sorted([*self.best[at], *found])[: self.k]
        self.best[at] = best
        if len(best) == self.k:
            self.least[at] = max(self.least[at], _below(-best[-1][0]))


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, in each the rows first, then the queries with their thresholds -> the best k of each query in each block."""
    now: int | None = None
    held: list[tuple[int, int, np.ndarray, np.ndarray, tuple | None]] = []  # length, kind, ids, vectors, statistics
    kinds = (*[pa.int64()] * 3, pa.binary())
    for batch in batches:
        keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("row_block", "is_query")])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for a, b in zip(np.append(0, edges).tolist(), np.append(edges, batch.num_rows).tolist(), strict=True):
            if int(keys[0, a]) != now:
                now = int(keys[0, a])
                held.clear()
            for at in range(a, b, ROWS):
                part = batch.slice(at, min(ROWS, b - at))
                for (n, kind), (ids, x) in scaled(part.column("embedding"), part.column("vec_id")).items():
                    if not keys[1, a]:
                        held.append((n, kind, ids, x, row_statistics(x) if kind == PLAIN else None))
                        continue
                    # Thresholds are longs, doubles below them are safe.
                    given = dict(zip(part.column("vec_id").to_pylist(), part.column("least").to_pylist(), strict=True))
                    least = np.array([-np.inf if given[i] is None else _below(given[i]) for i in ids.tolist()])
                    block = Block(ids, x, k, kind, least)
                    for m, other, theirs, vectors, known in held:
                        if m == n:
                            block.search(theirs, vectors, other, known)
                    found = [(int(q), i, *_long(int(-s))) for q, best in zip(block.ids, block.best, strict=True) for s, i in best]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["query_id", "vec_id", "score", "beyond"])


def _best(rows: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the queries (vec_id, embedding, least) among the rows."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("row_block")
    held = rows.select(block, F.lit(False).alias("is_query"), "vec_id", "embedding", F.lit(None).cast("long").alias("least"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("row_block"), F.lit(True).alias("is_query"), "vec_id", "embedding", "least")
    pairs = held.unionByName(asked).repartition("row_block").sortWithinPartitions("row_block", "is_query")
    found = pairs.transform(mapped, lambda it: _search(it, k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", row_bytes: int = ROW_BYTES, row_block: int = ROW_BLOCK, step: int = STEP, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest score of each query, its own id left out."""
    element = df.schema[vector_col].dataType.elementType
    vector = df[vector_col] if isinstance(element, (T.FloatType, T.DoubleType)) else df[vector_col].cast("array<double>")
    rows = df.select(df[id_col].cast("long").alias("vec_id"), vector.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.sum(F.size("embedding").cast("long")) * 8).first()
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("least", F.lit(None).cast("long"))
    # About one in ``part`` rows; small searches first, each with the thresholds of the one before.
    part = 1
    while n // (part * step) >= sample:
        part *= step
    while True:
        some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(part)) == 0) if part > 1 else rows
        # Held blocks of bounded bytes; while they are few, more of them, that tasks share the work.
        blocks = max(1, -(-(size or 0) // (part * row_bytes)), min(LEAST_BLOCKS, -(-n // (part * row_block))))
        found = _best(some, queries, blocks, k)
        if part == 1:
            return found
        part //= step
        # A score at the lower end of a long may stand for a lower one, and is no threshold.
        reached = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("reached")).where(F.col("reached") > _LEAST)
        queries = queries.drop("least").join(reached, "vec_id", "left").withColumnRenamed("reached", "least")


#: The same rows in SQL.
ORACLE = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
