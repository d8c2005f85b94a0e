"""Product codes of vectors: one codebook a part, by Lloyd's rounds with Elkan's bounds.

Components become integers, floor(256 * x), and a vector is cut into ``PARTS`` consecutive parts. Each part position has a
codebook of up to ``ENTRIES`` entries, which starts as that part of the vectors of smallest ids. A round assigns every part
to its nearest entry (squared Euclidean distance, ties to the lower index) and then replaces each entry by the floor of the
mean of its parts; unused entries stay. After ``ROUNDS`` rounds parts are assigned once more.

The first assignment measures all distances. Every later one starts from what the one before left in the written state: per
part an upper bound of the distance to its entry and a lower bound of the distance to each entry. An entry's movement is added
to the upper and taken from the lower bounds. An entry can be nearer only if its lower bound, and half its distance from the
part's entry, don't exceed the upper bound; strictly smaller upper bounds rule it out, so entries at equal distances are
always measured. What is left is measured in integers, after the upper bound has been, and compared by (distance, index).
Lower bounds are kept in ``STEPS`` steps of the part's largest, rounded down; upper bounds are rounded up.

State goes through Spark as rows of up to ``BLOCK_BYTES`` of vectors, written as a table in the shared folder in each
round; a task that runs again writes the same rows. With them each task writes the sums of its parts by entry, once for each
part position; these are added up in Spark, and codebooks alone, whose size is bounded by that of ENTRIES vectors, pass
through the driver.

Distances are exact in doubles while 4 * (components of a part) * (greatest component)**2 < 2**53. Parts beyond that, or
whose codebook is, are measured in integers of any length, without bounds.

Defined results: a vector that is null, empty or holds a null or non-finite component is dropped; so is one whose length is
not that of the kept vector of smallest id (of several with that id, the least vector in Spark's order of arrays). A length
that PARTS doesn't divide is cut as evenly as may be. A null id is kept and coded, but is no initial entry; repeated rows
each count, but an id gives one initial entry. Fewer rows than ENTRIES give as many entries; without an id there are none,
and no rows either. Equal labels' errors are added, nulls together. Errors beyond a long are given as the greatest long. Other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import mapped
from ._graph import cut, looked_up, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_BYTES = 1 << 19
STEPS = 31
#: Rounding of a few operations on doubles, relative.
SLACK = 1e-9
_MOST = 2**63 - 1

Book = list[list[int]]  # entries of integer components


def whole(x: np.ndarray) -> list[int]:
    """floor(256 * x), of any size."""
    return [int(c) * SCALE if abs(c) > 2.0**53 else math.floor(SCALE * c) for c in x.tolist()]


def cuts(dim: int, parts: int) -> list[int]:
    return [p * dim // parts for p in range(parts + 1)]


def _exact(x: np.ndarray, y: np.ndarray, length: int) -> bool:
    """Are squared distances between these exact in doubles?"""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(y).max(initial=0)))
    return 4.0 * max(length, 1) * most * most < 2.0**53


class Codebook:
    """One part's entries, their distances from each other, and how far each moved from the book before."""

    def __init__(self, entries: Book, before: Book | None = None):
        self.entries = entries
        self.x = np.array([[float(c) for c in e] for e in entries]).reshape(len(entries), -1)
        apart = np.sqrt(((self.x[:, None, :] - self.x[None]) ** 2).sum(2))
        self.half = apart * (0.5 * (1 - SLACK))
        self.moved = np.array([math.dist(a, b) for a, b in zip(entries, before, strict=True)]) * (1 + SLACK) if before else None

    def measured(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of the rows to all entries, exact for what _exact tells."""
        return (x * x).sum(1)[:, None] + (self.x * self.x).sum(1) - 2 * (x @ self.x.T)

    def nearest_in_integers(self, x: list[list[int]]) -> tuple[np.ndarray, list[int]]:
        best = [min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), j) for j, e in enumerate(self.entries)) for row in x]
        return np.array([j for _, j in best], np.int64), [d for d, _ in best]


def assigned(book: Codebook, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, upper bounds, lower bounds) of the rows after the entries moved, by Elkan's tests."""
    rows = np.arange(len(x))
    upper = upper + book.moved[code]
    lower = np.maximum(lower - book.moved, 0)
    open_ = (lower <= upper[:, None]) & (book.half[code] <= upper[:, None])
    open_[rows, code] = False
    doubt = np.flatnonzero(open_.any(1))
    if len(doubt):
        mine = code[doubt]
        square = ((x[doubt] - book.x[mine]) ** 2).sum(1)
        upper[doubt] = np.sqrt(square) * (1 + SLACK)
        lower[doubt, mine] = np.sqrt(square) * (1 - SLACK)
        tight = open_[doubt] & (lower[doubt] <= upper[doubt, None]) & (book.half[mine] <= upper[doubt, None])
        i, j = np.nonzero(tight)
        found = np.full(tight.shape, np.inf)
        found[np.arange(len(doubt)), mine] = square
        found[i, j] = ((x[doubt[i]] - book.x[j]) ** 2).sum(1)
        lower[doubt[i], j] = np.sqrt(found[i, j]) * (1 - SLACK)
        best = found.argmin(1)  # the first of equals
        code = code.copy()
        code[doubt] = best
        upper[doubt] = np.sqrt(found[np.arange(len(doubt)), best]) * (1 + SLACK)
    return code, upper, lower


_STATE = "part int, ids binary, labels array<string>, plain boolean, vectors binary, bounds binary, sums string"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _restored(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


class Block:
    """Vectors of one kind with the state of their parts: codes, upper and lower bounds."""

    def __init__(self, ids: pa.Array, labels: list, x: np.ndarray, plain: bool):
        self.ids, self.labels, self.x, self.plain = ids, labels, x, plain
        self.code = self.upper = self.lower = None

    @property
    def n(self) -> int:
        return len(self.x)

    def part(self, a: int, b: int) -> np.ndarray:
        return self.x[:, a:b].astype(np.float64)

    def integers(self, a: int, b: int) -> list[list[int]]:
        return [list(map(int, row)) for row in self.x[:, a:b].tolist()] if self.plain else [whole(row) for row in self.x[:, a:b]]

    def assign(self, books: list[Codebook], at: list[int]) -> None:
        first = self.code is None
        codes, uppers, lowers = [], [], []
        for p, book in enumerate(books):
            x = self.part(at[p], at[p + 1])
            if not (self.plain and _exact(x, book.x, x.shape[1])):
                code, _ = book.nearest_in_integers(self.integers(at[p], at[p + 1]))
                upper, lower = np.full(self.n, np.inf), np.zeros((self.n, len(book.entries)))
            elif first or not np.isfinite(self.upper[:, p]).all():
                square = book.measured(x)
                code = square.argmin(1)
                upper, lower = np.sqrt(square[np.arange(self.n), code]) * (1 + SLACK), np.sqrt(square) * (1 - SLACK)
            else:
                code, upper, lower = assigned(book, x, self.code[:, p].astype(np.int64), self.upper[:, p], self.lower[:, p])
            codes.append(code)
            uppers.append(upper)
            lowers.append(lower)
        self.code, self.upper, self.lower = np.stack(codes, 1).astype(np.uint8), np.stack(uppers, 1), np.stack(lowers, 1)

    def bounds(self) -> bytes:
        """Codes, upper bounds rounded up, lower bounds in steps rounded down."""
        upper = self.upper.astype(np.float32)
        upper = np.where(upper < self.upper, np.nextafter(upper, np.float32(np.inf)), upper)
        most = self.lower.max(2, initial=0)
        step = np.where(most > 0, most / STEPS, 1)
        step = np.where(np.isfinite(step), step, 1).astype(np.float32)
        steps = np.clip(np.floor(self.lower / step[:, :, None] * (1 - 1e-6)), 0, STEPS).astype(np.uint8)
        return _squeezed(self.code, upper, step, steps)

    def restore(self, raw: bytes, parts: int, entries: int) -> None:
        data, n, at = _restored(raw), self.n, 0
        held = []
        for kind, shape in ((np.uint8, (n, parts)), (np.float32, (n, parts)), (np.float32, (n, parts)), (np.uint8, (n, parts, entries))):
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            held.append(np.frombuffer(data[at : at + size], kind).reshape(shape))
            at += size
        self.code, self.upper = held[0], held[1].astype(np.float64)
        self.lower = held[3] * held[2].astype(np.float64)[:, :, None]

    def add_to(self, sums: list, at: list[int]) -> None:
        """sums[part]: counts and component sums by entry, as integers of any size."""
        for p in range(len(at) - 1):
            code = self.code[:, p].astype(np.int64)
            counts, totals = sums[p]
            for j, n in enumerate(np.bincount(code, minlength=len(counts)).tolist()):
                counts[j] += n
            if self.plain:
                for c in range(at[p + 1] - at[p]):  # below 2**24 * rows of a block: exact
                    for j, v in enumerate(np.bincount(code, self.x[:, at[p] + c], len(counts)).tolist()):
                        totals[j][c] += int(v)
            else:
                for j, row in zip(code.tolist(), self.integers(at[p], at[p + 1]), strict=True):
                    totals[j] = [a + b for a, b in zip(totals[j], row, strict=True)]

    def row(self) -> pa.RecordBatch:
        ids = self.ids
        raw = _squeezed(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy())
        values = [None, raw, self.labels, self.plain, _squeezed(self.x), self.bounds(), None]
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.string()), pa.bool_(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_NAMES)

    @staticmethod
    def of(row: dict, dim: int, parts: int, entries: int) -> Block:
        n = len(row["labels"])
        raw = _restored(row["ids"])
        ids = pa.array(np.frombuffer(raw[n:], np.int64), mask=~np.frombuffer(raw[:n], bool))
        x = np.frombuffer(_restored(row["vectors"]), np.int32 if row["plain"] else np.float64).reshape(n, dim)
        block = Block(ids, row["labels"], x, row["plain"])
        block.restore(row["bounds"], parts, entries)
        return block


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Block]:
    """Rows (vec_id, label, embedding), all without nulls in vectors of one length, as blocks of bounded size."""
    limit = max(1, BLOCK_BYTES // (8 * dim))
    for batch in batches:
        for a in range(0, batch.num_rows, limit):
            part = batch.slice(a, limit)
            x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            small = (np.abs(x) < 2.0**16).all(1)
            for plain in (True, False):
                mine = np.flatnonzero(small == plain)
                if len(mine):
                    rows = part.take(pa.array(mine))
                    yield Block(rows.column("vec_id"), rows.column("label").to_pylist(), np.floor(SCALE * x[mine]).astype(np.int32) if plain else x[mine], plain)


def _round(blocks: Iterator[Block], books: list[Book], before: list[Book] | None, at: list[int]) -> Iterator[pa.RecordBatch]:
    """Assigns every block, and gives the task's sums at its end."""
    held = [Codebook(book, before[p] if before else None) for p, book in enumerate(books)]
    sums = [([0] * len(book), [[0] * (at[p + 1] - at[p]) for _ in book]) for p, book in enumerate(books)]
    some = False
    for block in blocks:
        block.assign(held, at)
        block.add_to(sums, at)
        some = True
        yield block.row()
    if some:
        empty = [pa.nulls(len(sums), k) for k in (pa.binary(), pa.list_(pa.string()), pa.bool_(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), *empty, pa.array([_written(*x) for x in sums], pa.string())], names=_NAMES)


def _written(counts: list[int], totals: list[list[int]]) -> str:
    return ";".join(",".join(map(str, [n, *total])) for n, total in zip(counts, totals, strict=True))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a part, from all tasks."""
    found: dict[int, list[list[int]]] = {}
    for batch in batches:
        for p, text in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            rows = [list(map(int, x.split(","))) for x in text.split(";")]
            have = found.get(p)
            found[p] = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(have, rows, strict=True)] if have else rows
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([_written([x[0] for x in rows], [x[1:] for x in rows]) for rows in found.values()], pa.string())], names=["part", "sums"])


def _next(state: DataFrame, books: list[Book]) -> list[Book]:
    """Each entry's floored mean; codebooks only pass through the driver."""
    sums = state.where("part IS NOT NULL").select("part", "sums").repartition("part").transform(mapped, _added, "part int, sums string")
    out = [list(book) for book in books]
    for row in sums.collect():  # a row a part
        for j, text in enumerate(row.sums.split(";")):
            n, *total = map(int, text.split(","))
            if n:
                out[row.part][j] = [v // n for v in total]
    return out


_CODES = "vec_id long, label string, code string, error long"


def _final(blocks: Iterator[Block], books: list[Book], before: list[Book], at: list[int]) -> Iterator[pa.RecordBatch]:
    held = [Codebook(book, before[p]) for p, book in enumerate(books)]
    hexes = np.array([f"{i:02x}" for i in range(256)])
    for block in blocks:
        block.assign(held, at)
        error = np.zeros(block.n, object)
        for p, book in enumerate(held):
            x, code = block.part(at[p], at[p + 1]), block.code[:, p]
            if block.plain and _exact(x, book.x, x.shape[1]):
                error += ((x - book.x[code]) ** 2).sum(1).astype(np.int64)
            else:
                error += np.array([sum((a - b) ** 2 for a, b in zip(row, book.entries[j], strict=True)) for row, j in zip(block.integers(at[p], at[p + 1]), code, strict=True)], object)
        codes = ["".join(x) for x in hexes[block.code]]
        yield pa.RecordBatch.from_arrays([block.ids, pa.array(block.labels, pa.string()), pa.array(codes), pa.array([min(e, _MOST) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])


def quantise(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that is kept."""
    element = df.schema[vector_col].dataType.elementType
    vector = df[vector_col] if isinstance(element, (T.FloatType, T.DoubleType)) else df[vector_col].cast("array<double>")
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("string").alias("label"), vector.alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine))
    known = rows.where("vec_id IS NOT NULL")
    least = known.agg(F.min(F.struct("vec_id", "embedding")).alias("x")).first().x
    if least is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(least.embedding)
    rows, known = (df.where(F.size("embedding") == dim) for df in (rows, known))
    last = known.select("vec_id").distinct().orderBy("vec_id").limit(entries).agg(F.max("vec_id")).first()[0]  # ids only are shuffled
    seeds = known.where(F.col("vec_id") <= last).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    at = cuts(dim, parts)
    starts = [whole(np.array(r.embedding, np.float64)) for r in seeds]
    books = [[x[a:b] for x in starts] for a, b in zip(at[:-1], at[1:], strict=True)]
    n = len(starts)
    state, before = None, None
    for _ in range(rounds):
        if state is None:
            new = rows.transform(mapped, lambda it, books=books: _round(_blocks(it, dim), books, None, at), _STATE)
        else:
            new = _read(state).transform(mapped, lambda it, books=books, before=before: _round(_restore(it, dim, parts, n), books, before, at), _STATE)
        state = stored(new)
        before, books = books, _next(state, books)
    codes = _read(state).transform(mapped, lambda it: _final(_restore(it, dim, parts, n), books, before, at), _CODES)
    codes = stored(codes.withColumn("_label", F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")))).withColumn("label", F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit(""))))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    by_label = cut(codes.groupBy("_label", "label").agg(F.count("*").alias("times"), total.alias("label_error")))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return looked_up(codes, by_label, ["_label", "label"], "vec_id").select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _read(state: DataFrame) -> DataFrame:
    return state.where("part IS NULL").select("ids", "labels", "plain", "vectors", "bounds")


def _restore(batches: Iterator[pa.RecordBatch], dim: int, parts: int, entries: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block.of(batch.slice(i, 1).to_pylist()[0], dim, parts, entries)


def _assigned_sql(k: int) -> str:
    return f"""
a{k} AS (
  SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT id, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN book{k} USING (p)) GROUP BY id, p)"""


def _next_sql(k: int) -> str:
    return f"""
means{k + 1} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
    FROM (SELECT p, e, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM parts JOIN a{k} USING (id, p), (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) WHERE i <= len(v) GROUP BY ALL))
  GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k + 1} m USING (p, e))"""


#: The same rows in SQL, without bounds.
ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, p, v[len(v) * p // 16 + 1 : len(v) * (p + 1) // 16] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
seeds AS (SELECT min(id) AS id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 64),
book0 AS (SELECT p, e, v AS c FROM parts JOIN seeds USING (id)),{_assigned_sql(0)},{_next_sql(0)},{_assigned_sql(1)},{_next_sql(1)},{_assigned_sql(2)},
coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (id), books
"""
