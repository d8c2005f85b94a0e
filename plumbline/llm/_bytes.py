"""Vectorised helpers over Arrow text columns, used inside Spark tasks.

A *chunk* is a run of rows whose texts hold at most ``CHUNK_BYTES`` bytes together (or one longer row), so what a task
holds beside its Arrow batch is bounded by the chunk, or by a longer text, never by the partition: the functions here
take some 40 to 120 bytes for each byte of a chunk. Compressed bodies are cut by the sizes that their frames state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.RandomState(20240917)
#: Random non-zero values of the bytes, for two independent hashes.
BYTE_1, BYTE_2 = (_rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) for _ in range(2))
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least. Only those for a chunk are kept."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, out=up), np.cumprod(down, out=down)
        if size == CHUNK_BYTES + 4096:
            _powers[base] = have
    return have


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i; see span_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end], wherever the span lies."""
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start])


#: Bytes of an Arrow batch between Spark and a task's Python, where the session has none of its own; Spark's default is 64 MB,
#: of which the executor and the worker hold one or two each.
BATCH, _BATCH_KEY, _BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", ("64m", "67108864", "67108864b")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in batches of bounded bytes."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY).lower() in _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, BATCH)
    return df.mapInArrow(run, schema)


class Texts:
    """The UTF-8 bytes of a text column: data, and offsets of each row. Null counts as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        self.data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(column)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the maximal runs of bytes outside 0x20 and 0x09-0x0D."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        dark = np.zeros(len(self.data) + 1, bool)
        dark[:-1] = ~WHITE[self.data]
        edge = self.offsets[:-1][self.lengths > 0]
        before = np.zeros(len(dark), bool)
        before[1:] = dark[:-1]
        before[edge] = False
        starts = np.flatnonzero(dark & ~before)
        after = np.zeros(len(dark), bool)
        after[:-1] = dark[1:]
        after[edge[1:] - 1] = False
        ends = np.flatnonzero(dark & ~after) + 1
        return starts, ends, self.row_of(starts)


def _slices(batch: pa.RecordBatch, sizes: list[int], limit: int) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most ``limit`` bytes, or one row."""
    for batch in batches:
        yield from _slices(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), limit)


def body_chunks(batches: Iterable[pa.RecordBatch], column: str = "body", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same for compressed bodies, by their size when unpacked."""
    for batch in batches:
        yield from _slices(batch, [zstandard.frame_content_size(x) if x else 0 for x in batch.column(column).to_pylist()], limit)


def compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ...) -> (doc_id, zstd of the UTF-8 bytes, ...): what goes through a shuffle by document."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in chunks(batches):
        texts = Texts(batch.column("text"))
        packed = [pack(texts.data[a:b].tobytes()) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
        more = [c for c in batch.schema.names if c not in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), *(batch.column(c) for c in more)], names=["doc_id", "body", *more])


def unpacked(column: pa.Array) -> list[bytes]:
    one = zstandard.ZstdDecompressor().decompress
    return [one(x) if x else b"" for x in column.to_pylist()]


def mapped_text(df: DataFrame, text_col: str, change: Callable[[], Callable[[list[str | None]], list[str | None]]]) -> DataFrame:
    """The same rows and columns with the text column changed, a chunk at a time. ``change`` is called once per task."""
    rest = [c for c in df.columns if c != text_col]
    inner = df.select(df[text_col].cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[df[c] for c in rest]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = change()
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(one(batch.column("text").to_pylist()), pa.string()), batch.column("rest")], names=["text", "rest"])

    out = mapped(inner, run, inner.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every i with a whole window, by doubling."""
    if len(x) < width:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def window_anchors(hashes: np.ndarray, starts_ok: np.ndarray, gram_ok: np.ndarray, width: int) -> np.ndarray:
    """For each start i of a window of ``width`` grams, the leftmost position of its least hash, -1 where no window is.

    Windows of equal content have their anchor at the same distance, so equal windows share the anchor's hash.
    """
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    key[~gram_ok] = np.uint64(2**64 - 1)
    least = sliding_min(key, width)
    out = np.full(len(hashes), -1, np.int64)
    out[: len(least)] = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out[~starts_ok] = -1
    return out


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals within 0..size, as sorted maximal runs."""
    starts, ends = np.clip(starts, 0, size), np.clip(ends, 0, size)
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x
