"""Packing token streams into fixed-length sequences by Karmarkar-Karp multiway differencing.

``pack`` reads (id, text) rows, encodes every whole text with a public byte-level BPE vocabulary, ends it with one
separator id and cuts it into pieces. Full windows become sequences of their own. What remains of each document is
collected into groups that fill about ``GROUP_WINDOWS`` windows, and each group is dealt to near-equal windows: partial
partitions with opposing imbalances are merged (largest difference first), and the window count rises whenever a window
exceeds the capacity. What is cut is cut before: rests longer than half a window in two, the smallest rests, ``FINE`` of all
ids, into pieces of falling powers of two, which even out the sums, and what the group's windows can't hold is cut off the
longest pieces and waits for the next group. Nothing is shuffled: a task packs the rows it reads, a group at a time, so
a lost task is simply run again and gives the same sequences.

Defined results: a null text is an empty one (one separator id); an empty table gives no rows; repeated rows are packed
once each; a null id is carried through; other columns are left out; a very long text is encoded whole, and only its ids are
held; of partitions with equal differences (ties) the one made first is merged first.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._bytes import chunks, mapped

CAPACITY = 1024
SEPARATOR = 0
#: Windows, and pieces at most, that are packed together; they bound the memory and time of one differencing.
GROUP_WINDOWS, GROUP_PIECES = 340, 8192
#: Share of a group's ids that is cut into fine pieces, the greatest of these, and the share of room left open.
FINE, FINEST, OPEN = 0.04, 64, 0.002
#: Longer texts are read by the tokenizer of the JSON file itself.
FAST_CHARS = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


@functools.cache
def encoder(name: str = "byte_bpe_50k"):
    """text -> ids. The ranks hold the vocabulary of the .json file of the same name and give the same ids, faster.

    Added tokens of the file (the mark of a text's end) are matched in the text, as the file's tokenizer does by default.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @functools.cache
    def plain():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def encode(text: str) -> np.ndarray:
        # Past that size one run of white space or letters can exhaust the pattern engine's stack.
        if len(text) > FAST_CHARS:
            return np.array(plain().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode(text, allowed_special="all"), np.uint32)

    return encode


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: deal the sizes to k bins of near-equal sums. Returns each item's bin and the bins' sums.

    A partial partition is k sums in falling order. The two with the largest spread are merged, the large sums of one
    with the small sums of the other, until one is left.
    """
    n = len(sizes)
    left, right = [np.arange(n + 1)], [np.zeros(n + 1, np.int64)]  # nodes 1..n are the items, 0 is the empty bin
    node, heap = n + 1, []
    for i, size in enumerate(sizes):
        sums, ids = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[0], ids[0] = size, i + 1
        heap.append((-int(size), i, sums, ids))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, a_ids = heapq.heappop(heap)
        _, _, b, b_ids = heapq.heappop(heap)
        sums, b_ids = a + b[::-1], b_ids[::-1]
        both = (a_ids > 0) & (b_ids > 0)
        ids = np.where(a_ids > 0, a_ids, b_ids)
        new = np.flatnonzero(both)
        left.append(a_ids[new])
        right.append(b_ids[new])
        ids[new] = np.arange(node, node + len(new))
        node += len(new)
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, ids))
        tie += 1
    _, _, sums, ids = heap[0]
    bins, left, right = np.zeros(n, np.int64), np.concatenate(left), np.concatenate(right)
    for at, top in enumerate(ids):
        open_ = [top] if top else []
        while open_:
            x = open_.pop()
            if x <= n:
                bins[x - 1] = at
            else:
                open_ += [left[x], right[x]]
    return bins, sums


def windows(sizes: np.ndarray, capacity: int = CAPACITY, count: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Near-equal windows by differencing; every size must be within the capacity. Returns each item's window and the sums.

    The count starts with the least that can hold all (or more, if so told) and rises whenever the capacity is exceeded.
    """
    k = max(1, -(-int(sizes.sum()) // capacity), count)
    while True:
        bins, sums = differencing(sizes, k)
        over = int(np.maximum(sums - capacity, 0).sum())
        if not over:
            return bins, sums
        k += max(1, over // capacity)


Piece = tuple  # (document, start, ids, ids of the document)


def prepared(rests: list[Piece], capacity: int, last: bool) -> tuple[list[Piece], list[Piece]]:
    """(pieces of the group, what waits for the next): all cuts are made here, before the differencing."""

    def parts(piece: Piece, sizes: list[int]) -> list[Piece]:
        ends = np.cumsum(sizes).tolist()
        doc, start, ids, n = piece
        return [(doc, start + a, ids[a:b], n) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    total = sum(len(x[2]) for x in rests)
    pieces, fine = [], 0
    for piece in sorted(rests, key=lambda x: (len(x[2]), x[0] is not None, x[0] or 0, x[1])):  # whatever order they came in
        size = len(piece[2])
        if fine < FINE * total and size > 1:
            fine += size
            sizes, step = [], FINEST
            while size:
                sizes.append(min(step, size))
                size -= sizes[-1]
                step = step // 2 or FINEST
            pieces += parts(piece, sizes)
        elif size > capacity // 2 > 0:
            pieces += parts(piece, [capacity // 2] * (size // (capacity // 2)) + [size % (capacity // 2)] * (size % (capacity // 2) > 0))
        else:
            pieces.append(piece)
    waiting = []
    over = total - int((total // capacity) * capacity * (1 - OPEN))
    if not last and total >= capacity:
        pieces.sort(key=lambda x: len(x[2]))
        while over > 0:
            piece = pieces.pop()
            size = len(piece[2])
            if size > over:
                left, piece = parts(piece, [size - over, over])
                pieces.append(left)
            waiting.append(piece)
            over -= len(piece[2])
    return pieces, waiting


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, tokenizer: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 36
    rests: list[Piece] = []
    rows: list[tuple] = []

    def table() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)
        rows.clear()
        return batch

    def close(last: bool) -> None:
        nonlocal sequence
        pieces, rests[:] = prepared(rests, capacity, last)
        bins, sums = windows(np.array([len(ids) for _, _, ids, _ in pieces], np.int64), capacity)
        filled = np.zeros(len(sums), np.int64)
        for (doc, start, ids, n), at in zip(pieces, bins, strict=True):
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence + int(at), int(filled[at])))
            filled[at] += len(ids)
        sequence += len(sums)

    held = 0
    for batch in chunks(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.uint32(SEPARATOR)).astype("<u4")
            n = len(ids)
            whole = n - n % capacity
            for a in range(0, whole, capacity):
                rows.append((doc, a, capacity, zlib.crc32(ids[a : a + capacity].tobytes()), n, sequence, 0))
                sequence += 1
            if whole < n:
                rests.append((doc, whole, ids[whole:].copy(), n))
                held += n - whole
            if held >= GROUP_WINDOWS * capacity or len(rests) >= GROUP_PIECES:
                close(False)
                held = sum(len(x[2]) for x in rests)
            if len(rows) >= 8192:
                yield table()
    if rests:
        close(True)
    if rows:
        yield table()


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return docs.transform(mapped, lambda it: _packed(it, capacity, tokenizer), SCHEMA)
