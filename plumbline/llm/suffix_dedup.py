"""Removal of repeated byte strings by suffix arrays: per-shard arrays, common prefixes, and a cross-shard merge.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller id, or earlier in the same
document). Sorting every suffix of a corpus would ship each byte a hundred times, so shards hold only what can match:

1. Every window of LENGTH bytes has an *anchor*, the leftmost least-hash gram in it; equal windows have equal anchor
   grams. What repeats within a text is found where the text is read, each text for itself. Grams are counted in Spark
   (two shuffles of about one row per 43 bytes), and only those that two texts hold go on.
2. For each such anchor the stretch of text whose windows it anchors goes to the shard of its gram, each distinct one once
   per text. A gram of more than ``SHARD_ROWS`` of them, be they of many texts or of few that repeat it among other bytes, is
   dealt over as many shards (a power of two) as keep each that small; a stretch has less than twice LENGTH bytes.
3. A shard sorts the suffixes of its stretches by Larsson-Sadakane refinement (groups not yet sorted are split by the
   rank of the suffix h further on, h doubling), finds common prefixes by Kasai's recurrence, and removes all but the
   earliest of each run of windows that share LENGTH bytes.
4. Of grams dealt over several shards, each shard's earliest windows may meet others. Windows of one gram are told apart by
   where in them it stands, ``CLASSES`` ranges of places; equal ones have one range, and the bytes that any window of the
   range has around the gram (``LENGTH`` less a range). A shard gives one row per stretch and range, whose key is these
   bytes' hash; only rows whose key lies in two shards are expanded to their windows. Those meet sorted by window, and
   binary search cuts the merged runs: all but the earliest over all shards go.

Exact copies of a text are settled by its digest: all of a copy of LENGTH bytes or more goes, but for the smallest id.

Defined results: a null text is an empty one; rows with a null id are kept whole; rows that share an id and a text count
as one document (each is returned); of rows that share an id but not a text, those with other than the least digest are kept
whole; an empty table gives no rows; other columns are kept by ``deduplicate`` and left out by ``spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import BASE_1, BASE_2, BYTE_1, BYTE_2, Texts, body_chunks, chunks, compressed, mapped, merged, mix, prefix_hash, signed, span_hash, unpacked, window_anchors
from ._graph import cut, looked_up, stored

LENGTH = 100
GRAM = 16
#: Stretches of one gram that a shard holds, about, and bytes that it sorts at once.
SHARD_ROWS, SHARD_BYTES = 2048, 1 << 19
#: Ranges of places of the gram that the windows of a gram dealt over several shards are told apart by.
CLASSES = 4
#: Bytes of a text's own stretches that are sorted at once, about: whole grams, or one longer one.
OWN_BYTES = 1 << 18


def _eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").ravel().astype(np.uint64)


def window_grams(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the gram at each place, anchor of the window at each place or -1, document end of each place)."""
    eight = _eight_bytes(texts.data)
    hashes = eight * np.uint64(0xD6E8FEB86659FD93)
    hashes[: -(GRAM - 8)] ^= mix(eight[GRAM - 8 :] + np.uint64(0x632BE59BD9B4E019)) if len(eight) > GRAM - 8 else np.uint64(0)
    # 48 bits suffice to count by: what shares a count by chance is told apart by its bytes, and rows are shorter.
    hashes = mix(hashes) >> np.uint64(16)
    end = np.repeat(texts.offsets[1:], texts.lengths)
    left = end - np.arange(len(texts.data))
    return hashes, window_anchors(hashes << np.uint64(16), left >= length, left >= GRAM, length - GRAM + 1), end


def stretches(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor, in text order: first window, number of windows, row, gram, and a hash of the bytes of its windows."""
    hashes, anchors, _ = window_grams(texts, length)
    first = np.flatnonzero((anchors >= 0) & (anchors != np.append(-1, anchors[:-1])))
    windows = np.append(0, np.cumsum(anchors >= 0))
    n = np.diff(windows[np.append(first, len(anchors))])
    body = span_hash(prefix_hash(BYTE_1[texts.data], BASE_1), first, first + n + length - 1, BASE_1)
    return first, n, texts.row_of(first), hashes[anchors[first]], body


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return data[at]


_SPANS = "array<struct<start:int,end:int>>"
_ANCHORS = f"doc_id long, digest_1 long, digest_2 long, grams array<long>, own {_SPANS}, more array<struct<gram:long,n:int>>"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Digest and distinct grams of each text, and what of it repeats within it, by a shard of its own texts."""
    for batch in chunks(batches):
        texts = Texts(batch.column("text"))
        first, n, row, gram, body = stretches(texts, length)
        order = np.lexsort((first, body, gram, row))
        r, g, b = row[order], gram[order], body[order]
        new_gram = np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1]))[: len(order)]
        new_body = new_gram | np.append(True, b[1:] != b[:-1])[: len(order)]
        again = order[~new_body]  # equal to an earlier stretch of the text
        group = np.cumsum(new_gram) - 1
        distinct = np.bincount(group[new_body], minlength=1)
        several = distinct[group] > 1 if len(order) else np.zeros(0, bool)
        mine = order[new_body & several]  # stretches that share a gram but not all bytes, gram by gram
        spans = [(row[again], first[again], first[again] + n[again] + length - 1)]
        size = np.cumsum(n[mine] + length - 1)
        shard = np.maximum.accumulate(np.where(np.append(True, group[new_body & several][1:] != group[new_body & several][:-1])[: len(mine)], (size - n[mine]) // OWN_BYTES, 0)) if len(mine) else size
        for part in np.split(mine, np.flatnonzero(np.diff(shard)) + 1) if len(mine) else ():
            part = np.sort(part)
            size = n[part] + length - 1
            spans.append(sort_stretches(gathered(texts.data, first[part], size), size, row[part], first[part], n[part], length, apart=True)[:3])
        d, a, z = (np.concatenate(x) for x in zip(*spans, strict=True))
        by = np.argsort(d, kind="stable")
        d, a, z = d[by], a[by] - texts.offsets[d[by]], z[by] - texts.offsets[d[by]]
        kept = order[new_gram]
        wide = distinct[: len(kept)] > 1  # grams with several distinct stretches in a text: all beyond the first are counted apart
        digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(texts.data[x:y]), "<i8") for x, y in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]).reshape(-1, 2)

        def listed(rows: np.ndarray, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=texts.n))).astype(np.int32)), values)

        more = pa.StructArray.from_arrays([pa.array(signed(gram[kept[wide]])), pa.array((distinct[: len(kept)][wide] - 1).astype(np.int32))], names=["gram", "n"])
        own = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["start", "end"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), listed(row[kept], pa.array(signed(gram[kept]))), listed(d, own), listed(row[kept[wide]], more)],
            names=["doc_id", "digest_1", "digest_2", "grams", "own", "more"],
        )


def _packer(shared: bytes) -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None, write_checksum=False, write_content_size=True, write_dict_id=False).compress


def _unpacker(shared: bytes) -> Callable[[bytes], bytes]:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None).decompress


_STRETCHES = "gram long, part long, split boolean, doc_id long, start int, n int, body binary"


def _stretches(batches: Iterator[pa.RecordBatch], length: int, shared: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, found: [gram + 2**48 * (1 + log2 of its shards)]) -> the distinct stretches of the text whose gram other texts hold too."""
    pack = _packer(shared)
    for part in body_chunks(batches):
        texts = Texts(pa.array(unpacked(part.column("body")), pa.binary()).view(pa.string()))
        first, n, row, gram, body = stretches(texts, length)
        gram = signed(gram)
        order = np.lexsort((first, body, gram, row))
        new = np.append(True, (row[order][1:] != row[order][:-1]) | (gram[order][1:] != gram[order][:-1]) | (body[order][1:] != body[order][:-1]))[: len(order)]
        mine = np.sort(order[new])
        parts = np.zeros(len(first), np.int64)
        ends = np.searchsorted(row, np.arange(texts.n + 1))
        for i, found in enumerate(part.column("found")):
            packed = found.values.to_numpy()
            known, split = packed & (2**48 - 1), np.left_shift(1, (packed >> 48) - 1)
            by = np.argsort(known)
            at = by[np.minimum(np.searchsorted(known, gram[ends[i] : ends[i + 1]], sorter=by), len(known) - 1)]
            parts[ends[i] : ends[i + 1]] = np.where(known[at] == gram[ends[i] : ends[i + 1]], split[at], 0)
        mine = mine[parts[mine] > 0]
        if not len(mine):
            continue
        docs = part.column("doc_id").to_numpy()[row[mine]]
        start, size = first[mine] - texts.offsets[row[mine]], n[mine] + length - 1
        dealt = np.where(parts[mine] > 1, signed(mix((docs * 31 + start).astype(np.uint64)) >> np.uint64(1)) % parts[mine], 0)
        raw = texts.data
        bodies = pa.array([pack(raw[x:y].tobytes()) for x, y in zip(first[mine].tolist(), (first[mine] + size).tolist(), strict=True)], pa.binary())
        columns = [pa.array(gram[mine]), pa.array(dealt), pa.array(parts[mine] > 1), pa.array(docs), *(pa.array(x.astype(np.int32)) for x in (start, n[mine])), bodies]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STRETCHES.split(", ")])


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first ``depth`` bytes at least, and eight-byte keys of the data.

    Larsson-Sadakane: after sorting by the first h bytes, a suffix's rank is the first place of its group; only groups of
    several are sorted on, by the rank of the suffix h further on. Groups still equal at the depth keep text order.
    """
    n = len(data)
    eight = _eight_bytes(data)
    order = np.argsort(eight)
    key = eight[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(head, n))
    rank = np.zeros(n + depth, np.int64)  # beyond the end: the least rank
    rank[order] = np.repeat(head, size) + 1
    h = 8
    slots = np.flatnonzero(np.repeat(size > 1, size))  # places of the order that aren't settled
    while h < depth and len(slots):
        step = min(h, depth - h)
        mine = order[slots]
        key = (rank[mine] << 32) | rank[mine + step]
        by = np.argsort(key)
        mine, key = mine[by], key[by]
        order[slots] = mine
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(slots)))
        rank[mine] = np.repeat(slots[head], size) + 1
        slots = slots[np.repeat(size > 1, size)]
        h += step
    if len(slots):  # equal up to the depth: in text order
        mine = order[slots]
        order[slots] = np.sort((rank[mine] << 32) | mine) & 0xFFFFFFFF
    return order, eight


def common_prefixes(order: np.ndarray, eight: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Per place of the order: bytes shared with the suffix before it, counted up to ``length``.

    Kasai: read in text order, the common prefix of a suffix is at least that of the suffix one byte earlier less one,
    provided that the follower of the earlier one's neighbour still comes before it; suffixes equal up to the sorted
    depth stand in text order, so that is looked up. The recurrence runs down all stretches (starts, rising) side by
    side; eight bytes are compared at a time.
    """
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.append(-1, order[:-1])
    padded = np.concatenate([eight, np.zeros(length + 8, np.uint64)])
    out = np.zeros(n, np.int64)
    size = np.diff(np.append(starts, n))
    lanes = np.argsort(-size, kind="stable")
    starts, size = starts[lanes], size[lanes]
    have, beside = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -t, "left"))  # stretches longer than t
        i = starts[:live] + t
        at = place[i]
        j = before[at]
        follower = np.minimum(beside[:live] + 1, n - 1)
        h = np.where((beside[:live] >= 0) & (place[follower] < at), np.maximum(have[:live] - 1, 0), 0)
        open_ = np.flatnonzero((j >= 0) & (h < length))
        while len(open_):
            differ = padded[i[open_] + h[open_]] ^ padded[j[open_] + h[open_]]
            equal = differ == 0
            top = differ.astype(np.float64)  # the highest set bit, give or take a rounding up that the next line takes back
            bits = np.where(equal, 0, np.frexp(top)[1])
            bits -= (~equal) & (bits > 0) & ((differ >> np.maximum(bits - 1, 0).astype(np.uint64)) == 0)
            h[open_] += np.where(equal, 8, (64 - bits) // 8)
            open_ = open_[equal & (h[open_] < length)]
        h = np.minimum(h, length)
        have[:live], beside[:live] = h, j
        out[at] = h
    return out


_FOUND = "doc_id long, start int, end int, part long, shared long, body binary"


def sort_stretches(data: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, length: int, apart: bool = False) -> tuple[np.ndarray, ...]:
    """Documents, starts and ends of the removed spans of the stretches (in order of occurrence, their bytes in ``data``),
    then places in ``data`` of the earliest of each distinct window, with the stretch of each place.

    With ``apart`` a window counts as repeated only within its document, whatever else the others hold."""
    starts = np.cumsum(size) - size
    order, eight = suffix_array(data, length)
    prefix = common_prefixes(order, eight, starts, length)
    # Runs of suffixes that share LENGTH bytes; only windows of a stretch count, and text order is order of occurrence.
    lane = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(data)) - starts[lane]
    mine = (within < n[lane])[order]
    order, run = order[mine], np.cumsum(prefix < length)[mine]
    if apart:  # equal windows stand in text order, so those of a document lie together
        of = doc[lane[order]]
        run = np.cumsum(np.append(0, (run[1:] != run[:-1]) | (of[1:] != of[:-1])))[: len(order)]
    earliest = np.full(int(run.max(initial=0)) + 1, len(data), np.int64)
    np.minimum.at(earliest, run, order)
    gone = np.zeros(len(data) + 1, bool)
    gone[order] = order != earliest[run]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
    stop = np.flatnonzero(gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False))) + 1
    a = start[lane[begin]] + within[begin]
    heads = np.sort(earliest[np.unique(run)])
    return doc[lane[begin]], a, a + (stop - begin) + length - 1, heads, lane[heads]


def _sort_shard(rows: list[pa.RecordBatch], length: int, pack, unpack) -> Iterator[pa.RecordBatch]:
    """The removed spans of a shard's stretches, and the earliest windows (with a body) of grams that other shards hold too."""
    table = pa.Table.from_batches(rows).combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending")])
    gram, doc, start, n = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "doc_id", "start", "n"))
    texts = Texts(pa.array([unpack(x) for x in table.column("body").to_pylist()], pa.binary()).view(pa.string()))
    # Equal stretches of one shard: all but the earliest go whole.
    hashes = [span_hash(prefix_hash(b[texts.data], m), texts.offsets[:-1], texts.offsets[1:], m) for b, m in ((BYTE_1, BASE_1), (BYTE_2, BASE_2))]
    order = np.lexsort((np.arange(len(doc)), hashes[1], hashes[0]))
    same = np.append(False, (hashes[0][order][1:] == hashes[0][order][:-1]) & (hashes[1][order][1:] == hashes[1][order][:-1]))
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    again = np.zeros(len(doc), bool)
    again[order] = same & ((doc[order] != doc[lead]) | (start[order] != start[lead]))
    spans = [(doc[again], start[again], start[again] + n[again] + length - 1)]
    alone = np.ones(len(doc), bool)
    alone[order[same]] = False
    # A gram with one stretch left holds no more repeats, unless other shards do.
    dealt = table.column("split").to_numpy()
    _, number, times = np.unique(gram[alone], return_inverse=True, return_counts=True)
    keep = np.flatnonzero(alone)
    keep = keep[(times[number] > 1) | dealt[keep]]
    if len(keep):
        size = texts.lengths[keep]
        data = gathered(texts.data, texts.offsets[:-1][keep], size)
        *found, at, lane = sort_stretches(data, size, doc[keep], start[keep], n[keep], length)
        spans.append(tuple(found))
        more = dealt[keep][lane]
        if more.any():
            at, lane = at[more], lane[more]
            place = at - (np.cumsum(size) - size)[lane] + texts.offsets[:-1][keep[lane]]
            first, last, shared = window_classes(texts, place, keep[lane], length)
            of, a, b = keep[lane[first]], place[first], place[last] + length
            at = start[of] + a - texts.offsets[:-1][of]
            bodies = pa.array([pack(texts.data[x:y].tobytes()) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            yield _found(doc[of], at, at + b - a, table.column("part").to_numpy()[of], shared, bodies)
    d, a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
    yield _found(d, a, b, np.zeros(len(d), np.int64), np.zeros(len(d), np.uint64), pa.nulls(len(d), pa.binary()))


def window_classes(texts: Texts, place: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the windows (rising places, with the row of each) that have one row and one range of places of the gram: first
    and last of each run, and a hash of the bytes around the gram that every window of the range has. Equal windows share it."""
    anchor = window_grams(texts, length)[1][place]
    most = length - GRAM
    width = -(-(most + 1) // CLASSES)
    number = (anchor - place) // width
    new = np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1]))[: len(place)]
    first = np.flatnonzero(new)
    low = number[first] * width
    high = np.minimum(low + width - 1, most)
    shared = span_hash(prefix_hash(BYTE_1[texts.data], BASE_1), anchor[first] - low, anchor[first] - high + length, BASE_1)
    return first, np.append(first[1:], len(place)) - 1, shared


def _found(doc: np.ndarray, start: np.ndarray, end: np.ndarray, part: np.ndarray, shared: np.ndarray, bodies: pa.Array) -> pa.RecordBatch:
    columns = [doc.astype(np.int64), start.astype(np.int32), end.astype(np.int32), part.astype(np.int64), signed(shared)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), bodies], names=[c.split()[0] for c in _FOUND.split(", ")])


def _sort_shards(batches: Iterator[pa.RecordBatch], length: int, shared: bytes) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (gram, part); shards are cut between those groups, so that equal windows stay together."""
    pack, unpack = _packer(shared), _unpacker(shared)
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        gram, part = batch.column("gram").to_numpy(), batch.column("part").to_numpy()
        new = np.append(True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))
        new[0] = last != (gram[0], part[0])
        ends = np.append(np.flatnonzero(new), batch.num_rows)
        lengths = np.append(0, np.cumsum(batch.column("n").to_numpy().astype(np.int64) + length - 1))
        a = 0
        for b in ends:  # what comes before b may be closed at b
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(lengths[b] - lengths[a])
                a = b
            if size >= SHARD_BYTES and b < batch.num_rows:
                yield from _sort_shard(held, length, pack, unpack)
                held, size = [], 0
        last = gram[-1], part[-1]
    if held:
        yield from _sort_shard(held, length, pack, unpack)


def _dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from the beginnings of a few hundred texts. It only makes short stretches smaller to ship."""
    rows = docs.where("text IS NOT NULL").select(F.substring("text", 1, 1500).alias("text")).limit(400).collect()
    samples = [r.text[i : i + 130].encode() for r in rows for i in range(0, len(r.text), 130)]
    try:
        return zstandard.train_dictionary(16_384, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to learn from
        return b""


_WINDOWS = "doc_id long, start int, window_1 long, window_2 long"


def _windows(batches: Iterator[pa.RecordBatch], length: int, shared: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, body) -> the windows of the bodies."""
    unpack = _unpacker(shared)
    for part in body_chunks(batches):
        texts = Texts(pa.array([unpack(x) for x in part.column("body").to_pylist()], pa.binary()).view(pa.string()))
        n = texts.lengths - length + 1
        row = np.repeat(np.arange(texts.n), n)
        within = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        at = texts.offsets[:-1][row] + within
        w = [span_hash(prefix_hash(v[texts.data], m), at, at + length, m) for v, m in ((BYTE_1, BASE_1), (BYTE_2, BASE_2))]
        columns = [part.column("doc_id").to_numpy()[row], (part.column("start").to_numpy()[row] + within).astype(np.int32), signed(w[0]), signed(w[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _WINDOWS.split(", ")])


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (window, doc, start): of each window all but the first row are removed."""
    carried: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, start, w1, w2 = (batch.column(c).to_numpy() for c in ("doc_id", "start", "window_1", "window_2"))
        # Cut the sorted windows at each distinct (w1, w2): the first row of a run is the earliest.
        number = np.cumsum(np.append(0, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        lead = np.searchsorted(number, np.arange(number[-1] + 1), "left")
        lead_doc, lead_start = doc[lead], start[lead]
        if carried and carried[:2] == (w1[0], w2[0]):
            lead_doc[0], lead_start[0] = carried[2:]
        gone = (doc != lead_doc[number]) | (start != lead_start[number])
        carried = (w1[-1], w2[-1], lead_doc[-1], lead_start[-1])
        if gone.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone].astype(np.int64)), pa.array(start[gone].astype(np.int32)), pa.array((start[gone] + length).astype(np.int32))], names=["doc_id", "start", "end"])


def repartitioned(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("gram", "part")


def spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(bodies, removed) of rows (doc_id, text, ...) with an id: every row with its text compressed, and what goes, by id.

    removed has doc_id, lead (the smallest id of the same text), digest_1 and spans (array of start and end in bytes,
    not merged yet; null for copies, of which all goes).
    """
    known = docs.select("doc_id", "text")
    anchors = cut(known.transform(mapped, lambda it: _anchor_rows(it, length), _ANCHORS))
    # One text per id; and of equal texts the smallest id stays.
    texts = anchors.groupBy("doc_id").agg(F.min(F.struct("digest_1", "digest_2", "own")).alias("d")).select("doc_id", "d.*")
    leads = texts.groupBy("digest_1", "digest_2").agg(F.min("doc_id").alias("lead"))
    leads = cut(leads)  # so that the join below is one that adaptive execution can split where many rows are copies
    placed = texts.join(leads, ["digest_1", "digest_2"]).select("doc_id", "digest_1", "lead", F.when(F.col("doc_id") == F.col("lead"), F.col("own")).alias("own"))
    placed = cut(placed)
    seen = anchors.select("doc_id", F.explode("grams").alias("gram"))
    # Nearly all grams have one stretch a text; what others have beyond that is few rows, and lies by gram like the counts.
    beyond = anchors.select(F.explode("more").alias("m")).groupBy("m.gram").agg(F.sum("m.n").alias("beyond"))
    twice = seen.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").join(beyond, "gram", "left")
    twice = stored(twice.select("gram", (F.col("times") + F.coalesce("beyond", F.lit(0))).alias("times")))
    shards = F.greatest(F.ceil(F.log2(F.col("times") / SHARD_ROWS)), F.lit(0)) + 1
    known_grams = seen.join(twice, "gram").select("doc_id", (F.col("gram") + F.shiftleft(shards, 48)).alias("gram"))
    found = known_grams.groupBy("doc_id").agg(F.collect_list("gram").alias("found"))
    # The filter is what the inner join below implies; with it here both joins read one shuffle of the texts.
    bodies = docs.transform(mapped, compressed, _with_body(docs)).where("doc_id IS NOT NULL")
    shared = _dictionary(known)
    wanted = found.join(placed.where("doc_id = lead"), "doc_id").select("doc_id", "found")
    dealt = bodies.select("doc_id", "body").join(wanted, "doc_id").transform(mapped, lambda it: _stretches(it, length, shared), _STRETCHES).transform(repartitioned).sortWithinPartitions("gram", "part")
    shards = stored(dealt.transform(mapped, lambda it: _sort_shards(it, length, shared), _FOUND))
    held = shards.where("body IS NOT NULL").select("doc_id", "start", "shared", "part", "body")
    met = cut(held.groupBy("shared").agg(F.count("*").alias("times"), F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("shared", "times"))
    windows = looked_up(held, met, ["shared"], "doc_id").select("doc_id", "start", "body").transform(mapped, lambda it: _windows(it, length, shared), _WINDOWS)
    merge = windows.repartition("window_1").sortWithinPartitions("window_1", "window_2", "doc_id", "start").transform(mapped, lambda it: _merge(it, length), "doc_id long, start int, end int")
    removed = shards.where("body IS NULL").select("doc_id", "start", "end").unionByName(merge).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    empty = F.array().cast(_SPANS)
    every = F.concat(F.coalesce("own", empty), F.coalesce("spans", empty)).alias("spans")
    return bodies, placed.join(removed, "doc_id", "left").select("doc_id", "digest_1", "lead", every)


def _with_body(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("body", T.BinaryType()), *(f for f in docs.schema if f.name not in ("doc_id", "text"))])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for part in body_chunks(batches):
        rows, rests = [], []
        for doc, raw, lead, digest, found in zip(part.column("doc_id").to_pylist(), unpacked(part.column("body")), part.column("lead").to_pylist(), part.column("digest_1").to_pylist(), part.column("spans"), strict=True):
            start = end = np.zeros(0, np.int64)
            if lead is not None and digest == int(np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8")[0]):
                if lead != doc and len(raw) >= length:
                    start, end = np.zeros(1, np.int64), np.full(1, len(raw))
                elif lead == doc and found.is_valid and len(found.values):
                    start, end = merged(found.values.field("start").to_numpy().astype(np.int64), found.values.field("end").to_numpy().astype(np.int64), len(raw))
            kept = b"".join(raw[x:y] for x, y in zip(np.append(0, end), np.append(start, len(raw)), strict=True)) if len(start) else raw
            if texts:
                # A cut may fall within a code point; what is left of it is dropped.
                rests.append(kept.decode("utf-8", "ignore"))
            else:
                rows.append((doc, len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest()))
        if texts:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rests, pa.string()), part.column("rest")], names=["doc_id", "text", "rest"])
        else:
            kinds = (*[pa.int64()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")])


def removal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document what was removed and a digest of the rest."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    bodies, removed = spans(docs.where("doc_id IS NOT NULL"), length)
    out = bodies.join(removed, "doc_id", "left").select("doc_id", "body", "lead", "digest_1", "spans").transform(mapped, lambda it: _cut_out(it, length, False), _RESULT)
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    zero = F.lit(0).cast("long")
    whole = docs.where("doc_id IS NULL").select("doc_id", F.length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"))
    return out.unionByName(whole)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The same rows and columns, the text without what is removed; a text that all goes of is empty, a null one too."""
    kept = df.where(df[id_col].isNull())
    docs = df.where(df[id_col].isNotNull())
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[docs[c] for c in rest]).alias("rest"))
    bodies, removed = spans(docs, length)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), docs.schema["rest"]])
    out = bodies.join(removed, "doc_id", "left").select("doc_id", "body", "lead", "digest_1", "spans", "rest").transform(mapped, lambda it: _cut_out(it, length, True), schema)
    columns = {id_col: F.col("doc_id").cast(df.schema[id_col].dataType), text_col: F.col("text")}
    return out.select(*[columns[c].alias(c) if c in columns else F.col("rest")[c].alias(c) for c in df.columns]).unionByName(kept)


#: The same rows in SQL, over the hexadecimal form of the bytes.
ORACLE = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS p FROM raw WHERE length(h) >= 200),
windows AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS w FROM starts),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1),
marked AS (SELECT doc_id, p, CASE WHEN p > max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM repeated),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
gone AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM gone),
parts AS (
  SELECT g.doc_id, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS front, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM kept g JOIN raw USING (doc_id) GROUP BY g.doc_id)
SELECT r.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(front || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
FROM raw r LEFT JOIN parts USING (doc_id)
"""
