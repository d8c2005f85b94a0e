"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A *word* here is one match of the vocabulary's splitting pattern (a pre-token, with its leading space).

1. Each task splits whole texts into words, numbers the distinct words of a group of texts (``GROUP_BYTES`` of text, or one
   longer text) and keeps the texts as sequences of those numbers: the positions, packed. The groups are shuffled once, and
   both steps that follow read that one shuffle.
2. The distinct words of the groups are exploded by hash bucket and shuffled, so that all occurrences of a word meet: each
   distinct word is encoded once, by byte-pair merging, and its ids go back to every group that asked.
3. The ids are joined to the groups' sequences and put together again by position.

So a word that a third of all text consists of crosses the network once a group, not once an occurrence, and every bucket
holds near the same number of words whatever their frequency. The number of buckets follows the bytes of all texts, about
``BUCKET_BYTES`` for each, up to 2**``MOST_BITS`` of them; it only deals work out. ``decode`` joins the ids with the table of the
tokens' bytes, whose size is that of the vocabulary; each task looks its ids up there.

The splitting pattern is applied by a library whose tables of letters and digits may be of another Unicode version than the
tokenizer's; ``stand_ins`` asks the tokenizer about every code point, and those that differ are split as it would.

Defined results: a null text is an empty one: no ids, no bytes; a null id is carried through; repeated rows are encoded
each; an empty table gives no rows; other columns are left out; a very long text is split whole, in slices that end where
any match must end; ties don't arise. Null ids decode to no bytes; an id outside of the vocabulary is an error.
"""

from __future__ import annotations

import base64
import functools
import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import chunks, mapped

VOCABULARY = "byte_bpe_50k"
#: Bytes of text whose distinct words are numbered together.
GROUP_BYTES = 16 << 20
#: Characters of a slice of a long text.
SLICE = 1 << 20
BUCKET_BYTES, MOST_BITS = 2 << 20, 16
#: Tasks that put groups together again: one a group, about, up to so many, for a group's row is large and they are few.
MOST_PARTS = 1 << 16
#: No match goes on beyond a single space between two other characters: it begins one.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def ranks(name: str = VOCABULARY) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def word_encoder(name: str = VOCABULARY) -> Callable[[bytes], list[int]]:
    """The ids of one word, which isn't split again."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})._encode_single_piece


@functools.cache
def token_bytes(name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in order of ids, with starts and lengths by id (-1: no such id)."""
    size = max(ranks(name).values()) + 1
    tokens = [b""] * size
    length = np.full(size, -1, np.int64)
    for token, i in ranks(name).items():
        tokens[i], length[i] = token, len(token)
    held = np.maximum(length, 0)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(held) - held, length


@functools.cache
def stand_ins() -> dict[int, str]:
    """Code points that the tokenizer's pattern takes for another kind of character than ours, with a character of its kind.

    A vocabulary of bytes and of merges "letter, digit or sign with the first byte of a character" shows which of them the
    tokenizer keeps in one match with a character.
    """
    import public_tokenizers
    import regex
    import tiktoken

    merges = {bytes([x]): x for x in range(256)}
    for mark in b"a1!":
        for lead in range(0xC2, 0xF5):
            merges[bytes([mark, lead])] = len(merges)
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    theirs, ours = {}, {}
    for mark, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]")):
        ids = np.array(probe.encode_ordinary("".join(f"{mark}{chr(c)}\n" for c in points)))
        first = ids[np.append(0, np.flatnonzero(ids == 10)[:-1] + 1)]
        theirs |= {points[i]: mark for i in np.flatnonzero(first > 255)}
        ours |= {ord(x): mark for x in regex.findall(kind, "".join(map(chr, points)))}
    return {c: theirs.get(c, "　") for c in points if theirs.get(c) != ours.get(c)}


def splitter(other: dict[int, str]) -> Callable[[str], Iterator[list[str]]]:
    """text -> lists of its words in order, a slice at a time."""
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    odd = frozenset(map(chr, other))

    def words(part: str) -> list[str]:
        if not part.isascii() and not odd.isdisjoint(part):
            return [part[m.start() : m.end()] for m in pattern.finditer(part.translate(other))]
        return pattern.findall(part)

    def split(text: str) -> Iterator[list[str]]:
        start = 0
        while len(text) - start > SLICE and (cut := _SAFE.search(text, start + SLICE)):
            yield words(text[start : cut.start()])
            start = cut.start()
        yield words(text[start:] if start else text)

    return split


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as planes of bytes, compressed."""
    x = values.astype("<u4")
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


#: In one column, so that both readers of a group's row read the same shuffle: the document ids, counts of words,
#: sequence, places, and the sizes and bytes of the distinct words.
_GROUPS = "`group` long, body binary"


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _groups(batches: Iterator[pa.RecordBatch], other: dict[int, str], limit: int) -> Iterator[pa.RecordBatch]:
    """Texts as sequences of numbers of the group's distinct words, frequent ones first; the words in order of their hashes, so
    that those of a bucket lie together; and where in that order each numbered word is."""
    split = splitter(other)
    context = TaskContext.get()
    group = (context.partitionId() if context else 0) << 32
    held, docs, counts, parts = 0, [], [], []
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__

    def close() -> pa.RecordBatch:
        nonlocal held, group, docs, counts, parts
        sequence = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(sequence, minlength=len(number)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = [w.encode() for w in number]
        by_hash = np.argsort(_hashes(words))
        place = np.empty(len(order), np.uint32)
        place[by_hash] = np.arange(len(order))
        raw = [words[i] for i in by_hash.tolist()]
        sizes = np.array(list(map(len, raw)), np.uint32)
        body = pickle.dumps((docs, counts, _packed(rank[sequence]), _packed(place[order]), _packed(sizes), zstandard.ZstdCompressor(level=3).compress(b"".join(raw))))
        number_of = group
        held, docs, counts, parts, group = 0, [], [], [], group + 1
        number.clear()
        return pa.RecordBatch.from_arrays([pa.array([number_of], pa.int64()), pa.array([body], pa.binary())], names=["group", "body"])

    for batch in chunks(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            n = 0
            for words in split(text or ""):
                parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                n += len(words)
                held += sum(map(len, words))
            docs.append(doc)
            counts.append(n)
            if held >= limit:
                yield close()
    if docs:
        yield close()


_ASKED = "bucket int, `group` long, sizes binary, words binary"


def _asked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A group's distinct words, by the first bits of their hash."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for group, body in zip(batch.column("group").to_pylist(), batch.column("body").to_pylist(), strict=True):
            raw = _words(*pickle.loads(body)[4:])
            bucket = (_hashes(raw) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(raw), np.int64)
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(raw)).tolist()
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows.append((int(bucket[a]), group, _packed(np.array(list(map(len, raw[a:b])), np.uint32)), pack(b"".join(raw[a:b]))))
            for a in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 1024], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "group", "sizes", "words"])


def _words(sizes: bytes, words: bytes) -> list[bytes]:
    ends = np.cumsum(_unpacked(sizes)).tolist()
    body = zstandard.ZstdDecompressor().decompress(words)
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


_ANSWERS = "`group` long, bucket int, sizes binary, ids binary"


def _answers(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: every distinct word of a bucket is encoded once, for all groups that hold it."""
    encode = word_encoder(name)
    now, known = None, {}
    for batch in batches:
        rows = []
        for bucket, group, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "group", "sizes", "words")), strict=True):
            if bucket != now:
                now, known = bucket, {}
            raw = _words(sizes, words)
            for word in raw:
                if word not in known:
                    known[word] = encode(word)
            found = [known[word] for word in raw]
            rows.append((group, bucket, _packed(np.array(list(map(len, found)), np.uint32)), _packed(np.array([i for ids in found for i in ids], np.uint32))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["group", "bucket", "sizes", "ids"])


_IDS = "doc_id long, ids array<int>"


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group row, its answers) -> the ids of each text, in order of position."""
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, counts, sequence, place, *_ = pickle.loads(row["body"])
            place = _unpacked(place)
            answers = sorted(row["answers"] or (), key=lambda x: x["bucket"])
            size = np.concatenate([_unpacked(x["sizes"]) for x in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
            ids = np.concatenate([_unpacked(x["ids"]) for x in answers]) if answers else np.zeros(0, np.uint32)
            if len(size) != len(place):
                raise RuntimeError(f"group {row['group']}: {len(place)} words, {len(size)} answers")
            start, length = (np.cumsum(size) - size)[place], size[place]
            sequence, at = _unpacked(sequence), 0
            out_docs, out_ids, waiting = [], [], 0
            for doc, n in zip(doc_ids, counts, strict=True):
                mine = sequence[at : at + n]
                at += n
                lengths = length[mine]
                total = int(lengths.sum())
                out_docs.append(doc)
                out_ids.append(ids[np.arange(total) + np.repeat(start[mine] - (np.cumsum(lengths) - lengths), lengths)].astype(np.int32))
                waiting += total
                if waiting > 1 << 18:
                    yield _listed(out_docs, out_ids)
                    out_docs, out_ids, waiting = [], [], 0
            if out_docs:
                yield _listed(out_docs, out_ids)


def _listed(docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.append(0, np.cumsum(list(map(len, ids)))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text, without special tokens."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    other = stand_ins()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, (size // BUCKET_BYTES).bit_length())
    parts = min(MOST_PARTS, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // max(group_bytes, 1 << 20))))
    groups = docs.transform(mapped, lambda it: _groups(it, other, group_bytes), _GROUPS).repartition(parts, "group")
    asked = groups.transform(mapped, lambda it: _asked(it, bits), _ASKED)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").transform(mapped, lambda it: _answers(it, vocabulary), _ANSWERS)
    of_group = answers.repartition(parts, "group").groupBy("group").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("answers"))  # bounded: the distinct words of one group
    return groups.join(of_group, "group", "left").transform(mapped, _reassembled, _IDS)


def _decoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    data, start, length = token_bytes(name)
    for batch in batches:
        rows = batch.column("ids")
        size = np.array([len(x) if x.is_valid else 0 for x in rows], np.int64)
        cuts = np.append(0, np.cumsum(size))
        first = 0
        while first < len(rows):  # some 256,000 ids at a time, or one longer row
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + (1 << 18), "right")) - 1)
            ids = rows.slice(first, last - first).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or (length[ids] < 0).any()):
                raise ValueError("an id outside of the vocabulary")
            n = length[ids]
            body = data[np.arange(int(n.sum())) + np.repeat(start[ids] - (np.cumsum(n) - n), n)]
            ends = np.append(0, np.cumsum(n))[cuts[first : last + 1] - cuts[first]]
            decoded = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.binary())
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rest", "ids")), decoded], names=["rest", "ids", "decoded"])
            first = last


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the bytes of their ids beside them."""
    rest = [c for c in df.columns if c != ids_col]
    inner = df.select(F.struct(F.lit(0).alias("_"), *[df[c] for c in rest]).alias("rest"), df[ids_col].cast("array<int>").alias("ids"))
    schema = T.StructType([*inner.schema, T.StructField("decoded", T.BinaryType())])
    found = inner.transform(mapped, lambda it: _decoded(it, vocabulary), schema)
    return found.select(*[F.col("ids").alias(c) if c == ids_col else F.col("rest")[c].alias(c) for c in df.columns], F.col("decoded").alias(out))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding each text and decoding its ids gives."""
    both = decode(encode(df, id_col, text_col, vocabulary), vocabulary=vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def token_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, bytes) of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in sorted(ranks(vocabulary).items(), key=lambda x: x[1])], "id int, bytes binary")
