"""Removal of word sequences that earlier documents hold: Rabin-Karp hashes of windows, counted in Spark.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller id. Hashing and
counting every window would shuffle many times the corpus, so a first count, exact in what it rules out, comes before:

1. Each window's *anchor* is the leftmost least-hash gram of ``GRAM`` words in it; equal windows have equal anchors. Anchors
   (about one in 18 words) are counted in Spark, and windows whose anchor one document alone holds can't repeat.
2. Of all other windows 128 bits of Rabin-Karp hash are counted in Spark: the smallest id that holds each, with partial
   sums before the shuffle, and frequent windows are looked up on their own, so that none is a hot key.
3. Windows first held elsewhere are merged, per document, into maximal removal intervals.

Exact copies of a text are settled by its digest: all of a copy of WINDOW words or more goes, but for the smallest id.

Defined results: null, empty and blank texts have no words; rows with a null id are kept whole; rows that share an id and a text count as one
document (each is returned); of rows that share an id but not a text, those with other than the least digest are kept
whole; an empty table gives no rows; columns other than the two named are left out; a very long text is read whole, alone in its
chunk (its memory grows with its length, not with the table); of equal windows (ties) those of the smallest id stay, all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BASE_1, BASE_2, BYTE_1, BYTE_2, Texts, body_chunks, chunks, compressed, mapped, merged, prefix_hash, signed, span_hash, unpacked, window_anchors
from ._graph import cut, looked_up, stored

WINDOW, GRAM = 50, 16


def _hashed_words(texts: Texts, second: bool = False) -> tuple[np.ndarray, ...]:
    """(starts, ends, rows, 64-bit hashes) of the words, and second hashes where asked for."""
    starts, ends, rows = texts.words()
    out = [span_hash(prefix_hash(BYTE_1[texts.data], BASE_1), starts, ends, BASE_1)]
    if second:
        out.append(span_hash(prefix_hash(BYTE_2[texts.data], BASE_2), starts, ends, BASE_2))
    return starts, ends, rows, *out


def rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` words, by prefix sums; 0 where no whole run follows."""
    out = np.zeros(len(words), np.uint64)
    if len(words) >= width:
        at = np.arange(len(words) - width + 1)
        out[: len(at)] = span_hash(prefix_hash(words, base), at, at + width, base)
    return out


def _anchors(words: np.ndarray, rows: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes at each word, and each window's anchor or -1."""
    grams = rolled(words, GRAM, BASE_2)
    left = np.cumsum(np.bincount(rows, minlength=n))[rows] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    return grams, window_anchors(grams, left >= window, left >= GRAM, window - GRAM + 1)


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = Texts(batch.column("text"))
        _, _, rows, words = _hashed_words(texts)
        grams, anchors = _anchors(words, rows, window, texts.n)
        at = np.unique(anchors[anchors >= 0])
        pairs = np.unique(np.rec.fromarrays([rows[at], grams[at]], names="r,g")) if len(at) else np.rec.fromarrays([rows[at], grams[at]], names="r,g")
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(pairs.r, minlength=texts.n))).astype(np.int32))
        digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(texts.data[a:b]), "<i8") for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.ListArray.from_arrays(offsets, pa.array(signed(np.ascontiguousarray(pairs.g))))],
            names=["doc_id", "digest_1", "digest_2", "grams"],
        )


_WINDOWS = "window_1 long, window_2 long, doc_id long, places array<int>"


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, found) -> the distinct windows whose anchor is found, with the words they start at."""
    for part in body_chunks(batches):
        texts = Texts(pa.array(unpacked(part.column("body")), pa.binary()).view(pa.string()))
        _, _, rows, one, two = _hashed_words(texts, second=True)
        grams, anchors = _anchors(one, rows, window, texts.n)
        hits = []
        first = np.append(0, np.cumsum(np.bincount(rows, minlength=texts.n)))
        for i, found in enumerate(part.column("found")):
            at = np.arange(first[i], first[i + 1])
            at = at[anchors[at] >= 0]
            hits.append(at[np.isin(signed(grams)[anchors[at]], found.values.to_numpy())])
        at = np.concatenate(hits)
        if not len(at):
            continue
        w1, w2, row = rolled(one, window, BASE_1)[at], rolled(two, window, BASE_2)[at], rows[at]
        order = np.lexsort((at, w2, w1, row))
        w1, w2, row, at = w1[order], w2[order], row[order], at[order]
        new = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (row[1:] != row[:-1])))
        places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array((at - first[row]).astype(np.int32)))
        docs = part.column("doc_id").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(signed(w1[new])), pa.array(signed(w2[new])), pa.array(docs[row[new]]), places], names=["window_1", "window_2", "doc_id", "places"])


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut_out(batches: Iterator[pa.RecordBatch], window: int, keep: bool) -> Iterator[pa.RecordBatch]:
    for part in body_chunks(batches):
        rows = []
        for doc, raw, lead, digest, found in zip(part.column("doc_id").to_pylist(), unpacked(part.column("body")), part.column("lead").to_pylist(), part.column("digest_1").to_pylist(), part.column("found"), strict=True):
            starts, ends, _ = Texts(pa.array([raw], pa.binary()).view(pa.string())).words()
            n, gone = len(starts), np.zeros(len(starts), bool)
            if lead is not None and digest == int(np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8")[0]):
                if lead != doc:
                    gone[:] = n >= window
                elif found.is_valid and len(found.values):
                    at = found.values.flatten().to_numpy().astype(np.int64)
                    for x, y in zip(*merged(at, at + window, n), strict=True):
                        gone[x:y] = True
            text = b" ".join([raw[x:y] for x, y in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
            rows.append((doc, n, int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode() if keep else None))
        kinds = (*[pa.int64()] * 3, pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")])


def removal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per document its words, how many went, and a digest of the rest; with ``texts`` also the rest itself."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    anchors = cut(known.transform(mapped, lambda it: _anchor_rows(it, window), "doc_id long, digest_1 long, digest_2 long, grams array<long>"))
    one = anchors.groupBy("doc_id").agg(F.min(F.struct("digest_1", "digest_2")).alias("d")).select("doc_id", "d.*")
    leads = one.groupBy("digest_1", "digest_2").agg(F.min("doc_id").alias("lead"))
    leads = cut(leads)  # so that the join below is one that adaptive execution can split where many rows are copies
    placed = cut(one.join(leads, ["digest_1", "digest_2"]).select("doc_id", "digest_1", "lead"))
    seen = anchors.select("doc_id", F.explode("grams").alias("gram"))
    shared = stored(seen.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times")).where("low < high").select("gram", "times"))
    found = looked_up(seen, shared, ["gram"], "doc_id").groupBy("doc_id").agg(F.collect_list("gram").alias("found"))
    # The filter is what the inner join below implies; with it here all joins read one shuffle of the texts.
    bodies = known.transform(mapped, compressed, "doc_id long, body binary").where("doc_id IS NOT NULL")
    wanted = found.join(placed.where("doc_id = lead"), "doc_id").select("doc_id", "found")
    windows = bodies.join(wanted, "doc_id").transform(mapped, lambda it: _windows(it, window), _WINDOWS)
    first = windows.groupBy("window_1", "window_2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times")).where("low < high")
    first = stored(first.select("window_1", "window_2", "low", "times"))
    later = looked_up(windows, first, ["window_1", "window_2"], "doc_id").where("doc_id > low").groupBy("doc_id").agg(F.collect_list("places").alias("found"))
    joined = bodies.join(placed.join(later, "doc_id", "left"), "doc_id", "left").select("doc_id", "body", "lead", "digest_1", "found")
    out = joined.transform(mapped, lambda it: _cut_out(it, window, texts), _RESULT)
    lost = docs.where("doc_id IS NULL").transform(mapped, compressed, "doc_id long, body binary")
    lost = lost.select("doc_id", "body", F.lit(None).cast("long").alias("lead"), F.lit(None).cast("long").alias("digest_1"), F.lit(None).cast("array<array<int>>").alias("found"))
    return out.unionByName(lost.transform(mapped, lambda it: _cut_out(it, window, texts), _RESULT))


#: The same rows in SQL.
ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS p FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 49], ' ')) AS h FROM starts),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 50)) AS p FROM later),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
