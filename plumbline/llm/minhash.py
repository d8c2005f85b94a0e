"""MinHash near-duplicate detection by min-max hashing, every link confirmed on full shingle sets.

Each permutation of the shingle hashes is evaluated once and gives two signature values, its minimum and its maximum:
half the hash evaluations of plain MinHash, an unbiased estimate of the same similarity and, as the two are negatively
correlated, of lower variance. 64 permutations give 128 values in 32 bands of 4: a pair of large sets at similarity 0.75
shares no band with probability 5e-6. In small sets minimum and maximum depend on each other (sets of 4 and 3 shingles share
both with probability 0.5, not 0.5625), so sets of less than ``SMALL`` shingles are joined exactly, as in step 3, whatever
buckets they share.

1. Documents with the same shingle set form one class, and only its smallest id goes on.
2. In each band bucket every member is compared with the bucket's center only (a star, never all pairs). Links are
   confirmed on full sets, and their connected components found.
3. Where a bucket still holds several components, its members are joined exactly: sets that reach the threshold
   share one of their rarest shingles (prefix filter), and pairs of different components that do are confirmed.
   So no pair that shares a bucket loses its link, however large the bucket is. All small sets, and those large enough to
   reach the threshold with one, take part in this.

What is counted or chosen per bucket, class and shingle is cut before it is joined to their members, so that adaptive execution
splits those that a large part of all rows share.

Defined results: a text without words (null, empty, blank) has an empty set and is linked with nothing; so is a row with
a null id, which stays; rows that share an id count as one document; an empty table gives no rows; columns other than
the two named are left out; a very long text is hashed whole, alone in its chunk; where members of a bucket weigh the same
(ties), the smallest id is its center, which decides only which pairs are compared first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BASE_1, BYTE_1, Texts, body_chunks, chunks, compressed, mapped, mix, prefix_hash, signed, span_hash, unpacked
from ._graph import components, cut, stored

WORDS, PERCENT = 5, 75
PERMUTATIONS, BANDS = 64, 32
#: Sets of fewer shingles are compared exactly.
SMALL = 20

_rng = np.random.RandomState(6151)
_MULTIPLY = _rng.randint(0, 2**62, PERMUTATIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(0, 2**62, PERMUTATIONS, dtype=np.int64).astype(np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows (in order) of the distinct shingles; a text of fewer words has its whole sequence as one."""
    starts, ends, rows = texts.words()
    hashes = span_hash(prefix_hash(BYTE_1[_LOWER[texts.data]], BASE_1), starts, ends, BASE_1)
    count = np.bincount(rows, minlength=texts.n)
    base = np.uint64(0x9FB21C651E98DF25)
    gram, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= words:
        gram = hashes[: len(hashes) - words + 1].copy()
        for i in range(1, words):
            gram = gram * base + hashes[i : len(hashes) - words + 1 + i]
        inside = rows[: len(gram)] == rows[words - 1 :]
        gram, owner = gram[inside], rows[: len(gram)][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.cumsum(count) - count
        whole = np.array([np.bitwise_xor.reduce(mix(hashes[a : a + n] + np.arange(n, dtype=np.uint64))) ^ np.uint64(n) for a, n in zip(first[short], count[short], strict=True)], np.uint64)
        gram, owner = np.concatenate([gram, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
    gram = mix(gram)
    # Later copies within a row go; most rows have none.
    key = mix(gram ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        keep = np.ones(len(gram), bool)
        keep[at] = False
        keep[at[np.unique(key[at], return_index=True)[1]]] = True
        gram, owner = gram[keep], owner[keep]
    return gram, owner


def signature(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima and maxima, side by side, of the runs of gram that start at ``first``: one row of 2 * PERMUTATIONS."""
    out = np.empty((len(first), 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        x = gram * _MULTIPLY[p] + _ADD[p]
        out[:, 2 * p] = np.minimum.reduceat(x, first)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, first)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One hash per band of consecutive signature values, distinct between bands."""
    parts = signatures.reshape(len(signatures), BANDS, -1)
    out = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))[None, :].repeat(len(parts), 0)
    for i in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + parts[:, :, i])
    return out


_SIGNED = "doc_id long, n_shingles long, set_1 long, set_2 long, bands array<long>"


def _signed_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = Texts(batch.column("text"))
        gram, owner = shingles(texts, words)
        count = np.bincount(owner, minlength=texts.n)
        filled = np.flatnonzero(count)
        keys, sets = np.zeros((texts.n, BANDS), np.uint64), np.zeros((2, texts.n), np.uint64)
        if len(filled):
            first = (np.cumsum(count) - count)[filled]
            keys[filled] = bands(signature(gram, first))
            for i in range(2):
                sets[i, filled] = np.add.reduceat(mix(gram + np.uint64(0x1234567 + 99 * i)), first)
        offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.ascontiguousarray(keys[filled]).ravel())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(signed(sets[0])), pa.array(signed(sets[1])), flat], names=["doc_id", "n_shingles", "set_1", "set_2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, body) -> (doc_id, n, grams): the sorted set as little-endian 64-bit hashes."""
    for part in body_chunks(batches):
        rows = []
        for doc, text in zip(part.column("doc_id").to_pylist(), unpacked(part.column("body")), strict=True):
            gram = np.sort(shingles(Texts(pa.array([text], pa.binary()).view(pa.string())), words)[0])
            rows.append((doc, len(gram), gram.astype("<u8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n", "grams"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, grams_a, grams_b) -> the pairs whose full sets reach the threshold."""
    for batch in batches:
        keep, last, other = [], None, None
        for i in range(batch.num_rows):
            raw = batch.column("grams_b")[i].as_buffer()
            if last is None or not raw.equals(last):
                last, other = raw, np.frombuffer(raw, "<u8")
            mine = np.frombuffer(batch.column("grams_a")[i].as_buffer(), "<u8")
            if min(len(mine), len(other)) * 100 < percent * max(len(mine), len(other)):
                continue
            # Both are sorted and distinct: what is equal to its place in the other is shared.
            small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
            shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            if 100 * shared >= percent * (len(mine) + len(other) - shared):
                keep.append(i)
        if keep:
            yield batch.select(["a", "b"]).take(pa.array(keep))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose sets reach the threshold. Sizes that rule a pair out go before the sets are joined."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "grams_a", "grams_b").transform(mapped, lambda it: _confirmed(it, percent), "a long, b long")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, component, grams) -> one row per shingle."""
    for batch in chunks(batches, "grams"):
        size = np.array([len(x) // 8 for x in batch.column("grams").to_pylist()])
        gram = np.frombuffer(b"".join(batch.column("grams").to_pylist()), "<i8")
        docs, parts = (np.repeat(batch.column(c).to_numpy(), size) for c in ("doc_id", "component"))
        for i in range(0, len(gram), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (docs, parts, np.repeat(size, size), gram)], names=["doc_id", "component", "n", "gram"])


def _within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between members (doc_id, component) of different components, found exactly by prefix filter.

    Shingles are ordered by how many members hold them, rarest first. Of two sets that reach the threshold, the smaller
    one's first n - ceil(2 t n / (1 + t)) + 1 and the larger one's first n - ceil(t n) + 1 share a shingle, and what
    follows their places is long enough for the overlap. Most members of a shingle are in one component by now; pairs
    are the others with all, so a large group that is one component costs its size and not the square of it.
    """
    grams = members.join(sets, "doc_id").select("doc_id", "component", "grams").transform(mapped, _prefixes, "doc_id long, component long, n long, gram long")
    by_part = grams.groupBy("gram", "component").agg(F.count("*").alias("times"))
    held = by_part.groupBy("gram").agg(F.sum("times").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("times", "component")).alias("main"))
    # A shingle of one component takes its place in the order but brings no pair.
    ranked = grams.join(stored(held), "gram").withColumn("place", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY held, gram)"))
    heads = ranked.where("low < high").where(f"place <= n - ({percent} * n + 99) div 100 + 1").select("gram", "doc_id", "component", "n", "place", (F.col("component") != F.col("main")).alias("other"))
    heads = heads.withColumn("brief", F.expr(f"place <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1"))
    heads = stored(heads)
    test = f"""a.gram = b.gram AND a.component <> b.component AND (a.n < b.n OR a.n = b.n AND a.doc_id < b.doc_id) AND a.n * 100 >= {percent} * b.n
      AND 1 + least(a.n - a.place, b.n - b.place) >= ({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent}"""
    pairs = None
    for small, large in (("brief AND other", "true"), ("brief AND NOT other", "other")):
        found = heads.where(small).alias("a").join(heads.where(large).alias("b"), F.expr(test)).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return _confirm(pairs.distinct(), sets, percent)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept, one row per input row."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    signed_docs = cut(docs.transform(mapped, lambda it: _signed_sets(it, words), _SIGNED))
    filled = signed_docs.where("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["set_1", "set_2", "n_shingles"]
    classes = cut(filled.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    # One row per representative, matched by its id, for a class may hold a third of all rows; rows that share an id and a set are alike.
    reps = filled.join(classes.select(*key, F.col("rep").alias("doc_id")), ["doc_id", *key]).dropDuplicates(["doc_id", *key])
    reps = cut(reps.select("doc_id", "n_shingles", "bands"))
    keyed = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = stored(keyed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    found = stored(keyed.join(buckets, "band").select("band", "doc_id", "n", "size"))
    # The star's center is the member that stands in the largest buckets: the least edited of a group, as a rule.
    weight = found.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    center = F.max_by(F.struct("doc_id", "n"), F.struct("weight", -F.col("doc_id")))
    centers = found.join(weight, "doc_id").groupBy("band").agg(center.alias("c"))
    centers = stored(centers.select("band", F.col("c.doc_id").alias("center"), F.col("c.n").alias("n_center")))

    small = reps.where(F.col("n_shingles") * percent < SMALL * 100).select("doc_id")
    involved = found.select("doc_id").unionByName(small).distinct()
    bodies = docs.where("doc_id IS NOT NULL").transform(mapped, compressed, "doc_id long, body binary")
    sets = cut(bodies.join(involved, "doc_id").transform(mapped, lambda it: _sets(it, words), "doc_id long, n long, grams binary").dropDuplicates(["doc_id"]))
    starred = found.join(centers, "band")
    stars = starred.where(f"doc_id <> center AND least(n, n_center) * 100 >= {percent} * greatest(n, n_center)").select(F.col("doc_id").alias("a"), F.col("center").alias("b")).distinct()
    links = cut(_confirm(stars, sets, percent))
    parts = components(links)

    # Buckets whose members are in several components yet; and small sets.
    placed = found.join(parts, found.doc_id == parts.node, "left").select("band", F.coalesce("component", "doc_id").alias("component"))
    split = cut(placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band"))
    members = found.join(split, "band").select("doc_id").unionByName(small).distinct()
    members = cut(members.join(parts, members.doc_id == parts.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")))
    more = cut(_within(members, sets, percent))
    named = classes.join(parts, classes.rep == parts.node, "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    if not more.isEmpty():
        # What these links join are components, few and told by their least ids; the links within them needn't be read again.
        ends = more
        for end in ("a", "b"):
            ends = ends.join(members.select(F.col("doc_id").alias(end), F.col("component").alias(f"part_{end}")), end)
        joined = cut(components(ends.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))).withColumnRenamed("component", "whole"))
        named = named.join(joined, named.component_id == joined.node, "left").select(*key, F.coalesce("whole", "component_id").alias("component_id"))
    out = filled.join(cut(named), key).select("doc_id", "n_shingles", "component_id")
    rest = signed_docs.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same rows in SQL: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT reached.doc_id, b FROM reached JOIN both_ways ON other = a),
least_one AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_one USING (doc_id)
"""
