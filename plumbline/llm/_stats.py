"""Statistics of whole texts, computed a chunk at a time in numpy; the inputs of the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BASE_1, BYTE_1, Texts, WHITE, chunks, mapped, mix, prefix_hash, span_hash

GRAM = 5
#: Integer statistics, by name; all cover the whole text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_lower", "n_digits", "n_marks", "n_ends", "n_shouts", "n_pipes", "n_wide", "n_lines", "n_distinct", "n_top")
#: Features of the learners: name -> (numerator, denominator) over COUNTS, or the logarithm of one.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "lower_share": ("n_lower", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"), "end_share": ("n_ends", "n_words"), "shout_share": ("n_shouts", "n_words"), "pipe_share": ("n_pipes", "n_words"),
    "wide_share": ("n_wide", "word_chars"), "line_length": ("n_words", "n_lines"), "distinct_share": ("n_distinct", "n_words"), "top_share": ("n_top", "n_words"),
}
FEATURES = ("log_words", *RATIOS)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
_MASKS = {"n_symbols": _mask(b"#*$%&|<>"), "n_digits": _DIGIT, "n_marks": _mask(b".,;:!?'\"()-"), "n_ends": _mask(b".!?"), "n_shouts": _mask(b"!"), "n_pipes": _mask(b"|")}
_HEAD = np.ones(256, bool)  # first bytes of code points
_HEAD[0x80:0xC0] = False


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text. Words are runs outside 0x20 and 0x09-0x0D; null and empty texts have 0 everywhere."""
    texts = Texts(column)
    data, offsets, n = texts.data, texts.offsets, texts.n

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    head = _HEAD[data]
    out = {name: per_row(mask[data]) for name, mask in _MASKS.items()}
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    out["n_upper"] = per_row(_UPPER[data] | (after_c3 & (data < 0x9F)))
    out["n_lower"] = per_row(_LOWER[data] | (after_c3 & (data >= 0x9F)))
    out["n_chars"] = per_row(head)
    out["n_wide"] = per_row(head & (data >= 0x80))
    dark = ~WHITE[data]
    out["word_chars"] = per_row(head & dark)

    starts, ends, rows = texts.words()
    out["n_words"] = np.bincount(rows, minlength=n)
    prefix = prefix_hash(BYTE_1[data], BASE_1)
    words = span_hash(prefix, starts, ends, BASE_1)

    # Words in windows of GRAM that occur twice or more in the row.
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= GRAM:
        base = np.uint64(0x9FB21C651E98DF25)
        gram = words[: len(words) - GRAM + 1].copy()
        for i in range(1, GRAM):
            gram = gram * base + words[i : len(words) - GRAM + 1 + i]
        gram = mix(gram ^ mix(rows[: len(gram)].astype(np.uint64) + np.uint64(1)))
        inside = rows[: len(gram)] == rows[GRAM - 1 :]
        order = np.sort(gram[inside])
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, gram), len(twice) - 1)
            hit = np.flatnonzero((twice[at] == gram) & inside)
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + GRAM, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(covered)[:-1] > 0], minlength=n)

    # Lines with a word, and those equal to an earlier one of the row.
    breaks = np.flatnonzero(data == 0x0A)
    filled = np.flatnonzero(texts.lengths > 0)
    line_starts = np.sort(np.concatenate([offsets[filled], breaks + 1]))
    line_ends = np.sort(np.concatenate([offsets[filled + 1], breaks]))
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(dark, out=seen[1:])
    wordy = seen[line_ends] > seen[line_starts] if len(line_starts) else np.zeros(0, bool)
    line_starts, line_ends = line_starts[wordy], line_ends[wordy]
    line_rows = texts.row_of(line_starts)
    lines = span_hash(prefix, line_starts, line_ends, BASE_1)
    order = np.lexsort((lines, line_rows))
    again = np.zeros(len(lines), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_rows[order][1:] == line_rows[order][:-1])
    out["n_lines"] = np.bincount(line_rows, minlength=n)
    out["n_dup_lines"] = np.bincount(line_rows[order][again], minlength=n)

    # Distinct words, and the count of the most frequent one (40 bits of hash: features, not contracts).
    out["n_distinct"], out["n_top"] = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(words):
        key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        owner = (key[first] >> np.uint64(40)).astype(np.int64)
        out["n_distinct"] = np.bincount(owner, minlength=n)
        np.maximum.at(out["n_top"], owner, np.diff(np.append(first, len(key))))
    return out


def features(count: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, one column per name of FEATURES; 0 where the denominator is."""
    columns = [np.log1p(count["n_words"])]
    columns += [count[a] / np.maximum(count[b], 1) for a, b in RATIOS.values()]
    return np.column_stack(columns).astype(np.float64)


def feature_columns() -> dict[str, F.Column]:
    """The same features as Spark expressions over columns named as COUNTS."""
    return {"log_words": F.log1p("n_words")} | {name: F.col(a) / F.greatest(F.col(b), F.lit(1)) for name, (a, b) in RATIOS.items()}


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def statistics(docs: DataFrame) -> DataFrame:
    """COUNTS of each (doc_id, text) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            count = counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(count[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return docs.transform(mapped, run, SCHEMA)


#: Labelled rows that a learner reads, at most: a documented bound, so the driver and the broadcast of their ids stay small.
SAMPLE = 12_000


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: good) of a bounded, repeatable sample of the labelled rows outside the held-out third.

    The third with crc32(doc_id as text) mod 3 = 1 is never read. Of the rest the ``sample`` ids with the least hash are
    taken; ids with several labels count once, with the least label.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    mine = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    known = dict(chosen.toArrow().to_pandas().itertuples(index=False))
    table = statistics(mine).toArrow()
    ids = table.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = features({c: table.column(c).to_numpy() for c in COUNTS})[order]
    return x, np.array([known[i] for i in ids[order]], np.int64)


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
