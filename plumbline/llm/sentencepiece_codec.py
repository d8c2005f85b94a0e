"""SentencePiece encoding and decoding by streaming Viterbi.

The segmentation of a text is the sequence of the fewest pieces, of those the one with the highest sum of scores. Both are kept
in one number (a piece costs ``PIECE``, far more than any scores in a window come to), with backpointers, for
a window of the longest piece's length only, for a later piece can start nowhere else; whenever all paths that survive
at the window's places run through one boundary, the ids before it are committed and forgotten, so memory doesn't grow
with the text. Places that no piece of the vocabulary can span (before a space mark that follows another character) are
such boundaries from the outset: the stretches between them are encoded on their own, and short ones remembered.

The vocabulary is a public model file, a parameter. Its scores are ranks of merges, whose sum alone would favour many short early
pieces; with the fewest pieces first a text has no more ids than the library's greedy merges give it. Both decode to the
same text. Characters without a piece become bytes.

Defined results: null and empty texts have no ids; U+2581 in a text is read as a space, as the library does; repeated rows
are encoded each; a null id is carried through; an empty table gives no rows; other columns are left out; a very long text
needs the window, its ids and itself; of paths with equal pieces and scores (ties) the one whose last piece is longest is taken, at
every place.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import chunks, mapped

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches up to this length are remembered, so many at most per worker.
REMEMBERED_LENGTH, REMEMBERED = 48, 500_000
NONE = -1e300
#: Cost of a piece: scores are whole numbers above -1e6, so doubles hold the sums of a window exactly.
PIECE = 1e10


class Codec:
    def __init__(self, model: str = MODEL):
        import public_tokenizers
        import sentencepiece

        one = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        size = one.get_piece_size()
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(size):
            piece = one.id_to_piece(i)
            if one.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif one.is_control(i) or one.is_unknown(i):
                self.raw.append(b"")
            else:
                self.pieces[piece] = one.get_score(i) - PIECE, i
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.pieces))
        # Of each beginning of a piece: its score and id, or None if it isn't a piece itself.
        self.table: dict[str, tuple[float, int] | None] = {p[:n]: None for p in self.pieces for n in range(1, len(p))}
        self.table |= self.pieces
        self.byte_score = min(s for s, _ in self.pieces.values()) - 10.0
        # No piece may hold a space mark behind another character, else stretches can't be cut before space marks.
        whole = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.stretch = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    def viterbi(self, s: str) -> Iterator[list[int]]:
        """Committed ids of s, part by part."""
        look, longest, none = self.table.get, self.longest, NONE
        n, done = len(s), 0  # all before ``done`` is committed
        room = min(n, 5 * longest) + 1
        best, back = [none] * room, [0] * room  # of places done, done + 1, ...: score, start of the last piece, its id
        last: list[object] = [None] * room
        best[0] = 0.0
        for i in range(n):
            k = i - done
            if k + longest >= len(best) and len(best) + done <= n:
                more = 4 * longest
                best += [none] * more
                back += [0] * more
                last += [None] * more
            base = best[k]
            char = look(s[i], 0)
            if not char:
                score = base + self.byte_score * len(s[i].encode())
                if score > best[k + 1]:
                    best[k + 1], back[k + 1], last[k + 1] = score, k, s[i]
            if char != 0:
                if char:
                    score = base + char[0]
                    if score > best[k + 1]:
                        best[k + 1], back[k + 1], last[k + 1] = score, k, char[1]
                for j in range(i + 2, min(n, i + longest) + 1):
                    hit = look(s[i:j], 0)
                    if hit:
                        score = base + hit[0]
                        if score > best[j - done]:
                            best[j - done], back[j - done], last[j - done] = score, k, hit[1]
                    elif hit == 0:
                        break
            if k + 1 >= 4 * longest and i + 1 < n:
                # Places that pieces already reach: follow the latest back until one is left, where all paths meet.
                open_ = {p for p in range(k + 1, len(best)) if best[p] > none}
                while len(open_) > 1:
                    at = max(open_)
                    open_.remove(at)
                    open_.add(back[at])
                at = open_.pop()
                if at:
                    yield self._path(back, last, at)
                    zero = best[at]  # sums count from the boundary on, so they stay exact
                    best, back, last = [b - zero if b > none else none for b in best[at:]], [b - at for b in back[at:]], last[at:]
                    done += at
        yield self._path(back, last, n - done)

    def _path(self, back: list[int], last: list, at: int) -> list[int]:
        out: list[int] = []
        while at > 0:
            what = last[at]
            if isinstance(what, str):
                out += [self.bytes[b] for b in reversed(what.encode())]
            else:
                out.append(what)
            at = back[at]
        out.reverse()
        return out

    def _stretch_ids(self, s: str) -> bytes:
        ids = array("i")
        for part in self.viterbi(s):
            ids.extend(part)
        out = ids.tobytes()
        if len(s) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[s] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known, new = self.known, self._stretch_ids
        marked = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join([known.get(s) or new(s) for s in self.stretch.findall(marked)]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the space that encoding puts in front goes. Broken byte sequences give U+FFFD."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.cache
def codec(model: str) -> Codec:
    return Codec(model)


SCHEMA = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids array<int>"


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """ids of each whole text, their number and checksum (little-endian 32-bit), and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in chunks(batches):
            ids, texts = [], batch.column("text").to_pylist()
            for text in texts:
                ids.append(one.encode(text))
            same = [one.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same), lists], names=["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).transform(mapped, run, SCHEMA)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            texts = [one.decode(np.array([i for i in x if i is not None and 0 <= i < len(one.raw)], np.int32)) if x is not None else None for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).transform(mapped, run, "doc_id long, text string")
