"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Four patterns (e-mail addresses, IP addresses, card and phone numbers) are the base. The field labels every word of a
text with one of the four kinds or none, from the shapes of the word and its neighbours (runs of letters, digits and
marks), digit counts and a few key words; it is trained by gradient ascent on a small labelled table that this module
states as templates. Its spans are added where no base span lies, so it catches forms that no pattern lists:
"name (at) example dot com", numbers without a plus, cards with other separators.

Decoding is Viterbi in numpy over all words of a batch. Where a word's lead for "none" exceeds what any transition could
change, "none" is on the best path whatever its neighbours are: chains are cut there, exactly, and only the short runs
between are decoded, side by side.

Defined results: null and empty texts hold nothing; an empty table gives no rows; repeated rows are read each; a null id
is carried through; other columns are left out by ``find`` and kept by ``redact``; a very long text is read whole, alone in its chunk;
of labellings with equal scores (ties) the kind listed first wins.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import BASE_1, BASE_2, BYTE_1, Texts, chunks, mapped, mapped_text, prefix_hash, span_hash

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Fixed patterns of the base kinds. A match of the last three starts where its digits or its plus do, so each is linear.
EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost non-overlapping per kind, failing matches dropped."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _NAME:
            start -= 1
        m = EMAIL_END.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        # A name can't reach over an @, so what is before it needn't be read again.
        last = max(last, at + 1) if not m else last
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((3, *m.span()))
    return found


# --- the field -------------------------------------------------------------------------------------------------------

SHAPES, DIGITS, WORDS = 4096, 24, 16
#: Words that tell of what stands beside them.
KEY_WORDS = ("at", "dot", "(at)", "[at]", "(dot)", "[dot]", "email", "mail", "tel", "phone", "call", "card", "visa", "ip", "host")
#: Byte classes: other, lower, upper, digit, and some marks of their own.
_CLASS = np.full(256, 1, np.uint64)
_CLASS[:128] = 2
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 3, 4
for _i, _c in enumerate(b"@.-+():_/,"):
    _CLASS[_c] = 5 + _i
_CLASS *= np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(BYTE_1[data], BASE_1), np.array([0]), np.array([len(data)]), BASE_1)[0])


@functools.cache
def _key_hashes() -> tuple[np.ndarray, np.ndarray]:
    hashes = np.array([_word_hash(w) for w in KEY_WORDS], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order + 1


def observe(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, and their three feature numbers: shape, digit count, key word."""
    starts, ends, rows = texts.words()
    data = texts.data
    kind = _CLASS[data]
    # The shape is the sequence of classes, a run counting once.
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    kept = np.append(0, np.cumsum(change))
    shape = span_hash(prefix_hash(kind[change], BASE_2), kept[starts], kept[ends], BASE_2) if len(starts) else np.zeros(0, np.uint64)
    digits = np.append(0, np.cumsum((data >= 48) & (data <= 57)))
    n = np.minimum(digits[ends] - digits[starts], DIGITS - 1)
    word = span_hash(prefix_hash(BYTE_1[_LOWER[data]], BASE_1), starts, ends, BASE_1)
    known, number = _key_hashes()
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    key = np.where(known[at] == word, number[at], 0)
    return starts, ends, rows, np.column_stack([(shape % np.uint64(SHAPES)).astype(np.int64), n, key])


class Field:
    """Weights: per feature a table (previous, own, next word) x value x label, and label transitions."""

    def __init__(self):
        self.tables = [np.zeros((3, size, NONE + 1)) for size in (SHAPES, DIGITS, WORDS)]
        for t in self.tables:  # what the labelled table never shows speaks for none
            t[1, :, NONE] = 0.5
        self.steps = np.zeros((NONE + 1, NONE + 1))

    def emissions(self, features: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Label scores of each word; ``edge`` marks words that begin a text."""
        out = np.zeros((len(features), NONE + 1))
        for f, table in enumerate(self.tables):
            x = features[:, f]
            out += table[1][x]
            before, after = table[0][np.roll(x, 1)], table[2][np.roll(x, -1)]
            before[edge] = 0
            after[np.roll(edge, -1)] = 0
            out += before + after
        return out

    def decode(self, features: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The best label of each word, for all texts of a batch at once."""
        n = len(features)
        out = np.full(n, NONE)
        if not n:
            return out
        score = self.emissions(features, edge)
        lead = score[:, NONE] - score[:, :NONE].max(1)
        unsure = lead <= 2 * (self.steps.max() - self.steps.min())
        first = np.flatnonzero(unsure & (edge | ~np.append(False, unsure[:-1])))
        last = np.flatnonzero(unsure & (np.append(edge[1:], True) | ~np.append(unsure[1:], False)))
        length = last - first + 1
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        for a in range(0, len(first), 4096):
            self._runs(score, edge, first[a : a + 4096], length[a : a + 4096], out)
        return out

    def _runs(self, score: np.ndarray, edge: np.ndarray, first: np.ndarray, length: np.ndarray, out: np.ndarray) -> None:
        """Viterbi over runs of words, longest first; the neighbours of a run are none, or the text's ends."""
        best = score[first] + np.where(edge[first][:, None], 0, self.steps[NONE])
        back = []
        final = np.empty_like(best)
        n = len(score)
        for t in range(int(length[0])):
            ends = slice(int(np.searchsorted(-length, -(t + 1), "left")), int(np.searchsorted(-length, -t, "left")))
            stop = first[ends] + t + 1
            closed = (stop >= n) | edge[np.minimum(stop, n - 1)]
            final[ends] = best[ends] + np.where(closed[:, None], 0, self.steps[:, NONE])
            live = ends.start
            if not live:
                break
            through = best[:live, :, None] + self.steps
            back.append(through.argmax(1))
            best = through.max(1) + score[first[:live] + t + 1]
        label = final.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            out[first[:live] + t] = label[:live]
            if t:  # as many runs go on from t - 1 to t as are longer than t
                label[:live] = back[t - 1][np.arange(live), label[:live]]


def labelled_table(n: int = 900, seed: int = 5) -> tuple[list[str], list[list[int]]]:
    """The small labelled table: sentences of invented words with personal data of many forms, and numbers that are none."""
    rng = np.random.RandomState(seed)

    def digits(k: int) -> str:
        return "".join(str(x) for x in rng.randint(0, 10, k))

    def word() -> str:
        w = "".join(rng.choice(list("abcdefghilmnoprstuväéñ"), rng.randint(1, 10)))
        form = rng.randint(0, 16)
        return (w.capitalize() + ",.;:!?"[rng.randint(6)] if form == 15 else w + ",.;:!?"[rng.randint(6)] if form == 0 else w.capitalize() if form == 1 else w.upper() if form == 2 else w + "!!" if form == 3 else w + "".join(rng.choice(list("#*$%&|"), 3)) if form == 4 else f"{w}-{w}" if form == 5 else w)

    def name() -> str:
        return "".join(rng.choice(list("abcdefgijklmnorstu"), rng.randint(3, 8)))

    def card() -> str:
        body = digits(15)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def entity() -> tuple[list[str], int]:
        kind = rng.randint(0, 4)
        if kind == 0:
            a, b = name(), name()
            return [[f"{a}.{digits(2)}@{b}.example.com"], [f"{a}@{b}.org"], [a, "(at)", b, "(dot)", "com"], [a, "at", b, "dot", "org"], [a, "[at]", f"{b}.com"], [a, "(at)", f"{b}.net"], [f"<{a}@{b}.net>"]][rng.randint(7)], 0
        if kind == 1:
            a = ".".join(str(x) for x in rng.randint(1, 255, 4))
            return [[a], [f"{a}:{digits(4)}"], [f"({a})"], [f"{a},"]][rng.randint(4)], 1
        if kind == 2:
            c = card()
            return [[c], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join((c[:4], c[4:8], c[8:12], c[12:]))], [".".join((c[:4], c[4:8], c[8:12], c[12:]))], [f"{c}."]][rng.randint(5)], 2
        a, b, c = digits(3), digits(3), digits(4)
        return [["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+44{digits(10)}"], [f"+{digits(2)}", a, b, c], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"]][rng.randint(7)], 3

    def ended(words: list[str]) -> list[str]:
        return [*words[:-1], words[-1] + ",.;:?!"[rng.randint(6)]] if rng.randint(4) == 0 else words

    def plain() -> list[str]:
        if rng.randint(8) == 0:  # the key words in plain speech
            return [[word(), "at", word()], ["at", "the", word()], ["the", "dot", word()], [word(), "at", word(), "at", word()], ["the", "card", word()], ["call", word()]][rng.randint(6)]
        forms = (digits(rng.randint(1, 7)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{rng.randint(1, 99)}.{digits(2)}", f"${digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)}", f"no-{digits(4)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
                 f"{digits(2)}-{digits(2)}", f"({digits(4)})", f"{name()}={digits(3)}{name()}{digits(8)}", f"{name().upper()}{digits(2)}{name().upper()}{digits(1)}", f"{digits(2)}/{digits(2)}/{digits(4)}", digits(9), digits(rng.randint(20, 40)), f"{digits(3)}{name()}{digits(6)}", "at", "dot", "|", "-", "@", "(at)", "+")
        return [forms[rng.randint(len(forms))]]

    sentences, labels = [], []
    for _ in range(n):
        words: list[str] = []
        marks: list[int] = []
        for _ in range(rng.randint(2, 8)):
            kind = rng.randint(0, 10)
            got, mark = entity() if kind < 2 else (plain(), NONE) if kind < 5 else ([word() for _ in range(rng.randint(1, 6))], NONE)
            got = ended(got) if mark != NONE else got
            words += got
            marks += [mark] * len(got)
        sentences.append(" ".join(words))
        labels.append(marks)
    return sentences, labels


ROUNDS, RATE, DECAY = 90, 0.25, 2e-3


@functools.cache
def trained() -> Field:
    """Weights of highest penalised likelihood on the labelled table: forward-backward gradients, Adagrad steps."""
    sentences, labels = labelled_table()
    texts = Texts(pa.array(sentences))
    _, _, rows, features = observe(texts)
    y = np.concatenate([np.array(x) for x in labels])
    edge = np.append(True, rows[1:] != rows[:-1])
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(rows)))
    most, n, k = int(length.max()), len(first), NONE + 1
    at = np.minimum(first[:, None] + np.arange(most), len(rows) - 1)
    real = np.arange(most) < length[:, None]
    field = Field()
    squares = [np.full_like(t, 1e-3) for t in field.tables] + [np.full_like(field.steps, 1e-3)]
    for _ in range(ROUNDS):
        score = field.emissions(features, edge)[at]
        a, b = np.zeros((most, n, k)), np.zeros((most, n, k))
        a[0] = score[:, 0]

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

        for t in range(1, most):
            a[t] = np.where(real[:, t, None], total(a[t - 1][:, :, None] + field.steps, 1) + score[:, t], a[t - 1])
        for t in range(most - 2, -1, -1):
            b[t] = np.where(real[:, t + 1, None], total(field.steps + (b[t + 1] + score[:, t + 1])[:, None, :], 2), b[t + 1])
        whole = total(a[most - 1], 1)
        share = np.zeros((len(rows), k))
        pairs = np.zeros((k, k))
        for t in range(most):
            live = real[:, t]
            share[at[live, t]] = np.exp(a[t][live] + b[t][live] - whole[live, None])
            if t:
                pairs += np.exp(a[t - 1][live][:, :, None] + field.steps + (score[live, t] + b[t][live])[:, None, :] - whole[live, None, None]).sum(0)
        share = -share
        share[np.arange(len(y)), y] += 1
        seen = np.zeros((k, k))
        inner = np.flatnonzero(~edge)
        np.add.at(seen, (y[inner - 1], y[inner]), 1)
        grads = []
        for f, table in enumerate(field.tables):
            g = np.zeros_like(table)
            x = features[:, f]
            np.add.at(g[1], x, share)
            np.add.at(g[0], x[inner - 1], share[inner])
            np.add.at(g[2], x[inner], share[inner - 1])
            grads.append(g - DECAY * len(rows) ** 0.5 * table * (g != 0))
        grads.append(seen - pairs)
        for w, g, s in zip([*field.tables, field.steps], grads, squares, strict=True):
            s += g * g
            w += RATE * g / np.sqrt(s)
    return field


_TRIM = ".,;:!?<>[]'\"|*#$%&"


#: An address within a span of the field, whose neighbouring words are left out.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[(\[]\s*at\s*[)\]]|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[(\[]\s*dot\s*[)\]]|\sdot\s)\s*[A-Za-z0-9-]+)+", re.I)
#: Endings that an address spelled with the bare words "at" and "dot" must have; without an ending it is plain speech.
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv eu uk us de fr it es nl be ch at se no fi dk pl pt cz ru ua tr jp cn kr in au nz ca br mx ar za example".split())


def _checked(kind: int, text: str) -> bool:
    """What a span of the kind must hold at least; keeps chance labels of odd words out."""
    n = sum(map(text.count, "0123456789"))
    if kind == 0:
        return not re.search(r"\sdot\s", text, re.I) or text.split()[-1].lower() in ENDINGS
    if kind == 1:
        parts = re.fullmatch(r"\(?([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)(?::[0-9]+)?\)?", text)
        return bool(parts) and all(len(p) <= 3 and int(p) <= 255 for p in parts.groups())
    if kind == 2:
        digits = re.sub("[^0-9]", "", text)
        return 13 <= len(digits) <= 19 and not re.search("[A-Za-z]", text) and luhn(digits)
    return 8 <= n <= 15 and len(text) <= 2 * n and not re.search(r"[^0-9+().\x20-]", text) and bool(re.search(r"[+().\x20-]", text)) and not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+\.[0-9]+|[0-9]+(\.[0-9]+){3}", text)


def find_in(texts: Texts, strings: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per text the base spans, and all spans: (kind, start, end) in code points."""
    out = [(base := base_spans(s), list(base)) for s in strings]
    starts, ends, rows, features = observe(texts)
    if not len(starts):
        return out
    label = field.decode(features, np.append(True, rows[1:] != rows[:-1]))
    hit = np.flatnonzero(label != NONE)
    if len(hit):
        new = np.append(True, (hit[1:] != hit[:-1] + 1) | (label[hit[1:]] != label[hit[:-1]]) | (rows[hit[1:]] != rows[hit[:-1]]))
        a = hit[new]
        b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
        points = np.append(0, np.cumsum((texts.data & 0xC0) != 0x80))
        union: dict[int, tuple[list[int], list[int]]] = {}
        for i, j in zip(a, b, strict=True):
            row = int(rows[i])
            zero = points[texts.offsets[row]]
            x, y = int(points[starts[i]] - zero), int(points[ends[j]] - zero)
            s = strings[row][x:y]
            x, y = x + len(s) - len(s.lstrip(_TRIM)), y - (len(s) - len(s.rstrip(_TRIM)))
            kind = int(label[i])
            if kind == 0:
                m = SPELLED.search(strings[row], x, y)
                x, y = m.span() if m else (x, x)
            base, every = out[row]
            if row not in union:
                by = sorted((p, q) for _, p, q in base)
                union[row] = [p for p, _ in by], list(itertools.accumulate((q for _, q in by), max))
            starting, reach = union[row]
            before = bisect.bisect_left(starting, y)  # base spans that start before y, and how far they reach
            if x < y and _checked(kind, strings[row][x:y]) and not (before and reach[before - 1] > x):
                every.append((kind, x, y))
    return [(base, sorted(every)) for base, every in out]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts by kind, a digest of the base spans, and all spans (code points, end exclusive)."""

    sent = df.sparkSession.sparkContext.broadcast(trained())  # about half a megabyte, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in chunks(batches):
            strings = [s or "" for s in batch.column("text").to_pylist()]
            rows = []
            for doc, (base, every) in zip(batch.column("doc_id").to_pylist(), find_in(Texts(batch.column("text")), strings, field), strict=True):
                n = [sum(k == kind for k, _, _ in base) for kind in range(NONE)]
                rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).transform(mapped, run, SCHEMA)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, every span of the text replaced by its kind in angle brackets."""

    sent = df.sparkSession.sparkContext.broadcast(trained())

    def change():
        field = sent.value

        def all_of(texts: list[str | None]) -> list[str | None]:
            strings = [s or "" for s in texts]
            out = []
            for text, s, (_, spans) in zip(texts, strings, find_in(Texts(pa.array(strings, pa.string())), strings, field), strict=True):
                parts, at = [], 0
                for kind, a, b in sorted(spans, key=lambda x: x[1]):
                    if a >= at:
                        parts += [s[at:a], f"<{KINDS[kind]}>"]
                    at = max(at, b)
                out.append(None if text is None else "".join([*parts, s[at:]]))
            return out

        return all_of

    return mapped_text(df, text_col, change)
