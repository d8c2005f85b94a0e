"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Three patterns (assignments, access keys, hexadecimal runs) are the base. Beside them, every candidate string (a run
of key characters holding letters and digits, or letters of both cases) is read through a sliding window whose character
counts are updated incrementally; where a window's entropy reaches the threshold of its character class, the whole
candidate string is one ``entropy`` span, so that no part of a key stays. Letters of one case alone are taken for words.
An allow-list takes out what is random by design but public (UUIDs, dates, version strings, digests of lock files).

Defined results: a null or empty text has no secrets; an empty table gives no rows; repeated rows are each scanned;
a null id is carried through; other columns are left out by ``scan`` and kept by ``redact``. All scans are linear in the text, however
long; spans that start together (ties) stand in the order of their kinds.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import chunks, mapped, mapped_text

#: Fixed patterns of the base kinds, and the least length of what counts (of group 2, of the match, of the match).
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

#: Strings of key characters; those of digits only, or of letters of one case, are numbers or words and can't be told from keys.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WINDOW = 20
#: Bits that a window of WINDOW characters must reach, by class: 20 random ones have 3.4 (16 symbols) to 4.1 (64 symbols).
#: Shorter windows need the same share of the most they can have.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "base64": 3.7, "mixed": 3.6, "few": 3.9}
#: A window holds so many letters at least; with so many digits its class is hex, alnum or base64.
LEAST_OF_EACH = 3
#: With fewer digits, letters of both cases are a key ("mixed") if so large a share of neighbours differ in kind; words do so less.
TURNS = 0.3
#: Strings that are random by design and public.
ALLOW = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9]{2}-?[0-9]{2}-?[0-9]{2}Z?",
    r"sha(256|384|512)-[A-Za-z0-9+/]+={0,2}",
)
_HEX_SET, _DIGITS = frozenset("0123456789abcdefABCDEF"), frozenset("0123456789")
_KIND = str.maketrans({chr(c): "d" if chr(c).isdigit() else "u" if chr(c).isupper() else "l" if chr(c).islower() else "o" for c in range(128)})
_TURN = frozenset(("lu", "ul", "ld", "dl", "ud", "du"))
_BITS = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def entropy_windows(s: str, width: int = WINDOW) -> Iterator[tuple[int, float, str]]:
    """(start, entropy in bits, class) of each window that may be a key; a shorter string is one window.

    Three digits and three letters make it hex, alnum or base64. With fewer digits, letters of both cases that change
    often make it mixed (without a digit, two capitals must meet, which words written together avoid), and letters of
    one case with a digit make it few (unless signs part it into words).
    """
    width = min(width, len(s))
    kinds = s.translate(_KIND)
    counts: dict[str, int] = {}
    weight, not_hex, turns, capitals = 0.0, 0, 0, 0
    of = dict.fromkeys("dulo", 0)

    def put(i: int, by: int) -> None:
        nonlocal weight, not_hex
        n = counts.get(c := s[i], 0)
        counts[c] = n + by
        weight += _BITS[n + by] - _BITS[n]
        of[kinds[i]] += by
        not_hex += by * (c not in _HEX_SET)

    def pair(i: int, by: int) -> None:
        nonlocal turns, capitals
        turns += by * ((p := kinds[i : i + 2]) in _TURN)
        capitals += by * (p == "uu")

    for i in range(len(s)):
        if i >= width:
            put(i - width, -1)
            pair(i - width, -1)
        put(i, 1)
        if i and width > 1:
            pair(i - 1, 1)
        if i < width - 1 or of["u"] + of["l"] < LEAST_OF_EACH:
            continue
        if of["d"] >= LEAST_OF_EACH:
            kind = "hex" if not not_hex else "base64" if of["o"] else "alnum"
        elif of["u"] and of["l"]:
            if turns < TURNS * (width - 1) or not (of["d"] or capitals):
                continue
            kind = "mixed"
        elif of["d"] and of["o"] < 2:
            kind = "few"
        else:
            continue
        yield i - width + 1, math.log2(width) - weight / width, kind


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) by start, then kind; leftmost non-overlapping per kind, failing matches dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def added_spans(text: str, base: list[tuple[int, int, int]], allow: re.Pattern, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int, int]]:
    """Candidate strings with a high-entropy window, whole, less the base spans in them.

    Beside a base span, what is left counts if a window of its own does, or if letters or digits run on into the span.
    """
    found: list[tuple[int, int, int]] = []
    taken: list[list[int]] = []  # the union of the base spans
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for m in CANDIDATE.finditer(text):
        s, start, end = m[0], *m.span()
        if s.isdigit() or not _DIGITS.intersection(s) and (s == s.lower() or s == s.upper()) or allow.fullmatch(s):
            continue
        share = math.log2(min(WINDOW, len(s))) / math.log2(WINDOW)
        near = bisect.bisect_right(taken, [start, end])
        near -= bool(near and taken[near - 1][1] > start)
        if near == len(taken) or taken[near][0] >= end:
            if any(bits >= share * thresholds[kind] for _, bits, kind in entropy_windows(s)):
                found.append((start, 3, end))
            continue
        width = min(WINDOW, len(s))
        hits = [start + i for i, bits, kind in entropy_windows(s) if bits >= share * thresholds[kind]]
        at = start
        while hits and at < end:
            a, b = taken[near] if near < len(taken) else (end, end)
            a = min(a, end)
            if at < a:
                own = bisect.bisect_left(hits, at)
                joined = at > start and text[at - 1 : at + 1].isalnum() or a < end and text[a - 1 : a + 1].isalnum()
                if joined or own < len(hits) and hits[own] + width <= a:
                    found.append((at, 3, a))
            at, near = max(at, b), near + 1
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(text: str | None, allow: re.Pattern) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text := text or "")
    return base, sorted(base + added_spans(text, base, allow))


def _allow(more: Sequence[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{x})" for x in (*ALLOW, *more)))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ()) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, and all spans (code points, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = _allow(allow)
        for batch in chunks(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, every = find(text, allowed)
                n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return docs.transform(mapped, run, SCHEMA)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", allow: Sequence[str] = ()) -> DataFrame:
    """The same rows and columns, every found span of the text replaced by the mark (overlapping spans by one)."""

    def change():
        allowed = _allow(allow)

        def one(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for a, _, b in find(text, allowed)[1]:
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return lambda texts: [one(x) for x in texts]

    return mapped_text(df, text_col, change)
