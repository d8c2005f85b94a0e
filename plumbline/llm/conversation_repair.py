"""Repair of damaged conversations by signature deduplication.

A conversation's roles and faults are written as a compact string, its *signature*, one character a row. Every distinct
signature is solved once, by memoised recursion over its halves, and the cheapest audit is joined back to all
conversations that share it; then the edits are replayed over the rows.

Faults (the first that holds counts): *blank*, without a character outside of white space; *duplicate*, role and text seen
earlier in the conversation; *truncated*, the last character outside of white space isn't one of ``.!?``. Edits: Keep (0),
Rerole to user or assistant (1), Delete (2; the only one for blank and duplicate rows), Insert an empty row of user or
assistant anywhere (5); a truncated row that isn't deleted adds 5. The edited roles must read ``(s?(ua)+)?`` by their
initials. Of the cheapest audits (the edits' initials in order) the least in ASCII order is taken.

The recursion gives, for each state of that pattern before and after a piece of a signature, the cheapest audit of the
piece. As inserts stand before a row or at the end of all, of two audits of one cost none is the beginning of the other, so
least audits of the halves make the least audit of the whole; its depth is the logarithm of the length.

Texts are shuffled once, for the replay: rows stream by in order, their conversation's audit before them, and a running
digest is all that is held. Faults and signatures come from rows of ids and digests only, by windows and by two steps of
grouping (``BLOCK`` rows, then the blocks). A signature that many conversations share is looked up apart, without a hot task.
A conversation's digest needs its rows in order, so these pass through one task, as a stream.

Defined results: nulls are replaced by one space, in roles and texts and in what is hashed, but a null turn sorts first and
counts for no gap; rows of a null conversation are one; rows of one turn are taken in order of role, then of the SHA-256 of
the text; an empty role has the initial of a space, as a null one has, and any initial but s, u and a must be reroled or
deleted; repeated rows are duplicates; texts and conversations of any length are read whole; other columns are left out; an
empty table gives no rows; ties are settled as said. A conversation without rows after the damage gives zeros, an empty audit
and the digest of an empty string.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import mapped
from ._graph import cut, looked_up

BLANK, DUPLICATE, TRUNCATED = range(3)
WHITE = " \t\n\v\f\r"
BLOCK = 1024
#: Pieces of a signature up to this length are remembered, so many of them.
PIECE, REMEMBERED = 32, 1 << 13
#: Signatures up to this length may be broadcast, if frequent: bounded by 2,048 of them.
SHORT = 512


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after drops, blanked texts, lost marks, repeats and lost roles, drawn by a checksum of the id."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = df.select(df[conv].alias("conv_id"), df[turn].alias("turn"), blank(df[role]).alias("role"), blank(df[text]).alias("text"))
    kind = F.crc32(F.concat(blank(F.col("conv_id")), F.lit(":"), blank(F.col("turn"))).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


# --- signatures ------------------------------------------------------------------------------------------------------

#: Characters of a signature: the role's initial (o: any other), a capital where truncated, x where the row must go.
_KINDS = "sSuUaAoOx"


def signed(rows: DataFrame) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal and the signature."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    light = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2("text", 256).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"),
        F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    # The same partitioning serves all that follows: one shuffle, of ids and digests.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("place")) > 1
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen"), DUPLICATE).when(F.col("cut_off"), TRUNCATED)
    w = Window.partitionBy("conv_id").orderBy(*order)
    before = F.lag(F.struct("initial", "turn")).over(w)
    placed = light.withColumn("place", F.row_number().over(w)).withColumn("before", before).withColumn("seen", seen).withColumn("fault", fault)
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin(BLANK, DUPLICATE), "x").when(F.col("fault") == TRUNCATED, F.upper(initial)).otherwise(initial)
    pair = F.concat(F.col("before.initial"), F.col("initial"))
    blocks = placed.groupBy("conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", symbol.alias("symbol")))), lambda x: x["symbol"]), "").alias("part"),
        *[F.count_if(F.col("fault") == k).alias(name) for k, name in enumerate(("blank", "duplicate", "truncated"))],
        F.count_if(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        F.count_if(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before.turn"))).alias("turns"), F.min("turn").alias("least"), F.max("turn").alias("most"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "")
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps")
    return blocks.groupBy("conv_id").agg(gaps, *counts, whole.alias("signature"))


# --- solving ---------------------------------------------------------------------------------------------------------

#: States of the pattern: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = (START, SYSTEM, USER, ASSISTANT)
#: A user or assistant row of its own choice (Insert, Rerole) leads on in one way only.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
Costs = tuple[tuple[tuple[int, str] | None, ...], ...]


def _one(symbol: str) -> Costs:
    """[state before][state after] -> cheapest (cost, audit) of a row and of inserts before it."""
    plain, extra = symbol.lower(), 5 if symbol in "SUAO" else 0
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in _STATES]
    for before in _STATES:
        state = before
        for inserts in range(3):  # more never help: two inserts on lead back to where they began
            cost, audit = 5 * inserts, "I" * inserts
            ways = [(2, "D", state)]
            if plain != "x":
                ways.append((1 + extra, "R", _NEXT[state]))
                if (plain, state) in _KEPT:
                    ways.append((extra, "K", _KEPT[plain, state]))
            for more, letter, after in ways:
                found = (cost + more, audit + letter)
                if table[before][after] is None or found < table[before][after]:
                    table[before][after] = found
            state = _NEXT[state]
    return tuple(map(tuple, table))


def _joined(left: Costs, right: Costs, befores: tuple[int, ...]) -> Costs:
    """Both pieces one after the other, for some states before the first."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in _STATES]
    for before in befores:
        for after in _STATES:
            cheap = [(left[before][m][0] + right[m][after][0], m) for m in _STATES if left[before][m] and right[m][after]]
            if cheap:
                least = min(cheap)[0]
                table[before][after] = (least, min(left[before][m][1] + right[m][after][1] for cost, m in cheap if cost == least))
    return tuple(map(tuple, table))


@functools.lru_cache(REMEMBERED)
def _piece(signature: str) -> Costs:
    return _one(signature) if len(signature) == 1 else _halves(signature, _STATES)


def _halves(signature: str, befores: tuple[int, ...]) -> Costs:
    middle = len(signature) // 2
    if len(signature) > PIECE:  # pieces of whole multiples recur more often
        middle = (middle // PIECE or 1) * PIECE
    solved = [_piece(x) if len(x) <= PIECE else _halves(x, b) for x, b in ((signature[:middle], befores), (signature[middle:], _STATES))]
    return _joined(*solved, befores)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair."""
    if not signature:
        return 0, ""
    ends = (_piece(signature) if len(signature) <= PIECE else _halves(signature, (START,)))[START]
    closing = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    return min((end[0] + 5 * closing[state], end[1] + "I" * closing[state]) for state, end in enumerate(ends) if end)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(x) for x in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("times"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "times", "cost", "audit"])


def audits(conversations: DataFrame) -> DataFrame:
    """The rows of ``signed`` (cut) with the cost and the audit of their signatures, each distinct one solved once."""
    distinct = conversations.groupBy("signature").agg(F.count("*").alias("times"))
    facts = cut(distinct.transform(mapped, _solved, "signature string, times long, cost long, audit string"))
    short = F.length("signature") <= SHORT
    keyed = lambda df: df.withColumn("_hash", F.xxhash64("signature"))
    frequent = looked_up(keyed(conversations.where(short)), keyed(facts.where(short)), ["_hash", "signature"], "conv_id")
    others = conversations.where(~short).join(facts.where(~short), "signature")
    columns = [*conversations.columns, "cost", "audit"]
    return frequent.select(columns).unionByName(others.select(columns))


# --- replay ----------------------------------------------------------------------------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = ", ".join(f"{c} long" for c in _COUNTS)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits of the audit."""
    state = START
    for letter in audit:
        if letter == "I":
            role, text = "", ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
        if letter == "K":
            state = _KEPT[role[:1], state]
        else:
            state = _NEXT[state]
            role = "user" if state == USER else "assistant"
        yield role, text


def _replayed(batches: Iterator[pa.RecordBatch], kind: pa.DataType, keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, in each its counts and audit first -> one row with the digest, or all edited rows."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    kinds = (kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string())

    def stream() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column("conv_id").to_pylist(), batch.column("facts").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)

    rows, out = stream(), []
    held = 0
    for conv, facts, _, _ in rows:
        mine = ((role, text) for _, _, role, text in rows)  # as many as the audit takes
        if keep:
            for place, (role, text) in enumerate(edited(facts["audit"], mine)):
                out.append((conv, place, role, text))
                held += len(text)
                if held > 1 << 20 or len(out) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])
                    out, held = [], 0
            continue
        digest, between = hashlib.sha256(), b""
        for role, text in edited(facts["audit"], mine):
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        out.append((conv, *(facts[c] for c in _COUNTS), facts["audit"], digest.hexdigest()))
        if len(out) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if out and keep:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])
    elif out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _streamed(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Each conversation's counts and audit, then its rows in order, in one partition."""
    found = audits(cut(signed(rows)))
    zeros = {c: 0 for c in _COUNTS} | {"audit": ""}
    lost = originals.select("conv_id").distinct().select("conv_id", *[F.lit(v).cast("string" if c == "audit" else "long").alias(c) for c, v in zeros.items()])
    # Conversations without a row left have zeros; the others have both, and what is greater holds.
    every = found.select("conv_id", *zeros).unionByName(lost).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in zeros])
    heads = every.select("conv_id", F.struct(*zeros).alias("facts"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("digest"))
    body = rows.select("conv_id", F.lit(None).cast(heads.schema["facts"].dataType).alias("facts"), "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("facts").isNull().asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "facts", "role", "text")


def repair(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Per conversation of the originals, which hold those of the rows (conv_id, turn, role, text): counts, cost, audit and the digest of what is repaired."""
    stream = _streamed(rows, originals if originals is not None else rows)
    kind = stream.schema["conv_id"].dataType
    arrow = pa.int64() if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string()
    return stream.transform(mapped, lambda it: _replayed(it, arrow, False), f"conv_id {kind.simpleString()}, {_RESULT}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations themselves."""
    stream = _streamed(rows, rows)
    kind = stream.schema["conv_id"].dataType
    arrow = pa.int64() if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string()
    return stream.transform(mapped, lambda it: _replayed(it, arrow, True), f"conv_id {kind.simpleString()}, place long, role string, text string")


def damaged_and_repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair`` of the damaged rows, for every conversation that the rows have before the damage."""
    return repair(damage(df, conv, turn, role, text), df.select(df[conv].alias("conv_id")))


def _moved(state: str, cost: str, letter: str, line: str = "") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r" + (f" || chr(10) || {line}" if line else "") + "}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _if(test: str, way: str) -> str:
    return f"CASE WHEN {test} THEN {way} ELSE {{'c': 1000000000, 'a': '', 'r': ''}} END"


_INSERTED = {"U": "'user:'", "A": "'assistant:'"}
_U = lambda q: _moved(q, "5", "I", _INSERTED["U"])
_UA = lambda q: _moved(q, "10", "II", f"{_INSERTED['U']} || chr(10) || {_INSERTED['A']}")
_ROW = {
    "n": _moved("n", "2", "D"),
    "s": _least(_moved("s", "2", "D"), _if("NOT gone AND i = 's'", _moved("n", "e", "K", "role || ':' || text"))),
    "u": _least(
        _moved("u", "2", "D"), *[_if("NOT gone", _moved(q, "e + 1", "R", "'user:' || text")) for q in "nsa"], *[_if("NOT gone AND i = 'u'", _moved(q, "e", "K", "role || ':' || text")) for q in "nsa"]
    ),
    "a": _least(_moved("a", "2", "D"), _if("NOT gone", _moved("u", "e + 1", "R", "'assistant:' || text")), _if("NOT gone AND i = 'a'", _moved("u", "e", "K", "role || ':' || text"))),
}
_NOTHING, _FAR = "{'c': 0, 'a': '', 'r': ''}", "{'c': 1000000000, 'a': '', 'r': ''}"
#: The same rows in SQL: a recursive query that carries the cheapest audit of each state from row to row.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda j: CAST(ascii(substr(k, j, 1)) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM raw, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE kind <> 0)),
placed AS (
  SELECT conv_id, turn, role, text, CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM placed),
judged AS (
  SELECT *, body = '' OR nth > 1 AS gone, body <> '' AND nth = 1 AND NOT right(body, 1) IN ('.', '!', '?') AS truncated,
    coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i NOT IN ('su', 'ua', 'au'), false) AS illegal FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(body = '') AS blank, count_if(body <> '' AND nth > 1) AS duplicate, count_if(truncated) AS truncated,
    count_if(illegal) AS illegal, max(place) AS last FROM judged GROUP BY conv_id),
solved AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, {_NOTHING} AS n, {_FAR} AS s, {_FAR} AS u, {_FAR} AS a FROM counts
  UNION ALL
  SELECT conv_id, place, {_ROW["n"]} AS n, {_ROW["s"]} AS s, {_ROW["u"]} AS u, {_ROW["a"]} AS a
  FROM (
    SELECT j.conv_id, j.place, j.role, j.text, j.i, j.gone, CASE WHEN j.truncated THEN 5 ELSE 0 END AS e, p.n AS n, p.s AS s,
      {_least("p.u", _U("p.n"), _U("p.s"), _U("p.a"))} AS u, {_least("p.a", _moved("p.u", "5", "I", _INSERTED["A"]), _UA("p.n"), _UA("p.s"))} AS a
    FROM solved p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.place = p.place + 1)),
ended AS (
  SELECT c.*, {_least("n", _UA("s"), _moved("u", "5", "I", _INSERTED["A"]), "a")} AS best FROM solved x JOIN counts c ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND x.place = c.last)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
