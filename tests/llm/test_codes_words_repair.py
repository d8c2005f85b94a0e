"""Vector codes, byte-level BPE and conversation repair against brute force, SQL and round trips; and their defined edge cases."""

import functools
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, conversation_repair, queries, vector_codes
from plumbline.llm.vector_codes import Codebook, assigned

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_conversation_repair"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF_DIR)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# --- vector codes ----------------------------------------------------------------------------------------------------


def coded(rows, parts=16, entries=64, rounds=2):
    """Brute force in integers: {position in rows: (id, code, error, label error)}, digest."""
    kept = [(i, v, label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    first = min((i, v) for i, v, _ in kept if i is not None)[1]
    kept = [(i, [int(c) * 256 if abs(c) > 2**53 else math.floor(256 * c) for c in v], label) for i, v, label in kept if len(v) == len(first)]
    dim = len(first)
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    starts = [min(v for i, v, _ in kept if i == j) for j in ids]
    cut = [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]
    books = [[x[a:b] for x in starts] for a, b in cut]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), j) for j, e in enumerate(book)) for (a, b), book in zip(cut, books)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(cut):
            for j in range(len(books[p])):
                mine = [v[a:b] for (_, v, _), f in zip(kept, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    text = ",".join(str(c) for book in books for e in book for c in e)
    long = lambda x: min(x, 2**63 - 1)
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), long(e), long(sum(long(x) for x, (_, _, k) in zip(errors, kept) if k == label)), hashlib.sha256(text.encode()).hexdigest()) for (i, _, label), f, e in zip(kept, found, errors)), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, code string, part int, `_label` string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], VECTORS).repartition(3)


def check(spark, rows):
    got = sorted((tuple(r) for r in vector_codes.quantise(vectors(spark, rows)).collect()), key=repr)
    assert got == coded(rows)


def test_codes_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i * 7 % 400, [round(rng.gauss(0, 0.1), 2) for _ in range(32)], rng.choice([None, 0, 1])) for i in range(400)]
    rows += [(500 + i, rows[3][1], 2) for i in range(300)]  # one vector, many times
    rows += [rows[0], rows[0], (None, rows[9][1], 1), (900, None, 1), (901, [], 1), (902, [float("nan"), *[0.0] * 31], 1), (903, [float("inf"), *[0.0] * 31], 1), (904, [None, *[0.0] * 31], 1), (905, [0.5] * 31, 1)]
    check(spark, rows)


@pytest.mark.parametrize("dim", [5, 16, 40])
def test_codes_of_few_rows_and_any_length(spark, dim):
    rng = random.Random(dim)
    check(spark, [(i, [rng.choice([0.0, 0.004, 0.01, -0.01]) for _ in range(dim)], None) for i in range(20)])


def test_codes_of_very_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], i % 2) for i in range(90)]
    rows += [(100 + i, [rng.gauss(0, 1) * 10.0 ** rng.choice([3, 6, 20, 300]) for _ in range(16)], 5) for i in range(30)]
    rows += [(-1, [1e30, *[0.0] * 15], 7), (-2, [0.1] * 16, 7)]
    check(spark, rows)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(None, [0.5] * 16, 1)]):
        assert vector_codes.quantise(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)).count() == 0


def test_bounds_hold_and_prune():
    """After entries moved, pruned assignments are those of all distances, and the bounds enclose the distances."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 30, (3000, 4)))
    entries = [list(map(int, row)) for row in x[:64]]
    first = Codebook(entries)
    square = first.measured(x)
    code = square.argmin(1)
    moved = [[c + int(rng.integers(-2, 3)) for c in e] for e in entries]
    moved[5] = list(moved[4])  # equal entries: the lower index wins
    book = Codebook(moved, entries)
    found, upper, lower = assigned(book, x, code, np.sqrt(square.min(1)) * (1 + 1e-9), np.sqrt(square) * (1 - 1e-9))
    true = book.measured(x)
    assert (found == true.argmin(1)).all() and not (found == 5).any()
    assert (upper >= np.sqrt(true[np.arange(len(x)), found])).all() and (lower <= np.sqrt(true)).all()
    open_ = np.maximum(np.sqrt(square) * (1 - 1e-9) - book.moved, 0) <= (np.sqrt(square.min(1)) + book.moved[code])[:, None]
    assert open_.mean() < 0.3  # most distances are ruled out


# --- byte-level BPE --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(), special_tokens={})


def test_encodes_as_the_library_and_decodes_back(spark, library):
    rng = random.Random(4)
    texts = ["", None, " ", "\n\n  x", "a" * 70_000, " \t" * 9000, "été 中文 　ok'll<|endoftext|>", "𐵀 ͸ ᲊ'S", "the the the " * 3000, "\x00\x00 \x00a", "a  b   c \n d"]
    texts += ["".join(rng.choice(["the ", "word", "'ve", "  ", "\n", "é", "日", "12", "!?", "🙂", "​", " "]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t, "s", "g", 1) for i, t in enumerate(texts)] + [(None, "no id", "s", "g", 1), (3, texts[3], "s", "g", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, `group` string, bucket int").repartition(3)
    for limit in (200, byte_bpe.GROUP_BYTES):
        got = byte_bpe.decode(byte_bpe.encode(df, group_bytes=limit)).collect()
        assert sorted((repr(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == sorted((repr(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    one = {r.doc_id: r for r in byte_bpe.digests(df).collect()}
    ids = library.encode_ordinary(texts[6])
    assert one[6].n_tokens == len(ids) and one[6].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and one[6].decoded_sha256 == hashlib.sha256(texts[6].encode()).hexdigest()
    assert one[0].n_tokens == 0 and one[1].ids_sha256 == one[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.digests(df.limit(0)).count() == 0


def test_long_texts_are_cut_where_a_match_ends(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 5)
    split = byte_bpe.splitter(byte_bpe.stand_ins())
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice([" ", " ", "a", "b", "\n", "1", ".", "'s", "é"]) for _ in range(40))
        assert [i for words in split(text) for w in words for i in byte_bpe.word_encoder()(w.encode())] == library.encode_ordinary(text)


def test_every_code_point_is_split_as_the_library_does(library):
    split = byte_bpe.splitter(byte_bpe.stand_ins())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 499):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}'s!{chr(c)}" for c in points[a : a + 499])
        assert [i for words in split(text) for w in words for i in byte_bpe.word_encoder()(w.encode())] == library.encode_ordinary(text)


def test_ids_outside_of_the_vocabulary_are_an_error(spark):
    df = spark.createDataFrame([([1, 60_000],)], "ids array<int>")
    with pytest.raises(Exception, match="outside of the vocabulary"):
        byte_bpe.decode(df).collect()
    empty = spark.createDataFrame([(None, "x"), ([], "y")], "ids array<int>, decoded string")
    assert [bytes(r.out) for r in byte_bpe.decode(empty, out="out").collect()] == [b"", b""]


def test_token_table_holds_every_rank(spark):
    table = byte_bpe.token_table(spark)
    assert table.count() == table.select("id").distinct().count() == len(byte_bpe.ranks())


# --- conversation repair ---------------------------------------------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


@functools.cache
def cheapest(signature):
    """(cost, audit) by recursion over rows, keeping whole audits."""

    @functools.cache
    def go(i, last, inserts):
        ways = [(0, "")] if i == len(signature) and last in ("", "a") else []
        if inserts < 3:
            ways.append((5, "I", go(i, NEXT[last], inserts + 1)))
        if i < len(signature):
            x = signature[i]
            more = 5 if x.isupper() else 0
            ways.append((2, "D", go(i + 1, last, 0)))
            if x != "x":
                ways.append((1 + more, "R", go(i + 1, NEXT[last], 0)))
                if x.lower() == NEXT[last] or (x.lower(), last) == ("s", ""):
                    ways.append((more, "K", go(i + 1, x.lower(), 0)))
        return min(((w[0], w[1]) if len(w) == 2 else (w[0] + w[2][0], w[1] + w[2][1])) for w in ways) if ways else (10**9, "")

    return go(0, "", 0)


def repaired_rows(rows):
    """Brute force of the contract for (conv_id, turn, role, text) rows."""
    found = {}
    blank = lambda x: " " if x is None else x
    for c, t, r, x in rows:
        mine = found.setdefault(c, [])
        kind = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        r, x = blank(r), blank(x)
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        mine += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, mine in found.items():
        mine.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).hexdigest()))
        turns = {t for t, _, _ in mine if t is not None}
        seen, faults, signature = set(), [0, 0, 0], ""
        initials = [r[:1] or " " for _, r, _ in mine]
        for (_, r, x), i in zip(mine, initials):
            body = x.rstrip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (r, x) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((r, x))
            i = i if i in "sua" else "o"
            signature += i if fault is None else "x" if fault < 2 else i.upper()
            if fault is not None:
                faults[fault] += 1
        cost, audit = cheapest(signature)
        out, last, source = [], "", iter(mine)
        for letter in audit:
            _, role, text = ("", "", "") if letter == "I" else next(source)
            if letter != "D":
                last = role[0] if letter == "K" else NEXT[last]
                out.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        yield (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_solutions_equal_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        s = "".join(rng.choice("sSuUaAoOxuuaa") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 20, 33, 70])))
        assert conversation_repair.solve(s) == cheapest(s)
        cheapest.cache_clear()


def test_a_long_conversation_is_solved_without_deep_recursion():
    cost, audit = conversation_repair.solve("s" + "ua" * 100_000 + "u")
    assert (cost, audit) == (2, "sua".replace("s", "K")[0] + "K" * 200_000 + "D")


def test_repair_equals_brute_force_and_sql(spark):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice([None, "", " \n", "hi.", "hi", "Ok!  ", "x" * 50 + "?", "déjà."])) for c in [*range(60), None] for _ in range(rng.randint(0, 14))]
    rows += [(1000 + c, t, r, f"{r} {t}.") for c in range(300) for t, r in enumerate(["system", *["user", "assistant"] * 2])]  # a common signature
    rows += [(5000, t, "user" if t % 2 else "assistant", f"{t}!" + " " * 3000) for t in range(2500)]  # a long conversation, of several blocks
    df = spark.createDataFrame([(*r, "s", 0, 1) for r in rows], "conv_id long, turn long, role string, text string, signature string, place int, facts int").repartition(3)
    got = sorted((tuple(r) for r in conversation_repair.damaged_and_repaired(df).collect()), key=repr)
    import sys

    deep, _ = sys.getrecursionlimit(), sys.setrecursionlimit(20_000)
    short = [r for r in rows if r[0] != 5000]
    assert [r for r in got if r[0] != 5000] == sorted(repaired_rows(short), key=repr)
    sys.setrecursionlimit(deep)
    table = pa.table({n: pa.array([r[i] for r in short], pa.int64() if i < 2 else pa.string()) for i, n in enumerate(("conv_id", "turn", "role", "text"))})
    con = duckdb.connect()
    con.register("conversations", table)
    assert sorted(con.execute(conversation_repair.ORACLE).fetchall(), key=repr) == [r for r in got if r[0] != 5000]
    assert next(r for r in got if r[0] == 5000)[7].count("K") > 1500
    assert conversation_repair.damaged_and_repaired(df.limit(0)).count() == 0


def test_repaired_conversations_read_as_they_must(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["hi.", "yes!", "no", ""]) + str(t) + ".") for c in range(40) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = conversation_repair.repaired(df).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role"))).alias("x")).collect()
    assert out and all(re.fullmatch("(s?(ua)+)?", "".join(p.role[0] for p in r.x)) for r in out)
