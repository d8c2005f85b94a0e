"""Each operator against a brute-force version, an exact round trip, or held-out accuracy; and the defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _stats, minhash, packing, pii_crf, quality_gam, quality_rules, secrets, sentencepiece_codec, substring_dedup, suffix_dedup, topk
from plumbline.llm._bytes import Texts, chunks, merged, sliding_min
from plumbline.llm._graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rest string, body string, grams string, component string"


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, repeats within a text, odd white space, empty, null and long texts."""
    rng = random.Random(3)
    shared, line = passage(rng, 70), passage(rng, 9)
    texts = [passage(rng, rng.randint(1, 160)) for _ in range(40)]
    texts += [f"{passage(rng, 20)}\n{shared}\t{passage(rng, 20)}" for _ in range(8)]
    texts += [f"{line}\n" * 30, "ab " * 300, "word" * 120, "é" * 130, "a", "", None, " \n\t ", "#### $$$ %%%", texts[3], texts[3], texts[5].upper(), passage(rng, 4000)]
    near = texts[7].split(" ")
    for _ in range(6):
        one = list(near)
        one[rng.randrange(len(one))] = "changed"
        texts.append(" ".join(one))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 + 1, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, None, "s", None, "r", "b", "g", "c") for i, t in corpus]
    rows += [rows[2], rows[2], (None, corpus[0][1], *rows[0][2:]), (None, None, *rows[0][2:])]  # repeated rows and null ids
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    out = {}
    for r in df.collect():
        if r.doc_id is not None:
            assert out.setdefault(r.doc_id, r) == r
    return out


def test_every_row_has_a_result(docs, empty):
    n = docs.count()
    for f in (suffix_dedup.removal, suffix_dedup.deduplicate, substring_dedup.removal, minhash.near_duplicates, secrets.scan, pii_crf.find, sentencepiece_codec.encode, lambda d: quality_rules.judge(d, []), lambda d: quality_gam.classify(d, quality_gam.Model())):
        assert f(docs).count() == n and f(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert secrets.redact(docs).count() == pii_crf.redact(docs).count() == n


def test_statistics_and_base_rule(docs, corpus):
    got = by_id(quality_rules.judge(docs, []))
    for i, text in corpus:
        w = WORD.findall(text or "")
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert (r.n_dup_lines, r.n_repeat_words, r.n_distinct, r.n_chars) == (len(lines) - len(set(lines)), len(covered), len(set(w)), len(text or ""))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r.kept == (not r.base_failed)


def _quality_sample(n=1500):
    rng = np.random.RandomState(1)
    x = rng.rand(n, len(_stats.FEATURES))
    s, d = _stats.FEATURES.index("symbol_share"), _stats.FEATURES.index("distinct_share")
    good = ~((x[:, s] > 0.8) | ((x[:, d] < 0.3) & (x[:, 0] > 0.5)))
    return x, good.astype(np.int64), rng


def test_decision_list_learns_conjunctions(spark):
    x, good, _ = _quality_sample()
    rules = quality_rules.learn(x[:1000], good[:1000])
    rejected = np.any([quality_rules.covers(r, x[1000:]) for r in rules], axis=0)
    assert (rejected == (good[1000:] == 0)).mean() > 0.97 and rules == quality_rules.learn(x[:1000], good[:1000])
    assert quality_rules.learn(x, np.ones(len(x))) == [] and quality_rules.learn(x[:0], good[:0]) == []
    # The emitted expression rejects the same rows.
    counts = {"n_symbols": 9, "n_words": 10}
    row = spark.createDataFrame([tuple(counts.get(c, 5) for c in _stats.COUNTS)], ", ".join(f"{c} long" for c in _stats.COUNTS))
    rule = (quality_rules.Condition("symbol_share", True, 0.8),)
    assert row.select(quality_rules.verdict([rule]).alias("k")).first().k is False
    assert row.select(quality_rules.verdict([(quality_rules.Condition("symbol_share", False, 0.8),)]).alias("k")).first().k is True


def test_additive_model_learns_interactions():
    x, good, rng = _quality_sample()
    a, b = _stats.FEATURES.index("symbol_share"), _stats.FEATURES.index("pipe_share")
    good = ((x[:, a] > 0.5) == (x[:, b] > 0.5)).astype(np.int64)  # no single feature tells
    model = quality_gam.learn(x[:1000], good[:1000])
    score = model.score(x[1000:])
    assert ((score >= 0.5) == good[1000:]).mean() > 0.9 and (min(a, b), max(a, b)) in model.pairs
    assert ((score >= 0) & (score <= 1)).all() and (quality_gam.learn(x[:0], good[:0]).score(x[:3]) == 0.5).all()


def test_labels_of_the_held_out_third_are_never_read(spark):
    rows = [(i, ("good words here and there " if i % 2 else "## ## ## ") * 5) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    right = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    wrong = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 3 == 1 else i % 2) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    x, y = _stats.labelled(d, right)
    x2, y2 = _stats.labelled(d, wrong)
    assert np.array_equal(x, x2) and np.array_equal(y, y2) and len(y) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows)
    assert len(_stats.labelled(d, right, 20)[1]) == 20
    out = quality_gam.classify(d, quality_gam.fit(d, right)).collect()
    held = [r for r in out if r.held_out]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows) and all(r.predicted == r.doc_id % 2 for r in held)
    assert quality_gam.keep_good(d, quality_gam.fit(d, right)).count() == 150


def _plain_features(text):
    """The features of one text, from its counts alone."""
    count = {k: int(v[0]) for k, v in _stats.counts(pa.array([text], pa.string())).items()}
    return [math.log1p(count["n_words"]), *(count[a] / max(count[b], 1) for a, b in _stats.RATIOS.values())]


def test_scores_are_plain_sums_of_bins_and_rules_hold_row_by_row(spark):
    """Operators 8 and 1 over whole tables, against one text at a time: a loop over tables, a loop over rules in order."""
    import bisect

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model, texts = quality_gam.fit(d, labels), {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    assert model.pairs and len(model.tables) == len(_stats.FEATURES)
    for r in quality_gam.classify(d, model).collect():
        x = _plain_features(texts[r.doc_id])
        total = model.intercept
        for value, edges, table in zip(x, model.edges, model.tables, strict=True):
            total += table[bisect.bisect_right(edges.tolist(), value)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bisect.bisect_right(model.pair_edges[a].tolist(), x[a])][bisect.bisect_right(model.pair_edges[b].tolist(), x[b])]
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), abs_tol=1e-9) and r.predicted == (r.score >= 0.5)
    rules = quality_rules.fit(d, labels) or [(quality_rules.Condition("log_words", True, 4.0), quality_rules.Condition("symbol_share", False, 0.01))]
    rules = [*rules, (quality_rules.Condition("log_words", True, 6.0), quality_rules.Condition("symbol_share", False, 0.001))]
    rejected = 0
    for r in quality_rules.judge(d, rules).collect():
        x = dict(zip(_stats.FEATURES, _plain_features(texts[r.doc_id]), strict=True))
        hit = any(all(x[c.feature] >= c.threshold if c.above else x[c.feature] <= c.threshold for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not hit)
        rejected += hit
    assert rejected


def _removed_bytes(corpus, length):
    seen, out = set(), {}
    for i, text in sorted(corpus):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out[i] = raw, gone
    return out


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_suffix_dedup(docs, corpus, shard_rows, monkeypatch):
    """Also with grams dealt over several shards, whose earliest windows meet in the merge."""
    monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", shard_rows)
    got = by_id(suffix_dedup.removal(docs))
    for i, (raw, gone) in _removed_bytes(corpus, 100).items():
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_keeps_columns(docs, corpus):
    out = suffix_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    want = {i: bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore") for i, (raw, gone) in _removed_bytes(corpus, 100).items()}
    assert all(r.text == want[r.doc_id] and r.source == "s" and r.rest == "r" for r in out.collect() if r.doc_id is not None)


@pytest.mark.parametrize("ids", [(50, 7), (7, 50), (50, 7, 9, 3)])
def test_suffix_dedup_of_repeats_that_texts_share(spark, ids):
    """Texts that repeat the same line within them, whatever the order they are read in; the last two of four are exact copies."""
    rng = random.Random(11)
    line = passage(rng, 12)
    texts = [f"{passage(rng, 30)}\n" + f"{line}\n" * 30 + passage(rng, 30) for _ in ids]
    rows = [(i, texts[min(k, 2)]) for k, i in enumerate(ids)]
    got = by_id(suffix_dedup.removal(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    want = _removed_bytes(rows, 100)
    assert all(line.encode() in raw for raw, _ in want.values()) and len(got) == len(ids)
    for i, (raw, gone) in want.items():
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert (got[i].n_removed, got[i].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), i


def test_suffix_array_and_common_prefixes():
    rng = np.random.RandomState(2)
    for alphabet, n in ((2, 700), (4, 900), (1, 300)):
        data = rng.randint(97, 97 + alphabet, n).astype(np.uint8)
        raw = data.tobytes()
        order, eight = suffix_dedup.suffix_array(data, 100)
        assert sorted(order.tolist()) == list(range(n))
        heads = [raw[i : i + 100] for i in order]
        assert heads == sorted(heads)
        lcp = suffix_dedup.common_prefixes(order, eight, np.array([0, n // 3, n // 2]), 100)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            m = next((j for j in range(min(len(a), len(b), 100)) if a[j] != b[j]), min(len(a), len(b), 100))
            assert min(lcp[k], 100) == m or (m == min(len(a), len(b)) and lcp[k] >= m)


@pytest.mark.parametrize("window", [50])
def test_substring_dedup(docs, corpus, window):
    first, words = {}, {i: WORD.findall(t or "") for i, t in corpus}
    for i, w in sorted(words.items()):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    got = by_id(substring_dedup.removal(docs, texts=True))
    for i, w in words.items():
        gone = {k for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for k in range(p, p + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


def _shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _linked(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(docs, corpus):
    sets = {i: _shingles(t) for i, t in corpus}
    want = _linked(sets)
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_a_group_around_the_threshold(spark):
    """Hundreds of edits of one text: links that no star finds come from the exact residual join."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        one = list(base)
        for _ in range(rng.randint(0, 4)):
            one[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(one))
    rng.shuffle(texts)
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))
    assert {i: r.component_id for i, r in got.items()} == _linked(sets)


def test_minmax_estimates_similarity():
    rng = np.random.RandomState(4)
    a = rng.randint(0, 2**63 - 1, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], rng.randint(0, 2**63 - 1, 300).astype(np.uint64)])
    one, two = minhash.signature(a, np.array([0])), minhash.signature(b, np.array([0]))
    assert abs((one == two).mean() - 700 / 1300) < 0.15


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100} and len(got) == 44


def test_components_of_a_large_star(spark):
    """A center of most edges, whose id is neither the least nor the largest, and random edges beside it."""
    rng = np.random.RandomState(9)
    edges = [(5000, i) for i in range(9000) if i % 3] + [(int(a) + 20_000, int(b) + 20_000) for a, b in rng.randint(0, 3000, (1500, 2))]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {n: find(n) for n in {n for a, b in edges if a != b for n in (a, b)}}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    texts = dict(corpus)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    repeated = Counter(r.doc_id for r in docs.select("doc_id").collect())
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        times = np.zeros(len(ids), int)
        for r in pieces[i]:
            assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(ids[r.start : r.start + r.length].tobytes()), len(ids)) and 0 < r.length <= 1024
            times[r.start : r.start + r.length] += 1
        assert (times == repeated[i]).all()
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing_leaves_little_padding(monkeypatch):
    """Groups that follow each other: all cuts are made before, no window is ever over the capacity, and the count may rise in each."""
    rng = np.random.RandomState(8)
    dealt, plain = [], packing.windows

    def watched(sizes, capacity, count=0):
        bins, sums = plain(sizes, capacity, count)
        dealt.append((len(sizes), -(-int(sizes.sum()) // capacity), len(sums), int(sums.max())))
        return bins, sums

    monkeypatch.setattr(packing, "windows", watched)
    texts = [" ".join("word" for _ in range(n)) for n in rng.randint(1, 2500, 3000)]
    out = pa.Table.from_batches(packing._packed([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["doc_id", "text"])], 1024, "byte_bpe_50k"))
    length, sequence = out.column("length").to_numpy(), out.column("sequence_id").to_numpy()
    filled = np.bincount(sequence - sequence.min(), length)
    assert filled.max() <= 1024 and filled.sum() == sum(len(t.split()) + 1 for t in texts)
    assert 1 - filled.sum() / (1024 * len(filled)) < 0.01
    assert len(dealt) > 3 and all(most <= 1024 and windows >= least for _, least, windows, most in dealt)
    monkeypatch.setattr(packing, "windows", plain)
    sizes = rng.randint(1, 1025, 150)
    assert packing.windows(sizes)[1].max() <= 1024


def test_packing_of_a_text_above_the_fast_path(monkeypatch):
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(12)
    text = " ".join(rng.choice(["word", "déjà", "123", "a-b", "\n\n", "  ", "xyzzy", "日本"]) for _ in range(120_000))
    assert len(text) > packing.FAST_CHARS
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.encoder()(text).tolist() == ids
    monkeypatch.setattr(packing, "FAST_CHARS", len(text))
    assert packing.encoder()(text).tolist() == ids


@pytest.mark.parametrize("chars", [400_000, 0])
def test_packing_ids_of_added_tokens(chars, monkeypatch):
    """Either path gives the ids of the JSON file's tokenizer with its defaults, also on texts that hold its end mark."""
    from tokenizers import Tokenizer

    import public_tokenizers

    monkeypatch.setattr(packing, "FAST_CHARS", chars)
    t, encode, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(), random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n\n", "  ", "a", "don't", "é", "123", "<|im_start|>", "word "]
    texts = ["a<|endoftext|>b", " <|endoftext|>\n\n", ""] + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(300)]
    for text in texts:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert encode("a<|endoftext|>b").tolist() == [64, 50256, 65]


def test_differencing_balances():
    rng = np.random.RandomState(5)
    sizes = rng.randint(1, 1024, 200)
    bins, sums = packing.windows(sizes)
    assert np.array_equal(np.bincount(bins, sizes, len(sums)).astype(int), sums) and sums.max() <= 1024
    assert len(sums) * 1024 <= 1.08 * sizes.sum() + 1024
    bins, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]  # differencing's known answer
    assert packing.windows(np.array([1024, 1024]))[1].tolist() == [1024, 1024]


def test_sentencepiece(docs, corpus):
    codec = sentencepiece_codec.Codec()

    def whole(s):
        best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + codec.longest) + 1):
                hit = codec.pieces.get(s[i:j])
                if hit and best[i] + hit[0] > best[j]:
                    best[j], back[j] = best[i] + hit[0], (i, [hit[1]])
            if s[i] not in codec.pieces:
                score = best[i] + codec.byte_score * len(s[i].encode())
                if score > best[i + 1]:
                    best[i + 1], back[i + 1] = score, (i, [codec.bytes[b] for b in s[i].encode()])
        out, at = [], len(s)
        while at:
            at, ids = back[at]
            out = ids + out
        return best[-1], out

    for text in [t or "" for _, t in corpus if len(t or "") < 3000] + ["a" * 700, "日本語𝄞 " * 40, "  two  spaces\n", "\x00\x7f"]:
        got = codec.encode(text)
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert got.tolist() == (whole(marked)[1] if marked else [])
        assert codec.decode(got) == text
    import public_tokenizers
    import sentencepiece

    greedy = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    assert all(len(codec.encode(t)) <= len(greedy.encode(t)) for _, t in corpus if t)
    # Committed in parts, so the window stays bounded however long the text is.
    parts = list(codec.viterbi("abcde" * 400))
    assert len(parts) > 10 and [x for p in parts for x in p] == whole("abcde" * 400)[1]
    rows = sentencepiece_codec.encode(docs)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows.collect())
    back = by_id(sentencepiece_codec.decode(rows))
    assert all(back[i].text == (t or "") for i, t in corpus)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _personal(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data_base():
    rng = random.Random(6)
    texts = ["".join(rng.choice("a@.1 2+-()9%") for _ in range(rng.randint(0, 80))) for _ in range(4000)] + ["é 4539578763621486 x", "1" * 5000, "@" * 5000, "+1" * 3000, "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4"]
    for text in texts:
        assert pii_crf.base_spans(text) == _personal(text), text


def test_personal_data_field():
    field = pii_crf.trained()
    sentences, labels = pii_crf.labelled_table(300, seed=77)
    texts = Texts(pa.array(sentences))
    _, _, rows, features = pii_crf.observe(texts)
    edge = np.append(True, rows[1:] != rows[:-1])
    got, want = field.decode(features, edge), np.concatenate([np.array(x) for x in labels])
    assert (got == want).mean() > 0.98
    score = field.emissions(features, edge)
    for r in range(0, texts.n, 5):  # plain Viterbi over the whole sentence
        s = score[rows == r]
        best, back = s[0], []
        for t in range(1, len(s)):
            through = best[:, None] + field.steps
            back.append(through.argmax(0))
            best = through.max(0) + s[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert path[::-1] == got[rows == r].tolist()


def test_personal_data_spans(spark):
    text = "Ask jo (at) mail (dot) com or call (555) 123-4567 é +1 (269) 555-3296 4539578763621486 today 2024-01-30, 12.5 and no 123456"
    d = spark.createDataFrame([(1, text), (2, "plain words only, nothing else."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_crf.find(d).collect()}
    found = [(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in got[1].spans.split(","))]
    assert ("phone", "(555) 123-4567") in found and ("card", "4539578763621486") in found and ("email", "jo (at) mail (dot) com") in found
    assert not any(k for k, s in found if "2024" in s or "12.5" in s) and got[2].spans == got[3].spans == ""
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "4539578763621486" not in pii_crf.redact(d).where("doc_id = 1").first().text


def test_secrets(spark):
    rng = random.Random(8)
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    texts = ["".join(rng.choice(["token", "API_KEY", "=", ": ", '"', "AKIA", "deadbeef", "Zz9", "0123456789abcdef", " ", "é"]) for _ in range(12)) for _ in range(2000)] + ["f" * 9000, "AKIA" * 2000]
    for text in texts:
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        assert secrets.base_spans(text) == sorted(want)
    key = "xK9vQ2mLp7RtZ4wYb8Nc"
    d = spark.createDataFrame([(1, f"use {key} now"), (2, "id 123e4567-e89b-12d3-a456-426614174000 donaudampfschifffahrtsgesellschaft 453957876362"), (3, f"password={key} x {key}")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(d).collect()}
    assert got[1].spans == "entropy:4:24" and got[1].n_entropy == 1 and got[2].spans == ""
    assert got[3].spans == "assign:0:29,entropy:32:52"
    assert [r.text for r in secrets.redact(d).orderBy("doc_id").collect()][0] == "use [SECRET] now"
    assert secrets.scan(d.limit(1), allow=[key]).first().spans == ""


#: Written by hand, apart from the table that the field is trained on: text, and the personal data in it.
PERSONAL_BY_HAND = [
    ("please write to maria (at) lagoon (dot) org before noon", ["maria (at) lagoon (dot) org"]),
    ("Send it to jonas at harbour dot net, he reads mail daily.", ["jonas at harbour dot net"]),
    ("reach the crew: sea.lion [at] reef.com or by post", ["sea.lion [at] reef.com"]),
    ("my office line is (212) 555-0147 until six", ["(212) 555-0147"]),
    ("call 646-555-0199 for a berth", ["646-555-0199"]),
    ("fax 415.555.0133 still works", ["415.555.0133"]),
    ("the card 4111.1111.1111.1111 was charged twice", ["4111.1111.1111.1111"]),
    ("charge 5500.0000.0000.0004 please", ["5500.0000.0000.0004"]),
    ("mobile (305)555-0188 or none", ["(305)555-0188"]),
    ("Questions? ana (at) divers (dot) net knows", ["ana (at) divers (dot) net"]),
    ("we met at noon at the dot on the map", []),
    ("version 2.14.3 came out on 2024-05-17 at 12:30", []),
    ("order no-4471 costs $12.50, paid in 3 parts of 4,166", []),
    ("the year 1999-2000 saw 12345678 fish and 3.14159 sharks", []),
    ("look at page 44 and at line 12.5 of the log", []),
    ("ISBN 978-3-16-148410-0 sits on shelf 12", []),
    ("he was at home; she was at sea. nothing else to report!", []),
]
#: Random keys and what only looks like them.
KEYS_BY_HAND = [
    ("use kJ8sQ2vLx0Zt7RmW4bYp to log in", ["kJ8sQ2vLx0Zt7RmW4bYp"]),
    ("export K=Zx9+Qm3/Lw7Rt2Vb5Ny8Hc4Kd6Jf1Gs0Pa=", ["Zx9+Qm3/Lw7Rt2Vb5Ny8Hc4Kd6Jf1Gs0Pa="]),
    ("the bearer was h7d93kslq02mzx84bvn1", ["h7d93kslq02mzx84bvn1"]),
    ("A1B9-C3D7_E5F2G8H4J6K0 is old", ["A1B9-C3D7_E5F2G8H4J6K0"]),
    ("QwErZxTyVbUiNmOpLkJhGf is one too", ["QwErZxTyVbUiNmOpLkJhGf"]),
    ("internationalization and counterrevolutionaries", []),
    ("see /usr/local/share/documentation/overview for more", []),
    ("the id 123e4567-e89b-12d3-a456-426614174000 is public", []),
    ("self-contained-and-well-known-phrases-of-some-length", []),
    ("taken on 2024-05-17T10-20-30Z in the harbour", []),
    ("zzzzzzzzzzzzzzzzzzzzzzzz1111111111", []),
    ("Bearer eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9 expires", ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"]),
    ("client id 9f3Kq7TzW1xVb5Lm0Rj2", ["9f3Kq7TzW1xVb5Lm0Rj2"]),
    ("ghp_x7Kd02LmQz9Vb4Tn8RcY1sWjE5uHaGf3 was revoked", ["ghp_x7Kd02LmQz9Vb4Tn8RcY1sWjE5uHaGf3"]),
    ("getElementByIdentifierAndName(documentRootElement)", []),
]


def test_the_field_finds_what_no_pattern_lists():
    """Precision and recall of the field alone on sentences written by hand."""
    field, right, found, want = pii_crf.trained(), 0, 0, 0
    for text, spans in PERSONAL_BY_HAND:
        base, every = pii_crf.find_in(Texts(pa.array([text])), [text], field)[0]
        assert not base, text
        got = [text[a:b] for _, a, b in every]
        right += len(set(got) & set(spans))
        found += len(got)
        want += len(spans)
    assert found and right / found >= 0.9 and right / want >= 0.9, (right, found, want)


def test_entropy_finds_what_no_pattern_lists():
    """Precision and recall of the entropy scan alone on strings written by hand."""
    right, found, want = 0, 0, 0
    for text, keys in KEYS_BY_HAND:
        base, every = secrets.find(text, secrets._allow(()))
        assert not base, text
        got = [text[a:b] for a, _, b in every]
        right += len(set(got) & set(keys))
        found += len(got)
        want += len(keys)
    assert found and right / found >= 0.9 and right / want >= 0.8, (right, found, want)


def test_secrets_of_few_digits_are_found_whole():
    """Random keys, of whatever digits they have, are covered from end to end; words written together aren't keys."""
    rng = random.Random(21)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    allow = secrets._allow(())
    for alphabet, size, least in ((base64, 16, 0.95), (base64, 20, 0.98), (base64, 32, 0.99), (base64, 40, 0.99), (base64[:62], 20, 0.98), (base64[:62], 40, 0.99), (base64[:52], 20, 0.9), (base64[:52], 32, 0.98)):
        whole = 0
        for _ in range(1000):
            key = "".join(rng.choice(alphabet) for _ in range(size))
            spans = secrets.find(f"use {key} now", allow)[1]
            at = 4
            for a, _, b in spans:
                at = max(at, b) if a <= at else at
            whole += at >= 4 + size
        assert whole >= least * 1000, (len(alphabet), size, whole)
    for text in ("donaudampfschifffahrtsgesellschaft", "AbstractSingletonProxyFactoryBean", "getUserNameByIdFromDatabase", "/usr/local/lib/python3/dist-packages", "a-long-slug-of-2-words-and-1-more", "INTERNATIONALIZATION_TABLES"):
        assert secrets.find(text, allow)[1] == [], text
    key = "xK9vQ2mLp7RtZ4wYb80123456789abcdef01Gh2KqT"
    spans = secrets.find(f"use {key} now", allow)[1]
    assert "".join(f"use {key} now"[a:b] for a, _, b in spans) == key


def test_entropy_is_incremental():
    import math

    s = "ab12cd34ef56ab12zz99!?xyq81jk"
    for start, bits, _ in secrets.entropy_windows(s):
        w = s[start : start + 20]
        assert math.isclose(bits, -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()), abs_tol=1e-9)


def test_a_mark_that_few_texts_repeat_is_dealt_over_shards(spark, monkeypatch):
    """50 texts that hold one mark 250 times each, among changing bytes: the shards stay small, and the result is the SQL's."""
    import duckdb

    rng = random.Random(21)
    # A mark of least hash of many, so that it anchors most windows.
    mark = min((f"<{rng.getrandbits(56):014x}>" for _ in range(4000)), key=lambda m: int(suffix_dedup.window_grams(Texts(pa.array([m])), 16)[0][0]))
    fill = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = mark + fill(150) + mark
    texts = ["".join(fill(48) + mark for _ in range(250)) + (shared if i % 7 == 0 else "") for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    anchors = df.transform(suffix_dedup.mapped, lambda it: suffix_dedup._anchor_rows(it, 100), suffix_dedup._ANCHORS)
    most = anchors.select(F.explode("more").alias("m")).groupBy("m.gram").agg(F.sum("m.n").alias("n")).agg(F.max("n")).first()[0]
    assert most > 4 * suffix_dedup.SHARD_ROWS  # one gram, few texts, many stretches
    sizes = []
    monkeypatch.setattr(suffix_dedup, "repartitioned", lambda dealt: sizes.append(dealt.groupBy("gram", "part").count().agg(F.max("count")).first()[0]) or dealt.repartition("gram", "part"))
    got = sorted(map(tuple, suffix_dedup.removal(df).collect()))
    assert max(sizes) < 2 * suffix_dedup.SHARD_ROWS
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(50)), "text": texts}))
    assert got == sorted(con.execute(suffix_dedup.ORACLE).fetchall()) and sum(r[2] for r in got) > 0


def test_a_gram_beyond_the_bound_gives_few_rows_a_stretch(spark, monkeypatch):
    """A mark among changing bytes, and a passage that every ninth text has around it: what shards hand on is by stretch, not by window."""
    rng = random.Random(23)
    mark = min((f"<{rng.getrandbits(56):014x}>" for _ in range(4000)), key=lambda m: int(suffix_dedup.window_grams(Texts(pa.array([m])), 16)[0][0]))
    fill = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage_of_mark = fill(70) + mark + fill(70)
    rows = [(i, fill(120) + (passage_of_mark if i % 9 == 0 else fill(70) + mark + fill(70)) + fill(120)) for i in range(180)]
    monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", 16)
    old, made = suffix_dedup.mapped, {}
    monkeypatch.setattr(suffix_dedup, "mapped", lambda df, run, schema: made.setdefault(str(schema), old(df, run, schema)))
    got = by_id(suffix_dedup.removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    (shards,) = (df for schema, df in made.items() if schema == suffix_dedup._FOUND)
    assert shards.count() <= (suffix_dedup.CLASSES + 1) * made[suffix_dedup._STRETCHES].count()
    for i, (raw, gone) in _removed_bytes(rows, 100).items():
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert (got[i].n_removed, got[i].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in got.values()) > 0


def test_no_link_of_small_sets_is_lost(spark):
    """Texts of 8 and 7 words, 4 and 3 shingles: similarity 0.75 exactly, each pair of its own words."""
    pairs = 30_000
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("w"), F.hex(F.col("id") * 8 + i))), " ")
    whole = spark.range(pairs).select((F.col("id") * 2).alias("doc_id"), words.alias("text"))
    part = whole.select((F.col("doc_id") + 1).alias("doc_id"), F.array_join(F.slice(F.split("text", " "), 1, 7), " ").alias("text"))
    out = minhash.near_duplicates(whole.unionByName(part))
    assert out.where("NOT kept").count() == pairs and out.where("component_id <> doc_id - doc_id % 2").count() == 0


@pytest.mark.parametrize("how", [{}, {"row_block": 50}, {"row_bytes": 4000, "row_block": 9}, {"row_block": 40, "step": 3, "sample": 20}])
def test_top_k(spark, how):
    rng = np.random.RandomState(9)
    base = rng.randn(230, 24) / 5
    base[50:60] = base[0]  # ties
    rows = [(i * 10, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(5000, None), (5100, [None] * 24), (5200, [float("nan")] * 24), (5300, [float("inf")] * 24), (None, rows[0][1]), (5400, []), (5500, [1.0, 2.0]), (5501, [2.0, 1.0])]
    got = defaultdict(list)
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3), **how).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(1024 * np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q, x in good.items():
        if q % 100 == 0:
            order = sorted((-int(x @ y), i) for i, y in good.items() if i != q and len(y) == len(x))[:10]
            assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(order)], q
    assert set(got) == {q for q in good if q % 100 == 0}
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_of_large_vectors(spark, kind):
    """One row beyond all others, rows whose products leave the exact range of doubles, and (as doubles) that of a long or double."""
    rng = np.random.RandomState(12)
    v = rng.randn(160, 64) / 5
    v[3] = 90_000  # the best hit of many queries
    v[20:80] = rng.choice([-7_000, 7_000], (60, 64)) + rng.randint(-3, 4, (60, 64)) / 1024
    v[40:50] = v[20] + rng.randint(0, 2, (10, 64)) / 1024  # near ties
    if kind == "double":
        v[90:100, 0] = 1e12 * (1 + np.arange(10) % 4)
        v[100:110, :2] = -3e200 * (1 + np.arange(10)[:, None] % 3)
        v[110, 5], v[111, 5], v[112, 1] = 1.7e308, -1.7e308, 1e306
    v = v.astype(np.float32 if kind == "float" else np.float64).astype(float)
    rows = [(i * 50, [float(c) for c in x]) for i, x in enumerate(v)]
    got = defaultdict(list)
    out = topk.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)).orderBy("query_id", "rank")
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    for r in out.collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: [math.floor(Fraction(c) * 1024) for c in x] for i, x in rows}
    for q, x in whole.items():
        if q % 100 == 0:
            order = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole.items() if i != q)[:10]
            assert got[q] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in order], q
    assert len(got) == 80


def test_segment_bounds_hold():
    rng = np.random.RandomState(10)
    q, x = rng.randn(20, 37), rng.randn(30, 37)
    exact = ((q[:, None] - x[None]) ** 2).sum(2)
    last = None
    for n in (1, 2, 4, 8):
        a, b = topk.statistics(q, n), topk.statistics(x, n)
        bound = ((a[:, None] - b[None]) ** 2).sum(2)
        assert (bound <= exact + 1e-9).all() and (last is None or bound.mean() >= last)
        last = bound.mean()


def test_byte_helpers():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for w in range(1, 8):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    a, b = merged(np.array([5, 0, 2, -3]), np.array([9, 1, 6, 0]), 8)
    assert (a.tolist(), b.tolist()) == ([0, 2], [1, 8])
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "bbb", "c" * 50, ""])], names=["text"])
    parts = list(chunks([batch], limit=4))
    assert [p.num_rows for p in parts] == [2, 1, 1, 1]
    t = Texts(pa.array(["a b", None, "", "\tcé "]))
    assert [t.data[s:e].tobytes().decode() for s, e, _ in zip(*t.words())] == ["a", "b", "cé"] and t.words()[2].tolist() == [0, 0, 3]


@pytest.mark.parametrize("sizes", [[3_000_000], [140_000] * 40])
def test_long_texts_are_read_whole_in_bounded_chunks(sizes):
    """Chunks hold CHUNK_BYTES or one row; what a batch of long texts needs doesn't grow with its rows."""
    import tracemalloc

    from plumbline.llm import _bytes

    rng = np.random.RandomState(3)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)])
    texts = [" ".join(words[rng.randint(0, 4000, n // 7)]) for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    assert all(sum(map(len, b.column("text").to_pylist())) <= _bytes.CHUNK_BYTES or b.num_rows == 1 for b in chunks([batch]))
    bodies = list(_bytes.compressed([batch]))
    assert [x.decode() for b in bodies for x in _bytes.unpacked(b.column("body"))] == texts
    found = pa.array([[1 + (1 << 48)]] * len(texts), pa.list_(pa.int64()))
    parts = pa.Table.from_batches(bodies).combine_chunks().append_column("found", found).to_batches()
    largest = max(_bytes.CHUNK_BYTES, max(map(len, texts)))
    runs = {
        "anchors of bytes": lambda: suffix_dedup._anchor_rows([batch], 100), "stretches": lambda: suffix_dedup._stretches(parts, 100, b""), "anchors of words": lambda: substring_dedup._anchor_rows([batch], 50),
        "windows": lambda: substring_dedup._windows(parts, 50), "signatures": lambda: minhash._signed_sets([batch], 5), "sets": lambda: minhash._sets(bodies, 5), "statistics": lambda: map(_stats.counts, (b.column("text") for b in chunks([batch]))),
    }
    for name, run in runs.items():
        tracemalloc.start()
        for _ in run():
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 200 * largest, (name, most / largest)


def test_frequent_keys_are_looked_up_apart(spark):
    """A key of a third of all rows: the join gives every row, and no task of it reads that key whole."""
    from plumbline.llm._graph import cut, looked_up

    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"))
    facts = cut(rows.groupBy("k").agg(F.count("*").alias("times"), F.min("id").alias("low")).where("k <> 4"))
    got = looked_up(rows, facts, ["k"], "id")
    assert got.columns == ["id", "k", "times", "low"]
    want = rows.join(facts, "k")
    assert got.count() == want.count() == rows.where("k <> 4").count()
    assert got.agg(F.sum("low"), F.sum("times"), F.countDistinct("id")).first() == want.agg(F.sum("low"), F.sum("times"), F.countDistinct("id")).first()
