"""Each stage of the pipeline on its own input, and the whole of it, against plain versions."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import packing, secrets


def _docs(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    good = [words(80) + "." for _ in range(60)]
    texts = good + ["##$$ %%% ## && " * 12 for _ in range(30)] + [good[0] + " tail", good[1], f"{words(40)} {good[2]} {words(40)}", f"{words(30)} password=abcdef0123456789 {words(30)}"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 60), 0) for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stages_and_run(spark, tmp_path):
    docs, labels = _docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "repeated_bytes", "secrets", "packing"]

    good = stage["quality"](spark, docs, str(tmp_path)).cache()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert good.columns == docs.columns and ids(good) == set(range(60)) | {90, 91, 92, 93}
    unique = stage["near_duplicates"](spark, good, str(tmp_path)).cache()
    assert unique.columns == docs.columns and ids(unique) == ids(good) - {90, 91}
    cut = stage["repeated_bytes"](spark, unique, str(tmp_path)).cache()
    texts = {r.doc_id: r.text for r in unique.collect()}
    for r in cut.collect():
        assert r.n_chars == len(r.text)
        if r.doc_id == 92:
            assert len(r.text) < len(texts[92]) and texts[2][:100] not in r.text
        else:
            assert r.text == texts[r.doc_id]
    clean = stage["secrets"](spark, cut, str(tmp_path)).cache()
    assert clean.columns == docs.columns and clean.where(F.col("text").contains("abcdef0123456789")).count() == 0
    assert {r.doc_id: r.text for r in clean.where("doc_id <> 93").collect()} == {r.doc_id: r.text for r in cut.where("doc_id <> 93").collect()}
    assert secrets.scan(clean).where("spans <> ''").count() == 0
    packed = stage["packing"](spark, clean, str(tmp_path))
    assert ids(packed) == ids(clean)
    # Where a rest is cut depends on what a task reads beside it; what the pieces of a document make up doesn't.
    encode, clean_ids = packing.encoder(), {}
    for r in clean.collect():
        clean_ids[r.doc_id] = np.append(encode(r.text or ""), np.uint32(packing.SEPARATOR)).astype("<u4")

    def whole(rows):
        held = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            ids = clean_ids[r.doc_id]
            assert r.start == held.get(r.doc_id, 0) and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            held[r.doc_id] = r.start + r.length
        return held

    assert whole(packed.collect()) == whole(corpus_pipeline.run(spark, str(tmp_path)).collect()) == {i: len(x) for i, x in clean_ids.items()}


def test_stages_on_odd_rows(spark, tmp_path):
    docs, labels = _docs(spark)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (500, "", None, None, None), (500, "", None, None, None)], docs.schema)).withColumn("body", F.lit(1)).withColumn("spans", F.lit("x"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    empty = odd.where("false")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, odd, str(tmp_path))
        assert f(spark, empty, str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == odd.columns
        if name in ("repeated_bytes", "secrets"):
            assert out.count() == odd.count()
        if name == "near_duplicates":  # rows without words or an id stay
            assert out.where("doc_id IS NULL OR doc_id = 500").count() == 3


def test_a_run_leaves_its_last_table_only_and_reads_long_texts_whole(spark, tmp_path):
    import os

    from plumbline.llm import _graph

    docs, labels = _docs(spark)
    rng = random.Random(9)
    long = " ".join(f"{rng.getrandbits(40):x}tion" for _ in range(45_000)) + "."
    assert len(long) > packing.FAST_CHARS
    docs.unionByName(spark.createDataFrame([(500, long, "en", "s", len(long))], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    folder = _graph.folder(spark).removeprefix("file:")
    names = lambda: {n for n in os.listdir(folder) if n.startswith(("pipeline-", "cut-"))}
    before = names()
    out = corpus_pipeline.run(spark, str(tmp_path))
    mine = out.where("doc_id = 500").orderBy("start").collect()
    kept = secrets.redact(spark.createDataFrame([(500, long)], "doc_id long, text string")).first().text
    assert mine[0].doc_tokens == len(packing.encoder()(kept)) + 1 == sum(r.length for r in mine)
    assert len(names() - before) == 1 and all(n.startswith("pipeline-") and n.endswith("packing") for n in names() - before)
