"""The whole pipeline on a small table, each stage against brute force on what the stage before kept."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import sentencepiece
from sparkseek.llm import mixing, sentencepieces
from test_simhash import slow_kept
from test_suffixes import slow

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    every = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, one, cut, mix, ids = kept
    stay = {r.doc_id for r in good}
    assert np.mean([(r.doc_id in stay) == labels[r.doc_id] for r in every if r.doc_id in labels]) > 0.95
    assert sorted(r.doc_id for r in one) == slow_kept([(r.doc_id, r.text) for r in good])
    gone = slow([(r.doc_id, r.text) for r in one])
    want = {r.doc_id: bytes(b for at, b in enumerate(r.text.encode()) if at not in gone[r.doc_id]).decode() for r in one}
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(spark.createDataFrame(cut)).collect() if r.size}
    assert Counter(r.doc_id for r in mix if r.text.split()) == Counter({i: n for i, n in copies.items() if n})
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.tokenizer_path())
    assert Counter((r.doc_id, tuple(r.ids), zlib.crc32(np.array(r.ids, np.int32).tobytes())) for r in ids) == Counter((r.doc_id, tuple(x := sp.encode(r.text)), zlib.crc32(np.array(x, np.int32).tobytes())) for r in mix)
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, ids))


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", None, 1), (2, "", None, None, 0, 1), (None, "some words here", "en", "a", 3, 1), (3, "x " * 30000, "en", "b", 5, 1), (4, "one two three", "en", "a", 3, 1), (4, "one two three", "en", "a", 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    for frame in (docs, docs.limit(0)):
        out = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, SF)
            assert k == 4 or out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), out.schema)
        assert frame is docs or out.count() == 0
