"""What the third round's findings asked for: work per character, word or posting that grows no faster than the input."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.functions import normalize as N
from sparkseek.operators import vectors as V
from sparkseek.operators.index import TokenIndex, build_index, postings_of
from sparkseek.sources.store import FAN, IndexStore

TEXTS = ["Plain – “ÄÖÜ” text\n", "", None, "ＡＢＣ ｶﾞ é ΑΣ ﬁ İ", "́ starts with a mark", "Straße №5", "ǟb \U0001d400"]
SPECS = ["NormalizerAuto", 'NormalizerNFKC130("unify_kana", true), NormalizerNFKC130("unify_middle_dot", true)', 'NormalizerNFKC150("unify_to_romaji", true)', 'NormalizerNFKC100("remove_symbol", true, "remove_blank", true)']


def test_named_normalizer_reads_each_character_once(monkeypatch):
    kernel, seen = N.normalize_with_offsets, []
    monkeypatch.setattr(N, "normalize_with_offsets", lambda text, *rest: seen.append(text) or kernel(text, *rest))
    pick = random.Random(5)
    for spec in SPECS:
        text = "".join(pick.choice("aAÉé Σςßｶﾞ́̈ーゃャ①ﬁ·-\n") for _ in range(20000))
        N._each.cache_clear()
        seen.clear()
        assert N.normalize_text(text, spec) == kernel(text, spec)[0]
        assert N.normalize_text(text[:9] + "plain", spec) == kernel(text[:9] + "plain", spec)[0]
        # a character with marks is a text of its own; the rest are looked up
        assert max(map(len, seen)) < 100 and len([t for t in seen if len(t) == 1]) <= 21 + 5


def test_named_normalizer_leaves_plain_texts_to_native_code(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    for spec in SPECS:
        got = {r.id: r.n for r in df.select("id", N.normalize(F.col("t"), spec).alias("n")).collect()}
        assert got == {i: None if t is None else N.normalize_with_offsets(t, spec)[0] for i, t in enumerate(TEXTS)}
    plan = df.select(N.normalize(F.col("t"), "NormalizerAuto").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "lower" in plan


def test_named_normalizer_that_is_not_known_is_an_error():
    for text in ("", "plain"):
        with pytest.raises(ValueError):
            N.normalize_text(text, "Unknown")


def test_each_text_is_embedded_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word {i}" if i % 7 else None) for i in range(60)], "id int, t string").repartition(2)

    def model(name):
        def make():
            def embed(text):
                with open(tmp_path / name, "a") as f:
                    f.write("x")
                return V.hashing_embedding(text)

            return embed

        return make

    found = V.semantic_search(df, "t", "word 8", 70, "id", model("scan")).collect()
    assert found[0].id == 8 and len(found) == 51  # without the nulls
    index = V.SemanticIndex(spark, str(tmp_path / "index"), model("kept"))
    index.append(df, "id", "t")
    assert [r.doc_id for r in index.search("word 8", 70).collect()] == [r.id for r in found]
    # the query itself is one more
    assert len((tmp_path / "scan").read_text()) == 51 + 1 and len((tmp_path / "kept").read_text()) == 51 + 1


def test_embedding_is_the_sum_of_its_words_and_pairs():
    for text in ("", " \x1c", "one", "Two  words　Ünd\x85two words", "x" * 400 + " y"):
        words = text.lower().split()
        out = [0.0] * 64
        for w in (*words, *(" ".join(p) for p in zip(words, words[1:]))):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            out[h % 64] += 1 if h >> 63 else -1
        length = np.linalg.norm(out)
        assert V.hashing_embedding(text) == [float(np.float32(x / length if length else x)) for x in out]


def test_lexicon_shuffles_sums_by_token(spark):
    rows = [(1, "a b a", "b c"), (2, "a", None), (2, "a d", "d"), (None, "a e", ""), (None, "e", "A"), (3, None, None), (4, "東京都 a", "!"), (4, "", " ")]
    df = spark.createDataFrame(rows, "doc_id long, t string, u string")
    sums = lambda x: {(r.token, r.df, r.tf) for r in x.collect()}
    for columns in (["t"], ["t", "u"]):
        found = build_index(df, "doc_id", columns).lexicon()
        assert sums(found) == sums(TokenIndex(postings_of(df, "doc_id", columns), df.select("doc_id")).lexicon())
        assert not re.search(r"keys=\[token#\d+, doc_id#", found._jdf.queryExecution().executedPlan().toString())
    assert ("a", 4, 7) in sums(found) and ("d", 1, 2) in sums(found) and ("e", 1, 2) in sums(found)
    keys = df.withColumn("k", F.lit("x"))
    assert sums(build_index(keys, ["doc_id", "k"], ["t"]).lexicon()) == sums(build_index(df, "doc_id", ["t"]).lexicon())
    words = df.select("doc_id", F.split("t", " ").alias("w"))
    assert ("a", 4, 6) in sums(build_index(words, "doc_id", ["w"]).lexicon())


def test_append_reads_its_rows_once_and_writes_sorted_files(spark, tmp_path):
    @F.udf("string")
    def text(i):
        with open(tmp_path / "read", "a") as f:
            f.write("x")
        word = ("one", "two", "three")[i % 3]
        return f"b {word} c {word}"

    store = IndexStore(spark, str(tmp_path / "store"))
    store.create("docs", None, "id", ["t"])
    for n in range(FAN):  # the last one merges them all
        rows = spark.createDataFrame([(i,) for i in range(40 * n, 40 * n + 40)], "id long")  # of no known size, so that they are not dealt out first
        store.append("docs", rows.select("id", text("id").alias("t")))
    assert len((tmp_path / "read").read_text()) == 40 * FAN
    assert {(r.doc_id, r.score) for r in store.open("docs").search("two").collect()} == {(i, 2.0) for i in range(1, 40 * FAN, 3)}
    files = list((tmp_path / "store" / "docs").glob("*/postings/*.parquet"))
    assert len({f.parent for f in files}) == FAN + 1
    for f in files:
        rows = [tuple(r) for r in spark.read.parquet(str(f)).collect()]
        assert rows == sorted(rows)
