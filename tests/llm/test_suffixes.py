import random

import pyarrow as pa
from sparkseek.llm import suffixes as S


def slow(rows):
    """{doc: bytes that go}: every window of 50 words that stands earlier, by (doc, first byte)."""
    seen, gone = {}, {}
    for doc, text in sorted(((i if i is not None else S.NO_ID, t) for i, t in rows), key=lambda x: x[0]):
        raw = (text or "").encode()
        words, at = [], 0
        for w in raw.split():
            at = raw.index(w, at)
            words.append((at, at + len(w), w.lower()))
            at += len(w)
        cut = gone.setdefault(doc, set())
        for i in range(len(words) - 49):
            key = tuple(w for _, _, w in words[i : i + 50])
            first = seen.setdefault(key, (doc, words[i][0]))
            if first != (doc, words[i][0]):
                cut.update(range(words[i][0], words[i + 49][1]))
    return gone


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéXYZ") for _ in range(rng.randrange(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.choice([50, 51, 60, 75, 120, 49, 30])) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                p = p.upper() if "é" not in p else p.replace(" ", "\n\t ")
            if rng.random() < 0.3:
                w = p.split(" ")
                p = " ".join(w[rng.randrange(len(w) // 3) :])
            parts += [p, prose(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(100, rows[7][1]), (101, None), (102, ""), (103, " \n "), (104, "la " * 300), (105, "x" * 9000 + " " + "y" * 5000), (106, "a b c " * 60), (None, rows[9][1]), (107, rows[3][1]), (107, rows[3][1])]
    return rows


def check(spark, rows, parts):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, start string, places int").repartition(parts)
    want = slow(list(dict.fromkeys(rows)))
    got = {}
    for r in S.repeats(docs).collect():
        got.setdefault(r.doc_id if r.doc_id is not None else S.NO_ID, set()).update(range(r.start, r.end))
    assert {d: b for d, b in got.items() if b} == {d: b for d, b in want.items() if b}
    return docs, want


def test_all_windows(spark):
    for seed, parts in ((1, 2), (2, 5)):
        check(spark, corpus(seed), parts)


def test_one_common_passage_over_many_partitions(spark):
    rng = random.Random(3)
    p = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(70))
    rows = [(i, f"start{i} {p} end{i}") for i in range(150)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(spark, rows, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cut_text(spark):
    rows = corpus(4)
    docs, want = check(spark, rows, 3)
    cut = S.without_repeats(docs)
    assert cut.columns == docs.columns
    expected = sorted((i if i is not None else S.NO_ID, None if t is None else bytes(b for at, b in enumerate(t.encode()) if at not in want[i if i is not None else S.NO_ID]).decode()) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else S.NO_ID, r.text) for r in cut.collect() if r.text is not None) == [x for x in expected if x[1] is not None]
    spans = S.repeated_spans(docs).collect()
    assert len(spans) == len(rows) and all(r.n_bytes == len(want[r.doc_id if r.doc_id is not None else S.NO_ID]) for r in spans)
    assert S.repeated_spans(docs.limit(0)).count() == 0


def test_words():
    w = S.Words(pa.array(["", "Ab  c\n", None, "é", "x", " "]))
    assert w.text.tolist() == [1, 1, 3, 4] and w.start.tolist() == [0, 4, 0, 0] and w.stop.tolist() == [2, 5, 2, 1]
    assert S.Words(pa.array(["", None])).grams(50, S._B1).tolist() == []
