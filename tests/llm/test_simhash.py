import random

import numpy as np
import xxhash
from sparkseek.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, k):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = sorted(root)
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= k:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in fps]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def slow_kept(rows):
    """Smallest ids of the groups by fingerprints or by shared shingles; rows: (id, text), ids not null but where alike."""
    rows = [(i if i is not None else 1 << 62, t) for i, t in rows]
    fps, sets = [slow_fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or rows[i][0] == rows[j][0] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "".join(rng.choice("abcdefgh") for _ in range(5))
    return " ".join(words)


def test_edited_copies(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, prose(rng.randrange(1, 200))) for i in range(60)]
    base = prose(150)
    rows += [(500, base), *((100 + i, edited(rng, base, 2)) for i in range(40))]  # pairs of copies share less than each with the base
    for i in range(12):
        t = rows[i][1]
        rows += [(200 + i, edited(rng, t, max(1, len(t.split(" ")) // 60))), (300 + i, t.upper().replace(" ", "\n"))]
    rows += [(400, ""), (401, None), (402, " "), (403, "x y"), (404, "X  y"), (405, "a b " * 9000), (406, "a b " * 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == slow_kept(rows)


def test_fingerprint():
    for t in ["", " \t\n", "One", "One two", "a b c", "A\x0bB\x0cC d e", "é ü ß \xa0 x", "x " * 70000, "Foo bar baz " * 9]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_gray_rank():
    n = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash._gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(simhash, "LEAF", 256)
    codes = set()
    for _ in range(60):
        c = rng.getrandbits(64)
        codes.add(c)
        for _ in range(rng.randrange(30)):
            for _ in range(rng.randrange(1, 4)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    hub = rng.getrandbits(64)  # one node with many leaves
    codes |= {hub ^ (1 << a) ^ (1 << b) for a in range(43) for b in range(a)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame([(c,) for c in signed], "fp long").repartition(3)
    from sparkseek.llm.common import components

    got = {r.node: r.root for r in components(simhash.linked(rows, 2)).collect()}
    groups = {}
    for c, s in zip(codes, signed):
        groups.setdefault(got.get(s, s), set()).add(c)
    codes = list(codes)
    want = {}
    for c, r in zip(codes, slow_components(range(len(codes)), codes, 2)):
        want.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from it all day long " * 20
    rows = [(5, base), (3, base + "end"), (9, None), (8, ""), (7, " \n"), (4, "lone text here"), (4, "lone text here"), (None, base), (1, "x " * 30000)]
    docs = spark.createDataFrame([(i, t, i, "x", 0) for i, t in rows], "doc_id long, text string, component_id long, fp string, n_chars long")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted((i if i is not None else -1, f - (1 << 64) if f >> 63 else f, c) for (i, _), f, c in zip(rows, fps, slow_components([i for i, _ in rows], fps, 2)))
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept(rows)
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    from sparkseek.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, slow_components([r.doc_id for r in docs], fps, 2))}
    assert {tuple(r) for r in queries.op1_simhash(spark, sf).collect()} == want
