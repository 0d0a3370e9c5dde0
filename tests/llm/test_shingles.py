"""Texts near each other whose shared buckets are all led by one that is near neither."""

from collections import defaultdict

import pyarrow as pa
from sparkseek.llm import shingles
from sparkseek.llm.common import components
from test_simhash import shingles as slow_shingles


def family(f):
    """Texts of parts of 20 words: a busy one with eight edited copies, and two that share 0.8 but less with any of the others."""
    def text(swaps):  # noqa: E306
        return " ".join(f"f{f}{swaps.get(p, 'c')}p{p}w{i}" for p in range(25) for i in range(20))

    return [text({}), *(text({6 + 2 * k: f"e{k}"}) for k in range(8)), text({0: "s", 1: "s", 2: "a"}), text({0: "s", 1: "s", 3: "b"})]


def meets_only_under_others(texts):
    """Whether the last two share buckets, and none of these is led by one of the two."""
    count, digest = shingles.shingle_sets(pa.array(texts))
    bands = shingles.bands_of(digest, [0, *count.cumsum()[:-1]])
    buckets = defaultdict(list)
    for i, row in enumerate(bands.tolist()):
        for b in row:
            buckets[b].append(i)
    meets = [sum(len(buckets[b]) for b in row if len(buckets[b]) > 1) for row in bands.tolist()]
    a, b = len(texts) - 2, len(texts) - 1
    shared = [m for m in buckets.values() if a in m and b in m]
    return bool(shared) and all(max(meets[i] for i in m) > max(meets[a], meets[b]) for m in shared)


def alike(x, y):
    x, y = slow_shingles(x), slow_shingles(y)
    return len(x & y) / len(x | y)


def test_pairs_under_an_unlike_leader_are_compared(spark, monkeypatch):
    found = [t for f in range(400) if meets_only_under_others(t := family(f))][:5]
    assert len(found) == 5
    rows = [(100 * f + i, t) for f, texts in enumerate(found) for i, t in enumerate(texts)]
    assert all(alike(t[9], t[10]) >= 0.8 > max(alike(t[i], t[j]) for i in range(9) for j in (9, 10)) for t in found)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (512, 4):
        monkeypatch.setattr(shingles, "BLOCK", block, raising=False)
        roots = {r.node: r.root for r in components(shingles.near_copies(docs)).collect()}
        for f in range(len(found)):
            assert [roots.get(100 * f + i, 100 * f + i) - 100 * f for i in range(11)] == [0] * 9 + [9, 9]


def test_audit_counts_pairs_that_are_in_one_group(spark):
    import random

    from sparkseek.llm import simhash

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    rows += [(100 + i, " ".join([*t.split(" ")[:-2], word(), word()])) for i, t in rows[:20]] + [(200 + i, t) for i, t in rows[5:10]] + [(300, ""), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    true = sum(alike(x, y) >= 0.8 for i, (_, x) in enumerate(rows[:-2]) for j, (_, y) in enumerate(rows[:-2]) if i != j)
    groups = simhash.near_groups(docs)
    assert shingles.recall(docs, groups) == (1.0, true) and true >= 60
    assert shingles.recall(docs, groups.limit(0)) == (0.0, true)
    part = groups.filter("node not in (0, 100)")
    assert shingles.recall(docs, part)[0] == (true - 2) / true
