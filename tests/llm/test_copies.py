"""Many edited copies of one text, most of them near each other but not near enough."""

import numpy as np

from seqloom.llm import neardup
from seqloom.llm.shingles import shingles


def sets_of(texts, width=4):
    data = "".join(texts).encode()
    return shingles(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]), width)


def copies(n, words=120, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    return [" ".join(w if rng.random() > rate else f"x{rng.integers(10**6)}" for w in base) for rate in rng.uniform(0.005, 0.06, n)]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n, m, shared in ((1, 1, 0), (40, 45, 30), (400, 380, 350), (900, 300, 250), (2000, 2100, 1900)):
        h = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        a, b = h[:n], h[n - shared :]
        far = int(neardup.differences(*(np.frombuffer(neardup.parities(x), "<u8")[None] for x in (a, b)))[0, 0])
        assert far <= n + m - 2 * shared
        # tight where sets are near
        assert shared < 0.9 * max(n, m) or far >= 0.8 * (n + m - 2 * shared)


def test_edited_copies_are_linked_without_confirming_all_pairs(spark, monkeypatch):
    texts = copies(300)
    sets = [set(s.hashes.tolist()) for s in sets_of(texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    tried, confirm = [], neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda docs, classes, pairs, *rest: tried.append(pairs.count()) or confirm(docs, classes, pairs, *rest))
    monkeypatch.setattr(neardup, "ACROSS_ROWS", 70)
    got = neardup.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root)) and 1 < len(set(root)) < len(texts)
    assert sum(tried) < 10 * len(texts)
