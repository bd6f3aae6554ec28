import random
import re
from itertools import combinations

import numpy as np
import pytest

from flowsieve.llm import jaccard as J
from flowsieve.llm.components import components

BREAK = r"[\x20\x09-\x0d]+"


def shingle_set(text):
    w = [x for x in re.split(BREAK, text or "") if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(class id, links) of each row by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and both >= threshold * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted((str(i), str(ids.get(find(k))), links[k]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((str(r["doc"]), str(r["class_id"]), r["n_links"]) for r in df.collect())


def chain(n, seed):
    """Copies of copies, each with some words changed, so that links reach far and are not transitive."""
    rng = random.Random(seed)
    texts = [[f"t{rng.randrange(10**6)}" for _ in range(90)]]
    for _ in range(n - 1):
        w = list(rng.choice(texts[-20:]))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            del w[rng.randrange(len(w))]
        texts.append(w)
    return [" ".join(w) for w in texts]


def test_groups_of_near_copies_against_all_pairs(spark, monkeypatch):
    rows = list(enumerate(chain(120, 1) + chain(40, 2) + ["a b c"] * 5 + ["unique words here and there now"]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute(rows)
    assert max(x[2] for x in expected) > 10
    assert got(J.jaccard_join(df)) == expected
    monkeypatch.setattr(J, "BLOCK", 16)  # many blocks, the same result
    assert got(J.jaccard_join(df)) == expected


def test_edge_rows(edge, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(J.jaccard_join(edge)) == brute(rows)
    assert J.jaccard_join(nothing).count() == 0
    kept = J.keep_one(edge)
    assert kept.columns == edge.columns
    left = sorted(str(r["doc_id"]) for r in kept.collect())
    # 1 stands for the copies and near copies of it, 8 for 9; texts without words all stay.
    assert left == sorted(["1", "4", "5", "6", "7", "8", "10", "None"])
    assert J.keep_one(nothing).count() == 0


def test_real_table(tables):
    docs = tables("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(J.jaccard_join(docs)) == brute(rows)


def test_least_matches_is_a_posterior_tail():
    """Against the integral of the Beta law on a fine grid."""
    p0 = 0.8 + 0.2 / 256
    grid = np.linspace(0, 1, 400_001)[1:-1]
    for n, m in J.least_matches(0.8)[:3]:
        tail = {}
        for k in (m - 1, m):
            law = np.exp(k * np.log(grid) + (n - k) * np.log1p(-grid) - np.log(0.5) * n * 0)
            tail[k] = law[grid >= p0].sum() / law.sum()
        assert tail[m] >= J.TOLERANCE * 0.9 and tail[m - 1] < J.TOLERANCE * 1.1


def test_pruning_keeps_pairs_at_the_threshold_and_drops_far_ones():
    rng = np.random.default_rng(3)
    kept = dropped = 0
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
        a, near, far = np.unique(x[:810]), np.unique(x[90:900]), np.unique(np.concatenate([x[:250], x[850:]]))
        sig = [np.frombuffer(J.signature(s)[0], np.uint8) for s in (a, near, far)]
        block, one = np.stack(sig), np.array([0])
        kept += len(J.surviving(block, block, one, np.array([1]), J.least_matches(0.8)))
        dropped += not len(J.surviving(block, block, one, np.array([2]), J.least_matches(0.8)))
    assert kept == 60 and dropped == 60


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(0, k) for k in range(1, 40)]
    pairs = path + star + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    rng.shuffle(pairs)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert found == {k: find(k) for k in parent if find(k) != k}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
