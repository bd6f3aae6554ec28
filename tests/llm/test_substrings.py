"""Substring dedup against comparing all windows, at several sizes of a shard."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import substrings

SIZE = substrings.WINDOW


def brute(rows):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - SIZE + 1):
            key, at = tuple(w[k : k + SIZE]), (i is None, i)
            first[key] = min(first.get(key, at), at) if i is not None else first.get(key, at)
    out = []
    for (i, t), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - SIZE + 1):
            if first[tuple(w[k : k + SIZE])] < (i is None, i) and first[tuple(w[k : k + SIZE])] != (True, None):
                gone.update(range(k, k + SIZE))
        out.append((i, len(w), len(gone), None if t is None else " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def run(docs):
    done = substrings.dedup_substrings(docs)
    return order(tuple(r) for r in done.select("doc_id", "n_words", "n_removed", "text").collect())


def corpus(seed):
    """Passages that texts share whole, in part, changed in a word, twice in one text, and in long repeats."""
    draw = random.Random(seed)
    prose = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    shared = [prose(n) for n in (49, 50, 51, 60, 130, 400)] + [["x"] * 300, ["a", "b"] * 200]
    rows = []
    for k in range(60):
        words = []
        for _ in range(draw.randrange(1, 6)):
            p = list(draw.choice(shared))
            a = draw.randrange(len(p)) if draw.random() < 0.4 else 0
            p = p[a : a + draw.randrange(20, 500)]
            if draw.random() < 0.3 and p:
                p[draw.randrange(len(p))] = "other"
            words += p + (prose(draw.randrange(60)) if draw.random() < 0.6 else [])
        gap = lambda: draw.choice([" ", "\n", "\t ", "\x0b"])
        i = draw.choice([k, k // 3, None]) if draw.random() < 0.5 else k
        rows.append((i, "".join(w + gap() for w in words)))
    return rows + rows[:4] + [(5, None), (6, ""), (7, "few words")]


@pytest.mark.parametrize("seed,shard", [(1, 1024), (2, 1024), (3, 2), (4, 1)])
def test_against_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert run(docs) == order(brute(rows))


def test_passages_do_not_depend_on_pieces(monkeypatch):
    """Every window is in one passage, with the same anchor in all texts, however texts are cut up."""
    texts = [t or "" for _, t in corpus(5)]
    seen = []
    for chunk, segment in [(1 << 18, 1 << 17), (600, 64)]:
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        monkeypatch.setattr(substrings, "SEGMENT", segment)
        owner, at, n, anchor, _ = substrings.passages(texts)
        seen.append(sorted((o, a + j, h) for o, a, c, h in zip(owner, at, n, anchor) for j in range(c)))
        assert n.max() <= substrings.LONGEST
    assert seen[0] == seen[1]
    count = sum(max(len(t.split()) - SIZE + 1, 0) for t in texts)
    assert len(seen[0]) == len({x[:2] for x in seen[0]}) == count


@pytest.mark.parametrize("size", [1, 2, 5])
def test_automaton(size):
    draw = random.Random(size)
    for _ in range(200):
        known, texts = substrings.Automaton(), []
        for k in range(draw.randrange(1, 7)):
            text = [draw.randrange(3) for _ in range(draw.randrange(0, 15))]
            runs = [text[i : i + size] for i in range(len(text) - size + 1)]
            first = [next((j for j, t in enumerate(texts) if any(t[i : i + size] == r for i in range(len(t)))), -1) for r in runs]
            assert known.windows(text, size) == first
            known.add(text, k)
            texts.append(text)


def test_edge_rows(spark, edge, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert run(edge) == order(brute(rows))
    done = substrings.dedup_substrings(edge)
    assert set(done.columns) == {*edge.columns, "n_words"} and done.where(F.col("Key") != 0).count() == 0
    assert substrings.dedup_substrings(nothing).count() == 0
    words = edge.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert substrings.dedup_substrings(words).count() == len(rows)


def test_one_long_text(spark):
    """A text of many segments, of which a later one repeats the end."""
    long = " ".join(f"n{k}" for k in range(200_000))
    rows = [(1, long), (2, "start " + " ".join(long.split()[-70:])), (3, "y" * 600_000 + " z " + "q " * 60)]
    done = {r[0]: r[1:3] for r in run(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert done == {1: (200_000, 0), 2: (71, 70), 3: (62, 0)}
    assert substrings.without("a  b\tc d", np.array([1, 1]), np.array([2, 3])) == ("a d", 2)
