"""Resampling against plain counting, for runs of one word and of several."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from flowsieve.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def counted(texts, buckets, longest):
    total = [0] * buckets
    for t in texts:
        for f in features(t, longest)[1]:
            total[zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets] += 1
    return total


def brute(rows, target, buckets=10_000, longest=1, seed=2024, least=20, percent=10):
    raw, aim = counted([t for _, t in rows], buckets, longest), counted(target, buckets, longest)
    s_all, t_all = sum(raw), sum(aim)
    gain = [
        math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(raw, aim)
    ]
    scored = []
    for i, text in rows:
        n_words, found = features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets] for f in found)
        head = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((head + 0.5) / 4294967296)))
        scored.append((i, len(found), weight, score, n_words))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: len(able) * percent // 100]
    out = [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]]
    return out + [(*r[:4], None) for r in scored if r[4] < least]


def order(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("longest,piece", [(1, 1 << 19), (1, 64), (2, 40), (3, 1 << 10)])
def test_against_brute_force(spark, monkeypatch, longest, piece):
    """Also with pieces far shorter than a text, and in few buckets."""
    draw, signs = random.Random(longest * piece), "Ab1 é _-\n日\x7f"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(400))) for _ in range(60)]
    rows = [(k // 2 if k % 9 else None, t) for k, t in enumerate(texts)] + [(1, None), (2, ""), (3, texts[0]), (3, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(t,) for t in texts[5:15] + [None]], "text string")
    monkeypatch.setattr(resample, "PIECE", piece)
    raw = sum((t for table in (resample._runs([t or "" for _, t in rows], longest),) for t in _totals(table, 50)), np.zeros(50, np.int64))
    assert raw.tolist() == counted([t for _, t in rows], 50, longest)
    done = resample.resample(docs, target, buckets=50, longest=longest, least_words=4, percent=37)
    assert order(done.collect()) == order(brute(rows, texts[5:15], 50, longest, least=4, percent=37))


def _totals(tables, buckets):
    for table, _ in tables:
        total = np.zeros(buckets, np.int64)
        used = table.first >= 0
        np.add.at(total, table.bucket(buckets)[used], table.count[used])
        yield total


def test_collisions_are_verified():
    """Runs with equal keys and other bytes get places of their own."""
    words = [b"aa", b"bb", b"aa", b"cc", b"bb", b"a"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    table = resample.Interned(data, start, end, key=np.full(len(words), 15, np.uint64))
    assert len(set(table.slot.tolist())) == 4
    assert table.slot[0] == table.slot[2] and table.slot[1] == table.slot[4]
    assert sorted(table.count[table.count > 0].tolist()) == [1, 1, 2, 2]


def test_edge_rows(spark, edge, nothing):
    target = spark.createDataFrame([("base1 base2 one",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert order(resample.resample(edge, target).collect()) == order(brute(rows, ["base1 base2 one"]))
    assert resample.resample(nothing, target).count() == 0
    assert order(resample.resample(edge, target.where("false")).collect()) == order(brute(rows, []))
    tied = spark.range(40).selectExpr("id % 7 as doc_id", "repeat('w ', 30) as text")
    ranks = sorted(r["rank"] for r in resample.resample(tied, target).collect() if r["rank"])
    assert ranks == [1, 2, 3, 4]
