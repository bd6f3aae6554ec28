import math
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowsieve.llm import quality as Q
from flowsieve.llm.common import where_late

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def h(text):
    return xxhash.xxh64_intdigest(text.encode(), 42)


def h2(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)
    return xxhash.xxh64_intdigest(struct.pack("<Q", b), first)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def features(text, buckets):
    hs = [h(w) for w in WORD.findall(text or "")]
    return [signed(x) % buckets for x in hs + [h2(a, b) for a, b in zip(hs, hs[1:])]]


def ratios(raw, target):
    if not sum(target):
        return [0] * len(raw)
    n, m = sum(raw) + len(raw), sum(target) + len(raw)
    return [round(Q.UNIT * (math.log((y + 1) / m) - math.log((x + 1) / n))) for x, y in zip(raw, target)]


def repeated(w):
    seen, covered = {}, set()
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + d for p in places for d in range(5)}
    return covered


def fold(i):
    first = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return signed(xxhash.xxh64_intdigest(b"fold", first)) % Q.FOLDS


def held_out(docs, trusted, raw, target):
    """The threshold: trusted documents under weights without their part, drawn to the prior."""
    buckets, scores, without = len(raw), [], {}
    for i, t in docs:
        w = WORD.findall(t or "")
        if i not in trusted or len(w) < 10 or 100 * len(repeated(w)) > 20 * len(w):
            continue
        if fold(i) not in without:
            rest = list(target)
            for j, u in docs:
                if j in trusted and fold(j) == fold(i):
                    for b in features(u, buckets):
                        rest[b] -= 1
            without[fold(i)] = ratios(raw, rest)
        found = features(t, buckets)
        scores.append(math.floor(sum(without[fold(i)][b] for b in found) / len(found)))
    n = len(scores)
    least = sorted(scores)[max(math.ceil(Q.LOST * n), 1) - 1] if scores else 0
    return (n * least / Q.UNIT + Q.PRIOR_WEIGHT * Q.PRIOR) / (n + Q.PRIOR_WEIGHT)


def brute(docs, trusted, buckets=Q.BUCKETS):
    raw, target = [0] * buckets, [0] * buckets
    for i, t in docs:
        for b in features(t, buckets):
            raw[b] += 1
            target[b] += i in trusted
    weights = ratios(raw, target)
    threshold = held_out(docs, trusted, raw, target)
    rows = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        covered = repeated(w)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        score = sum(weights[b] for b in features(t, buckets))
        kept = not failed and score >= round(threshold * Q.UNIT) * (2 * len(w) - 1)
        rows.append(
            (
                str(i),
                len(w),
                sum(map(len, w)),
                len(re.findall(r"[#*$%&|<>]", t)),
                len(lines) - len(set(lines)),
                len(covered),
                failed,
                kept,
            )
        )
    return sorted(rows)


def got(df):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in df.select("doc_id", *names).collect())


def test_real_table_against_brute_force(tables):
    docs, labels = tables("documents"), tables("labels").where("quality = 1 and toxic = 0")
    trusted = {r["doc_id"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = got(Q.quality_rules(docs, labels))
    assert found == brute(rows, trusted)
    assert 0.6 * len(rows) < sum(r[-1] for r in found) < len(rows)


def test_edge_rows(spark, edge, nothing):
    trusted = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id bigint")
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(Q.quality_rules(edge, trusted)) == brute(rows, {1})
    assert got(Q.quality_rules(edge, trusted.where("false"))) == brute(rows, set())
    assert Q.quality_rules(nothing, trusted).count() == 0


def test_repeats_and_symbols(spark):
    texts = ["a b c d e " * 3, "x a b c d e y a b c d e z", "a a a a a a a", "#*$ |<> &% é😀", "l\nl\n\n \nl\nm"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    none = docs.select("doc_id").where("false")
    assert got(Q.quality_rules(docs, none)) == brute(list(enumerate(texts)), set())


def test_junk_scores_below_clean(tables):
    """Held-out labels: the verdict parts them better than the base rules alone."""
    docs, labels = tables("documents"), tables("labels")
    fit = labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0")
    judged = Q.quality_rules(docs, fit).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id")
    by = {r["quality"]: r["r"] for r in judged.groupBy("quality").agg(F.avg("log_ratio").alias("r")).collect()}
    assert by[1] > Q.PRIOR and by[1] > by.get(0, -1) + 0.1


def test_threshold_has_no_switch(spark):
    """One more held-out document moves it little, with few of them and with many."""
    text = lambda k: " ".join(f"w{(k * 7 + j * j) % 90}" for j in range(40))
    found = []
    for n in (0, 1, 19, 20, 21, 60):
        docs = [(k, text(k)) for k in range(80)]
        table = spark.createDataFrame(docs, "doc_id bigint, text string")
        trusted = table.select("doc_id").where(F.col("doc_id") < n)
        weights, threshold = Q.fit(table, trusted, buckets=64)
        found.append(threshold)
        if n:
            raw = [sum(features(t, 64).count(b) for _, t in docs) for b in range(64)]
            target = [sum(features(t, 64).count(b) for _, t in docs[:n]) for b in range(64)]
            assert threshold == held_out(docs, set(range(n)), raw, target)
    assert found[0] == Q.PRIOR and abs(found[3] - found[2]) < 0.1 and abs(found[4] - found[3]) < 0.1


def test_plan_text_is_short(tables):
    """The weights are not written out in the plan."""
    judged = Q.judge(tables("documents"), np.arange(Q.BUCKETS, dtype=np.int32))
    text = judged._jdf.queryExecution().toString()
    assert len(text) < 100_000 and judged.agg(F.max("log_ratio")).first()[0] > 0


@pytest.mark.parametrize("sf, most", [("sf0.001", 0), ("sf0.01", 0.15), ("sf0.1", 0.05)])
def test_junk_goes_and_clean_stays_at_every_size(spark, sf, most):
    """Labelled junk that the base rules pass, and trusted rows that the fit did not see."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    fit = labels.where("quality = 1 and toxic = 0 and pmod(xxhash64(doc_id), 5) > 0")
    judged = where_late(Q.quality_rules(docs, fit), ~F.col("base_failed")).select("doc_id", "kept")
    unseen = judged.join(labels, "doc_id").where("toxic = 0 and (quality = 0 or pmod(xxhash64(doc_id), 5) = 0)")
    unseen = unseen.groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    kept = dict(unseen.collect())
    assert kept[0] <= most and kept[1] >= 0.9
