"""Similarity join on sets of five-word runs, with Bayesian pruning of candidates.

1. Every text becomes a set of shingle digests, its MinHash values and band digests of those. Texts
   with equal sets are one *set* from then on, however many copies there are.
2. Sets that share a band are candidates. Their MinHash values are compared 32 at a time; after each
   step a pair is dropped once the posterior probability (uniform prior) that its similarity reaches
   the threshold is below the tolerance. Pairs are never written out: a bucket of any size is cut
   into blocks by digest, a task compares two blocks and returns at most one line per member.
3. What survives is joined into clusters. Inside a cluster, again block by block, pairs are pruned
   the same way and the rest is verified exactly on the whole sets, giving the number of links of
   each set and, by components, its class.

With 40 bands of 5 values a pair at similarity 0.8 is missed with probability 1.2e-7, less above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import fresh, row_key
from flowsieve.llm.components import components
from flowsieve.llm.vectors import mix, shingles, word_hashes
from flowsieve.session import materialise, ship_package

BANDS, ROWS = 40, 5
VALUES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-7
#: Members of a block, and bytes of shingles in one.
BLOCK, BLOCK_BYTES = 768, 4 << 20
_random = np.random.Generator(np.random.PCG64(7))
FACTORS = _random.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)
BAND_FACTORS = _random.integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(sets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """One byte of each MinHash value, and the band digests."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(low, (x[i : i + 256, None] * FACTORS + OFFSETS).min(axis=0), out=low)
    byte = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    bands = (low.reshape(BANDS, ROWS).astype(np.uint64) * BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return byte.tobytes(), mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * BAND_FACTORS[0]).view(np.int64)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on). A byte also matches by chance, once in 256.

    With a uniform prior the match rate given m of n has a Beta(m + 1, n - m + 1) law, whose upper
    tail at p is the probability of at most m successes in n + 1 draws at p.
    """
    p = threshold + (1 - threshold) / 256
    steps = []
    for n in [*range(STEP, VALUES, STEP), VALUES]:
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        steps.append((n, m))
    return steps


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, steps) -> np.ndarray:
    """Which pairs (i of left, j of right) are still possible after all values."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    done = 0
    for n, least in steps:
        same = left[i[alive], done:n] == right[j[alive], done:n]
        matches = matches + same.sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index joined to each of ``n`` indexes by the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        for k in (root[i], root[j]):  # hang roots, not members, so that whole trees move
            np.minimum.at(root, k, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` of every index once the pairs are joined as well."""
    i, j = root[i], root[j]
    open_ = i != j
    return _roots(len(root), i[open_], j[open_])[root] if open_.any() else root


def _pairs(side: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a unit in bounded pieces: all of one block, or those across two."""
    if own:
        n = len(side)
        for i in range(0, n - 1, 64):
            rows = np.arange(i, min(i + 64, n - 1))
            a = np.repeat(rows, n - 1 - rows)
            b = np.concatenate([np.arange(r + 1, n) for r in rows])
            yield a, b
        return
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for k in range(0, len(first), 64):
        part = first[k : k + 64]
        if len(second):
            yield np.repeat(part, len(second)), np.tile(second, len(part))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole units (equal unit, x, y) from rows sorted by those."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        marks = list(zip(batch["unit"], batch["x"], batch["y"]))
        cuts = [0, *[k for k in range(1, len(marks)) if marks[k] != marks[k - 1]], len(marks)]
        if kept and marks[0] != kept[0].attrs["mark"]:
            yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
            kept = []
        for a, b in zip(cuts, cuts[1:]):
            part = batch.iloc[a:b]
            part.attrs = {"mark": marks[a]}
            kept.append(part)
            if b < len(marks):
                yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
                kept = []
    if kept:
        yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), VALUES)


def _candidates(threshold: float):
    steps = least_matches(threshold)

    def run(batches):
        a, b = [], []
        for unit in _units(batches):
            sid, sig = unit["sid"].to_numpy(), _bytes(unit["sig"])
            side = unit["side"].to_numpy()
            own = bool((unit["x"].iat[0] == unit["y"].iat[0]))
            root = np.arange(len(sid))
            for p, q in _pairs(side, own):
                apart = root[p] != root[q]  # what is joined already needs no further edge
                p, q = p[apart], q[apart]
                alive = surviving(sig, sig, p, q, steps)
                root = _joined(root, p[alive], q[alive])
            for k in np.flatnonzero(root != np.arange(len(sid))):
                a.append(sid[k])
                b.append(sid[root[k]])
            if len(a) > 10_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": a, "b": b})

    return run


def _verified(threshold: float):
    steps = least_matches(threshold)

    def run(batches):
        rows = []
        for unit in _units(batches):
            sid, sig = unit["sid"].to_numpy(), _bytes(unit["sig"])
            sets = [np.frombuffer(x, np.uint64) for x in unit["shingles"]]
            size = np.array([len(x) for x in sets])
            copies = unit["copies"].to_numpy()
            links = np.zeros(len(sid), np.int64)
            root = np.arange(len(sid))
            own = bool(unit["x"].iat[0] == unit["y"].iat[0])
            for p, q in _pairs(unit["side"].to_numpy(), own):
                even = np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q])
                p, q = p[even], q[even]
                alive = surviving(sig, sig, p, q, steps)
                linked = []
                for k, m in zip(p[alive].tolist(), q[alive].tolist()):
                    both = _shared(sets[k], sets[m])
                    if both >= threshold * (size[k] + size[m] - both):
                        links[k] += copies[m]
                        links[m] += copies[k]
                        linked.append((k, m))
                if linked:
                    root = _joined(root, *np.array(linked, np.int64).T)
            for k in np.flatnonzero(links):
                rows.append((sid[k], links[k], sid[root[k]]))
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=["sid", "links", "root"])
                rows = []
        yield pd.DataFrame(rows, columns=["sid", "links", "root"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _sketched(batches):
    for batch in batches:
        out = []
        for text in batch["text"]:
            found = shingles(word_hashes(text))
            if not len(found):
                out.append((None, 0, None, None))
                continue
            sig, bands = signature(found)
            out.append((hashlib.md5(found.tobytes()).digest(), len(found), sig, bands))
        more = pd.DataFrame(out, columns=["sid", "n", "sig", "bands"], index=batch.index)
        yield pd.concat([batch.drop(columns="text"), more], axis=1)


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``key``, ``sid`` (digest of the shingle set; null without words), ``n``, ``sig``, ``bands``."""
    ship_package(docs.sparkSession)
    cut = docs.select(
        F.col(id_col).cast("string").alias("doc"),  # pandas has no whole numbers with nulls
        row_key(F.col(id_col), F.col(text)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    made = cut.mapInPandas(
        _sketched, "doc string, key binary, sid binary, n bigint, sig binary, bands array<bigint>"
    )
    return made.withColumn("doc", F.col("doc").cast(docs.schema[id_col].dataType))


def _in_units(rows: DataFrame, blocks: str) -> DataFrame:
    """A row for every pair of blocks that the row's block takes part in: ``x``, ``y`` and its ``side``."""
    mine = F.pmod(F.xxhash64("sid"), F.col(blocks)).cast("int")
    rows = rows.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    )
    return (
        rows.withColumn("x", F.least("mine", "other"))
        .withColumn("y", F.greatest("mine", "other"))
        .withColumn("side", (F.col("mine") == F.col("y")).cast("int"))
        .drop("mine", "other", blocks)
    )


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("unit"), F.col("x"), F.col("y")).sortWithinPartitions("unit", "x", "y", "sid")


def candidate_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join all sets which may be similar; a spanning part of the pairs."""
    bands = sets.select(F.explode("bands").alias("unit"), F.xxhash64("sid").alias("h"))
    full = bands.groupBy("unit").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = bands.join(full, "unit").select(
        "unit", "h", F.ceil(F.col("c") / BLOCK).cast("bigint").alias("blocks")
    )
    signed = sets.select("sid", "sig", F.xxhash64("sid").alias("h"))
    rows = _in_units(members.join(signed, "h").drop("h"), "blocks")
    return _dealt(rows).mapInPandas(_candidates(threshold), "a binary, b binary").distinct()


def _with_shingles(batches):
    for batch in batches:
        found = [shingles(word_hashes(t)).tobytes() for t in batch["text"]]
        yield batch.drop(columns="text").assign(shingles=found)


def verified_links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, threshold: float, text: str, id_col: str) -> DataFrame:
    """``sid``, its ``links`` to documents of other sets, and a ``root`` it is joined to; a row per unit."""
    roots = clusters.select(F.col("root").alias("node"), "root").distinct()
    placed = sets.join(clusters.unionByName(roots), F.col("sid") == F.col("node")).select(
        F.col("root").alias("unit"), "sid", "sig", "n", "copies", "key"
    )
    size = placed.groupBy("unit").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES))
        .cast("bigint")
        .alias("blocks"),
        F.count(F.lit(1)).alias("c"),
    )
    size = size.select("unit", F.least("blocks", "c").alias("blocks"))
    placed = placed.join(size, "unit")
    bodies = docs.select(row_key(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text")).where(
        "text is not null"
    )
    read = bodies.join(placed, "key").dropDuplicates(["key"]).drop("key", "n")
    shape = "unit binary, sid binary, sig binary, copies bigint, blocks bigint"
    filled = read.select("text", "unit", "sid", "sig", "copies", "blocks").mapInPandas(
        _with_shingles, f"{shape}, shingles binary"
    )
    return _dealt(_in_units(filled, "blocks")).mapInPandas(
        _verified(threshold), "sid binary, links bigint, root binary"
    )


def jaccard_join(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8
) -> DataFrame:
    """One row per document: ``doc``, ``key``, ``class`` (digest), ``class_id`` and ``n_links``.

    Words are what white space separates. A text with one to four words is one shingle. ``n_links``
    counts the other rows whose sets have a Jaccard similarity of at least ``threshold``, copies
    included; ``class_id`` is the smallest id joined to the document by links (null if none has one).
    Null and empty texts have no shingles: no links, a class of their own, ``class`` null. Rows that
    repeat are copies of each other. Other columns are not read.
    """
    signed = materialise(sketch(docs, id_col=id_col, text=text), "sketch")
    sets = materialise(
        signed.where("sid is not null")
        .groupBy("sid")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("doc").alias("first_doc"),
            F.first("key").alias("key"),
            F.first("n").alias("n"),
            F.first("sig").alias("sig"),
            F.first("bands").alias("bands"),
        ),
        "sets",
    )
    clusters = components(candidate_edges(sets, threshold))
    found = materialise(verified_links(docs, sets, clusters, threshold, text, id_col), "links")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    rooted = (
        sets.select("sid", "copies", "first_doc")
        .join(links, "sid", "left")
        .join(member.select(F.col("node").alias("sid"), "root"), "sid", "left")
        .select(
            "sid",
            "first_doc",
            F.coalesce("root", "sid").alias("class"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    named = rooted.groupBy("class").agg(F.min("first_doc").alias("class_id"))
    rooted = rooted.join(named, "class").select("sid", "class", "class_id", "n_links")
    worded = signed.where("sid is not null").select("doc", "key", "sid").join(rooted, "sid").drop("sid")
    alone = signed.where("sid is null").select(
        "doc",
        "key",
        F.lit(None).cast("binary").alias("class"),
        F.col("doc").alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links"),
    )
    return worded.unionByName(alone)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents with one of each class: that with the smallest id, then digest of id and text.

    Rows without id come last in a class. Documents without words all stay. Of rows with equal id and
    text one stays. Columns and their order are those of ``docs``.
    """
    classes = materialise(jaccard_join(docs, id_col=id_col, text=text, threshold=threshold), "classes")
    rank = F.struct(F.col("doc").isNull().alias("last"), "doc", "key")
    best = (
        classes.where("class is not null").groupBy("class").agg(F.min(rank).alias("best")).select("best.key")
    )
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text)))
    worded = F.col(text).isNotNull() & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    chosen = (
        keyed.where(worded).join(best.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key])
    )
    return chosen.unionByName(keyed.where(~F.coalesce(worded, F.lit(False)))).drop(key)
