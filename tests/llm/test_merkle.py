"""Manifests against a plain tree in Python and against SQL, over more rounds than one."""

import hashlib
import random
import zlib

import duckdb
import oracle_check

from flowsieve.llm import merkle

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row[c] if c != "text" else text for c in merkle.FIELDS]
    return hashlib.sha256(
        b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values)
    ).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, at):
    for nodes in tree[:-1]:
        low = at // 16 * 16
        yield nodes[low:at], nodes[at + 1 : low + 16]
        at //= 16


def brute(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, places = [], []
    for s in sources:
        mine = [(r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r) for r in rows if r["source"] == s]
        mine.sort(key=lambda x: x[:3])
        places.append([x[3] for x in mine])
        trees.append(levels([x[2] for x in mine]))
    top = levels([t[-1][0] for t in trees]) if trees else [[None]]
    out = []
    for k, (tree, mine) in enumerate(zip(trees, places)):
        for at, r in enumerate(mine):
            text, i = r["text"], r["doc_id"]
            if i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0:
                text = text.translate(LOWER)
            steps, value = [*path(tree, at), *path(top, k)], leaf(r, text)
            for a, b in steps:
                value = h("".join([*a, value, *b]))
            proof = h("".join("".join(a + b) for a, b in steps))
            out.append((i, tree[0][at], tree[-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return out


def found(df):
    return [tuple(r) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def make(spark, sizes, seed=5):
    draw, rows = random.Random(seed), []
    for source, n in sizes:
        for _ in range(n):
            i = draw.choice([None, draw.randrange(10**6), -draw.randrange(99)]) if n < 50 else draw.randrange(10**7)
            text = draw.choice([None, "", "Ab c", "ünï Code", "low", f"T{i}"])
            rows.append((i, text, draw.choice(["en", None]), source, draw.choice([None, 3])))
    return spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_small_trees(spark):
    """Lone leaves, last runs of one node, null sources, repeated rows, over one source in the top run and more."""
    for sizes in [[("a", 1)], [("a", 17), (None, 1), ("é", 2), ("z", 1)], [(f"s{k}", 1 + k % 3) for k in range(290)]]:
        docs = make(spark, sizes)
        rows = [r.asDict() for r in docs.collect()]
        assert order(found(merkle.manifest(docs))) == order(brute(rows))


def test_more_rounds_than_one(spark, monkeypatch):
    docs = make(spark, [("big", 4500), ("edge", 4096), ("next", 4097), (None, 257)])
    rows = [r.asDict() for r in docs.collect()]
    assert order(found(merkle.manifest(docs))) == order(brute(rows))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert oracle_check.compare(con, merkle.SQL, merkle.manifest(docs)) == []


def test_every_change_shows(spark, tables):
    """A witness fails exactly where the text has changed."""
    done = merkle.manifest(tables("documents")).collect()
    bad = {
        r["doc_id"]
        for r in tables("documents").collect()
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] != r["text"].translate(LOWER)
    }
    assert {r["doc_id"] for r in done if not r["verified"]} == bad and bad
    assert len({r["root"] for r in done}) == 1


def test_witnesses_grow(spark):
    """After every append, open subtrees hold what is complete; at the end each leaf has its whole path."""
    grown, leaves = merkle.Subtree(3), [h(str(k)) for k in range(300)]
    for k, value in enumerate(leaves):
        grown.append(value)
        assert [len(run) for run in grown.open] == [(k + 1) % 16, (k + 1) // 16 % 16, (k + 1) // 256, 0]
    root = grown.close()
    tree = levels(leaves)
    assert root == tree[-1][0]
    at = [k for k in range(len(grown.hash)) if grown.hash[k] in set(leaves)]
    for k in (0, 15, 16, 255, 256, 299):
        steps = list(path(tree, k))
        assert grown.path(at[k]) == (["".join(a) for a, _ in steps], ["".join(b) for _, b in steps])
        assert grown.fold(at[k], leaves[k]) == root != grown.fold(at[k], leaves[0 if k else 1])


def test_edge_rows(spark, edge, nothing):
    rows = [r.asDict() for r in edge.select(*merkle.FIELDS).collect()]
    assert order(found(merkle.manifest(edge))) == order(brute(rows))
    assert merkle.manifest(nothing).count() == 0
    assert merkle.manifest(edge).columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    ]
    words = edge.select(edge.doc_id.cast("string").alias("doc_id"), "text", "lang", "source", "n_chars", "Key")
    assert dict(merkle.manifest(words).dtypes)["doc_id"] == "string" and merkle.manifest(words).count() == len(rows)
