"""A Merkle manifest of a table, with a witness for every row, built by aligned appends.

Rows become leaves of one tree per source, the roots of these become leaves of one tree on top. A
node is the digest of its (up to sixteen) children. Nodes are appended in order; every open subtree
carries what is known of the witnesses of its members, and each run that is completed extends them by
the siblings. Tasks do this for aligned blocks of 16^3 nodes; the roots of the blocks are appended in
the same way, until one is left.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.rows import sorted_row_id
from flowsieve.session import broadcast_if_small, materialise, ship_package

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One row in five is verified against altered content.
TAMPERED = 5


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def levels_of(n: int) -> int:
    """Levels between ``n`` nodes and the one that is left of them, at most those of a block."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """Nodes appended in order, up to ``levels`` above them, and how far each one's witness has grown."""

    def __init__(self, levels: int):
        self.hash: list[str] = []
        self.left: list[str] = []
        self.right: list[str] = []
        self.parent: list[int] = []
        self.open: list[list[int]] = [[] for _ in range(levels + 1)]
        self._tails: dict[int, str] = {}
        self._folds: dict[tuple[int, str], str] = {}

    def append(self, value: str, level: int = 0) -> int:
        me = len(self.hash)
        self.hash.append(value)
        self.left.append("")
        self.right.append("")
        self.parent.append(-1)
        run = self.open[level]
        run.append(me)
        if len(run) == FAN and level + 1 < len(self.open):
            self._complete(level)
        return me

    def _complete(self, level: int) -> None:
        """The open run of a level becomes a node; its members' witnesses get their siblings."""
        run, self.open[level] = self.open[level], []
        text = "".join([self.hash[k] for k in run])
        size = len(self.hash[run[0]])
        up = self.append(digest(text), level + 1)
        for i, k in enumerate(run):
            self.left[k], self.right[k], self.parent[k] = text[: i * size], text[(i + 1) * size :], up

    def close(self) -> str:
        """Complete the runs that are still open, also those of one node; the root."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        (top,) = self.open[-1]
        return self.hash[top]

    def path(self, node: int) -> tuple[list[str], list[str]]:
        """The siblings on the left and on the right, level by level."""
        left, right = [], []
        while self.parent[node] >= 0:
            left.append(self.left[node])
            right.append(self.right[node])
            node = self.parent[node]
        return left, right

    def proof(self, node: int) -> str:
        """All siblings of the path in one text; nodes of a run share what is above them."""
        if self.parent[node] < 0:
            return ""
        up = self.parent[node]
        if up not in self._tails:
            self._tails[up] = self.proof(up)
        return self.left[node] + self.right[node] + self._tails[up]

    def fold(self, node: int, value: str) -> str:
        """The root that the witness of ``node`` gives if its digest is ``value``."""
        if self.parent[node] < 0:
            return value
        key = self.parent[node], digest(self.left[node] + value + self.right[node])
        if key not in self._folds:
            self._folds[key] = self.fold(*key)
        return self._folds[key]


def fold(value: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right):
        value = digest(a + value + b)
    return value


def _blocks(batches, columns: list[str]):
    """Lists of rows of one block each, from batches sorted by tree, block and place."""
    block, key = [], None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns]):
            if row[:2] != key:
                if block:
                    yield block
                block, key = [], row[:2]
            block.append(row)
    if block:
        yield block


def _batches(rows, schema: pa.Schema, size: int = BLOCK):
    """Rows as record batches of about ``size``."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _in_blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes dealt by block of their tree and sorted in it; a row of place -1 comes first."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos", *more)


def _block_of(pos: Column) -> Column:
    return F.floor(pos / BLOCK).cast("bigint")


NODES = "tree bigint, pos bigint, n bigint, hash string"
PATHS = "tree bigint, pos bigint, lefts array<string>, rights array<string>, subroot string, root string"
_NODES = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])
_PATHS = pa.schema(
    [
        ("tree", pa.int64()),
        ("pos", pa.int64()),
        ("lefts", pa.list_(pa.string())),
        ("rights", pa.list_(pa.string())),
        ("subroot", pa.string()),
        ("root", pa.string()),
    ]
)
RESULTS = "id string, leaf string, subroot string, root string, proof string, folded string"
_RESULTS = pa.schema([(c.split()[0], pa.string()) for c in RESULTS.split(", ")])


def _climb(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks of ``nodes``, themselves the nodes of the next round."""

    def run(batches):
        def roots():
            for block in _blocks(batches, ["tree", "block", "n", "hash"]):
                tree, at, n, _ = block[0]
                grown = Subtree(levels_of(n))
                for row in block:
                    grown.append(row[3])
                yield tree, at, -(-n // BLOCK), grown.close()

        yield from _batches(roots(), _NODES)

    dealt = _in_blocks(nodes.select("tree", _block_of(F.col("pos")).alias("block"), "pos", "n", "hash"))
    return dealt.mapInArrow(run, NODES)


def _rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes``, the roots of their blocks and so on, until every tree has one node left."""
    rounds = [nodes]
    while most > 1:
        rounds.append(materialise(_climb(rounds[-1]), "nodes"))
        most = -(-most // BLOCK)
    return rounds


def _headed(nodes: DataFrame, paths: DataFrame, extra: list[str]) -> DataFrame:
    """Nodes behind a row with the path of their block: one of place -1."""
    head = paths.select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "lefts", "rights", "subroot", "root"
    )
    body = nodes.select("tree", _block_of(F.col("pos")).alias("block"), "pos", "n", "hash", *extra)
    return _in_blocks(head.unionByName(body, allowMissingColumns=True))


def _descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of ``nodes`` to the root from those of their blocks."""

    def run(batches):
        def out():
            for head, *block in _blocks(batches, ["tree", "block", "pos", "n", "hash", "lefts", "rights", "subroot", "root"]):
                grown = Subtree(levels_of(block[0][3]))
                at = [grown.append(row[4]) for row in block]
                grown.close()
                for row, me in zip(block, at):
                    left, right = grown.path(me)
                    yield row[0], row[2], left + head[5], right + head[6], head[7], head[8]

        yield from _batches(out(), _PATHS, 256)

    return _headed(nodes, paths, []).mapInArrow(run, PATHS)


def _prove(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """A row per leaf: digest of its witness, and the root folded from what it is now."""

    def run(batches):
        columns = ["tree", "block", "n", "hash", "lefts", "rights", "subroot", "root", "id", "altered"]

        def out():
            for head, *block in _blocks(batches, columns):
                lefts, rights, subroot, root = head[4:8]
                above = "".join([a + b for a, b in zip(lefts, rights)])
                grown = Subtree(levels_of(block[0][2]))
                at = [grown.append(row[3]) for row in block]
                grown.close()
                known: dict[str, str] = {}
                for row, me in zip(block, at):
                    top = grown.fold(me, row[9] or row[3])
                    if top not in known:
                        known[top] = fold(top, lefts, rights)
                    yield row[8], row[3], subroot, root, digest(grown.proof(me) + above), known[top]

        yield from _batches(out(), _RESULTS)

    return _headed(leaves, paths, ["id", "altered"]).mapInArrow(run, RESULTS)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of all values with their lengths in bytes; a null is told from every value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    fields: tuple[str, ...] = FIELDS,
    tampered: int = TAMPERED,
) -> DataFrame:
    """One row per row: ``id_col``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Leaves of a source ascend by id (null first), rows of equal id by digest, so that repeated rows are
    leaves side by side; sources ascend by their bytes, null is one of its own and comes first. Rows whose
    id has a checksum that ``tampered`` divides are folded from their text in lower case; those without id
    or text are as they were. An empty table has no root and no rows. Only ``fields`` are read.

    Texts are read once; what is shuffled is a digest or two and the id of each row. Places come from one
    range sort, so a source of any size is spread, and a task holds one block. The path above a block is
    sent to it once. The driver gets the number of sources and the size of the largest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    altered = F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % tampered == 0, F.translate(text, UPPER, LOWER))
    now = [F.coalesce(altered, F.col(c)) if c == text else F.col(c) for c in fields]
    leaves = docs.select(
        F.col(source).cast("string").alias("source"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in fields]).alias("hash"),
        F.when(altered.isNotNull(), leaf_digest(now)).alias("altered"),
    )
    # Written, as the sort samples its input first. What is equal here is the same leaf, so that a place in
    # the scan may tell such rows apart.
    ranked = sorted_row_id(materialise(leaves, "leaves"), ["source", "id", "hash"], into="at")
    trees = materialise(
        ranked.groupBy("source").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("n")), "trees"
    )
    size, count = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))
    known = trees.select(key.alias("key"), "tree", "n")
    leaves = ranked.withColumn("key", key).join(broadcast_if_small(known), "key")
    place = (F.col("at") - F.col("tree")).alias("pos")
    leaves = leaves.select("tree", place, "n", "hash", F.col("id").cast("string").alias("id"), "altered")
    rounds = _rounds(leaves, size or 0)
    # The order of the first places is that of the sources.
    subroots = rounds[-1].select(F.col("tree").alias("own"), "hash")
    top = sorted_row_id(subroots, ["own"], into="pos").select(
        F.lit(0).cast("bigint").alias("tree"), "pos", F.lit(count).cast("bigint").alias("n"), "hash", "own"
    )
    tops = _rounds(materialise(top, "subroots"), count)
    none = F.array().cast("array<string>")
    paths = tops[-1].select(
        "tree", "pos", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")
    )
    for nodes in tops[-2::-1]:
        paths = materialise(_descend(nodes, paths), "paths")
    zero = F.lit(0).cast("bigint")
    paths = paths.drop("subroot", "tree").join(tops[0].select("pos", "own", F.col("hash").alias("subroot")), "pos")
    paths = paths.select(F.col("own").alias("tree"), zero.alias("pos"), "lefts", "rights", "subroot", "root")
    for nodes in rounds[:0:-1]:
        paths = materialise(_descend(nodes, paths), "paths")
    proved = _prove(leaves, paths)
    return proved.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _levels_sql(name: str, leaves: str) -> str:
    """Nodes of all levels of the trees in ``leaves(tree, pos, n, hash)``, with their siblings' texts."""
    return f"""
{name}_n(tree, level, pos, n, hash) as (
  select tree, 0, pos, n, hash from {leaves}
  union all
  select tree, any_value(level) + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' order by pos))
  from {name}_n where n > 1 group by tree, pos // 16
), {name}_r as (
  select tree, level, pos // 16 run, string_agg(hash, '' order by pos) t from {name}_n where n > 1 group by all
), {name}_s as (
  select tree, level, pos, substr(t, 1, 64 * (pos % 16)) l, substr(t, 64 * (pos % 16) + 65) r
  from {name}_n join {name}_r using (tree, level) where pos // 16 = run
), {name}_top as (select tree, hash from {name}_n where n = 1)"""


def _crc32_sql(blob: str) -> str:
    """The checksum of a blob, bit by bit."""
    signs = f"flatten(list_transform(range(octet_length({blob})), lambda i: [('0x' || substr(hex({blob}), 2 * i + 1, 2))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when x >= 0 then xor(s, x) when s % 2 = 1 then xor(s >> 1, 3988292384) else s >> 1 end"
    return f"xor(list_reduce({signs}, lambda s, x: {step}, 4294967295::bigint), 4294967295)"


def _leaf_sql(text: str) -> str:
    parts = [text if f == "text" else f"{f}::varchar" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p}))::varchar || ':' || {p}, '-')" for p in parts) + ")"


#: The whole operator in SQL.
SQL = f"""
with recursive d as (
  select row_number() over () r, doc_id, source, {_leaf_sql("text")} hash,
    case when {_crc32_sql("encode(doc_id::varchar)")} % {TAMPERED} = 0 and text is not null
      then {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} else {_leaf_sql("text")} end now
  from documents
), leaves as (
  select *, dense_rank() over (order by source nulls first) - 1 tree, count(*) over (partition by source) n,
    row_number() over (partition by source order by doc_id nulls first, hash) - 1 pos from d
), {_levels_sql("a", "leaves")}, subroots as (
  select 0 tree, tree pos, count(*) over () n, hash from a_top
), {_levels_sql("b", "subroots")}, path as (
  select leaves.r, level, s.l, s.r rr from leaves join a_s s on s.tree = leaves.tree and s.pos = leaves.pos // pow(16, level)::bigint
  union all
  select leaves.r, 100 + level, s.l, s.r from leaves join b_s s on s.pos = leaves.tree // pow(16, level)::bigint
), proof as (
  select r, sha256(string_agg(l || rr, '' order by level)) p, list(l || '|' || rr order by level) steps from path group by r
), done as (
  select doc_id, leaves.hash leaf, a_top.hash subroot, b_top.hash root, coalesce(p, sha256('')) proof_sha256,
    list_reduce(coalesce(steps, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2)), now) folded_root
  from leaves join a_top using (tree) cross join b_top left join proof using (r)
)
select *, folded_root = root verified from done
"""
