"""Substring dedup: passages that an earlier document has, found with suffix automata.

A window is a run of fifty words. Its anchor is the least digest of the eight-word runs in it, which
only its words decide, so equal windows have equal anchors and a text is a sequence of passages: runs of
windows of one anchor. All passages of an anchor are a shard. Its different texts are streamed, earliest
document first, past the suffix automaton of those before: the matching statistics tell which windows came
before, and first in which document. Words covered by such windows are removed as maximal spans.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import fresh, text_of, words
from flowsieve.llm.vectors import CHUNK, mix, tables, word_hashes
from flowsieve.session import broadcast_if_small, materialise, ship_package

WINDOW, GRAM = 50, 8
#: Passages are cut after so many windows; ordinary ones end before, as another digest is least.
LONGEST = WINDOW - GRAM + 1
#: With more texts than this an anchor's windows are compared one by one, spread over all tasks.
SHARD = 1024
#: Windows of a long text that are worked on together.
SEGMENT = 1 << 17
_STEPS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WINDOW + LONGEST)], np.uint64)
_SALT = np.uint64(0x2545F4914F6CDD1D)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _sums(hashes: np.ndarray, start: np.ndarray, length: np.ndarray | int, steps: np.ndarray) -> np.ndarray:
    """Digests of the runs of words that begin at ``start``."""
    total = np.zeros(len(start), np.uint64) + np.asarray(length, np.uint64)
    if isinstance(length, int):
        for k in range(length):
            total += hashes[start + k] * steps[k]
        return mix(total)
    order = np.argsort(-length, kind="stable")
    start, length, part = start[order], length[order], total[order]
    ends = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
    for k, n in enumerate(ends.tolist()):
        part[:n] += hashes[start[:n] + k] * steps[k]
    total[order] = mix(part)
    return total


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The least digest of the eight-word runs in every window."""
    n = len(hashes) - GRAM + 1
    least = np.zeros(n, np.uint64)
    for k in range(GRAM):
        least += hashes[k : k + n] * _STEPS[k]
    least = mix(least)
    size = 1
    while 2 * size <= LONGEST:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = LONGEST - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _group_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word digests of short texts, and the number of the text of each."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    turns = np.flatnonzero(np.diff(solid))
    start, end = turns[0::2], turns[1::2]
    powers, inverse = tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    stops = np.cumsum([len(t) + 1 for t in texts])
    return mix((sums[end] - sums[start]) * inverse[start]), np.searchsorted(stops, start, side="right")


def _hashed(texts: list[str]):
    """(word digests, number of the text of each, number of the first text), of short texts together."""
    group: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if group and size + len(raw) + 1 > CHUNK:
            yield *_group_words(group), first
            group, size = [], 0
        if len(raw) + 1 > CHUNK:
            hashes = word_hashes(text)
            yield hashes, np.zeros(len(hashes), np.int64), k
            continue
        if not group:
            first = k
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield *_group_words(group), first


def passages(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(number of the text, first word, windows, anchor, digest) of all passages of ``texts``."""
    found: list[tuple[np.ndarray, ...]] = []
    for all_hashes, all_owners, shift in _hashed(texts):
        firsts = np.searchsorted(all_owners, np.arange(int(all_owners.max(initial=-1)) + 1))
        for low in range(0, max(len(all_hashes) - WINDOW + 1, 0), SEGMENT):
            hashes, owner = (x[low : low + SEGMENT + WINDOW - 1] for x in (all_hashes, all_owners))
            least = anchors(hashes)
            n = len(least)
            whole = owner[:n] == owner[WINDOW - 1 :]
            turn = np.ones(n, bool)
            turn[1:] = (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1]) | (whole[1:] != whole[:-1])
            starts = np.flatnonzero(turn)
            turn |= (np.arange(n) - np.repeat(starts, np.diff(starts, append=n))) % LONGEST == 0
            starts = np.flatnonzero(turn)
            count = np.diff(starts, append=n)
            kept = whole[starts]
            starts, count = starts[kept], count[kept]
            mine = owner[starts]
            place = starts + low - firsts[mine]
            found.append((mine + shift, place, count, least[starts], _sums(hashes, starts, count + WINDOW - 1, _STEPS)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(map(np.concatenate, zip(*found)))


class Automaton:
    """Suffix automaton of texts that are added one after the other; states know the first text they are in."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, length: int, first: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for those strings of ``q`` that are at most one word longer than ``p``'s."""
        copy = self._state(self.length[p] + 1, self.first[q])
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, text: list[int], number: int) -> None:
        last = 0
        for word in text:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, number), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def windows(self, text: list[int], size: int) -> list[int]:
        """The first text that has each window of ``size`` words of ``text``, -1 if none has."""
        found, state, length = [], 0, 0
        for k, word in enumerate(text):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= size:  # a longer match is not needed
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                length = size
            if k >= size - 1:
                found.append(self.first[state] if length == size else -1)
        return found


def _shard(batches):
    """Rows of a shard together, from batches sorted by anchor and document."""
    shard, key = [], None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "name", "body")]):
            if row[0] != key:
                if shard:
                    yield shard
                shard, key = [], row[0]
            if not shard or shard[-1][1] != row[1]:  # rows of equal id and text give the same twice
                shard.append(row)
    if shard:
        yield shard


def _stream(batches):
    """For every text of a shard, its windows in runs that were first in one document."""
    rows = []
    for shard in _shard(batches):
        known = Automaton()
        for k, (anchor, digest, n, doc, body) in enumerate(shard):
            text = np.frombuffer(body, np.uint64).tolist()
            first = known.windows(text, WINDOW) if k else [-1] * n
            start = 0
            for i in range(1, n + 1):
                if i == n or first[i] != first[start]:
                    rows.append((anchor, digest, start, i - start, shard[first[start]][3] if first[start] >= 0 else doc))
                    start = i
            if k + 1 < len(shard):
                known.add(text, k)
        if len(rows) >= 8192:
            yield rows
            rows = []
    if rows:
        yield rows


def _before(a: Column, b: Column) -> Column:
    """Whether document ``a`` comes before ``b``; those without id are last, and none before another."""
    return F.coalesce(a < b, a.isNotNull() & b.isNull())


def _row(docs: DataFrame, id_col: str, text: str) -> Column:
    """Tells apart documents of one id."""
    return F.xxhash64(F.lit(7), F.col(id_col), F.col(text), F.col(text).isNull())


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``row`` (a digest of the text) and ``starts``, ``ends`` of the words an earlier document has.

    Spans may overlap. A passage is a row of some fifty bytes, its words are fetched only where a shard has
    different texts, once for each; equal texts are one throughout. Shards of more than ``SHARD`` texts are
    not brought together: the windows of these texts are counted one by one, so that no anchor, however
    common, is one task's work.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("doc"), _row(docs, id_col, text).alias("row"), text_of(text).alias("text"))

    def find(batches):
        for batch in batches:
            owner, at, n, anchor, digest = passages(batch.column("text").to_pylist())
            taken = [batch.column(c).take(pa.array(owner)) for c in ("doc", "row")]
            numbers = [pa.array(x.view(np.int64)) for x in (at, n, anchor, digest)]
            yield pa.RecordBatch.from_arrays([*taken, *numbers], names=["doc", "row", "at", "n", "anchor", "digest"])

    schema = f"doc {id_type}, row bigint, at bigint, n bigint, anchor bigint, digest bigint"
    placed = materialise(cut.mapInArrow(find, schema), "passages")
    who = F.struct(F.col("doc").isNull().alias("none"), "doc")
    texts = placed.groupBy("anchor", "digest").agg(
        F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "at", "n")).alias("first"), F.max(who).alias("last")
    )
    texts = materialise(texts, "texts")
    shared = materialise(
        texts.groupBy("anchor")
        .agg(
            F.min(F.struct("first.none", "first.doc")).alias("first"),
            F.max("last").alias("last"),
            F.count(F.lit(1)).alias("texts"),
        )
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("anchor", "texts"),
        "shards",
    )
    texts = texts.join(broadcast_if_small(shared), "anchor").select(
        "anchor", "digest", "first.doc", "first.row", "first.at", "first.n", F.col("last.doc").alias("last"), "texts"
    )
    texts = materialise(texts, "shared")
    alone = texts.where("texts = 1").select("anchor", "digest", F.lit(0).cast("bigint").alias("off"), "n", F.col("doc").alias("least"))
    bodies = materialise(_fetch(cut, texts.where("texts > 1"), id_type), "bodies")

    def match(batches):
        types = [pa.int64()] * 4 + [pa.string()]
        for rows in _stream(batches):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "digest", "off", "n", "least"])

    small = bodies.where(F.col("texts") <= SHARD).withColumn("name", F.col("doc").cast("string"))
    small = small.repartition("anchor").sortWithinPartitions("anchor", F.col("doc").isNull(), "doc", "digest")
    streamed = small.select("anchor", "digest", "n", "name", "body").mapInArrow(
        match, "anchor bigint, digest bigint, off bigint, n bigint, least string"
    )
    streamed = streamed.withColumn("least", F.col("least").cast(id_type))
    known = alone.unionByName(streamed).unionByName(_one_by_one(bodies.where(F.col("texts") > SHARD), id_type))
    # What no member of a text comes after removes nothing.
    lasts = texts.select("anchor", "digest", "last")
    known = known.join(lasts, ["anchor", "digest"]).where(_before(F.col("least"), F.col("last"))).drop("last")
    known = materialise(known.withColumnRenamed("n", "count"), "known")
    hits = placed.select("doc", "row", "at", "anchor", "digest").join(broadcast_if_small(known), ["anchor", "digest"])
    hits = hits.where(_before(F.col("least"), F.col("doc")))
    start = F.col("at") + F.col("off")
    spans = hits.groupBy("doc", "row").agg(
        F.collect_list(F.struct(start.alias("start"), (start + F.col("count") + WINDOW - 1).alias("end"))).alias("spans")
    )
    return spans.select("doc", "row", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def _fetch(cut: DataFrame, texts: DataFrame, id_type: str) -> DataFrame:
    """The word digests of ``texts``, taken from the first document of each."""
    wanted = texts.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "digest", "at", "n", "texts")).alias("wanted"))
    wanted = materialise(wanted, "wanted").select(F.col("doc").alias("of"), F.col("row").alias("of_row"), "wanted")
    joined = cut.join(wanted, F.col("doc").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")))

    def run(batches):
        for batch in batches:
            rows, owner = [], []
            for k, (text, each) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                hashes = word_hashes(text)
                for w in each:
                    body = hashes[w["at"] : w["at"] + w["n"] + WINDOW - 1].tobytes()
                    rows.append((w["anchor"], w["digest"], w["n"], w["texts"], body))
                    owner.append(k)
            types = [pa.int64()] * 4 + [pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            doc = batch.column("doc").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, doc], names=["anchor", "digest", "n", "texts", "body", "doc"])

    schema = f"anchor bigint, digest bigint, n bigint, texts bigint, body binary, doc {id_type}"
    # Rows of equal id and text are fetched from alike; what they repeat is passed over later.
    return joined.select("doc", "text", "wanted").mapInArrow(run, schema)


def _one_by_one(bodies: DataFrame, id_type: str) -> DataFrame:
    """What ``_stream`` gives, for shards of any number of texts: the first document of each window."""

    def run(batches):
        for batch in batches:
            parts = []
            for k, body in enumerate(batch.column("body").to_pylist()):
                hashes = np.frombuffer(body, np.uint64)
                at = np.arange(len(hashes) - WINDOW + 1)
                two = [_sums(hashes, at, WINDOW, s) for s in (_STEPS, _STEPS * _SALT)]
                parts.append((np.full(len(at), k), at, *[x.view(np.int64) for x in two]))
            owner, at, low, high = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
            taken = [batch.column(c).take(pa.array(owner)) for c in ("anchor", "digest", "doc")]
            yield pa.RecordBatch.from_arrays([*taken, *map(pa.array, (at, low, high))], names=["anchor", "digest", "doc", "off", "low", "high"])

    schema = f"anchor bigint, digest bigint, doc {id_type}, off bigint, low bigint, high bigint"
    each = bodies.select("anchor", "digest", "doc", "body").mapInArrow(run, schema)
    each = materialise(each, "windows")
    first = each.groupBy("low", "high").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc")).alias("first"))
    one = F.lit(1).cast("bigint").alias("n")
    return each.join(first, ["low", "high"]).select("anchor", "digest", "off", one, F.col("first.doc").alias("least"))


def _pieces(data: bytes):
    """Parts of some 256 KB that end where a word does."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK) if at + CHUNK < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def without(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[str, int]:
    """The words of ``text`` that no span covers, joined by blanks, and how many are covered."""
    depth = np.zeros(int(ends.max()) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    covered = np.cumsum(depth) > 0
    kept, at = [], 0
    for piece in _pieces(text.encode("utf-8", "surrogatepass")):
        found = piece.split()  # at the same six signs
        here = covered[at : at + len(found)]
        kept += [w for w, c in zip(found, here) if not c] + found[len(here) :]
        at += len(found)
    return b" ".join(kept).decode("utf-8", "surrogatepass"), int(covered.sum())


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words left over as ``text``, joined by one blank, and ``n_words``, ``n_removed`` (replacing
    namesakes).

    A word goes if a window of fifty words that covers it also starts in a document of smaller id. Windows are
    those of the input. Documents of equal id take nothing from each other; those without id come last and
    take nothing from each other. Null texts stay null and have no words, like empty ones; texts of fewer than
    fifty words keep all. An empty table stays empty. A text is held whole by a task, its windows in segments.
    """
    ship_package(docs.sparkSession)
    spans = materialise(repeated_spans(docs, id_col=id_col, text=text), "spans")
    of, row, starts, ends, mine, done = fresh(docs, "_of", "_row", "_starts", "_ends", "_mine", "_done")
    spans = spans.toDF(of, row, starts, ends)
    df = docs.withColumn(mine, _row(docs, id_col, text))
    df = df.join(broadcast_if_small_spans(spans), F.col(id_col).eqNullSafe(F.col(of)) & (F.col(mine) == F.col(row)), "left")

    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        made = [without(t, s, e) if t is not None else (None, 0) for t, s, e in zip(texts, starts, ends)]
        return pd.DataFrame(made, columns=["text", "n"])

    cleaned = F.pandas_udf(cut, "text string, n bigint")(F.when(F.col(starts).isNotNull(), F.col(text)), F.col(starts), F.col(ends))
    df = df.withColumn(done, cleaned)
    split = words(F.col(text))
    own = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", text.lower())]
    return df.select(
        *own,
        F.coalesce(F.col(done)["text"], F.array_join(split, " ")).alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("bigint").alias("n_words"),
        F.coalesce(F.col(done)["n"], F.lit(0).cast("bigint")).alias("n_removed"),
    )


def broadcast_if_small_spans(spans: DataFrame) -> DataFrame:
    """Spans hold arrays, which are measured by their elements."""
    size = spans.agg(F.coalesce(F.sum(32 + 16 * F.size(spans.columns[2])), F.lit(0))).first()[0]
    return F.broadcast(spans) if size <= 32 << 20 else spans


#: The whole operator in SQL.
SQL = r"""
with d as (
  select row_number() over () r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents
), windows as (
  select r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from (select *, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)
), firsts as (
  select *, min(doc_id) over (partition by h) least from windows
), gone as (
  select distinct r, unnest(range(i, i + 50)) k from firsts where least < doc_id or (doc_id is null and least is not null)
), kept as (
  select x.r, count(gone.k) n_removed, string_agg(x.word, ' ' order by x.k) filter (gone.k is null) t
  from (select r, unnest(w) word, generate_subscripts(w, 1) k from d) x left join gone on gone.r = x.r and gone.k = x.k group by x.r
)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (r)
"""
