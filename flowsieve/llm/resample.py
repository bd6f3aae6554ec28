"""Importance resampling towards a target: hashed n-gram gains, one perturbed score per document.

Texts are worked on in pieces of bounded size. In each, the runs of words are interned in an
open-addressed table of NumPy arrays: keyed by xxhash64, verified byte by byte, with a slot for the
bucket and one for the count. Counts go to the corpus totals by slot; when documents are weighed, the
slot of each occurrence gathers its gain.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from flowsieve.llm.common import text_of
from flowsieve.operators.rows import sorted_row_id
from flowsieve.session import materialise, ship_package

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of text that are interned together; longer texts are cut between words.
PIECE = 1 << 19
# What a word is made of: digits, letters, and all that is not ASCII; capitals become small ones.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Interned:
    """Open-addressed table of the byte runs ``data[start:end]``, filled in one go.

    ``slot`` is the place of each run; a place holds ``key``, ``first`` (the run that came first to it),
    ``count`` and, once asked for, ``bucket``.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray | None = None):
        raw = data.tobytes()
        if key is None:
            cuts = zip(start.tolist(), end.tolist())
            key = np.fromiter((xxh64_intdigest(raw[a:b]) for a, b in cuts), np.uint64, len(start))
        size = 1 << max(4, (2 * len(start)).bit_length())
        self.raw, self.start, self.end = raw, start, end
        self.key = np.zeros(size, np.uint64)
        self.first = np.full(size, -1, np.int64)
        self.slot = np.full(len(start), -1, np.int64)
        left = np.arange(len(start))
        at = (key & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            here = at[left]
            free = self.first[here] < 0
            if free.any():  # the first run in order takes the place
                comers = left[free][::-1]
                self.first[at[comers]] = comers
                taken = self.first[here]
                self.key[here[free]] = key[taken[free]]
            mine = self.key[here] == key[left]
            mine[mine] = _equal(data, start, end, left[mine], self.first[here[mine]])
            self.slot[left[mine]] = here[mine]
            left = left[~mine]
            at[left] = (at[left] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)

    def bucket(self, buckets: int) -> np.ndarray:
        """The bucket of every place in use, 0 elsewhere."""
        found = np.zeros(len(self.first), np.int64)
        for place in np.flatnonzero(self.first >= 0).tolist():
            k = self.first[place]
            found[place] = zlib.crc32(self.raw[self.start[k] : self.end[k]]) % buckets
        return found


def _equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether runs ``a`` and ``b`` have the same bytes, pair by pair."""
    size = end[a] - start[a]
    same = size == end[b] - start[b]
    todo = np.flatnonzero(same & (a != b) & (size > 0))
    if not len(todo):
        return same
    size = size[todo]
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(first, size)
    equal = data[np.repeat(start[a[todo]], size) + step] == data[np.repeat(start[b[todo]], size) + step]
    same[todo] = np.logical_and.reduceat(equal, first)
    return same


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = _SOLID[data]
    turns = np.flatnonzero(np.diff(solid))
    return turns[0::2], turns[1::2]


def _pieces(texts: list[str], longest: int):
    """(bytes, first byte and end of each word, its text's number, words that only lead up to the piece).

    Short texts go together. A text longer than a piece is cut after a word, and the next piece begins with
    the last ``longest`` - 1 words again, so that no run is lost or counted twice.
    """
    group: list[bytes] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if size and size + len(raw) > PIECE:
            yield _piece(group, owners)
            group, owners, size = [], [], 0
        if len(raw) <= PIECE:
            group.append(raw)
            owners.append(k)
            size += len(raw) + 1
            continue
        data = np.frombuffer(raw, np.uint8)
        start, end = _words(data)
        at = 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, side="right")))
            lead = min(at, longest - 1)
            low, high = int(start[at - lead]), int(end[stop - 1])
            span = slice(at - lead, stop)
            yield _LOWER[data[low:high]], start[span] - low, end[span] - low, np.full(stop - at + lead, k), lead
            at = stop
    if group:
        yield _piece(group, owners)


def _piece(group: list[bytes], owners: list[int]):
    raw = b" ".join(group)
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    start, end = _words(data)
    stops = np.cumsum([len(g) + 1 for g in group])
    return data, start, end, np.array(owners)[np.searchsorted(stops, start, side="right")], 0


def _runs(texts: list[str], longest: int):
    """For each piece and length: (table of its runs, the text of each)."""
    for data, start, end, owner, lead in _pieces(texts, longest):
        joined, at, stop = data, start, end
        if longest > 1:  # words with one blank between them
            size = end - start + 1
            stop = np.cumsum(size) - 1
            at = stop - size + 1
            joined = np.full(int(size.sum()), 32, np.uint8)
            step = np.arange(int(size.sum())) - np.repeat(at, size)
            word = step < np.repeat(size - 1, size)
            joined[word] = data[(np.repeat(start, size) + step)[word]]
        for n in range(1, longest + 1):
            first = max(lead - n + 1, 0)  # runs that end in the lead are the last piece's
            count = len(at) - n + 1
            if count <= first:
                continue
            kept = np.flatnonzero(owner[first:count] == owner[first + n - 1 :][: count - first]) + first
            yield Interned(joined, at[kept], stop[kept + n - 1]), owner[kept]


def count_features(texts: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """Occurrences of all runs of words by bucket; the driver gets a number a bucket, as do the tasks' results."""
    ship_package(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for table, _ in _runs(batch.column("text").to_pylist(), longest):
                used = table.first >= 0
                np.add.at(total, table.bucket(buckets)[used], table.count[used])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    counted = texts.select(text_of(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    sums = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return total


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to raw, rounded down."""
    size, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    ratios = zip(raw.tolist(), target.tolist())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_raw + size) / ((s + 1) * (all_target + size))))
            for s, t in ratios
        ],
        np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, *, id_col: str, text: str, longest: int) -> DataFrame:
    """``id`` (as text), ``n_words``, ``n_features`` and ``weight``, the sum of the gains of all runs."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for table, owner in _runs(texts, longest):
                n = np.bincount(owner, minlength=len(texts))
                features += n
                np.add.at(weight, owner, gain[table.bucket(len(gain))][table.slot])
            if longest == 1:
                words = features
            else:
                for table, owner in _runs(texts, 1):
                    words += np.bincount(owner, minlength=len(texts))
            made = [batch.column("id"), *map(pa.array, (words, features, weight))]
            yield pa.RecordBatch.from_arrays(made, names=["id", "n_words", "n_features", "weight"])

    cut = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text).alias("text"))
    return cut.mapInArrow(run, "id string, n_words bigint, n_features bigint, weight bigint")


def perturbation(id_text: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that seed and id decide."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))).cast("binary"), 256), 1, 8)
    unit = (F.conv(head, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per row: ``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    Features are all runs of up to ``longest`` words in lower case (of A-Z). Of the rows with at least
    ``least_words`` words the ``percent`` of highest score are drawn, ties by smaller id (null last), then by
    features and weight; what is equal in all of them is drawn in any order. Null and empty texts have no
    features, weight 0, and are not drawn; a null id is perturbed as an empty one. Empty tables on either
    side count nothing. Texts of any length go through in pieces.

    Texts are read twice and never shuffled. The driver and the tasks hold one number a bucket. The narrow
    scores are ranked by one range sort, so no task gets them all.
    """
    raw = count_features(docs, text, buckets, longest)
    gains = gains_of(raw, count_features(target, target_text, buckets, longest))
    scored = weigh(docs, gains, id_col=id_col, text=text, longest=longest)
    scored = materialise(
        scored.select(
            F.col("id").cast(docs.schema[id_col].dataType).alias("id"),
            "n_words",
            "n_features",
            "weight",
            (F.col("weight") + perturbation(F.col("id"), seed)).alias("score"),
        ),
        "scores",
    )
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = able.select(
        F.struct(
            (-F.col("score")).alias("down"), F.col("id").isNull().alias("last"), "id", "n_features", "weight"
        ).alias("place"),
        "id",
        "n_features",
        "weight",
        "score",
    )
    ranked = sorted_row_id(order, ["place"], into="at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    both = ranked.withColumn("rank", rank).select("id", "n_features", "weight", "score", "rank").unionByName(
        rest.select("id", "n_features", "weight", "score", "rank")
    )
    return both.withColumnRenamed("id", id_col)


def _sql() -> str:
    from flowsieve.llm.merkle import LOWER, UPPER, _crc32_sql

    def words(table: str) -> str:
        cut = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
        return f"select row_number() over () r, * exclude (text), {cut} w from {table}"

    return f"""
with d as ({words("documents")}), q as ({words("benchmark")}),
f as (select r, unnest(w) f from d), g as (select unnest(w) f from q),
b as (select f, {_crc32_sql("encode(f)")} % {BUCKETS} b from (select f from f union select f from g)),
s as (select b, count(*) s from f join b using (f) group by b), t as (select b, count(*) t from g join b using (f) group by b),
total as (select (select count(*) from f) s, (select count(*) from g) t),
gain as (
  select b.b, floor(1000 * ln((coalesce(any_value(t.t), 0) + 1)::double * ((select s from total) + {BUCKETS})
    / ((coalesce(any_value(s.s), 0) + 1)::double * ((select t from total) + {BUCKETS}))))::bigint gain
  from (select distinct b from b) b left join s using (b) left join t using (b) group by b.b
), weight as (
  select r, sum(gain)::bigint weight from f join b using (f) join gain using (b) group by r
), scored as (
  select doc_id, len(w)::bigint n_features, coalesce(weight, 0) weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h
  from d left join weight using (r)
), full_score as (
  select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score from scored
), ranked as (
  select *, case when n_features >= {LEAST_WORDS} then
    row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls last, n_features, weight) end k,
    count(*) filter (n_features >= {LEAST_WORDS}) over () n
  from full_score
)
select doc_id, n_features, weight, score, case when k <= {PERCENT} * n // 100 then k end "rank" from ranked
"""


#: The whole operator in SQL, for runs of one word.
SQL = _sql()
