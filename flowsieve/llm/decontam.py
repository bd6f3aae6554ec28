"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so that a question asked again with other values
has the same template. Windows of eight template tokens of the documents are joined by digest with
those of the benchmark; for each alignment of a document with an item the values in the slots are
compared: each value of the item must always stand for the same value in the document, or its
windows count only where they are as in the item.
"""

from __future__ import annotations

from copy import copy
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import fresh, let, row_key
from flowsieve.llm.vectors import CHUNK, mix, tables
from flowsieve.session import materialise, ship_package

WINDOW, LEAST = 8, 4
COVERAGE = 0.5
#: Bits of the filter that spares most windows of the documents the join; its size is fixed.
FILTER_BITS = 1 << 24

# Words for numbers and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
    "tonnes lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons second seconds "
    "sec s minute minutes min hour hours hr hrs h day days week weeks month months year years kmh mph kph hz "
    "khz mhz ghz w kw mw v kv j kj cal kcal pa kpa bar k c f degree degrees percent dollar dollars cent cents "
    "euro euros usd eur gbp kb mb gb tb".split()
)
LITERAL, NUMBER, UNIT, NAME, SIGN = range(5)
#: The reading without placeholders.
PLAIN = 2
PLACEHOLDERS = mix(np.array([0, 11, 12, 13], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Keeps the windows of the three readings of a text apart.
SALTS = np.array([0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D], np.uint64)
_STEPS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
# Byte classes: 0 between tokens, 1 letters and all of other alphabets, 2 digits, 3 signs that count as units.
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[[36, 37]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGNS = str.maketrans("€£°", "$$%")
_SPACE, _POINT, _QUOTE, _STOP = (np.zeros(256, bool) for _ in range(4))
_SPACE[[32, *range(9, 14)]] = _POINT[[44, 46]] = _QUOTE[39] = _STOP[[33, 46, 58, 63]] = True
#: Bytes of documents that are worked on together, so that short texts cost little each.
GROUP = 1 << 17


def _between(kinds: np.ndarray, data: np.ndarray, signs: np.ndarray, kind: int) -> None:
    """Give the signs the class of both their neighbours, where that is ``kind``."""
    at = np.flatnonzero(signs[data[1:-1]]) + 1 if len(data) > 2 else np.empty(0, np.int64)
    kinds[at[(kinds[at - 1] == kind) & (kinds[at + 1] == kind)]] = kind


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes, and where a capital begins; Latin letters, with their accents."""
    low, capital = _LOWER[data], (data >= 65) & (data <= 90)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)]
    low[lead + 1] += 0x20
    capital[lead] = True
    return low, capital


def _chunk(data: np.ndarray, opens: bool) -> tuple[tuple[np.ndarray, ...], bool]:
    """(start, end, kind, digest, whether it opens a sentence) of the tokens; whether the next one opens one."""
    powers, inverse = tables()
    kinds = _CLASS[data]
    _between(kinds, data, _POINT, 2)
    _between(kinds, data, _QUOTE, 1)
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 3)
    edges = np.flatnonzero(edge)
    solid = kinds[edges[:-1]] != 0
    start, end = edges[:-1][solid], edges[1:][solid]
    low, capital = _lowered(data)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    digest = mix((sums[end] - sums[start]) * inverse[start])
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOP[data] & (kinds == 0), out=stops[1:])
    before = np.concatenate([[0], end[:-1]])
    first = stops[start] > stops[before] if len(start) else np.empty(0, bool)
    kind = np.choose(kinds[start], [LITERAL, LITERAL, NUMBER, SIGN]).astype(np.int8)
    second = start + 1 + (data[start] >= 0xC0)
    name = capital[start] & (second < end) & ~capital[np.minimum(second, len(data) - 1)]
    kind[name & (kind == LITERAL)] = NAME
    if len(start):
        first[0] |= opens
        opens = bool(stops[-1] > stops[end[-1]])
    else:
        opens = opens or bool(stops[-1])
    return (start, end, kind, digest, first), opens


def _tokens(data: np.ndarray) -> tuple[np.ndarray, ...]:
    parts, at, opens = [], 0, True
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        part, opens = _chunk(data[at:end], opens)
        parts.append((part[0] + at, part[1] + at, *part[2:]))
        at = end
    if not parts:
        parts = [_chunk(data, True)[0]]
    return tuple(np.concatenate(x) for x in zip(*parts))


@lru_cache(maxsize=1)
def _listed() -> tuple[np.ndarray, np.ndarray]:
    digest = lambda words: np.sort(np.array([_tokens(np.frombuffer(w.encode(), np.uint8))[3][0] for w in words]))
    return digest(NUMBER_WORDS), digest(UNITS)


def _among(digests: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, digests), len(known) - 1)] == digests


class Templates:
    """The canonical tokens of some texts: digests, kinds, and where the values are.

    A name is a word with one capital that does not open a sentence; neighbours are one name. A unit
    is a listed word after a number, or a sign before or after one. All work is on arrays of bytes.
    """

    def __init__(self, texts: list[str]):
        texts = [t.translate(_SIGNS) if any(c in t for c in "€£°") else t for t in texts]
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(raws)
        begins = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
        start, end, kind, digest, first = _tokens(np.frombuffer(self.raw, np.uint8))
        owner = np.searchsorted(begins, start, side="right") - 1
        heads = np.ones(len(kind), bool)
        heads[1:] = owner[1:] != owner[:-1]
        numbers, units = _listed()
        if len(kind):
            worded = (kind == LITERAL) | (kind == NAME)
            kind[worded & _among(digest, numbers)] = NUMBER
            unit = worded & _among(digest, units)
            kind[unit] = UNIT
            before = np.concatenate([[LITERAL], kind[:-1]])
            before[heads] = LITERAL
            after = np.concatenate([kind[1:], [LITERAL]])
            after[:-1][heads[1:]] = LITERAL
            kind[unit & (before != NUMBER)] = LITERAL
            kind[kind == SIGN] = np.where((before == NUMBER) | (after == NUMBER), UNIT, LITERAL)[kind == SIGN]
        self.start, self.end = start, end
        self._all, self._opens, self._owner, self._digest = kind, first | heads, owner, digest
        self._texts, self._salt = len(texts), SALTS[0]
        self._read(np.where((kind == NAME) & self._opens, LITERAL, kind))

    def _read(self, kind: np.ndarray) -> None:
        run = np.zeros(len(kind), bool)
        run[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
        self.at = np.flatnonzero(~run)
        self.kind, self.owner = kind[self.at], self._owner[self.at]
        self.hash = np.where(self.kind == LITERAL, self._digest[self.at], PLACEHOLDERS[self.kind])
        #: First canonical token of each text.
        self.base = np.searchsorted(self.owner, np.arange(self._texts))

    def readings(self) -> list[Templates]:
        """This one, one where capitalised words that open a sentence are names too, and one of words as they are."""
        named, plain = copy(self), copy(self)
        named._salt, plain._salt = SALTS[1:]
        named._read(self._all)
        plain._read(np.full(len(self._all), LITERAL, self._all.dtype))
        return [self, named, plain]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the windows of ``size`` tokens of one text, at least half of them literal; and their places."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total += self.hash[k : k + n] * _STEPS[k]
        sums = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        literal = 2 * (sums[size:] - sums[:-size]) >= size
        places = np.flatnonzero(literal & (self.owner[:n] == self.owner[size - 1 :]))
        return mix(total[places] ^ self._salt), places

    def slots(self, place: int, size: int) -> list[str]:
        """Values in the placeholders of a window, a run of names as one."""
        values = []
        for k in range(place, place + size):
            if self.kind[k] != LITERAL:
                last = self.at[k + 1] if k + 1 < len(self.at) else len(self.start)
                value = self.raw[self.start[self.at[k]] : self.end[last - 1]].decode("utf-8", "replace").lower()
                values.append(value.replace(",", "") if self.kind[k] == NUMBER else " ".join(value.split()))
        return values


def _item_windows(batches):
    for batch in batches:
        rows = []
        for item, text in zip(batch["item"], batch["text"]):
            for reading, made in enumerate(Templates([text]).readings()):
                size = min(WINDOW, len(made.hash))
                tokens = len(made._all)
                if size < (1 if reading == PLAIN else LEAST):
                    continue
                h, places = made.windows(size)
                rows += [
                    (item, x, reading, p, size, len(h), tokens, made.slots(p, size))
                    for x, p in zip(h.view(np.int64).tolist(), places.tolist())
                ]
        yield pd.DataFrame(rows, columns=["item", "h", "reading", "item_at", "size", "n", "tokens", "item_slots"])


def item_windows(benchmark: DataFrame, *, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """Windows of the benchmark in all readings; an item of up to seven tokens is one window.

    A template of less than four tokens has none; the words as they are have them at any length.
    """
    ship_package(benchmark.sparkSession)
    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = cut.mapInPandas(
        _item_windows, "item string, h bigint, reading int, item_at bigint, size int, n bigint, tokens bigint, item_slots array<string>"
    )
    return made.withColumn("item", F.col("item").cast(benchmark.schema[item_col].dataType))


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """A bit for every digest (its lowest bits); at most ``FILTER_BITS`` / 64 numbers reach the driver."""
    place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (
        windows.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def leading_windows(items: DataFrame, coverage: float) -> DataFrame:
    """Windows of each item of which a document must have one at least: all but the commonest.

    Of n windows a document that has the item has ``coverage`` * n; so if one window fewer than that is left out,
    it still has one of the others. Left out are those that most items have, such as the opening of a usual
    question, which would pair all of these items with all documents that have it.
    """
    common = items.groupBy("h", "size").agg(F.countDistinct("item").alias("items"))
    order = Window.partitionBy("item", "reading").orderBy("items", "h", "item_at")
    spare = F.ceil(F.col("n") * coverage) - 1
    ranked = items.join(common, ["h", "size"]).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= F.greatest(F.col("n") - spare, F.lit(1))).select("item", "reading", "h", "size").distinct()


def _grouped(batch: pd.DataFrame):
    """Slices of a batch with about ``GROUP`` characters of text."""
    first = size = 0
    for k, text in enumerate(batch["text"]):
        size += len(text)
        if size >= GROUP:
            yield batch.iloc[first : k + 1]
            first, size = k + 1, 0
    if first < len(batch):
        yield batch.iloc[first:]


def _document_windows(bits, sizes: list[int]):
    def run(batches):
        known = bits.value
        for batch in batches:
            rows = []
            for group in _grouped(batch):
                docs, keys, first = group["doc"].tolist(), group["key"].tolist(), Templates(group["text"].tolist())
                for made, size in product(first.readings(), sizes):
                    h, places = made.windows(size)
                    low = h & np.uint64(FILTER_BITS - 1)
                    word = known[(low >> np.uint64(6)).astype(np.int64)]
                    hit = np.flatnonzero((word >> (low & np.uint64(63))) & np.uint64(1))
                    for digest, place in zip(h[hit].view(np.int64).tolist(), places[hit].tolist()):
                        k = int(made.owner[place])
                        rows.append((docs[k], keys[k], digest, place - int(made.base[k]), size, made.slots(place, size)))
            yield pd.DataFrame(rows, columns=["doc", "key", "h", "doc_at", "size", "doc_slots"])

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and benchmark item that it contains, as it is or with other values.

    Columns: ``doc``, ``key`` (digest of id and text), ``item``, ``n_windows`` (windows of the item
    that were found), ``coverage`` (their share), ``exact`` (all values as in the item). A pair counts
    if windows with consistent slots make up ``coverage`` of the item's: within an alignment a value of
    the item that stands for several ones counts only in windows that are as in the item. Null and empty
    texts have no windows. Texts are read three ways (capitalised words that open a sentence as words, as
    names, and all tokens as they are but for case); the best counts, so copies of any item are found.
    ``n_tokens`` is the length of the item. Pairs are sought by the rarer windows of each item (``leading_windows``) and
    then compared in all. A text is worked on whole, its windows that are in no item are dropped at once.
    Repeated rows give one row. Ids may be null. Other columns are not read.
    """
    spark = docs.sparkSession
    items = materialise(item_windows(benchmark, item_col=item_col, text=item_text), "item-windows").distinct()
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    bits = spark.sparkContext.broadcast(_filter_bits(items))
    cut = docs.select(
        F.col(id_col).cast("string").alias("doc"),  # pandas has no whole numbers with nulls
        row_key(F.col(id_col), F.col(text)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    found = cut.mapInPandas(
        _document_windows(bits, sizes),
        "doc string, key binary, h bigint, doc_at bigint, size int, doc_slots array<string>",
    ).withColumn("doc", F.col("doc").cast(docs.schema[id_col].dataType))
    found = materialise(found, "document-windows")
    pairs = found.join(leading_windows(items, coverage), ["h", "size"]).select(
        "key", F.col("item").alias("of"), F.col("reading").alias("read")
    )
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = pairs.join(items, F.col("of").eqNullSafe(F.col("item")) & (F.col("read") == F.col("reading"))).drop("of", "read")
    found = materialise(
        found.join(wanted, ["key", "h", "size"]).select(
            "doc",
            "key",
            "item",
            "reading",
            "n",
            "tokens",
            "item_at",
            (F.col("doc_at") - F.col("item_at")).alias("shift"),
            F.arrays_zip("item_slots", "doc_slots").alias("slots"),
        ),
        "leak-windows",
    )
    align = ["doc", "key", "item", "reading", "shift"]
    aligned = (
        found.groupBy(*align)
        .agg(F.max("n").alias("n"), F.max("tokens").alias("tokens"), F.collect_set(F.struct("item_at", "slots")).alias("windows"))
    )
    same = lambda s: s["item_slots"] == s["doc_slots"]

    def repeated(was):
        return F.array_distinct(F.filter(was, lambda v, i: F.coalesce(F.get(was, i + 1) == v, F.lit(False))))

    def fitting(torn):
        clear = lambda s: ~F.array_contains(torn, s["item_slots"])
        kept = F.filter("windows", lambda w: F.forall(w["slots"], same) | F.forall(w["slots"], clear))
        return F.transform(kept, lambda w: w["item_at"])

    pairs = F.sort_array(F.array_distinct(F.flatten("windows.slots")))
    torn = let(F.transform(pairs, lambda s: s["item_slots"]), repeated)
    return (
        aligned.select(
            *align,
            "n",
            "tokens",
            let(torn, fitting).alias("places"),
            F.forall("windows", lambda w: F.forall(w["slots"], same)).alias("same"),
        )
        .groupBy("doc", "key", "item", "reading")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_windows"),
            F.max("n").alias("n"),
            F.max("tokens").alias("tokens"),
            F.bool_and("same").alias("exact"),
        )
        .withColumn("coverage", F.col("n_windows") / F.col("n"))
        .where(F.col("coverage") >= coverage)
        .groupBy("doc", "key", "item")
        .agg(
            F.max_by("n_windows", F.struct("coverage", "n_windows")).alias("n_windows"),
            F.bool_or(F.col("exact") & ((F.col("reading") != PLAIN) | (F.col("coverage") == 1))).alias("exact"),
            F.max("coverage").alias("coverage"),
            F.max("tokens").alias("n_tokens"),
        )
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = LEAST, **kw
) -> DataFrame:
    """``docs`` without those that contain a benchmark item of ``least`` tokens or more; columns and their order stay.

    Shorter items, such as a single word, stand in many documents by chance: ``leaks`` lists them, and nothing goes
    for them alone. ``least=1`` lets all items count.
    """
    (key,) = fresh(docs, "_key")
    found = leaks(docs, benchmark, id_col=id_col, text=text, **kw).where(F.col("n_tokens") >= least)
    bad = found.select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text)))
    return keyed.join(bad, key, "left_anti").drop(key)
