"""Secret scans with ownership counted over the whole corpus.

Each text is scanned for assignments, access keys, long hexadecimal runs and other key-like tokens. The
values, as digests, are counted over the corpus by distinct repositories and owners: what many of them
have is a copied example, what few have and looks random is marked as owned, likely live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import let, text_of
from flowsieve.session import materialise

# What is looked for. A run of hexadecimal digits or of capitals and digits is taken
# whole either way, so the least length may stand in the pattern; that of an assigned value may not.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Other key-like tokens: runs of base64 signs with capitals, small letters and digits, or of the signs of
# identifiers with letters and digits.
KEYLIKE = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9_-])"
    r"|(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}={0,2}"
)
KINDS = ["assign", "access", "hex", "owned"]
#: Pattern, group of the value and its least length, by kind; the last are tokens that no base span touches.
LOOKED_FOR = [(ASSIGN, 2, 6), (ACCESS, 0, 20), (HEX, 0, 24), (KEYLIKE, 0, 20)]
#: From so many owners on, or so many repositories of more than one owner, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 8
#: A live-looking value has so many characters, so many of them different.
LIVE_LENGTH, LIVE_SIGNS = 16, 8

OWNED = "array<struct<start:bigint,k:int,end:bigint,n_repos:bigint,n_owners:bigint>>"
FOUND = "array<struct<k:int,i:int,before:int,len:int,own:int,h:binary,live:boolean>>"


def _found(text: Column, k: int) -> Column:
    """The matches of kind ``k`` in order: signs before each, its length and its value's, digest, liveness.

    Matches and the pieces between them come from scans with one pattern; nothing is added up here.
    """
    pattern, group, _ = LOOKED_FOR[k]
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("between"),
    )

    def match(c: Column, i: Column) -> Column:
        value = F.get(c["value"], i)
        return F.struct(
            F.lit(k).alias("k"),
            i.alias("i"),
            F.length(F.get(c["between"], i)).alias("before"),
            F.length(F.get(c["whole"], i)).alias("len"),
            F.length(value).alias("own"),
            F.unhex(F.md5(value)).alias("h"),
            _looks_live(value).alias("live"),
        )

    every = let(cut, lambda c: F.transform(F.sequence(F.lit(0), F.size(c["whole"]) - 1), lambda i: match(c, i)))
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(FOUND))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind; spans are (start, kind's number, end)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])
    )
    return F.array_join(parts, ",")


def _looks_live(value: Column) -> Column:
    signs = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_LENGTH) & (signs >= LIVE_SIGNS)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: list[str]) -> DataFrame:
    """A row per document: ``id``, ``owner``, ``repo`` and the matches ``found`` of all kinds."""
    key = lambda *cs: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cs])
    df = docs.select(
        F.col(id_col).alias("id"), key(owner).alias("owner"), key(owner, *repo).alias("repo"), text_of(text).alias("text")
    )
    found = F.concat(*[_found(F.col("text"), k) for k in range(len(LOOKED_FOR))])
    return df.select("id", "owner", "repo", found.alias("found"))


def place_spans(scanned: DataFrame) -> DataFrame:
    """A row per span: ``place`` of its row, ``k``, ``start``, ``end``, ``from`` (of the value), ``h``, ``live``,
    with ``owner`` and ``repo``.

    Lengths are added up over the matches of a text and kind. A key-like token is let go if a base span that
    begins no later ends in it or beyond, or one begins in it: a running greatest end from the front, a running
    least start from the back. All of it sorts rows and takes time in proportion to the matches.
    """
    each = scanned.select("place", "owner", "repo", F.explode("found").alias("m")).select("place", "owner", "repo", "m.*")
    each = each.repartition("place")
    order = Window.partitionBy("place", "k").orderBy("i")
    upto = F.sum((F.col("before") + F.col("len")).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    least = F.get(F.array(*[F.lit(n) for *_, n in LOOKED_FOR]), F.col("k"))
    spans = each.withColumn("end", upto).where(F.col("own") >= least)
    spans = spans.select(
        "place", "owner", "repo", "k", (F.col("end") - F.col("len")).alias("start"), "end", (F.col("end") - F.col("own")).alias("from"), "h", "live"
    )
    base = F.col("k") < KINDS.index("owned")
    front = Window.partitionBy("place").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("place").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("reach", F.max(F.when(base, F.col("end"))).over(front))
    spans = spans.withColumn("ahead", F.min(F.when(base, F.col("start"))).over(back))
    touched = (F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce(F.col("ahead") < F.col("end"), F.lit(False)))
    return spans.where(base | ~touched).drop("reach", "ahead")


def ownership(spans: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``h``, ``n_repos``, ``n_owners`` and ``example`` for every value; combined before each shuffle."""
    seen = spans.groupBy("h", "repo", "owner").count()
    many = (F.col("n_repos") >= example_repos) & (F.col("n_owners") > 1)
    return (
        seen.groupBy("h")
        .agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
        .withColumn("example", (F.col("n_owners") >= example_owners) | many)
    )


def find_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repo: tuple[str, ...] = (),
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """One row per row of ``docs``: id, base counts and digest, ``spans``, ``n_owned``, ``n_example``, ``owned``.

    A repository is an owner with the ``repo`` columns; null owners are one owner of their own. Added
    to the base spans is an ``owned`` span for every value, of base spans or other key-like tokens, that looks
    live and is no example: fewer than ``example_owners`` owners have it, and one only or fewer than
    ``example_repos`` repositories. ``owned`` lists these as start:end:repositories:owners. Null and empty texts
    have no spans. Repeated rows give equal rows, and copies by one owner do not make a value an example. Long
    texts are held whole by the scan; their matches are rows from then on, so that time grows with their number.
    """
    scanned = materialise(
        scan(docs, id_col=id_col, text=text, owner=owner, repo=list(repo)).withColumn(
            "place", F.monotonically_increasing_id()
        ),
        "secrets",
    )
    spans = materialise(place_spans(scanned.where(F.size("found") > 0)), "spans")
    # Base spans of two kinds may have one value in one place.
    values = spans.groupBy("place", "h", F.col("from").alias("start"), "end").agg(F.first("live").alias("live"))
    judged = values.join(ownership(spans, example_owners, example_repos), "h")
    owned = F.col("live") & ~F.col("example")
    judged = judged.groupBy("place").agg(
        F.collect_list(F.when(owned, F.struct("start", F.lit(3).alias("k"), "end", "n_repos", "n_owners"))).alias("owned"),
        F.count_if("example").alias("n_example"),
    )
    kinds = range(len(KINDS) - 1)
    base = spans.groupBy("place").agg(
        F.collect_list(F.when(F.col("k") < len(kinds), F.struct("start", "k", "end"))).alias("base"),
        *[F.count_if(F.col("k") == k).alias(f"n_{KINDS[k]}") for k in kinds],
    )
    both = scanned.select("place", "id").join(base.join(judged, "place"), "place", "left")
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    base, mine = F.coalesce("base", none), F.sort_array(F.coalesce("owned", F.array().cast(OWNED)))
    places = F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    counts = F.transform(mine, lambda s: F.concat_ws(":", s["start"], s["end"], s["n_repos"], s["n_owners"]))
    return both.select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{KINDS[k]}", F.lit(0).cast("bigint")).alias(f"n_{KINDS[k]}") for k in kinds],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, places)).alias("spans"),
        F.size(mine).cast("bigint").alias("n_owned"),
        F.coalesce("n_example", F.lit(0).cast("bigint")).alias("n_example"),
        F.array_join(counts, ",").alias("owned"),
    )
