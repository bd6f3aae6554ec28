"""WARC archives: write one transaction of three records per page, read them back, assemble captures.

A transaction is a request, a response (or a revisit, where an equal payload is archived elsewhere)
and a metadata record; request and metadata name the response in WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import fresh, located
from flowsieve.session import checkpoint_root, materialise, ship_package

NEWLINE = "\r\n"
GZIP = b"\x1f\x8b"
#: Payload bytes of an archive file, as reading holds a file in memory.
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1, from the hexadecimal one: five digits make four signs."""
    hexed = F.sha1(payload)
    signs = []
    for k in range(8):
        five = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            signs.append(F.substring(F.lit(BASE32), F.shiftright(five, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*signs)


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, fields: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """Header and block; a field that is null is left out. The sink adds the two line ends after it."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"),
        *[F.concat(F.lit(f"{name}: "), value) for name, value in fields],
        F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(NEWLINE, *lines), F.lit(NEWLINE * 2), block)


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 0,
) -> None:
    """Write all ``pages`` as WARC files below ``path``.

    Of pages with equal payloads of at least ``least`` bytes that with the largest id is the response
    (null is smallest; of equal ids one), the others revisit it. Null payloads are empty,
    null urls and ids are left out of the records; line ends in urls are escaped. Pages are dealt to
    files by a digest of their place in the table, so no payload or host fills one file. They are read twice,
    and known by that place both times, however the reading is split. Other columns are not read. A page is held
    whole, with its file when it is read back.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    (place,) = fresh(pages, "place")
    numbered = located(pages, place).select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"),
        body.alias("body"),
        F.col(place).alias("place"),
    )
    narrow = materialise(
        numbered.select("id", "place", payload_digest(F.col("body")).alias("digest"), F.octet_length("body").alias("size")),
        "payloads",
    )
    total = narrow.agg(F.sum("size")).first()[0] or 0
    top = narrow.groupBy("digest").agg(F.max(F.struct("id", "place")).alias("top"))
    roles = narrow.join(top, "digest").select(
        "place", "digest", F.when((F.col("size") >= least) & (F.col("place") != F.col("top.place")), F.col("top")).alias("top")
    )
    dealt = numbered.repartition(int(total // FILE_BYTES) + 1, "place").join(roles, "place")
    main, revisit = _record_id("response", F.hex("place"), F.col("id")), F.col("top").isNotNull()
    target = ("WARC-Target-URI", F.col("url"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "),
        F.octet_length("body").cast("string"),
        F.lit(NEWLINE * 2),
    )
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        main,
        [
            target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, _record_id("response", F.hex("top.place"), F.col("top.id")))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
        ],
        "application/http; msgtype=response",
        F.when(revisit, http).otherwise(F.concat(http, F.col("body"))),
    )
    request = _record(
        F.lit("request"),
        _record_id("request", F.hex("place"), F.col("id")),
        [target, ("WARC-Concurrent-To", main)],
        "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(f" HTTP/1.1{NEWLINE * 2}")),
    )
    metadata = _record(
        F.lit("metadata"),
        _record_id("metadata", F.hex("place"), F.col("id")),
        [target, ("WARC-Concurrent-To", main)],
        "application/warc-fields",
        F.coalesce(F.concat(F.lit("page_id: "), F.col("id").cast("string"), F.lit(NEWLINE)), F.lit("")),
    )
    dealt.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option(
        "lineSep", NEWLINE * 2
    ).option("compression", "gzip").text(path)


def parse_records(data: bytes):
    """Header fields (lower-case names) and block of each record of an archive, by the stated lengths."""
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split(NEWLINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, "
    "stated_digest string, payload_bytes bigint, digest string, payload binary, fields string"
)


def read_records(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, compressed or not; without ``payloads`` only their sizes and digests."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = []
                if data[:2] == GZIP:
                    data = gzip.decompress(data)
                for f, block in parse_records(data):
                    kind, size, digest, body, text = f["warc-type"], None, None, None, None
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    elif kind == "metadata":
                        text = block.decode("utf-8")
                    rows.append(
                        (
                            f["warc-record-id"],
                            kind,
                            f.get("warc-concurrent-to"),
                            f.get("warc-refers-to"),
                            f.get("warc-target-uri"),
                            f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            size,
                            digest,
                            body if payloads else None,
                            text,
                        )
                    )
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                yield out.astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (its id), ``response``, ``request`` and ``metadata``.

    ``response`` is the response or revisit record. The others belong to the record they name in
    WARC-Concurrent-To, or to the one that names them. Captures without them have null there; of
    several the one with the smallest id stands. Records that belong to no capture are left out.
    """
    body = F.struct(*records.columns)
    is_main = F.col("type").isin("response", "revisit")
    main = records.where(is_main).select(F.col("record_id").alias("capture"), "concurrent_to", body.alias("response"))
    others = records.where(F.col("type").isin("request", "metadata")).select(
        "record_id", "type", "concurrent_to", body.alias("record")
    )
    named = others.where("concurrent_to is not null").select(F.col("concurrent_to").alias("capture"), "type", "record")
    naming = main.where("concurrent_to is not null").select("capture", F.col("concurrent_to").alias("record_id"))
    sides = named.unionByName(others.join(naming, "record_id").select("capture", "type", "record"))
    pick = lambda kind: F.min(F.when(F.col("type") == kind, F.col("record"))).alias(kind)
    sides = sides.groupBy("capture").agg(pick("request"), pick("metadata"))
    return main.drop("concurrent_to").join(sides, "capture", "left").select("capture", "response", "request", "metadata")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A row per capture of the archives: ``page_id``, size and digest of the full payload, type, ``refers_to``."""
    nested = materialise(assemble(materialise(read_records(spark, path, payloads=False), "records")), "captures")
    page = F.regexp_extract("metadata.fields", r"page_id: (-?\d+)", 1)
    flat = nested.select(
        "capture",
        F.when(page != "", page.cast("bigint")).alias("page_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.digest", "response.stated_digest").alias("payload_digest"),
    )
    known = flat.where("record_type = 'response'").select(
        F.col("capture").alias("target"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("size"),
    )
    own = flat.where("target is null").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to")
    )
    other = flat.where("target is not null").join(known, "target", "left")
    return own.unionByName(
        other.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their captures back."""
    spark = pages.sparkSession
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **kw)
    return captures(spark, path)


#: The round trip of table ``pages`` in SQL.
SQL = f"""
with p as (
  select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n from pages
), r as (
  select *, sha1(h) x, max(page_id) over (partition by h) top,
    row_number() over (partition by h order by page_id desc nulls last) k from p
)
select page_id, n::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
    ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::int >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') payload_digest,
  case when k = 1 then 'response' else 'revisit' end record_type, case when k > 1 then top end refers_to
from r
"""
