"""Line deduplication by overlapping windows of three lines.

Every run of three neighbouring lines that are not blank is a window. Windows are compared over the
whole corpus by digest; of equal ones the first stays, in the order of document id, then of a digest
of id and text, then of position. The lines that the later ones cover are removed together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import NOT_BREAK, fresh, row_key, text_of

EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
SIZE = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _solid(lines: Column) -> Column:
    """Indexes of the lines that are not blank."""
    found = F.transform(lines, lambda x, i: F.when(x.rlike(NOT_BREAK), i))
    return F.filter(found, lambda i: i.isNotNull())


def _windows(lines: Column, solid: Column) -> Column:
    trimmed = lambda i, k: F.regexp_replace(F.get(lines, F.get(solid, i + k)), EDGE, "")
    return F.when(
        F.size(solid) >= SIZE,
        F.transform(
            F.sequence(F.lit(0), F.size(solid) - SIZE),
            lambda i: F.struct(
                F.unhex(F.md5(F.concat_ws("\n", *[trimmed(i, k) for k in range(SIZE)]))).alias("h"), i.alias("at")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<h:binary,at:int>>"))


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of a document and ``starts``, the windows in it that came before, in that order.

    Both passes over the windows shuffle digests and places only. Counting is combined before the
    shuffle, and the join splits a window that very many documents have.
    """
    body = text_of("text")
    cut = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    cut = cut.select("doc", row_key(F.col("doc"), F.col("text")).alias("key"), _lines(body).alias("lines"))
    cut = cut.withColumn("solid", _solid(F.col("lines")))
    windows = cut.select("doc", "key", F.explode(_windows(F.col("lines"), F.col("solid"))).alias("w")).select(
        F.col("w.h").alias("h"),
        F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), "key", "w.at").alias("place"),
    )
    first = (
        windows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        .where("n > 1")
        .select("h", "first")
    )
    later = windows.join(first, "h").where("place.key != first.key or place.at != first.at")
    return later.groupBy(F.col("place.key").alias("key")).agg(
        F.sort_array(F.collect_set("place.at")).alias("starts")
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with cleaned text, and ``n_lines`` and ``n_removed`` added (replacing namesakes).

    Lines equal but for outer white space are equal. Texts with fewer than three solid lines, empty
    and null texts stay as they are (null stays null). Rows with equal id and text are one document:
    all of them get the result of the first. Rows without id come last in the order.
    """
    lines, solid, key, gone = fresh(docs, "_lines", "_solid", "_key", "_gone")
    starts = repeated_windows(docs, id_col=id_col, text=text).select(
        F.col("key").alias(key), F.col("starts").alias(gone)
    )
    df = docs.withColumn(key, row_key(F.col(id_col), F.col(text))).join(starts, key, "left")
    df = df.withColumn(lines, _lines(text_of(text)))
    df = df.withColumn(solid, F.when(F.col(gone).isNotNull(), _solid(F.col(lines))))
    covered = F.array_distinct(
        F.flatten(
            F.transform(gone, lambda p: F.transform(F.sequence(p, p + SIZE - 1), lambda i: F.get(F.col(solid), i)))
        )
    )
    df = df.withColumn(gone, covered)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cleaned = F.when(
        F.col(gone).isNotNull(), F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")
    ).otherwise(F.col(text))
    return df.withColumns(
        {
            "n_lines": F.size(lines).cast("bigint"),
            "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
            text: cleaned,
        }
    ).drop(lines, solid, key, gone)


#: The whole operator in SQL.
SQL = r"""
with cut as (
  select doc_id, text, string_split(coalesce(text, ''), chr(10)) lines,
    coalesce('=' || doc_id::varchar, '~') a, coalesce('=' || text, '~') b from documents
), keyed as (
  select *, md5(concat_ws(',', length(a), length(b), a, b)) k from cut
), solid as (
  select doc_id, k, lines, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^\x20\x09-\x0D]')) s from keyed
), placed as (
  select distinct doc_id, k, s, unnest(range(1, len(s) - 1)) p, lines from solid
), windows as (
  select doc_id, k, s, p, md5(concat_ws(chr(10), regexp_replace(lines[s[p]], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    regexp_replace(lines[s[p + 1]], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    regexp_replace(lines[s[p + 2]], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))) h from placed
), ranked as (
  select *, row_number() over (partition by h order by doc_id nulls last, k, p) r from windows
), gone as (
  select k, list_distinct(flatten(list(s[p:p + 2]))) g from ranked where r > 1 group by k
)
select doc_id, len(lines)::bigint n_lines, coalesce(len(g), 0)::bigint n_removed,
  case when g is null then text
    else array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: not list_contains(g, i)), lambda i: lines[i]), chr(10)) end "text"
from keyed left join gone using (k)
"""
