"""Scans that bind columns by name, and stacking of sources."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import presets
from flowsieve.functions.names import normalise_names, quoted

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("Flow ID", T.StringType()),
        T.StructField("Src IP", T.StringType()),
        T.StructField("Src Port", T.IntegerType()),
        T.StructField("Dst IP", T.StringType()),
        T.StructField("Dst Port", T.IntegerType()),
        T.StructField("Protocol", T.IntegerType()),
        T.StructField("Timestamp", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in presets.MEASUREMENTS],
        *[T.StructField(c, T.DoubleType()) for c in presets.DROP_CONSTANT[1:]],
        T.StructField("Label", T.StringType()),
    ]
)


RESCUED = "_rescued"


def bind_by_name(
    df: DataFrame, schema: T.StructType, *, lenient: bool = False, rescue: bool = False
) -> DataFrame:
    """Project ``df`` to the declared columns by name, cast to the declared types.

    Columns the schema does not name are left out. A bad number fails the job, or becomes
    null when ``lenient``. With ``rescue`` it becomes null and its text is kept in ``_rescued``, a map by
    column that is null where all values are good.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; present: {df.columns}")

    def cast(field):
        source = F.col(quoted(field.name))
        return source.try_cast(field.dataType) if lenient or rescue else source.cast(field.dataType)

    bound = [cast(f).alias(f.name) for f in schema]
    if rescue:
        lost = [
            F.when(F.col(quoted(f.name)).isNotNull() & cast(f).isNull(), F.struct(F.lit(f.name), F.col(quoted(f.name)).cast("string")))
            for f in schema
            if not isinstance(f.dataType, T.StringType)
        ]
        entries = F.map_from_entries(F.array_compact(F.array(*lost))) if lost else F.create_map()
        bound.append(F.when(F.size(entries) > 0, entries).cast("map<string,string>").alias(RESCUED))
    return df.select(*bound)


def rescued_counts(df: DataFrame) -> DataFrame:
    """``column_name`` and ``n_rescued``: how many values of a column did not cast."""
    names = df.where(F.col(RESCUED).isNotNull()).select(F.explode(F.map_keys(RESCUED)).alias("column_name"))
    return names.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rescued"))


def header_groups(spark: SparkSession, path: str, parallelism: int = 16) -> dict[tuple[str, ...], list[str]]:
    """Files below ``path`` by their header line. One line of each file is read, several files at a time; Spark
    lists and opens them, so any store it reads will do. The driver gets the names of the files."""
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    inherit = inheritable_thread_target(spark)
    with ThreadPool(parallelism) as pool:
        headers = pool.map(inherit(lambda f: tuple(spark.read.option("header", True).csv(f).columns)), files)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers):
        groups.setdefault(header, []).append(file)
    groups.pop((), None)  # files without a line
    return groups


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = FLOW_SCHEMA,
    *,
    lenient: bool = False,
    rescue: bool = False,
    position: bool = False,
) -> DataFrame:
    """Headered CSV, each file bound by the names in its own header, whatever their order.

    Only header lines are read up front: no inference pass over the data. Files of one header are one
    scan, and these are stacked; a file that lacks a declared column is an error that names its header. An empty
    folder is one, too. ``rescue`` keeps what does not cast (see ``bind_by_name``). ``position`` adds where each
    row was read, for ``rows.scan_order_id``.
    """
    groups = header_groups(spark, path)
    if not groups:
        raise ValueError(f"no file with a header below {path}")
    scans = [
        _scan_group(spark, header, files, schema, lenient=lenient, rescue=rescue, position=position)
        for header, files in groups.items()
    ]
    return reduce(DataFrame.unionByName, scans)


def _scan_group(
    spark: SparkSession,
    header: tuple[str, ...],
    files: list[str],
    schema: T.StructType,
    *,
    lenient: bool,
    rescue: bool,
    position: bool,
) -> DataFrame:
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(files)
    )
    if not position:
        return bind_by_name(raw, schema, lenient=lenient, rescue=rescue)
    fields = T.StructType(list(schema) + [
        T.StructField("_file", T.StringType()),
        T.StructField("_block", T.LongType()),
        T.StructField("_at", T.LongType()),
    ])
    located = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return bind_by_name(located, fields, lenient=lenient, rescue=rescue)


def scan_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, row_key: bool = False
) -> DataFrame:
    """Parquet, optionally projected and cast to a declared schema.

    ``row_key`` adds ``_file`` and ``_row``, the file's name and the place in it, which
    together identify a row and depend neither on the folder nor on how files are split among tasks.
    """
    df = spark.read.parquet(path)
    extra = []
    if row_key:
        df = df.select(
            "*",
            F.col("_metadata.file_name").alias("_file"),
            F.col("_metadata.row_index").alias("_row"),
        )
        extra = [T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())]
    return bind_by_name(df, T.StructType(list(schema) + extra)) if schema else df


def stack_sources(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union by column name; a column absent from a source is null there. ``tag`` names the
    source each row came from and serves as a partition column when written."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def scan_flows(
    spark: SparkSession, paths: dict[str, str], *, lenient: bool = False, position: bool = True
) -> DataFrame:
    """All sources of flow records, stacked in the given order, with normalised names.

    ``_source`` tags the source; its text sorts in the order of ``paths``.
    """
    scans = {
        f"{i:03d}-{name}": scan_csv(spark, path, lenient=lenient, position=position)
        for i, (name, path) in enumerate(paths.items())
    }
    return normalise_names_keeping(stack_sources(scans, tag="_source"))


def normalise_names_keeping(df: DataFrame) -> DataFrame:
    """Normalise all names but the engine's own, which start with an underscore."""
    own = [c for c in df.columns if c.startswith("_")]
    public = normalise_names(df.drop(*own))
    if not own:
        return public
    renamed = {new: old for new, old in zip(public.columns, [c for c in df.columns if c not in own])}
    return df.select(
        *[F.col(quoted(old)).alias(new, metadata={"original": old}) for new, old in renamed.items()],
        *own,
    )
