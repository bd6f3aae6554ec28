"""Session helpers and the one way this package cuts lineage: a written table."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}

_LOCAL_ROOT: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def local_session(
    cores: int | str = 8, app: str = "flowsieve", memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own. ``shared``: ``spark.checkpoint.dir``."""
    builder = SparkSession.builder
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Only a local session may go without one; it then gets a temporary folder that is
    removed when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        root = tempfile.mkdtemp(prefix="flowsieve-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _LOCAL_ROOT[app] = root
    return _LOCAL_ROOT[app]


def _table_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"


def _store(df: DataFrame, name: str, partition_by: list[str] | None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{_table_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back.

    Unlike cached blocks the table outlives lost executors, and unlike an RDD checkpoint
    it is columnar, so later passes read only the columns they need.
    """
    return _store(df, name, partition_by)[0]


@contextmanager
def materialised(df: DataFrame, name: str, partition_by: list[str] | None = None):
    """The same for a table that is not needed after the block; it is deleted then."""
    stored, path = _store(df, name, partition_by)
    try:
        yield stored
    finally:
        _delete(df.sparkSession, path)


@contextmanager
def scratch_folder(spark: SparkSession, name: str):
    """A path in the checkpoint folder for files that are not needed after the block."""
    path = f"{_table_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _delete(spark, path)


def let_go(spark: SparkSession) -> None:
    """Have Spark free the shuffles and broadcasts of queries that are over.

    It does so once their plans are collected, which on a driver with heap to spare is long after; a chain of many
    queries would keep all of them until then.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def drop_tables(spark: SparkSession) -> None:
    """Delete what this application has materialised; call it when no result needs it."""
    _delete(spark, _table_folder(spark))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few driver-side rows, handed over as Arrow so that no Python worker starts."""
    fields = T.StructType.fromDDL(schema).fields
    arrays = [
        pa.array([r[i] for r in rows], ARROW_TYPES[f.dataType.simpleString()]) for i, f in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=[f.name for f in fields]))


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after measuring: text by its bytes, anything else 8 a value."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    numbers = lambda kind: len(kind.fields) + 1 if isinstance(kind, T.StructType) else 1
    fixed = 8 * (sum(numbers(f.dataType) for f in df.schema) + 2)
    size = F.lit(fixed) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    total = df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= max_bytes else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, whatever threads ask for it."""
    context = spark.sparkContext
    with _SHIPPING:
        if context.applicationId in _SHIPPED:
            return
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="flowsieve-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(
            os.path.join(folder, "flowsieve"), "zip", os.path.dirname(package), os.path.basename(package)
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
