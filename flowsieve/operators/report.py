"""Per-fold lists and means, and the appended report."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import small_table


def fold_report(metrics: DataFrame) -> DataFrame:
    """(model, fold, metric, value) to (model, metric, per_fold, mean); lists are in fold
    order and no longer than the number of folds."""
    per_fold = F.sort_array(F.collect_list(F.struct("fold", "value")))
    return metrics.groupBy("model", "metric").agg(
        F.transform(per_fold, lambda e: e["value"]).alias("per_fold"), F.avg("value").alias("mean")
    )


MARKS = "_marks"


def _marked(spark: SparkSession, path: str) -> dict[str, str]:
    """Attempt of each committed run, by run id. One mark a run, so this is as long as the list of runs.

    Two attempts of one run that were committed side by side hold the same rows; the smaller name counts."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKS}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return dict(name.split("~") for name in sorted(names, reverse=True) if not name.startswith("."))


def append_once(
    df: DataFrame, path: str, run_id: str, *, partition_by: tuple[str, ...] = (), file_format: str = "parquet"
) -> bool:
    """Append ``df`` as one run's part of the table below ``path``; whether it was added.

    Rows are written to a folder of this attempt alone, and count only once a mark, an empty file, names it. So
    readers never see half of a run, a lost attempt leaves nothing behind that is read, and an append that is
    repeated under the same ``run_id`` adds nothing. Any number of runs may be appended side by side.
    """
    if not re.fullmatch("[A-Za-z0-9_-][A-Za-z0-9_.-]*", run_id):
        raise ValueError(f"run id {run_id!r} is no name of a file")
    spark = df.sparkSession
    if run_id in _marked(spark, path):
        return False
    attempt = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).format(file_format).save(f"{path}/{run_id}~{attempt}")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKS}/{run_id}~{attempt}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, False).close()
    return _marked(spark, path)[run_id] == attempt


def read_runs(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The rows of all committed runs with their ``run_id``; none is an error."""
    marked = _marked(spark, path)
    if not marked:
        raise ValueError(f"no run is committed below {path}")
    parts = [
        spark.read.format(file_format).load(f"{path}/{run}~{attempt}").withColumn("run_id", F.lit(run))
        for run, attempt in sorted(marked.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def append_metrics(metrics: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Add to the metrics table, one folder per model, once per ``run_id`` (new if not given)."""
    return append_once(metrics, path, run_id or uuid.uuid4().hex, partition_by=("model",))


def render_text(report: DataFrame, confusions: DataFrame, best: DataFrame) -> str:
    """Readable text of three small tables (rows: models x metrics, models x folds twice)."""
    lines: list[str] = []
    rows = sorted(report.collect(), key=lambda r: (r["model"], r["metric"]))
    matrices = sorted(confusions.collect(), key=lambda r: (r["model"], r["fold"]))
    chosen = sorted(best.collect(), key=lambda r: (r["model"], r["fold"]))
    for model in dict.fromkeys(r["model"] for r in rows):
        lines += [model, "", "Best parameters per fold:"]
        lines += [f"  fold {r['fold']}: {r['params']}" for r in chosen if r["model"] == model]
        lines += ["", "Metrics:"]
        for r in rows:
            if r["model"] == model:
                lines.append(f"  {r['metric']}: {[round(v, 9) for v in r['per_fold']]}")
                lines.append(f"  {r['metric']} mean: {r['mean']:.9f}")
        lines += ["", "Confusion matrices [[tn, fp], [fn, tp]]:"]
        lines += [
            f"  fold {r['fold']}: [[{r['tn']}, {r['fp']}], [{r['fn']}, {r['tp']}]]"
            for r in matrices
            if r["model"] == model
        ]
        lines.append("")
    return "\n".join(lines)


def append_text(df: DataFrame, text: str, path: str, run_id: str | None = None) -> bool:
    """Append the rendered report as a text file below ``path``, on the cluster's storage, once per ``run_id``."""
    lines = small_table(df.sparkSession, [(text,)], "value string").coalesce(1)
    return append_once(lines, path, run_id or uuid.uuid4().hex, file_format="text")
