import pytest
from pyspark.sql import functions as F

from flowsieve.functions.names import normalise
from flowsieve.operators import rows
from flowsieve.session import materialise
from flowsieve.session import materialise
from flowsieve.sources.flows import (
    FLOW_SCHEMA,
    rescued_counts,
    scan_csv,
    scan_flows,
    scan_parquet,
    stack_sources,
)


def test_negative_rows_go_and_unknown_ones_stay(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (None,), (float("nan"),)], "c double")
    assert rows.drop_negative(df, "c").count() == 3


def test_drop_columns_names_the_missing_one(spark):
    with pytest.raises(ValueError, match="nope"):
        rows.drop_columns(spark.range(1), ["nope"])


def test_exclude_ids_accepts_repeats_and_strangers(spark):
    df = spark.range(5).union(spark.createDataFrame([(None,)], "id long"))
    ids = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id long")
    assert sorted(r.id for r in rows.exclude_ids(df, ids, "id").collect() if r.id is not None) == [0, 2, 3, 4]
    assert rows.exclude_ids(df, ids, "id").count() == 5


def test_csv_is_bound_by_name(spark, flow_files):
    df = scan_csv(spark, flow_files["plain"])
    assert df.columns == [f.name for f in FLOW_SCHEMA]
    assert df.first()["Protocol"] in (6, 17)


def test_csv_missing_column_is_named(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="Flow ID"):
        scan_csv(spark, str(tmp_path / "x.csv"))


def test_csv_keeps_trailing_blank_and_checks_numbers(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("Label", T.StringType())])
    path = str(tmp_path / "y.csv")
    (tmp_path / "y.csv").write_text("Label,n\nDDoS ,1.5\nNormal,oops\n")
    assert scan_csv(spark, path, schema, lenient=True).collect() == [(1.5, "DDoS "), (None, "Normal")]
    with pytest.raises(Exception, match="oops"):
        scan_csv(spark, path, schema).collect()


def test_csv_folder_with_differing_headers(spark, tmp_path):
    """Every file is bound by its own header; one without a declared column is named, empty files are nothing."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n1,2\n")
    (tmp_path / "3.csv").write_text("c,b,a\nx,5,6\n")
    (tmp_path / "4.csv").write_text("")
    assert sorted(map(tuple, scan_csv(spark, str(tmp_path), schema).collect())) == [(1, 2), (2, 1), (6, 5)]
    placed = scan_csv(spark, str(tmp_path), schema, position=True)
    ids = rows.scan_order_id(materialise(placed, "scanned")).collect()
    assert [tuple(r)[:2] for r in sorted(ids, key=lambda r: r.row_id)] == [(1, 2), (2, 1), (6, 5)]
    (tmp_path / "5.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="missing columns: .'b'"):
        scan_csv(spark, str(tmp_path), schema)


def test_values_that_do_not_cast_are_rescued(spark, tmp_path):
    from pyspark.sql import types as T

    kinds = {"n": T.DoubleType(), "k": T.IntegerType(), "t": T.StringType()}
    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    (tmp_path / "1.csv").write_text("n,k,t\n1.5,2,x\noops,,y\n")
    (tmp_path / "2.csv").write_text("t,k,n\nz,3.5.6,none\n,7,NaN\n")
    df = scan_csv(spark, str(tmp_path), schema, rescue=True)
    got = sorted((r.t or "", r.k, r._rescued) for r in df.collect())
    assert got == [("", 7, None), ("x", 2, None), ("y", None, {"n": "oops"}), ("z", None, {"n": "none", "k": "3.5.6"})]
    counts = {r.column_name: r.n_rescued for r in rescued_counts(df).collect()}
    assert counts == {"n": 2, "k": 1}
    names = scan_csv(spark, str(tmp_path), T.StructType([T.StructField("t", T.StringType())]), rescue=True)
    assert names.where("_rescued is not null").count() == 0


def test_stack_aligns_by_name(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "y int, x int")
    c = spark.createDataFrame([(5,)], "x int")
    got = {r.source: (r.x, r.y) for r in stack_sources({"a": a, "b": b, "c": c}).collect()}
    assert got == {"a": (1, 2), "b": (4, 3), "c": (5, None)}


def test_scan_order_ids_follow_sources_and_lines(spark, flow_files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")  # several blocks per file
        raw = scan_flows(spark, flow_files).select("flow_id", "_source", "_file", "_block", "_at")
        stored = materialise(raw, "t")
        assert stored.select("_file", "_block").distinct().count() > 3
        got = rows.scan_order_id(stored, order=["_source"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.row_id, r.flow_id) for r in got) == [(i, f"flow-{i}") for i in range(2000)]


def test_sorted_ids_are_contiguous_with_a_hot_key(spark):
    df = spark.range(9000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    got = rows.sorted_row_id(df, ["k"]).collect()
    assert sorted(r.row_id for r in got) == list(range(9000))
    ordered = [r.k for r in sorted(got, key=lambda r: r.row_id)]
    assert ordered == sorted(ordered)


def labelled(spark, n=3000, partitions=8):
    return spark.range(n, numPartitions=partitions).select(
        F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("label")
    )


def test_folds_are_balanced_in_total_and_by_class(spark):
    folded = rows.stratified_folds(labelled(spark, 3001), label="label", key=["key"], k=5)
    assert folded.count() == 3001
    for by in ([], ["label"]):
        counts = {}
        for r in folded.groupBy(*by, "fold").count().collect():
            counts.setdefault(r["label"] if by else None, []).append(r["count"])
        assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in counts.values())


def test_folds_do_not_depend_on_partitioning(spark):
    def assigned(partitions):
        df = rows.stratified_folds(labelled(spark, partitions=partitions), label="label", key=["key"])
        return sorted((r.key, r.fold) for r in df.collect())

    assert assigned(1) == assigned(8)


def test_folds_equal_a_plain_ranking(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(rows, "ROWS_PER_CELL", 20)  # many cells even on a small table
    got = rows.stratified_folds(labelled(spark), label="label", key=["key"], k=4, seed=9).collect()
    digest = lambda k: hashlib.md5(f"9~{k}".encode()).hexdigest()
    ordered = sorted(((r.label, digest(r.key), r.key), r.fold) for r in got)
    assert [f for _, f in ordered] == [i % 4 for i in range(3000)]


def test_cells_grow_by_digits_and_folds_stay(spark, monkeypatch):
    """Cells that the first count leaves too large are parted by more digits, here six; folds are the same."""
    by_key = lambda: sorted((r.key, r.fold) for r in rows.stratified_folds(labelled(spark), label="label", key=["key"]).collect())
    plain = by_key()
    monkeypatch.setattr(rows, "ROWS_PER_CELL", 4)
    monkeypatch.setattr(rows, "FIRST_DIGITS", 2)
    assert by_key() == plain
    monkeypatch.setattr(rows, "FIRST_DIGITS", 1)
    monkeypatch.setattr(rows, "ROWS_PER_CELL", 1)
    _, cells = rows._celled(labelled(spark), "label", ["key"], 1)
    assert cells.agg(F.max("n"), F.max(F.length("_cell"))).first()[:] == (1, len("0~") + 7)
    assert by_key() == plain


def test_folds_spread_copies_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(rows, "ROWS_PER_CELL", 100)
    df = labelled(spark, 6000).withColumn("key", F.when(F.col("key") % 3 == 0, -1).otherwise(F.col("key")))
    with pytest.raises(Exception, match="does not identify a row"):
        rows.stratified_folds(df, label="label", key=["key"]).collect()
    folded = rows.stratified_folds(df, label="label", key=["key"], spread_copies=True)
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert sorted(sizes) == [1200] * 5


@pytest.mark.parametrize("partitions", [1, 8])
def test_two_copies_of_a_key_are_enough_to_fail(spark, partitions):
    df = labelled(spark, 3000, partitions).withColumn("key", F.when(F.col("key") == 7, 0).otherwise(F.col("key")))
    with pytest.raises(Exception, match="does not identify a row"):
        rows.stratified_folds(df, label="label", key=["key"]).collect()


def test_folds_need_enough_rows_and_labels(spark):
    few = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "key int, label int")
    with pytest.raises(Exception, match="fewer rows than 3 folds"):
        rows.stratified_folds(few, label="label", key=["key"], k=3).collect()
    gap = spark.createDataFrame([(i, None if i == 3 else 0) for i in range(9)], "key int, label int")
    with pytest.raises(Exception, match="null in label"):
        rows.stratified_folds(gap, label="label", key=["key"], k=3).collect()


def test_train_and_test_are_a_partition(spark):
    folded = rows.stratified_folds(labelled(spark), label="label", key=["key"])
    train, test = rows.train_test(folded, 2)
    assert train.count() + test.count() == 3000
    assert train.join(test, "key", "left_semi").count() == 0


def test_parquet_row_key_is_unique(spark, tmp_path):
    spark.range(1000, numPartitions=5).write.parquet(str(tmp_path / "p"))
    df = scan_parquet(spark, str(tmp_path / "p"), row_key=True)
    assert df.select("_file", "_row").distinct().count() == 1000


def test_shape(spark):
    row = rows.frame_shape(spark.range(7).withColumn("x", F.lit(1))).first()
    assert (row.n_rows, row.n_columns) == (7, 2)


def test_declared_names_have_no_collisions():
    names = [normalise(f.name) for f in FLOW_SCHEMA]
    assert len(set(names)) == 84


@pytest.mark.parametrize("outer", range(4))
def test_inner_folds_by_arithmetic_are_those_of_the_part(spark, outer):
    folded = rows.stratified_folds(labelled(spark, 2001), label="label", key=["key"], k=4, rank="r")
    train, _ = rows.train_test(folded, outer)
    counted = train.withColumn("inner", rows.inner_fold("r", outer, 4, 3))
    ranked = rows.stratified_folds(train, label="label", key=["key"], k=3, into="inner")
    pairs = lambda df: sorted((r.key, r.inner) for r in df.collect())
    assert pairs(counted) == pairs(ranked)
