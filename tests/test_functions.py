import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from flowsieve import presets
from flowsieve.functions.labels import recode
from flowsieve.functions.names import normalise, normalise_names
from flowsieve.functions.network import prefix_flags
from flowsieve.functions.times import cyclic, parse_time, weekend_flag


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_recode_is_exact_and_keeps_the_blank_key(spark):
    df = column(spark, ["DDoS ", "Normal", "DDoS"])
    assert [r.c for r in recode(df, "c", presets.LABEL_MAP).collect()] == [1, 0, 1]


@pytest.mark.parametrize("large", [False, True])
def test_recode_policies(spark, large):
    mapping = dict(presets.LABEL_MAP)
    if large:
        mapping |= {f"extra{i}": 1 for i in range(200)}
    df = column(spark, [" Normal", "Unknown", None, "Probe"])
    null = [r.c for r in recode(df, "c", mapping, unmapped="null").collect()]
    assert null == [None, None, None, 1]
    kept = [r.c for r in recode(df, "c", mapping, unmapped="keep").collect()]
    assert kept == [" Normal", "Unknown", None, "1"]
    trimmed = [r.c for r in recode(df, "c", mapping, unmapped="null", trim=True).collect()]
    assert trimmed == [0, None, None, 1]
    with pytest.raises(Exception, match="unmapped value in c"):
        recode(df, "c", mapping).collect()


def test_recode_touches_one_column(spark):
    df = spark.createDataFrame([("Normal", "Normal")], "a string, b string")
    row = recode(df, "a", presets.LABEL_MAP).first()
    assert (row.a, row.b) == (0, "Normal")


TIMES = ["05/02/2020 01:58:05 PM", "25/12/2019 02:05:09 AM", "5/2/2020 13:58", "not a date", None]


def test_time_is_day_first(spark):
    got = [r.t for r in column(spark, TIMES).select(parse_time(F.col("c")).alias("t")).collect()]
    assert got == [
        dt.datetime(2020, 2, 5, 13, 58, 5),
        dt.datetime(2019, 12, 25, 2, 5, 9),
        dt.datetime(2020, 2, 5, 13, 58),
        None,
        None,
    ]


def test_time_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = column(spark, ["08/03/2020 02:30:00 AM"])  # inside the zone's daylight gap
        assert df.select(parse_time(F.col("c")).alias("t")).first().t == dt.datetime(2020, 3, 8, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_strict_time_fails(spark):
    df = column(spark, ["05/02/2020 01:58:05 PM", None])
    assert df.select(parse_time(F.col("c"), strict=True).alias("t")).collect()[1].t is None
    with pytest.raises(Exception, match="unparsable time"):
        column(spark, ["31/31/2020 10:00"]).select(parse_time(F.col("c"), strict=True)).collect()


def test_weekend(spark):
    days = [dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 2), dt.datetime(2020, 2, 3), None]
    df = column(spark, days, "timestamp_ntz")
    assert [r.w for r in df.select(weekend_flag(F.col("c")).alias("w")).collect()] == [1, 1, 0, 0]


@pytest.mark.parametrize("parts,period", [([0, 15, 30, 45], 60), ([0, 6, 12, 18], 24)])
def test_cyclic(spark, parts, period):
    sin, cos = cyclic(F.col("c"), period)
    rows = column(spark, parts, "int").select(sin.alias("s"), cos.alias("k")).collect()
    assert [round(r.s) for r in rows] == [0, 1, 0, -1]
    assert [round(r.k) for r in rows] == [1, 0, -1, 0]
    assert all(math.isclose(r.s**2 + r.k**2, 1.0) for r in rows)


def test_prefix_flags(spark):
    values = ["192.168.20.133", "192.168.2.5", "192.168.20", "10.192.168.20.1", None]
    flags = prefix_flags(F.col("c"), {"Dst 192.168.20.": "192.168.20."})
    rows = column(spark, values).select(*flags).collect()
    assert [r.dst_192_168_20_ for r in rows] == [1, 0, 0, 0, 0]


def test_names(spark):
    assert normalise("Dst 192.168.8") == "dst_192_168_8"
    assert normalise("Flow Byts/s") == "flow_byts_s"
    df = spark.createDataFrame([(1, 2)], "`Dst 1.2.` int, `B/s` int")
    renamed = normalise_names(df)
    assert renamed.columns == ["dst_1_2_", "b_s"]
    assert renamed.schema["dst_1_2_"].metadata["original"] == "Dst 1.2."
    with pytest.raises(ValueError, match="both become"):
        normalise_names(spark.createDataFrame([(1, 2)], "`A b` int, `a/B` int"))


def test_fixed_lists_take_84_columns_to_28():
    from flowsieve.sources.flows import FLOW_SCHEMA

    names = [f.name for f in FLOW_SCHEMA]
    assert len(names) == len(set(names)) == 84
    sizes = [84]
    derived = ["hr_sin_minutes", "hr_cos_minutes", "hr_sin_hours", "hr_cos_hours", "Weekend"]
    derived += [*presets.DST_PREFIXES, *presets.SRC_PREFIXES]
    for gone, new in [
        (presets.DROP_CONSTANT, []),
        ([], derived),
        (presets.DROP_RAW, []),
        (presets.DROP_CORRELATED, []),
        (presets.DROP_ELIMINATED, []),
    ]:
        assert set(gone) <= set(names)
        names = [n for n in names if n not in gone] + new
        sizes.append(len(names))
    assert sizes == [84, 71, 85, 82, 61, 28]
    assert set(names) - {"Label"} == set(presets.FINAL_FEATURES)


def test_trimming_maps_and_columns_alike(spark):
    df = spark.createDataFrame([("a ",), ("b\t",)], "c string")
    assert [r.c for r in recode(df, "c", {" a": 1, "b\t": 2}, trim=True).collect()] == [1, 2]
    with pytest.raises(ValueError, match="two codes"):
        recode(df, "c", {"a": 1, "a ": 2}, trim=True)
