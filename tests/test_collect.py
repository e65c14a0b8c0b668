from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import scalar as S
from fieldglass.operators import collect as C


def test_plan_doubles_until_buckets_fit(spark):
    df = spark.range(1000).withColumn("name", F.col("id").cast("string"))
    p = C.plan(df, limit=100)
    assert p.total == 1000 and p.rounds[0] == 10 and p.buckets == p.rounds[-1] > 10
    assert sum(n for _, n in p.counts) == 1000 and max(n for _, n in p.counts) < 100
    assert [b for b, _ in p.counts] == sorted(b for b, _ in p.counts)


def test_small_results_stay_whole_and_equal_rows_cannot_be_divided(spark):
    assert C.plan(spark.range(5), limit=6).buckets is None
    with pytest.raises(C.CollectionError):
        C.plan(spark.range(50).select(F.lit(1).alias("x")), limit=20)


def test_byte_limit_divides_further(spark):
    df = spark.range(64).withColumn("text", F.repeat(F.lit("x"), 100))
    p = C.plan(df, limit=100, byte_limit=2000)
    assert p.buckets and p.buckets > 4


def test_written_parts_are_the_input(spark, tmp_path):
    df = spark.range(500).withColumn("name", F.col("id").cast("string"))
    p = C.plan(df, limit=60)
    assert C.collect_to(df, str(tmp_path / "out"), p) == 500
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("id").distinct().count() == 500 and back.filter(F.col("DumpPartition") >= p.buckets).count() == 0


@pytest.mark.parametrize("rows,total", [([(0, 5), (0, 5)], 10), ([(0, 5), (9, 5)], 10), ([(0, 5), (1, 0)], 5), ([(0, 5), (None, 5)], 10), ([(0, 5)], 10), ([(-1, 5)], 5)])
def test_bad_bucket_replies_are_rejected(spark, rows, total):
    with pytest.raises(C.CollectionError):
        C.check_counts(spark.createDataFrame(rows, "DumpPartition long, Count long"), 4, total)


def test_key_columns_are_scalar_sorted_and_there(spark):
    df = spark.sql("select 1 as b, array(1) as list, 'x' as a, timestamp'2024-01-01' as t")
    assert C.key_columns(df.schema) == ["a", "b", "t"]
    with pytest.raises(C.CollectionError):
        C.key_columns(spark.sql("select array(1) as x").schema)
    with pytest.raises(C.CollectionError):
        C.key_columns(spark.sql("select 1 as x, 2 as x").schema)


def test_hostile_column_names_make_keys(spark):
    df = spark.createDataFrame([("v", 1)], ["we`ird \"[x]|'//", "n"])
    assert C.bucket_counts(df, 4).first()["Count"] == 1


def test_window_is_half_open_and_null_arrival_stays(spark):
    rows = [(1, datetime(2024, 1, 1), None), (2, datetime(2024, 1, 2), datetime(2024, 1, 5)), (3, datetime(2024, 1, 3), datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "id int, t timestamp, arrived timestamp")
    assert [r.id for r in C.window(df, "t", "2d", datetime(2024, 1, 3), "arrived").collect()] == [1]


@pytest.mark.parametrize("text", ["5", "5w", "d", "1d; drop", "-1d", "99999999999d"])
def test_bad_lookbacks(text):
    with pytest.raises(ValueError):
        S.lookback_microseconds(text)


def test_count_replies():
    assert C.count_reply([{"COUNT": 7.0}]) == 7
    for bad in ([], [{"Count": 1}, {"Count": 2}], [{"Count": 1.5}], [{"x": 1}], [{"Count": True}]):
        with pytest.raises(C.CollectionError):
            C.count_reply(bad)
