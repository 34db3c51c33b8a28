"""Ranges that cut any person or letter, without a list of common ones."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from letterflow.operators import dose, frequency, ranges
from letterflow.sources.sink import new_folder
from test_skew import PRESC, SF, prescriptions, reports
from work import work_done


def folder(spark):
    return new_folder(spark, "ranges")


@pytest.fixture(params=[3, 40])
def small_ranges(request, monkeypatch):
    """Ranges of a few rows, smaller than what a rule looks back over, and larger ones."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", request.param)
    return request.param


@pytest.mark.parametrize("variant", frequency.VARIANTS)
def test_look_backs_across_ranges(spark, frame, small_ranges, variant):
    df = frame(SF, reports(1, 60), 7)
    plain = frequency.frequency_table(df, variant)
    cut = frequency.frequency_table(df, variant, path=folder(spark))
    assert rows_of(cut.select(plain.columns)) == rows_of(plain)


@pytest.mark.parametrize("rule", ["matched", "previous"])
def test_doses_across_ranges(spark, frame, small_ranges, rule):
    df = frame(PRESC, prescriptions(2, 60), 6)
    plain = dose.total_daily_dose(df, rule)
    cut = dose.total_daily_dose(df, rule, path=folder(spark))
    assert rows_of(cut.select(plain.columns)) == rows_of(plain)


def test_another_order_across_ranges(spark, frame, small_ranges):
    """Interleaved spans: the window covers the letter, and the letter is cut all the same."""
    order = ("END", "DOSE", "START", "CUI", "FREQUENCY", "UNIT", "NAME")
    df = frame(PRESC, prescriptions(3, 60), 6)
    plain = dose.total_daily_dose(df, order=order)
    cut = dose.total_daily_dose(df, order=order, path=folder(spark))
    assert rows_of(cut.select(plain.columns)) == rows_of(plain)


def test_a_person_with_a_third_of_all_rows_is_in_many_ranges(spark, frame, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    rows = [("hot" if k % 3 == 0 else f"p{k}", k) for k in range(6000)]
    kept = ranges.ranged(frame("SYSTEM_ID string, v int", rows, 7), ["SYSTEM_ID", "v"], folder(spark))
    sizes = [r["count"] for r in kept.filter("SYSTEM_ID = 'hot'").groupBy("_part").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 15 and max(sizes) <= 300


def test_copies_of_one_row_are_spread(spark, frame, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    kept = ranges.ranged(frame("SYSTEM_ID string, v int", [("hot", 1)] * 3000, 7), ["SYSTEM_ID", "v"], folder(spark))
    sizes = [r["count"] for r in kept.groupBy("_part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 300


def test_ranges_that_share_a_bucket_are_a_small_task(spark):
    """Ranges are hashed to buckets: what meets in one task stays small as tables grow."""
    df = spark.range(3_000_000).select((F.col("id") % 1000).alias("SYSTEM_ID"), F.col("id").alias("v"))
    kept = ranges.ranged(df, ["SYSTEM_ID", "v"], folder(spark))
    tasks = ranges.sizes(kept).groupBy(F.spark_partition_id()).agg(F.sum("_size").alias("rows")).collect()
    assert sum(r["rows"] for r in tasks) == 3_000_000 and max(r["rows"] for r in tasks) <= 700_000


def test_look_backs_shuffle_no_report_again(spark, frame):
    """After the kept, bucketed table its rows stay where they are: only the ends of ranges move."""
    rows = [(f"p{k % 5}", k, 1, date(2015, 1, 1) + timedelta(days=k % 900), "C0", None, 1.0, None, "Day", 1.0, None, None,
             None, None, None, None) for k in range(20_000)]
    done = work_done(frequency.severity_table(frame(SF, rows, 7), path=folder(spark)))
    parts = spark.sparkContext.defaultParallelism
    assert done["read"] >= 20_000 and done["shuffled"] <= 10 * parts * 4 * frequency.DEPTH


def test_empty_table(spark, frame):
    none = frame(SF, [])
    assert frequency.frequency_table(none, path=folder(spark)).collect() == []
    assert dose.total_daily_dose(frame(PRESC, []), path=folder(spark)).collect() == []
