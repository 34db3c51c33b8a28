"""What must hold on any input, checked on the smallest test tables."""

import pytest
from pyspark.sql import functions as F

from checks.adapters import load
from checks.queries import AS_OF, NAME_MAP, nine_tables
from conftest import rows_of
from letterflow.operators import dose, frequency, identity

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("variant", frequency.VARIANTS)
def test_severity_keeps_rows_and_range_on_any_partitioning(spark, variant):
    df = load(spark, SMALL, "sf_v")
    table = frequency.severity_table(df, variant)
    assert table.count() == df.count()
    assert table.filter("FreqSeverity NOT BETWEEN 1 AND 7").count() == 0
    again = frequency.severity_table(df.repartition(7), variant, hot_rows=10)
    assert rows_of(again.select(table.columns)) == rows_of(table)


def test_doses_keep_rows_and_the_maximum_is_largest(spark):
    df = load(spark, SMALL, "presc_v")
    doses = dose.generic_name(dose.total_daily_dose(df), NAME_MAP)
    assert doses.count() == df.count()
    again = dose.generic_name(dose.total_daily_dose(df.repartition(7), hot_rows=3), NAME_MAP)
    assert rows_of(again.select(doses.columns)) == rows_of(doses)
    clean = dose.daily_dose_clean(doses)
    keys = list(dose.CLEAN_KEYS)
    top = dose.max_daily_dose(doses).withColumnRenamed("DailyDose", "top")
    joined = clean.join(top, keys)
    assert joined.count() == clean.count()
    assert joined.filter(F.col("DailyDose") > F.col("top")).count() == 0


def test_identity_ids_are_dense_and_repeatable(spark):
    tables = nine_tables(spark, SMALL)
    file = identity.identity_file(identity.individuals(tables), AS_OF)
    ids = [r[0] for r in rows_of(file, "SYSTEM_ID")]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    other = identity.identity_file(
        identity.individuals([t.repartition(5) for t in reversed(tables)]), AS_OF)
    assert rows_of(other.select(file.columns)) == rows_of(file)
