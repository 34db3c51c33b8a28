"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries as all_queries
from checks import adapters, queries as checks_queries
from checks.compare import database, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from conftest import rows_of
from letterflow.operators import dates, frequency, identity, skew, validation
from letterflow.plans import identity as identity_plan
from letterflow.plans import prescriptions
from letterflow.sources import sink
from letterflow.sources.schemas import KINDS
from work import work_done

SMALL = "/root/testdata/sf0.001"


def queries():
    """The library's own queries; those of the optional subpackage have tests of their own."""
    return QUERIES


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def names(plan):
    return re.findall(r"^[\s:+\-|]*(?:\*\(\d+\) )?([A-Z]\w+)", plan, re.M)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_product_and_no_window_over_everything(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for window in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan):
        # Only the sizes and the ends of ranges are ordered without a partition.
        first = window.split(",")[0].strip()
        assert first.startswith("_part") or " ASC" not in first


def test_severity_needs_one_shuffle_and_one_sort(spark):
    ops = names(final_plan(queries()["severity"](spark, SMALL)))
    assert ops.count("Exchange") == 1 and ops.count("Sort") == 1 and ops.count("FileScan") == 1


def test_doses_need_a_shuffle_for_the_window_and_one_for_the_maximum(spark):
    plan = final_plan(queries()["max_daily_dose"](spark, SMALL))
    ops = names(plan)
    assert ops.count("Exchange") == 2 and ops.count("Window") == 2 and ops.count("Sort") == 1


def rows_of_table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").count()


def test_a_severity_reads_and_shuffles_each_report_once(spark):
    reports = rows_of_table(spark, "orders")
    done = work_done(queries()["severity"](spark, SMALL))
    assert done == {"read": reports, "shuffled": reports}


def test_common_people_cost_at_most_one_more_pass(spark):
    """The common people are counted on the narrow table; the reports are then read twice."""
    rows = adapters.load(spark, SMALL, "sf_v")
    reports = rows_of_table(spark, "orders")
    hot = skew.hot_keys(rows, ["SYSTEM_ID"], 12)
    assert 0 < hot.count() < 300
    done = work_done(frequency.severity_table(rows, hot=hot))
    # The broadcast count stands in the plan once more for each pass.
    assert done["read"] <= 4 * reports
    plain = frequency.severity_table(rows)
    assert rows_of(frequency.severity_table(rows, hot=hot)) == rows_of(plain)


@pytest.mark.parametrize("name, tables", [
    ("max_daily_dose", ["lineitem", "orders", "part"]),
    ("attach_record_date", ["lineitem", "orders", "part", "orders"]),
    ("dates_with_letters", ["orders", "orders", "orders"]),
    ("dose_ratio", ["lineitem", "orders", "part"]),
])
def test_every_input_is_read_once(spark, name, tables):
    done = work_done(queries()[name](spark, SMALL))
    assert done["read"] <= sum(rows_of_table(spark, t) for t in tables)


def static_names(df):
    return names(df._jdf.queryExecution().executedPlan().toString())


def test_the_whole_dose_chain_scans_each_table_once(spark):
    dates_v, letters_v, presc_v = (adapters.load(spark, SMALL, v) for v in ("dates_v", "letters_v", "presc_v"))
    linked = dates.letter_dates(dates_v, letters_v)
    dated = prescriptions.dated_prescriptions(presc_v.drop("DATEREC", "DOC"), linked)
    ops = static_names(prescriptions.dose_ratios(dated, checks_queries.top_doses(spark), checks_queries.NAME_MAP))
    # lineitem, orders and part for prescriptions, orders for dates and for letters
    assert ops.count("FileScan") == 5
    assert ops.count("Exchange") <= 10 and ops.count("SortMergeJoin") <= 4


def test_scans_grow_with_the_number_of_joins(spark):
    one = static_names(queries()["clinic_letter_full"](spark, SMALL))
    two = static_names(queries()["dates_with_letters"](spark, SMALL))
    assert one.count("FileScan") == 2 and two.count("FileScan") == 3


def test_identity_file_in_one_pass(spark, monkeypatch):
    """Nine tables of two inputs each are evaluated once; the file's plan reads what was kept."""
    kept = {}
    monkeypatch.setattr(identity, "keep", lambda df, path: kept.setdefault("numbers", df) and sink.keep(df, path))
    file = checks_queries.file(spark, SMALL)
    ops = static_names(kept["numbers"])
    assert ops.count("FileScan") == 18 and ops.count("Window") == 0
    assert static_names(file).count("FileScan") == 2


def test_identity_is_not_shuffled_again_for_nine_tables(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = adapters.load(spark, SMALL, "ident_v")
        kinds = {kind: rows.filter(F.col("Letter") % 9 == k) for k, kind in enumerate(KINDS)}
        _, matched = identity_plan.link(kinds, "2024-01-31", sink.new_folder(spark, "identity"))
        for df in matched.values():
            plan = df._jdf.queryExecution().executedPlan().toString()
            join = plan[plan.index("SortMergeJoin"):]
            # the annotations' side has exchanges, the bucketed file's side none
            file_side = join[join.index("NHS_NUMBER", join.index("SortMergeJoin") + 200):]
            assert len(re.findall(r"Exchange hashpartitioning\(_person", join)) == 1, file_side
            assert "SelectedBucketsCount" in join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_keys_evaluate_two_full_joins_once(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(validation, "keep", lambda df, path: kept.setdefault("rows", df) and sink.keep(df, path))
    plan = queries()["duplicate_docs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert static_names(kept["rows"]).count("FileScan") == 3
    # then the kept rows, and their keys alone
    assert names(plan).count("FileScan") == 2 and "ReadSchema: struct<DOC:bigint>" in plan


def test_scores_are_evaluated_once(spark):
    """The ends of the scores are seen as they are written; then the kept table is read once."""
    assert static_names(queries()["severity_norm"](spark, SMALL)).count("FileScan") == 1
    doses = static_names(checks_queries.ratios(spark, SMALL)).count("FileScan")
    assert static_names(queries()["person_timeline"](spark, SMALL)).count("FileScan") == doses + 1


def test_columns_and_filters_reach_the_scan(spark):
    plan = final_plan(queries()["people_with_epilepsy"](spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= all_queries().items() and ORACLES.items() <= oracle_sql().items()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, con, name):
    problem, _ = difference(spark, con, queries()[name], ORACLES[name], SMALL)
    assert problem is None
