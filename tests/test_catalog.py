import datetime

import pytest

from lumenspan.plans import catalog
from tests.compare import connect, differences

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, larger, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql()[name]
    problems = differences(spark, con, SF, query, sql)
    if problems == ["no rows"]:  # nothing compared yet
        problems = differences(spark, larger, LARGER, query, sql)
    assert not problems


def test_compare_sees_rows_of_either_side(spark, con):
    rows = lambda n: lambda spark, sf_dir: spark.range(n)
    assert differences(spark, con, SF, rows(0), "SELECT 1 AS id WHERE false") == ["no rows"]
    assert "only Spark" in differences(spark, con, SF, rows(2), "SELECT 1 AS id WHERE false")[0]
    assert "only SQL" in differences(spark, con, SF, rows(0), "SELECT 0 AS id")[0]
    assert differences(spark, con, SF, rows(1), "SELECT 0 AS id") == []


def test_ages_are_told_in_nearest_seconds(spark, tmp_path):
    times = ["00:00:00.6", "00:00:00.5", "00:00:01.5", "00:00:01.6", "00:00:02.5", "00:01:00.4", "00:01:00.5"]
    rows = [(datetime.datetime.fromisoformat(f"{day} {t}"),) for day in ("2024-01-01", "1969-12-30") for t in times]
    spark.createDataFrame(rows, "ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert differences(spark, connect(tmp_path), str(tmp_path), catalog.queries()["age_labels"], catalog.oracle_sql()["age_labels"]) == []


@pytest.mark.parametrize("name", ["symbol_index", "symbol_search"])
def test_every_file_of_a_large_repository_is_indexed(spark, tmp_path, name):
    spark.range(2_100).selectExpr("id AS s_suppkey", "0 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert differences(spark, connect(tmp_path), str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name]) == []
