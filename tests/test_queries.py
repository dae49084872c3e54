import pytest

from seriate import cleaning, cleaning_sql
from seriate import queries as ordered

QUERIES, ORACLES = {**ordered.QUERIES, **cleaning.QUERIES}, {**ordered.ORACLES, **cleaning_sql.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ratios_of_all_users(spark):
    """A ratio for each user of the table, not of a few IDs; the filters by value take a good part of the rows."""
    sf = "/root/testdata/sf0.001"
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    assert {r[0] for r in QUERIES["text_max_prev_ratio_users"](spark, sf).select("user_id").collect()} == {r[0] for r in users.collect()}
    assert QUERIES["text_max_prev_ratio"](spark, sf).first()[0] > 1
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert QUERIES["where_range"](spark, sf).count() > orders / 10
