import pytest

from tests.oracle import connect
from tidewell.plans import catalogue


@pytest.mark.parametrize(("name", "table"), [("doc_list_all", "documents"), ("version_order_all", "part")])
def test_every_row_in_the_order_of_the_sql(spark, sf_dir, name, table):
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, sf_dir).collect()]
    assert len(got) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count() > 60
    assert got == connect(sf_dir).sql(catalogue.ORACLES[name]).fetchall()
