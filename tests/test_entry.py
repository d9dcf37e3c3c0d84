"""Driver contract: entry() runs; every registered query equals its DuckDB oracle on sf0.001."""

import pytest

import __spark_entry__ as entry
from tests.conftest import built
from scanledger.plans import catalog
from scanledger.plans.verify import compare, duck_connection

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "status" in df.columns and "fingerprint" in df.columns


def test_every_query_has_an_oracle():
    # compressed bytes have no SQL form: test_documents decodes them
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"sarif_upload_bodies"} and set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    ok, msg = compare(spark, duck, lambda s, d: built(s, name, d), entry.oracle_sql()[name], SF)
    assert ok, msg


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE",
                 "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_column_types_match_oracle(spark, duck, name):
    sdf = built(spark, name, SF)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    rel = duck.sql(f"SELECT * FROM ({entry.oracle_sql()[name]}) LIMIT 0")
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert spark_types == duck_types
