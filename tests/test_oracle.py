"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

from tests.conftest import SF_SMALL
from tidemark.plans.registry import ORACLES, QUERIES, load_all

load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    from tools.oracle_check import frame_rows, type_diffs

    sdf = QUERIES[name](spark, SF_SMALL)
    schema = sdf.schema
    scols, srows = frame_rows(sdf.toPandas())
    dcols, drows = frame_rows(duck.execute(ORACLES[name]).fetchdf())
    assert scols == dcols
    assert len(srows) == len(drows)
    assert srows == drows
    assert not type_diffs(schema, duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
