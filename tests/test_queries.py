"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as ENTRY  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

from tessera.plans.queries import QUERIES  # noqa: E402

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_runs(spark):
    df = ENTRY.entry(spark)
    assert df.columns == ["img_name", "grid", "grid_ord", "class", "class_ord", "n"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_iterative():
    assert set(QUERIES) <= set(ENTRY.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = ENTRY.queries()[name](spark, SF_SMALL).toPandas()
    sql = ENTRY.oracle_sql().get(name)
    if sql is None:
        assert len(sp) > 0
        return
    dk = con.execute(sql).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
    for c in sc:
        assert str(sp[c].dtype) == str(dk[c].dtype), c


def test_fit_heads_beats_the_label_rate(spark):
    rows = ENTRY.queries()["fit_heads"](spark, SF_SMALL).collect()
    assert len(rows) == 10 and all(r["beats_prior"] for r in rows)
