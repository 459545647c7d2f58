"""Every registered query with SQL agrees with DuckDB on the smallest tables; the others run."""

import math

import pytest

from tests.oracle import difference, duck
from wakelane import registry

SF = "/root/testdata/sf0.001"
TRAINED = [n for n in registry.QUERIES if n not in registry.ORACLES]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF) is None


#: Rows of queries without SQL, by formula from the given tables.
ROWS = {
    "g15_coral_align": "SELECT count(*) FROM embeddings WHERE label < 5",
    "b1_normalize_columns": "SELECT count(*) FROM nation",
    "k21_project2d": "SELECT count(*) FROM embeddings",
    "i5_platt_calibrate": "SELECT count(*) FROM (SELECT CAST(('0x' || substr(md5('1:' || vec_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM embeddings) WHERE u < 0.3",
    "k13_isolation_forest": "SELECT count(*) FROM embeddings",
}


@pytest.mark.parametrize("name", TRAINED)
def test_rows_without_sql(spark, con, name):
    """Rows there are, of full width: no column without a value, no double that is not finite, no row twice."""
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)
    assert all(math.isfinite(r[c]) for c, t in df.dtypes if t == "double" for r in rows if r[c] is not None)
    assert len({repr(r) for r in rows}) == len(rows)
    auc = [r["auc"] for r in rows] if "auc" in df.columns else []
    assert all(0 <= x <= 1 for x in auc)
    if ROWS.get(name):
        assert len(rows) == con.execute(ROWS[name]).fetchone()[0]


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
    assert set(registry.ORACLES) <= set(registry.QUERIES)
