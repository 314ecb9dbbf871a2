"""Every query with SQL against DuckDB on the smallest tables; the others are in ``test_values``."""

import os

import duckdb
import pytest

from tessitura.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def _sorted(frame):
    cols = sorted(frame.columns)
    return frame[cols].sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = _sorted(registry.QUERIES[name](spark, SF).toPandas()), _sorted(duck.execute(registry.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert ((got[c] - want[c]).abs() <= 2e-6 + 1e-8 * want[c].abs()).all(), c
        else:
            assert (got[c] == want[c]).all(), c


def test_every_other_query_has_a_value_test():
    from pathlib import Path

    source = Path(__file__).with_name("test_values.py").read_text()
    assert [n for n in sorted(set(registry.QUERIES) - set(registry.ORACLES)) if f'"{n}"' not in source] == []
