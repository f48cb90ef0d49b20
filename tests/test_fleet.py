"""The re-aim's key property: a fleet run equals the union of the runs of
each server and snapshot (every operator works per fleet key)."""

import pytest
from pyspark.sql import functions as F

import opslens.suite_cases as cases
from opslens.sources.bindings import relation
from opslens.suite import CASES
from tools.oracle_check import rows_of

from .conftest import SF_SMALL

KEYS = ["server_name", "snapshot_id"]


def _rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


# The cases of sources and sinks choose and merge snapshots, which is not done snapshot by snapshot.
OPERATORS = sorted(n for n, (fn, _) in CASES.items() if fn.__module__ == cases.__name__)


@pytest.mark.parametrize("name", OPERATORS)
def test_fleet_equals_union(spark, name, monkeypatch):
    """Each case is run on the whole fixtures and on one server's snapshot:
    the rows of that server and snapshot must be the same."""
    whole = CASES[name][0](spark, SF_SMALL)
    if not set(KEYS) <= set(whole.columns):
        pytest.skip("result without fleet key")
    server, snapshot = "srv2", 1

    def one(spark, d, *names):
        out = [relation(spark, d, n).where((F.col("server_name") == server) & (F.col("snapshot_id") == snapshot)) for n in names]
        return out[0] if len(out) == 1 else out

    want = _rows(whole.where((F.col("server_name") == server) & (F.col("snapshot_id") == snapshot)))
    monkeypatch.setattr(cases, "rel", one)
    assert _rows(CASES[name][0](spark, SF_SMALL)) == want
