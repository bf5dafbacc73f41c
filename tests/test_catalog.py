"""Every registered query of the core against its SQL, at the smallest scale."""

import functools

import pytest

import __spark_entry__ as entry
from checks import catalog_rows, catalog_series, catalog_stats, catalog_stream
from checks.compare import compare, connect
from checks.registry import ORACLES, QUERIES
from fleetgauge.session import written

SF = "/root/testdata/sf0.001"
SHARED = ("telemetry", "faulty", "errors", "scaled")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Source tables that most queries derive anew are made once here."""
    made = {}

    def once(fn):
        @functools.wraps(fn)
        def run(spark, sf, *more, **named):
            key = (fn.__name__, fn.__module__, sf, more, tuple(named.items()))
            if key not in made:
                made[key] = written(fn(spark, sf, *more, **named), "shared")
            return made[key]

        return run

    with pytest.MonkeyPatch.context() as patch:
        for module in (catalog_rows, catalog_series, catalog_stats, catalog_stream):
            for name in SHARED:
                if hasattr(module, name):
                    patch.setattr(module, name, once(getattr(module, name)))
        patch.setattr(catalog_stream, "_live", functools.cache(catalog_stream._live))  # three queries look at one run
        yield


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
