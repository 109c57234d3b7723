"""Queries against their SQL over the smallest tables."""

import oracle
import pytest

from corpusq import registry

SF = "/root/testdata/sf0.001"
LAYERS: dict = {}


@pytest.fixture(autouse=True)
def one_gold(monkeypatch):
    make = registry.gold

    def gold(spark, sf_dir):
        if sf_dir not in LAYERS:
            LAYERS[sf_dir] = make(spark, sf_dir).cache()
        return LAYERS[sf_dir]

    monkeypatch.setattr(registry, "gold", gold)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLE_SQL:
        oracle.compare(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])
    else:
        assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_layer_is_written_once_and_again_if_it_is_gone(spark, monkeypatch):
    calls = []
    make = registry.gold
    monkeypatch.setattr(registry, "gold", lambda *a: calls.append(a) or make(*a))
    monkeypatch.setattr(registry, "_LAYERS", {})
    n = registry.layer(spark, SF).count()
    assert registry.layer(spark, SF).count() == n and len(calls) == 1
    next(iter(registry._LAYERS.values()))[0].clear()
    assert registry.layer(spark, SF).count() == n and len(calls) == 2
