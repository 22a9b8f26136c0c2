"""Every registered query of the drought engine against its DuckDB oracle."""

import os

import duckdb
import pytest

from drywell.plans import catalog, gridded, regrids, stored  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.execute(catalog.ORACLES[name])
    columns, expected = in_order([c[0] for c in want.description], want.fetchall())
    got_columns, got = in_order(df.columns, rows)
    assert got_columns == columns
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=1e-9) if all(isinstance(x, (int, float)) for x in a) else all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=1e-9)) for x, y in zip(a, b))


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_halves_are_rounded_up_whatever_the_order_of_sums(spark):
    """Means over 64 pairs that are exactly 110.8125 and 111.4625; DuckDB's own sums fall on either side by threads and runs."""
    rows = {r["month"]: r["MAE"] for r in catalog.QUERIES["mainland_pairs"](spark, "/root/testdata/sf0.01").where("month IN ('2001-08', '1995-12')").collect()}
    assert rows == {"2001-08": 110.813, "1995-12": 111.463}


def test_gbt_predict_fits_all_trees_to_all_rows(spark, monkeypatch):
    """What the query asks its trees for; they are not grown here."""
    asked, model = {}, catalog.model

    class Asked(Exception):
        pass

    class Trees:
        def __init__(self, **settings):
            asked.update(settings)

        def fit(self, data):
            asked["n"] = data.count()
            raise Asked

    monkeypatch.setattr(model, "GBTRegressor", Trees)
    with pytest.raises(Asked):
        catalog.QUERIES["gbt_predict"](spark, DATA)
    assert {k: asked[k] for k in ("maxIter", "stepSize", "maxDepth", "subsamplingRate")} == {k: model.PARAMS[k] for k in ("maxIter", "stepSize", "maxDepth", "subsamplingRate")}
    assert asked["maxIter"] == 800
    assert asked["n"] == catalog.history(spark, DATA).where("year < 2000").count()
