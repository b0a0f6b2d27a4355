"""Driver contract: entry smoke and all oracle twins at sf0.001."""
from collections import Counter

import duckdb

import __spark_entry__ as E
from tests.tables import SF_SMALL
from haggle.plans import registry
from haggle.sources.fixtures import TABLES


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "opening_price", "final_price", "outcome", "prize_gap", "strategy",
                          "intent_score", "reward"]
    assert df.count() > 0


def test_registry_complete():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def _norm(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def test_all_oracles(spark):
    """Every twin of the library's own queries on the smallest tables (the
    corpus operators have tests of their own)."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    registry.load_all()
    for name, sql in registry.ORACLES.items():
        sdf = registry.QUERIES[name](spark, SF_SMALL)
        cols = sorted(sdf.columns)
        s = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
        cur = con.execute(sql)
        dcols = [d[0] for d in cur.description]
        assert sorted(dcols) == cols, name
        d = Counter(tuple(_norm(r[dcols.index(c)]) for c in cols) for r in cur.fetchall())
        assert s == d, name
