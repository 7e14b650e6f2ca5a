"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import datetime as dt
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from sf_paths import SF_SMALL
from txsentry.operators import models as M
from txsentry.plans import scoring as P

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
ORACLE = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


def test_every_query_registered_with_callable():
    assert len(QUERIES) >= 100
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture
def few_rounds(monkeypatch):
    """What the model queries return holds for any number of rounds; the full
    number (``test_full_rounds``) takes minutes a query."""
    for fit, rounds in ((M.train_gbt, 12), (M.train_rf, 20)):
        monkeypatch.setattr(fit, "__defaults__", (rounds, *fit.__defaults__[1:]))
    args = list(P.train.__defaults__)
    args[2] = 12
    monkeypatch.setattr(P.train, "__defaults__", tuple(args))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, few_rounds, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.sql(ORACLE[key])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    drows = Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert srows == drows
