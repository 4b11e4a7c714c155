"""Every query with SQL gives the SQL's rows on DuckDB; the others give rows of a stable schema."""

import datetime as dt
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tests.conftest import plain
from tidewater.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(name, spark, duck, sf):
    df = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    a = Counter(tuple(map(plain, r)) for r in df.collect())
    b = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(name, spark, sf):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.take(1)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).take(1)


def test_standardize_asinh_keeps_the_sign_of_nought(spark, tmp_path):
    closes = {dt.datetime(2024, 1, 31): [100.0, 100.0, 100.0], dt.datetime(2024, 2, 29): [110.0, 99.99999, 90.0]}
    rows = [{"l_suppkey": s, "l_shipdate": d, "l_quantity": 1.0, "l_extendedprice": x} for d, prices in closes.items() for s, x in enumerate(prices)]
    pd.DataFrame(rows).astype({"l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    text = lambda found: sorted((m, s, str(x)) for m, s, x in found)
    got = text(map(tuple, registry.QUERIES["standardize_asinh"](spark, str(tmp_path)).select("month", "sid", "score").collect()))
    assert got == text(con.execute(registry.ORACLE["standardize_asinh"]).fetchall())
    assert [x for _, s, x in got if s == 1] == ["0.0", "-0.0"]


def test_standardize_asinh_of_odd_months_is_as_its_sql(spark, tmp_path):
    rows = [(s, dt.datetime(2024, m, d), 2.0, 100.0 + 7 * s + (s * m * d) % 11) for s in range(9) for m in range(1, 7) for d in (5, 20)]
    rows += [(20, dt.datetime(2024, 3, 5), 1.0, 50.0), (20, dt.datetime(2024, 4, 5), 1.0, 55.0), (20, dt.datetime(2024, 6, 5), 1.0, 60.0)]  # begins late: a null score
    rows += [(21, dt.datetime(2024, 5, 5), 1.0, 40.0), (21, dt.datetime(2024, 5, 20), None, None), (21, dt.datetime(2024, 6, 5), 1.0, 50.0)]  # no close on its last day
    rows += [(3, None, 1.0, 10.0), (None, dt.datetime(2024, 2, 5), 1.0, 5.0), (None, dt.datetime(2024, 3, 5), 1.0, 6.0)]
    rows += [(s, dt.datetime(2024, m, 5), 1.0, 10.0 * m) for s in (30, 31, 32) for m in (8, 9)]  # in September all grow alike
    rows += [(40, dt.datetime(2024, 11, 5), 1.0, 0.0), (40, dt.datetime(2024, 12, 5), 1.0, 5.0), (41, dt.datetime(2024, 12, 5), 0.0, 5.0)]  # divided by nought
    frame = pd.DataFrame(rows, columns=["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"])
    frame.astype({"l_suppkey": "Int64", "l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = Counter(tuple(map(str, r)) for r in con.execute(registry.ORACLE["standardize_asinh"]).fetchall())
    got = Counter(tuple(map(str, r)) for r in registry.QUERIES["standardize_asinh"](spark, str(tmp_path)).select("month", "sid", "score").collect())
    assert got == want
    assert got["2024-09-01", "30", "nan"] == 1 and not any(m == "None" for m, _, _ in got)
