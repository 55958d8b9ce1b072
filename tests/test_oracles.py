"""Every query against its SQL, at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from barloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(v):
        if pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_divergences_equal_sql_with_prices_of_zero(spark, tmp_path):
    # Lines from or to a price of zero have no slope or amplitude: no row, neither here nor there.
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    c.execute(f"""copy (select event_id, ts, user_id, event_type, case when event_type = 'click' and value < 0.5 then 0 else value end as value, props
      from '{DATA.parent}/sf0.01/events.parquet' where event_type in ('click', 'purchase')) to '{tmp_path}/events.parquet' (format parquet)""")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = catalog.queries()["level_divergences"](spark, str(tmp_path)).toPandas(), c.execute(SQL["level_divergences"]).df()
    assert plain(got) == plain(want)
    assert len(got.query("measure == 'amp'")) < len(got.query("measure == 'diff'"))
