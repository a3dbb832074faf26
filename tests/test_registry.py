import duckdb
import pytest

from paylint.plans import checks, exports, published, registry, review

TABLES = ("orders", "customer", "nation", "region", "lineitem", "documents", "part", "supplier", "events")
QUERIES = registry.queries() | review.queries() | checks.queries() | exports.queries() | published.queries()
SQL = registry.oracle_sql() | review.oracle_sql() | checks.oracle_sql() | exports.oracle_sql() | published.oracle_sql()


def shown(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    wanted = db.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()
    rows = got.select(*(f"`{c}`" for c in columns)).collect()
    assert rows
    assert shown(rows) == shown(wanted)
