"""Queries with a DuckDB twin against it, on the smallest tables."""

import duckdb
import pytest

from weftline.llm import registry


def rows(table, names):
    return sorted(repr(r) for r in table.select(", ".join(f'"{n}"' for n in names)).fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf, tmp_path):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    registry.queries()[name](spark, sf).coalesce(1).write.parquet(str(tmp_path / "out"))
    own, sql = duck.sql(f"SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')"), duck.sql(registry.oracle_sql()[name])
    assert dict(zip(own.columns, map(str, own.types))) == dict(zip(sql.columns, map(str, sql.types)))
    assert rows(own, sorted(own.columns)) == rows(sql, sorted(own.columns))
