"""The operators that SQL can state, against DuckDB on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lettermill.llm import queries


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    relation = db.sql(queries.ORACLE_SQL[name])
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == want and want
