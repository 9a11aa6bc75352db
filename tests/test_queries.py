"""Every query with SQL against DuckDB on the same tables; the others by their shape."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lettermill import archive, plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return db

#: Results that the tables leave empty; their semantics are tested on small fixtures.
EMPTY = ("near_duplicates", "coordinated_timing", "coordinated_timing_greedy", "orphan_anti_join")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bytes | bytearray):
        return hashlib.sha256(value).hexdigest()
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    frame = plans.QUERIES[name](spark, sf_dir)
    relation = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    order = [relation.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert got == want, (list((got - want).items())[:4], list((want - got).items())[:4])
    assert got or name in EMPTY, "an empty result shows nothing"


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_run(spark, sf_dir, name):
    frame = plans.QUERIES[name](spark, sf_dir)
    assert frame.columns
    rows = frame.count()
    assert rows > 0 or name in EMPTY


def test_quotes_by_the_whole_ladder(spark, tmp_path):
    quotes = [(1, "Alpha, beta; gamma delta epsilon!"), (2, "a räumliche rearrangement of it"), (3, "plain words"), (4, "not there"), (5, " "), (6, "!!")]
    docs = [(10, "so alpha beta gamma (delta) epsilon"), (11, "a raeumliche rearrange-\nment of it"), (12, "PLAIN  words"), (13, None), (14, "plainwords"), (15, "what!!")]
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in plans.QUERIES["quote_match_state"](spark, str(tmp_path)).select("item_id", "doc_id", "state").collect()}
    assert got == {(1, 10, "exact"), (2, 11, "near_exact"), (3, 12, "exact"), (6, 15, "exact")}
    assert tuple(plans.QUERIES["evidence_verify"](spark, str(tmp_path)).select("total", "exact", "near_exact").first()) == (6, 3, 1)


@pytest.mark.parametrize("name", ["attachment_stats", "batch_hydration", "entity_reextraction_concat", "full_hydration", "relationship_summary"])
def test_more_line_items_take_more_partitions(spark, sf_dir, duck, monkeypatch, name):
    monkeypatch.setattr(archive, "LINES_A_TASK", 500)
    n = archive.parts(spark, sf_dir)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"hashpartitioning\((.*), (\d+)\)", plan)
    assert exchanges and all(int(count) == n or keys.split("#")[0] in ("email", "extension") and "," not in keys for keys, count in exchanges), exchanges
    test_matches_sql(spark, sf_dir, duck, name)


def test_paths_read_the_letters_once(spark, sf_dir):
    assert "l_orderkey" not in plans.QUERIES["k_paths"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
