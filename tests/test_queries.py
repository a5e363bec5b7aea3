"""Every query that has SQL against DuckDB, and the others run."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from spanloom.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    got = Counter(tuple(r) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    r = sql.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert got == Counter(tuple(x[i] for i in at) for x in r.fetchall())


def test_web_records_whose_urls_repeat(spark, sql, tmp_path):
    rows = [(1, "http://a/x", "<p>one two</p>"), (2, "http://a/x", "three"), (3, "http://a/x", "three"), (4, "http://b/y z", "four"), (5, "://", "five six"), (6, None, "seven"), (7, "http://c/", None), (8, "http://c/", "--")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["src_web_records"](spark, str(tmp_path))
    want = sql.execute(ORACLES["src_web_records"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert Counter(map(tuple, got.select("page_id", "url", "words").collect())) == Counter(want) and len(want) == 6
