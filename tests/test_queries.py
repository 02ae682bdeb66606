"""Each registered query against its SQL, run by DuckDB over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from quire.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = duck.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_normalizer_is_not_vacuous(spark):
    from quire.plans.text import pages

    raw = pages(spark, FOLDER).toPandas().set_index("page")["raw"]
    done = registry.QUERIES["normalize_page"](spark, FOLDER).toPandas().set_index("page")["text"]
    assert (raw != done.reindex(raw.index)).sum() > len(raw) // 2
    assert not done.str.contains("[ ​­ﬁ]|  |-\nly").any()


#: Books of so many pages that their labels have five digits; the last pages stand apart.
LONG_BOOKS = "SELECT page * 20 + book AS p_partkey FROM range(3) b(book), (SELECT unnest(range(0, 30)) AS page UNION ALL SELECT unnest(range(9950, 11200)) UNION ALL SELECT unnest(range(12000, 12040))) p"


def same_on_long_books(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY ({LONG_BOOKS}) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    got = con.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), names)


def test_numbering_of_long_books(spark, tmp_path):
    same_on_long_books(spark, tmp_path, "numbering_series")


def test_labels_of_long_books(spark, tmp_path):
    same_on_long_books(spark, tmp_path, "printed_labels")
