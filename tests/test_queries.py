"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from knotwork import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, sf_dir, db, name):
    got = core.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(core.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    as_text = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    a, b = as_text(got), as_text(want)
    assert len(a) == len(b)
    assert a.equals(b), a.compare(b).head()


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, sf_dir, name):
    core.queries()[name](spark, sf_dir).collect()


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["type", "name", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_citations_of_short_and_cut_items(spark, tmp_path, monkeypatch):
    items = [(1, "light and darkness"), (2, "The river of time runs on without end"), (3, "ight shines in the dark of every nigh"), (4, "one"), (5, None), (6, "a b c d e f"), (7, " a  leading and odd\tspace with more ")]
    docs = [(1, 'He said "The river of time runs on without end".'), (2, "a light shines in the dark of every night"), (3, "on light and darkness, someone"), (4, None), (5, "(a b c d e f)"), (6, "so a  leading and odd\tspace with more of it"), (7, "a leading and odd space with more of it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, i) for d, t in docs for i, q in items if t and q and q in t}
    for size in (1 << 20, 8):
        monkeypatch.setattr(core, "SHORT_SLICE", size)
        assert {tuple(r) for r in core.queries()["citation_edges"](spark, str(tmp_path)).collect()} == want
