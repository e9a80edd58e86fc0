import hashlib
import unicodedata

import duckdb
import pandas as pd
import pytest

from attest.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLES:
        assert name in BY_FORCE
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    same = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(same(got), same(want), check_dtype=False)


#: Queries that SQL cannot express, each with its own test below.
BY_FORCE = {"unicode_keys"}


def test_unicode_keys_are_brute_force(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        key = "".join(filter(str.isalnum, unicodedata.normalize("NFKC", r.text or "").upper()))
        letters = "".join(filter(str.isalpha, unicodedata.normalize("NFKD", (r.text or "").upper())))
        want[r.doc_id] = (hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest(), len(letters))
    assert {r.doc_id: (r.key_sha256, r.letters) for r in catalog.QUERIES["unicode_keys"](spark, sf_dir).collect()} == want


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_field_closure_is_of_the_whole_graph(spark, tmp_path):
    """Needs cross any blocks of keys: every part reaches the smallest ones."""
    keys = range(1, 300)
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    want = set()
    for k in keys:
        open_, seen = [k], set()
        while open_:
            x = open_.pop()
            if x not in seen:
                seen.add(x)
                open_ += [y for y in (x // 2, x // 3, 12 if x == 6 else x) if y > 0]
        want |= {(k, x) for x in seen}
    rows = catalog.QUERIES["field_closure"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.root, r.name) for r in rows} == want and (299, 1) in want


def test_adaptive_bands_sends_no_table_to_the_driver(spark, sf_dir):
    """Lines and bands are as many as customers, however small their file is."""
    df = catalog.QUERIES["adaptive_bands"](spark, sf_dir)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
