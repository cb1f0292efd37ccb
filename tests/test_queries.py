"""Every query that SQL can restate gives the rows of its SQL; the others give rows."""

import math

import duckdb
import pandas as pd
import pytest

from folioflow.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(round(x, 6))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    expected = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_garbled_words_are_split_once(spark, sf_dir):
    # Each use of a word split the whole text again.
    plan = QUERIES["p10_phantom_tables"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_printable_ratio_of_odd_texts(spark, tmp_path):
    # Texts that are null went missing, and some halves were rounded up that the SQL rounds down.
    odd = [None, "plain", "a\tb\r\n\xa0c"] + ["x" * n + "\n" * (640 - n) for n in (41, 323, 333, 639)]
    pd.DataFrame({"doc_id": range(len(odd)), "text": odd}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got = QUERIES["f3_printable_ratio"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(SQL["f3_printable_ratio"]).df()) and len(got) == len(odd)
