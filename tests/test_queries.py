"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kumiki.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    one = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(cols), sorted(tuple(one(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    r = duck.execute(plans.oracle_sql()[name])
    assert got == rows([c[0] for c in r.description], r.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_rerank_signals_are_of_every_item(spark):
    found = plans.queries()["rerank_features_topk"](spark, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").distinct()
    per = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count("intent_match").alias("asked"))
    assert per.count() == items.count() and per.filter("n <> 20 OR asked <> n * int(query_id % 3 > 0)").count() == 0
