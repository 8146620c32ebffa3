"""The corpus queries against their SQL, the pipeline against its stages, and what the driver asks of the repository."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kumiki.llm import queries as corpus
from kumiki.llm.decontaminate import decontaminate
from kumiki.llm.exact_dedup import exact_dedup
from kumiki.llm.jaccard_join import jaccard_components

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = corpus.queries()[name](spark, SF)
    r = con.execute(corpus.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(r.fetchall(), key=str)


def test_all_ten_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "exact_dedup":
            assert ids == {r.doc_id for r in exact_dedup(before, keep="largest").filter("kept").collect()}
        if name == "jaccard_join":
            assert ids == {r.component_id for r in jaccard_components(before, k=5, percent=80).collect()}
        if name == "decontaminate":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids == {r.doc_id for r in decontaminate(before, items).filter("NOT contaminated").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "kumiki").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), p
