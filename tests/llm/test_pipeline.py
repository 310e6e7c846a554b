import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from checks.compare import connect, difference
from givetide.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_statement(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, connect(SMALL).execute(SQL[name]).df()) is None


def test_stages_keep_the_columns_of_documents(spark):
    from corpus_pipeline import STAGES

    docs = given = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == given.columns
        assert docs.schema.simpleString() == given.schema.simpleString()
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids
        assert len(now) < len(ids) or stage.__name__ in ("keep_clean",)
        ids = now
    encoded = STAGES[-1][1](spark, docs, SMALL)
    assert encoded.count() == docs.count()


def test_run_is_the_stages_one_after_another(spark):
    import corpus_pipeline

    result = corpus_pipeline.run(spark, SMALL)
    got = result.orderBy("start").collect()
    home = Path(result.inputFiles()[0].removeprefix("file://")).parent.parent
    assert [f.name for f in home.iterdir()] == [corpus_pipeline.STAGES[-1][0].split()[0].replace("/", "-")]
    assert [r["start"] for r in got][1:] == [r["start"] + r["n_tokens"] for r in got][:-1]
    texts = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    assert {r["doc_id"] for r in got} < {i for i, _ in texts}


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


def test_nothing_else_imports_the_package():
    code = "import sys, checks.queries, checks.oracle, givetide.plans.dashboard; print([m for m in sys.modules if m.startswith('givetide.llm')])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[]"
