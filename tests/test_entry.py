import os
import re

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_nothing_else_imports_the_training_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "skein")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", open(os.path.join(folder, f)).read()), f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_and_some_twins(spark):
    duckdb = pytest.importorskip("duckdb")
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    for name in ("bm25_all", "filter_not", "metadata_values", "rrf", "scan_changes", "retrieval_metrics"):
        df = entry.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        rel = c.execute(entry.oracle_sql()[name])
        at = [[x[0] for x in rel.description].index(k) for k in cols]
        plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
        want = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
        assert sorted(str([plain(r[k]) for k in cols]) for r in df.collect()) == want, name
