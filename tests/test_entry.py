"""The driver's entry module, with and without the llm operators, and every query's SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from foliant.plans import queries as Q

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns[:3] == ["doc_id", "title", "source"] and out.count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(Q.SQL) == set(Q.QUERIES)


def test_without_the_llm_operators(tmp_path):
    for name in ("foliant", "__spark_entry__.py"):
        src = REPO / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'detect_title' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_errors_within_the_llm_operators_are_not_hidden(tmp_path):
    shutil.copytree(REPO / "foliant", tmp_path / "foliant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "foliant/llm").mkdir()
    (tmp_path / "foliant/llm/__init__.py").write_text("")
    (tmp_path / "foliant/llm/queries.py").write_text("import not_there\n")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode and "not_there" in run.stderr


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    v = float(v) if type(v).__name__ == "Decimal" else v
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_and_sql_agree(spark, tables, name):
    rel = tables.sql(Q.SQL[name])
    cols = sorted(rel.columns)
    want = sorted(str([plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols]) for r in rel.fetchall())
    rows = Q.QUERIES[name](spark, DATA)
    assert sorted(rows.columns) == cols
    assert sorted(str([plain(r[c]) for c in cols]) for r in rows.collect()) == want


@pytest.mark.parametrize("name", ["merge_adjacent", "spans_to_lines", "detect_wrapped_title", "ocr_budget"])
def test_fold_queries_do_not_depend_on_partitions(spark, name):
    a = Q.QUERIES[name](spark, DATA).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = Q.QUERIES[name](spark, DATA).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = Q.QUERIES["page_char_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_scoring_costs_one_exchange_of_lines(spark):
    plan = Q.QUERIES["line_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
