"""The driver contract: the flagship query, matching names, and queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].cut_value == 1497 and rows[0].variant == "exact"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


@pytest.mark.parametrize("name", ["edges_merged", "degree_hist", "contract_by_region", "components_labels", "relabel_first_seen", "prefix_offsets", "region_min_cut", "matrix_long_form", "pagerank_k", "trial_plan"])
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(row) for row in found.fetchall()), key=str)
    got = sorted((tuple(r) for r in entry.queries()[name](spark, DATA).select(*columns).collect()), key=str)
    assert got == want


def test_region_separation_against_sql(spark):
    """On sf0.001 region 1 alone (1677) would be the least cut from region 0, but the SQL leaves region 4 on region 1's side."""
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    want = con.execute(entry.oracle_sql()["region_separation"]).fetchall()
    assert want == [(1908,)] and [tuple(r) for r in entry.queries()["region_separation"](spark, DATA).collect()] == want


def test_entry_without_the_optional_subpackage(tmp_path):
    """The library and its queries do not need graphloom.llm and the pipeline; another missing module is an error."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    run = lambda code: subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    found = run("import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))")
    assert found.returncode == 0 and found.stdout.split()[1] == "False" and int(found.stdout.split()[0]) > 50, found.stderr
    (copy / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in run("import __spark_entry__").stderr
