import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_and_sql_go_together():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "column_stats_basic" in sql


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6


def test_works_without_the_corpus_package_and_hides_no_other_error(tmp_path):
    """The optional package may be missing; an error within it is not taken for that."""
    for name in ("__spark_entry__.py", "tablewright"):
        (tmp_path / name).symlink_to(REPO / name)
    code = "import __spark_entry__ as e; print(len(e.queries()) > 30, any(n.startswith('op') for n in e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.split() == ["True", "False"]
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    assert "a_module_that_is_missing" in run().stderr
