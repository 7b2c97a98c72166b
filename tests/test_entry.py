"""Driver contract: entry() runs, every registered query runs on the smoke
tables, and every oracle key names a registered query."""

import __spark_entry__ as E


def test_entry_board(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["col_pos", "col_id", "col_title"]


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 70


def test_all_queries_run_smoke(spark):
    bad = {}
    for name, fn in sorted(E.queries().items()):
        try:
            fn(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        except Exception as ex:  # noqa: BLE001
            bad[name] = str(ex)[:300]
    assert not bad, bad


def test_registry_imports_without_a_session():
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_python_worker_queries_from_another_folder(tmp_path):
    """The driver may import the entry from elsewhere with a plain session:
    pandas-backed queries must still find the package on the workers."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "q = E.queries()\n"
        "print(q['breaker_windows'](s, '/root/testdata/sf0.001').count(), q['top_k'](s, '/root/testdata/sf0.001').count())\n"
    ) % root
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600, env=env)
    assert out.returncode == 0, out.stderr[-3000:]


def test_a_name_stands_for_one_query():
    import pytest
    from postingflow.plans import catalog
    catalog.load_all()
    assert "in_pipeline" in catalog.QUERIES and "pipeline" not in catalog.QUERIES
    with pytest.raises(ValueError):
        E._merged({"a": 1}, {"a": 2})
    with pytest.raises(ValueError):
        catalog.register("in_pipeline")(lambda spark, sf: None)


def test_entry_without_the_training_data_folders(tmp_path):
    """A copy without the optional files, but with a left-over cache folder."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns(".git", "__pycache__", "tests", "llm", "corpus_pipeline.py")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    os.makedirs(tmp_path / "repo" / "postingflow" / "llm" / "__pycache__")
    code = "import __spark_entry__ as E; q = E.queries(); print(len(q), 'pipeline' in q, 'in_pipeline' in E.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split()[1:] == ["False", "True"]
