import __spark_entry__ as entry


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).count() > 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60


def test_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "versicle", tmp_path / "versicle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'entity_counts' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
