import __spark_entry__ as entry
from roadlens.plans import queries as engine


def test_entry_and_registry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(engine.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(tmp_path):
    """The entry module works where the subpackage and the pipeline are missing."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/roadlens", f"{tmp_path}/roadlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[-2:] == [str(len(engine.queries())), str(len(engine.oracle_sql()))], out.stderr
