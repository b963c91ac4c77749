import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_statement_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        import __spark_entry__ as entry

        assert entry.entry(spark).count() == 10


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120)
