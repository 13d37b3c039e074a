"""The driver entry: names agree, and it works without the optional part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


CODE = "import warnings; warnings.simplefilter('error'); import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"


def without(tmp_path, *gone):
    def left_out(folder, names):
        return [n for n in names if n in (".git", "__pycache__", "spark-warehouse", *gone)]

    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    return {"cwd": tmp_path / "repo", "env": {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, "timeout": 120}


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_the_optional_part(tmp_path, gone):
    subprocess.run([sys.executable, "-c", CODE], **without(tmp_path, *gone), check=True)


def test_a_broken_optional_part_is_told(tmp_path):
    """What is there but cannot be imported is left out with a warning, not in silence."""
    given = without(tmp_path, "llm", "corpus_pipeline.py")
    (given["cwd"] / "corpus_pipeline.py").write_text("import something_that_is_not_here")
    ran = subprocess.run([sys.executable, "-c", CODE.replace("'error'", "'always'")], **given, capture_output=True, text=True)
    assert ran.returncode == 0 and "something_that_is_not_here" in ran.stderr


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir("/root/testdata/sf0.001"):
        out = entry.entry(spark)
        assert out.columns == ["user_id", "bucket", "spent"] and out.count() > 0
