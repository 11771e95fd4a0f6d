import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"p1_found", "p3_found", "p5_found"} <= set(e.queries())


def test_the_core_does_without_the_training_data_part(tmp_path):
    """The library is imported from a copy that lacks the optional subpackage."""
    import shutil

    shutil.copytree(ROOT / "quarrystone", tmp_path / "quarrystone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('p6_') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 70


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
