import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(k.startswith('op') for k in e.queries()))"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_subpackage(tmp_path, left):
    """Also where the pipeline's file is still there."""
    shutil.copytree(REPO / "waymark", tmp_path / "waymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *left):
        shutil.copy(REPO / name, tmp_path)
    found = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(found[0]) > 90 and int(found[1]) > 80 and found[2:] == ["False", "False"]
    subprocess.run([sys.executable, "-c", "import bench"], cwd=tmp_path, check=True)
