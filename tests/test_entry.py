import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_works_without_the_training_data_operators(tmp_path, also):
    """With the operators gone, whether the pipeline went with them or not; a folder with old compiled files may be left."""
    for name in ("__spark_entry__.py", "factloom", "tests", *(name for name in also if os.path.exists(os.path.join(ROOT, name)))):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(source) else {}))
    os.makedirs(tmp_path / "factloom" / "llm" / "__pycache__")
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    # the other tests are found and import what they need
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, check=True, stdout=subprocess.DEVNULL, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["a", "b", "c"] and out.count() == 1200
