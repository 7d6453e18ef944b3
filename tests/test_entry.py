"""The entry points, also without the training-text package."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["path", "title", "artist", "audio_id", "output", "error"] and df.count() == 100


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_text_package(tmp_path):
    shutil.copytree(REPO / "phonolith", tmp_path / "phonolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
