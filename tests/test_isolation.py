"""The library without its training-data operators."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert e.__file__.startswith(sys.argv[1])
found = e.queries()
assert "routes" in found and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in [*found, *e.oracle_sql()])
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.entry(spark).count())
"""


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_without_llm(tmp_path, with_pipeline):
    skipped = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    out = subprocess.run([sys.executable, "-c", RUN, str(tmp_path / "copy")], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("rows")[1]) > 0
