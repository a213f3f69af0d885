"""The entry module, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry_module

ROOT = os.path.dirname(os.path.abspath(entry_module.__file__))


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and its tests everything else still imports, the pipeline's file staying behind."""
    for name in ("repolens", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not [n for n in q if n.startswith('op')]; import bench; assert set(bench.HEADLINE) <= set(q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
