"""The library without its training-text operators: everything else still registers and runs."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
names = e.queries()
assert "c1_order_pages" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
from pagetext.session import build_session
spark = build_session("alone", "local[2]", **{"spark.sql.shuffle.partitions": "2"})
assert names["f1_substitute"](spark, "/root/testdata/sf0.001").limit(1).count() == 1
spark.stop()
print(len(names))
"""


def test_queries_without_the_folders(tmp_path):
    for name in ("pagetext", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 150
