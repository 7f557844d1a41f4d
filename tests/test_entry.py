"""The entry works without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert len(q) > 80 and set(s) <= set(q), (len(q), set(s) - set(q))
print(sum(k.startswith("op") or k == "pipeline" for k in q))
"""


def copy(folder, *gone):
    """A copy of the library in which the parts named are missing."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "rosterlake"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, folder / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, folder / name)
    for name in gone:
        path = folder / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()


def looked(folder) -> str:
    env = {**os.environ, "PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-c", LOOK], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.strip()


def test_without_the_package(tmp_path):
    copy(tmp_path, "rosterlake/llm")
    assert looked(tmp_path) == "0"


def test_without_package_and_pipeline(tmp_path):
    copy(tmp_path, "rosterlake/llm", "corpus_pipeline.py")
    assert looked(tmp_path) == "0"
