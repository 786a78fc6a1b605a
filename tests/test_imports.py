"""Each module imports by itself, in whatever order."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

# One interpreter loads what all need, and a fork of it imports one module each.
ALONE = """
import os, sys
import pandas, pyarrow, pyspark.sql.functions, pyspark.ml
for name in sys.argv[1:]:
    if (pid := os.fork()) == 0:
        try:
            __import__(name)
        except BaseException as e:
            print(name, repr(e), flush=True)
        os._exit(0)
    os.waitpid(pid, 0)
"""


def test_every_module_imports_alone():
    files = [p for p in (ROOT / "tidemark").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    names = sorted(".".join(p.relative_to(ROOT).with_suffix("").parts).removesuffix(".__init__") for p in files)
    assert "tidemark.plans.books" in names
    run = subprocess.run([sys.executable, "-c", ALONE, *names, "__spark_entry__"], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert (run.stdout, run.returncode) == ("", 0), run.stderr
