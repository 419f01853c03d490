"""The driver's entry points, also where the training-data subpackage can't be imported."""

import os
import subprocess
import sys

from conftest import ROOT

HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r} or name in {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
from assayflow.plans import queries
assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
print(sorted(set(entry.queries()) - set(queries.QUERIES)))
"""


def others(*hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    return out.stdout.strip(), out.stderr


def test_queries_without_what_the_subpackage_needs():
    """A missing library takes away the subpackage's queries alone, and is told; a missing folder isn't worth a word."""
    found, said = others("public_tokenizers")
    assert found == "[]" and ("public_tokenizers" in said or not os.path.isdir(f"{ROOT}/assayflow/llm"))
    found, said = others("assayflow.llm")
    assert found == "[]"
