"""The driver's entry module with and without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

HIDE = """
import sys, warnings
warnings.simplefilter("ignore")
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r} or name in {hidden!r}:
            raise ImportError(name + " is hidden")
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
found = entry.queries()
assert set(entry.oracle_sql()) <= set(found)
print(sum(n.startswith("op") for n in found), "pipeline" in found, len(found) > 100)
"""


@pytest.mark.parametrize(
    ("hidden", "said"),
    [(("topolake.llm", "corpus_pipeline"), "0 False True"), (("topolake.llm",), "0 False True"), (("zstandard",), "0 False True")],
)
def test_entry_without_its_optional_parts(hidden, said):
    run = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip() == said, run.stderr
