"""The engine imports, and its queries are registered, without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("cairnledger.llm", "corpus_pipeline")):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_corpus_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for path in (ROOT / "cairnledger").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
