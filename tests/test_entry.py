import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

GONE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("shelfmark.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert q and set(o) <= set(q) and not any(n.startswith("op1") or n == "pipeline" for n in q), sorted(q)
"""


def test_entry_without_the_training_text_part():
    subprocess.run([sys.executable, "-c", GONE], cwd=ROOT, check=True, timeout=120)


def test_entry_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=ROOT, check=True, timeout=120)
