"""The library without its text-corpus subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ALONE = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("corpusloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Missing())
from corpusloom.operators import components, dedup, features, joins, metrics, sampling
from corpusloom.sources import archives, metadata, sinks
from corpusloom.streaming import jobs
from corpusloom.plans import catalogue
print(len(catalogue.QUERIES))
"""


def test_nothing_else_imports_the_subpackage():
    done = subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 80, done.stderr
