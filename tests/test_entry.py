"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registered():
    import __spark_entry__ as e

    assert len(e.queries()) >= 60
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_part(tmp_path):
    """The rest imports when the corpus operators and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, corpus = out.stdout.split()
    assert int(n) >= 50 and corpus == "False"
