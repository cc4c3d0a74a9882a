"""The entry module with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("without", [["tabsight/llm"], ["tabsight/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports_without_optional_parts(tmp_path, without):
    skip = {str(ROOT / w) for w in without}
    shutil.copytree(ROOT / "tabsight", tmp_path / "tabsight", ignore=lambda folder, names: [
        n for n in names if n == "__pycache__" or str(Path(folder) / n) in skip])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) >= 130
