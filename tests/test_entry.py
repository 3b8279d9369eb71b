"""The entry module with and without the training-data subpackage and what that needs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
{before}
import __spark_entry__ as e
q = e.queries()
assert {{"template_detections", "roc_curve"}} <= set(q) and set(e.oracle_sql()) <= set(q)
assert any(k.startswith("op1_") or k == "pipeline" for k in q) == {llm}
"""


@pytest.mark.parametrize("without, before, llm", [
    (("llm", "corpus_pipeline.py"), "", False), (("llm",), "", False), (("corpus_pipeline.py",), "", False),
    ((), "sys.modules['public_tokenizers'] = None", True),
])
def test_entry_without(tmp_path, without, before, llm):
    present = (ROOT / "sonagrid" / "llm").exists() and (ROOT / "corpus_pipeline.py").exists()
    shutil.copytree(ROOT / "sonagrid", tmp_path / "sonagrid", ignore=shutil.ignore_patterns("__pycache__", *without))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and name not in without:
            shutil.copy(ROOT / name, tmp_path)
    code = CODE.format(before=before, llm=llm and present)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
