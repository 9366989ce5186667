import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_text_operators(tmp_path):
    """The rest imports and has its queries when the text operators are deleted."""
    shutil.copytree(ROOT / "emberline", tmp_path / "emberline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_a_failing_import_of_the_text_operators_is_an_error(tmp_path):
    """Operators that are there but can't be imported aren't left out silently."""
    shutil.copytree(ROOT / "emberline", tmp_path / "emberline", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "a_module_that_is_not_there" in done.stderr


def test_nothing_else_imports_the_text_operators():
    for f in (ROOT / "emberline").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "emberline.llm" not in f.read_text(), f
