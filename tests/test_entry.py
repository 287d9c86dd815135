"""The library without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LISTS = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"


def _copy(to: Path, *left_out: str) -> Path:
    def skip(folder: str, names: list[str]) -> list[str]:
        shown = [(name, (Path(folder) / name).relative_to(ROOT).as_posix()) for name in names]
        return [name for name, path in shown if path in left_out or name in (".git", "__pycache__")]

    return Path(shutil.copytree(ROOT, to, ignore=skip))


def _listed(folder: Path) -> str:
    done = subprocess.run([sys.executable, "-c", LISTS], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.strip()


def test_imports_without_the_optional_part(tmp_path):
    from checks.queries import QUERIES

    wanted = f"{len(QUERIES)} []"
    without = ("newsweave/llm", "tests/llm")
    assert _listed(_copy(tmp_path / "pipeline-stays", *without)) == wanted
    assert _listed(_copy(tmp_path / "all-gone", *without, "corpus_pipeline.py")) == wanted
    kept = _copy(tmp_path / "empty-folder", *without)
    (kept / "newsweave" / "llm").mkdir()
    assert _listed(kept) == wanted
