import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_training_data_operators():
    for path in (ROOT / "lodeworks").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "lodeworks").parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "token_counts" in entry.queries()
