import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert all(callable(f) for f in queries.values())


def test_base_does_not_import_the_training_data_folder():
    for path in (ROOT / "lexarium").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lexarium.llm") for n in names), path


def test_entry_runs(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).count() > 0
