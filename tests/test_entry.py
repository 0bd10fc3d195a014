import ast
from pathlib import Path

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200


def test_no_name_is_defined_twice():
    """A second definition in a module or class would silently replace the first."""
    twice = []

    def look(path, body):
        names = [n.name for n in body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        names += [t.id for n in body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
        twice.extend((path.name, n) for n in set(names) if names.count(n) > 1)
        for n in body:
            if isinstance(n, ast.ClassDef):
                look(path, n.body)

    root = Path(entry.__file__).parent
    for path in [*root.glob("*.py"), *root.glob("pagewright/**/*.py"), *root.glob("tests/**/*.py")]:
        look(path, ast.parse(path.read_text()).body)
    assert not twice
