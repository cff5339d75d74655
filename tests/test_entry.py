"""The entry module, with and without the text operators."""

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ts", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_query_has_sql(spark):
    """Each query over series is compared with SQL."""
    from tsengine import more_queries

    assert set(more_queries.QUERIES) == set(more_queries.SQL)


def test_imports_without_text_operators(tmp_path):
    """A copy of the library without that subpackage, and without the pipeline, still imports."""
    code = "import __spark_entry__ as e, sys; assert 'flagship_sum_rate' in e.queries() and not any(k.startswith('op1') for k in e.queries()); assert 'tsengine.llm' not in sys.modules"
    for path in (TOP / "tsengine").rglob("*.py"):
        if "llm" not in path.parts:
            to = tmp_path / path.relative_to(TOP)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((TOP / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
