import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 50


def test_nothing_outside_the_subpackage_imports_it():
    for p in (ROOT / "lattica").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+lattica\.llm|from lattica import.*\bllm\b", p.read_text(), re.M), p


def test_flagship_query_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "relevance", "distance"] and df.count() >= 0
