import re

import __spark_entry__ as entry


def test_contract(spark, data):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    assert {"p3_found", "p4_found", "p7_found"} <= set(queries)
    assert entry.entry(spark).columns[:2] == ["persoon_id", "besluit_id"]


def test_the_rest_does_not_import_the_llm_part():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "plenaria").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import) plenaria\.llm", p.read_text(), re.M), p
