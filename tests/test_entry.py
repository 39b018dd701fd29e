"""The registry: every query runs on the smallest tables and gives the same columns as its SQL."""

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_imported_by_nothing_else():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "tallywright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)[^\n]*\bllm\b", p.read_text()), p
