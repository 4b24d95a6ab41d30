"""The registered queries and their SQL, and the module without the training-data part."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import differences
from flatscan import queries

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


SQL = queries.oracle_sql(entry.SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_scan_queries_equal_their_sql(spark, name):
    assert differences(queries.queries()[name](spark, entry.SF_DIR), SQL[name], entry.SF_DIR) == []


def test_entry_is_a_row_range(spark):
    out = entry.entry(spark)
    assert out.columns == ["l_orderkey", "l_quantity", "row_index", "row_group"] and out.count() == 1000


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_data_part():
    code = (
        "import sys; sys.modules['flatscan.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries()\n"
        "assert 'sc_row_range' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_nothing_else_imports_the_training_data_part():
    for folder, _, names in os.walk(f"{ROOT}/flatscan"):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(f"{folder}/{n}").read(), n
