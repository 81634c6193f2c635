"""The subpackage's queries are registered where the subpackage is."""

import __spark_entry__ as entry_module
from pitspark.llm.queries import QUERIES, SQL


def test_all_are_registered():
    assert QUERIES.keys() <= entry_module.queries().keys() and SQL.keys() <= entry_module.oracle_sql().keys()
    assert {"p2_found", "p8_ids", "p9_found", "p10_found"} <= QUERIES.keys()
