"""Every registered query against its SQL counterpart."""

import pytest
from compare import compare
from conftest import SF

from codestrata.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Checked in test_documents.py instead.
WITHOUT_SQL = {"tree_json", "render_report_xml"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, QUERIES[name], ORACLES.get(name))
    assert ok or name in WITHOUT_SQL, note
