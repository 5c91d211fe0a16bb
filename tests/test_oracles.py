"""Every registered query against its SQL on the smallest data set."""

import pytest

from tests import oracle
from vereda.plans import catalog

SF = f"{oracle.DATA}/sf0.001"
# Queries whose result SQL does not state; their operators are tested elsewhere. Any other query needs its SQL.
NO_SQL = {"answer_cascade", "chunk_recursive", "chunk_sections", "chunk_sweep", "eval_rouge_l"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, message, _, rows = oracle.compare(spark, con, name, SF)
    assert ok and (name in catalog.ORACLES or name in NO_SQL), message
