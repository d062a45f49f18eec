"""Every registered query with an oracle gives the DuckDB answer on sf0.001."""

import pytest

from helpers import SF_SMALL, canon

from storelens.plans.catalog import ORACLE, QUERIES


# The nine full-size fits take minutes; test_io_models_bundles checks selection with small models.
@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("model_selection_")))
def test_query_matches_oracle(spark, duck, name):
    got = canon(QUERIES[name](spark, SF_SMALL).toPandas())
    want = canon(duck.execute(ORACLE[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
