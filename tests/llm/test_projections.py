"""Every registered query counts, and gives any one of its columns, without the others."""

import pytest

from grainfield.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_count_and_one_column(spark, sf_dir, name):
    own = queries.QUERIES[name](spark, sf_dir)
    n = own.count()
    assert n > 0 and len(own.select(own.columns[-1]).collect()) == n
