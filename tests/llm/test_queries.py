"""The subpackage's queries with SQL against DuckDB, and the rest for what they must hold."""

import pytest
from test_entry import DATA, compare, duck, pytestmark  # noqa: F401

from nestwork.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, name)


def test_the_rest_runs(spark):
    shares = queries.p8_shares(spark, DATA)
    assert shares.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    found = {r.doc_id for r in queries.p8_found(spark, DATA).collect()}
    # a hundred pages certify no cutoff, so nothing is rejected
    assert not found and queries.p8_cutoffs(spark, DATA).filter("cutoff is not null").isEmpty()
    runs = queries.p6_runs(spark, DATA).collect()
    assert runs and all(r.n_words >= 20 for r in runs)
    if queries.TOKENIZER.startswith("/opt"):
        assert queries.p7_draw(spark, DATA).filter("copies < 1").isEmpty()
