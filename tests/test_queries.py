import pytest
from oracle import same

from vellum import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_embedding_search_is_exact_and_leaves_the_query_out(spark, sf_dir):
    rows = queries.embedding_topk(spark, sf_dir).collect()
    assert all(r.query_id != r.neighbor_id for r in rows)
    assert {r["rank"] for r in rows} == set(range(1, 11))
