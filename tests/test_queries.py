"""Every registered query against its SQL at the smallest scale; the slow model fits run once."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

MODEL_FITS = [name for name in entry.queries() if name not in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None


@pytest.mark.parametrize("name", ["als_recommend", "fm_rank_all"])
def test_model_query_gives_rows(spark, con, sf_dir, name):
    assert name in MODEL_FITS
    assert compare(spark, con, sf_dir, name) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["drugId", "proteinId", "amount_interactions", "rank"]
