"""Registered queries do the whole job that their name says: whole trainings, whole rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from bipath import schemas
from bipath.models import als, blocks, fm
from bipath.operators import edges, features, matrices, splits, twohop
from bipath.registry import fm_sql, queries


@pytest.fixture(scope="module")
def small(spark):
    dti = [(f"D{d}", f"P{(7 * d + 3 * i) % 30}") for d in range(8) for i in range(4)]
    ppi = [(f"P{i}", f"P{(i * j + j) % 30}", 0.5 + (i + j) % 25 / 50) for i in range(30) for j in (2, 5, 7)]
    dti = edges.distinct_dti(spark.createDataFrame(dti, schemas.DTI)).cache()
    raw = spark.createDataFrame(ppi, schemas.PPI)
    return dti, edges.symmetrize_ppi(raw, 0.5).cache(), twohop.amount_interactions(dti, raw).cache()


class Asked(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """The grids that a query asks its models for; the training itself is left out."""
    seen = {}

    def grid_of(name, at):
        def train(*args, **options):
            seen[name] = args[at]
            raise Asked

        return train

    monkeypatch.setattr(als, "train", grid_of("als", 1))
    for name in ("train", "cross_validation"):
        monkeypatch.setattr(fm, name, grid_of("fm", 2))
    return seen


@pytest.mark.parametrize(
    "name", ["fm_fit_grid", "fm_cross_validate", "rank_specific_pairs", "fm_rank_all_feedback", "compare_rankings"]
)
def test_fm_queries_train_as_long_as_the_reference(spark, sf_dir, asked, name):
    with pytest.raises(Asked):
        queries.QUERIES[name](spark, sf_dir)
    assert asked["fm"]["maxIter"] == [500] and asked["fm"]["factorSize"] == [2]


def test_als_fit_has_the_rank_and_iterations_of_the_reference(spark, sf_dir, asked):
    with pytest.raises(Asked):
        queries.QUERIES["als_fit_grid"](spark, sf_dir)
    assert asked["als"]["rank"] == [30] and asked["als"]["maxIter"] == [10]


def test_compared_models_are_wholly_trained(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.comparison, "compare_models", lambda *args: seen.append(args[4:6]))
    monkeypatch.setattr(queries.comparison, "compare_rankings", lambda *args: None)
    monkeypatch.setattr(queries, "_fm_factors", lambda s, d, grid: (None, seen.append(grid)))
    monkeypatch.setattr(queries, "_als_ranking", lambda s, c, n, grid: seen.append(grid))
    monkeypatch.setattr(fm, "rank_all", lambda *args: None)
    queries.compare_models(spark, sf_dir)
    queries.compare_rankings(spark, sf_dir)
    (als_grid, fm_grid), *others = seen
    assert others == [fm_grid, als_grid] and fm_grid["maxIter"] == [500]
    assert als_grid["rank"] == [30] and als_grid["maxIter"] == [10]


@pytest.mark.parametrize("mode", ["interaction", "feedback"])
def test_fm_in_one_task_equals_iterations_over_cells(small, monkeypatch, mode):
    """Also where a run stops early, another goes on, and a fold is left out."""
    dti, strong, amount = small
    cells = features.interaction_cells(dti, strong) if mode == "interaction" else features.feedback_cells(amount, folds=3, seed=7)
    runs = [
        {"regParam": r, "maxIter": m, "initStd": 0.1, "factorSize": f, "fold": fold}
        for r, m, f, fold in ((0.01, 2, 1, 0), (0.0, 3, 2, -1), (0.001, 1, 2, 2))
    ]
    data = splits.with_fold(amount, 7, 3).cache()

    def fitted():
        weights, errors = fm._fitted(data, cells, runs, 1, 0.01, tol=0.02)
        return {(r.run, r.feature): (r.w, r.v0, r.v1) for r in weights.collect()}, errors

    monkeypatch.setattr(blocks, "CELL_ENTRIES", 64)
    one, errors = fitted()
    monkeypatch.setattr(blocks, "TASK_ENTRIES", 0)
    many, same = fitted()
    assert one.keys() == many.keys() and len(one) == 3 * (cells.size + 1)
    assert all(many[key] == pytest.approx(one[key], abs=1e-9) for key in one)
    assert all(same[name] == pytest.approx(errors[name], nan_ok=True) for name in errors)


def test_iterations_shuffle_no_cells(spark, small):
    """Kept cells stay in their tasks: what an iteration shuffles are the vectors that meet them."""
    dti, strong, amount = small
    data = fm._numbered(splits.with_fold(amount, 7, 3), features.interaction_cells(dti, strong), [0], 2).kept()
    weights = fm._weight_blocks(fm._first_weights(spark, [{"factorSize": 2, "initStd": 0.1}], [1.0], data.features.n - 1, 2, 1), data)
    met = blocks.over_cells(data.drug_cells, fm._forward(data, 0), columns=weights.select("b", "data"))
    text = met._jdf.queryExecution().executedPlan().toString()
    left = text[text.index("FlatMapCoGroupsInPandas") :]
    assert 0 < left.index("InMemoryTableScan") < left.index("Exchange")
    data.release()


def test_recursive_sql_equals_unrolled_steps(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    from bipath.registry.oracle import with_views

    rows_of = ("rows_of", "SELECT *, CASE WHEN split = 'test' THEN 0 ELSE 1 END AS fold FROM split_rows")
    runs = [{"regParam": r, "maxIter": 3, "initStd": 0.1, "factorSize": 2, "fold": 0} for r in (0.0, 0.01)]
    body = "SELECT run, round(rmse, 9), round(train_rmse, 9) FROM errors ORDER BY run"
    plain, recursive, settled = (
        con.execute(fm_sql._joined([rows_of, *steps, *fm_sql._errors()], body, with_views)).fetchall()
        for steps in (fm_sql._steps(runs, 42, 0.01), fm_sql._until_settled(runs, 42, 0.01), fm_sql._until_settled(runs, 42, 0.01, 1.0))
    )
    assert plain == recursive and settled != plain


@pytest.mark.parametrize("list_size", [1, 2, 100])
def test_rows_hold_all_other_counts_of_their_drug(spark, monkeypatch, list_size):
    """Also where a drug's list comes in pieces and its rows in blocks, and where a drug has one protein alone."""
    monkeypatch.setattr(matrices, "LIST_BLOCK", list_size)
    amount = [("D1", "P3", 2), ("D1", "P4", 1), ("D1", "P7", 5), ("D2", "P1", 1), ("D2", "P3", 1), ("D3", "P3", 4)]
    found = matrices.others_cells(spark.createDataFrame(amount, schemas.AMOUNT), list_size).collect()
    others = {(d, p): sorted((q, n) for e, q, n in amount if e == d and q != p) for d, p, _ in amount}
    got = {key: [] for key in others}
    for r in found:
        got[r.drugId, r.proteinId] += [tuple(c) for c in r.cells]
        mine = others[r.drugId, r.proteinId]
        assert (r.others, r.others_sum) == (len(mine), sum(n for _, n in mine)) and r.pieces == -(-(r.others + 1) // list_size)
    assert {key: sorted(cells) for key, cells in got.items()} == others


def test_others_query_holds_counts_and_not_totals_alone(spark, sf_dir):
    rows = queries.QUERIES["others_interactions"](spark, sf_dir).collect()
    seen = {}
    for r in rows:
        seen.setdefault((r.drugId, r.proteinId, r.others, r.others_sum), []).extend(c.split(":") for c in r.cells.split(",") if c)
    assert all(len(cells) == n and sum(int(c) for _, c in cells) == total for (_, _, n, total), cells in seen.items())
