"""Rows of the folds."""

from voxelmill.catalog import load_all

load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_rows_are_kept(spark):
    """four rounds of quantiles took the overlap of all masks from the beginning."""
    from voxelmill.catalog.metrics import fold_rows
    rows = fold_rows(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in plan(rows) and rows.count() == 3 * rows.select("case_id").distinct().count()
