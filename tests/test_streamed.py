"""Steps that once made a pandas frame for every small group."""

import pytest

from voxelmill.catalog import load_all
from voxelmill.operators import texture as tx


load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_second_eigenvalues_are_streamed(spark):
    """a pandas frame a case and direction took most of the time."""
    rows = [("a", 0, 1, 1, .4), ("a", 0, 1, 2, .1), ("a", 0, 2, 1, .1), ("a", 0, 2, 2, .4),
            ("a", 1, 1, 1, .3), ("a", 1, 1, 3, .2), ("a", 1, 3, 1, .2), ("a", 1, 3, 3, .3), ("b", 0, 4, 4, 1.0)]
    got = tx.glcm_mcc(spark.createDataFrame(rows, "case_id string, dir int, g1 int, g2 int, p double"))
    # transition [[s, 1 - s], [1 - s, s]] has second eigenvalue 2s - 1; one level gives 1
    assert {r.case_id: r.MCC for r in got.collect()} == {"a": pytest.approx((.6 + .2) / 2), "b": 1.0}
    assert "InPandas" not in plan(got)


def test_slabs_and_files_are_streamed(spark, tmp_path):
    """a pandas frame was made for every slab, and one for every file that was packed."""
    from voxelmill.catalog.rowsonly import volume_files
    from voxelmill.catalog.study import Study
    from voxelmill.sources import slabs
    study = Study(spark, "/root/testdata/sf0.001")
    folder = volume_files(study, str(tmp_path / "plain"), plain=True)
    got = slabs.read_slabs(spark, folder, range_bytes=8192)
    steps = plan(got)
    assert steps.count("MapInArrow") == 1 and steps.count("MapInPandas") == 1  # headers are read once
    n = study.volumes.selectExpr("sum(nx) AS slabs", "sum(nz * ny * nx) AS voxels").first()
    assert (got.count(), slabs.explode_slabs(got).count()) == (n.slabs, n.voxels)
