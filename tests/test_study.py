"""The study is made in compiled code, from rows that move once."""

from pyspark.sql import functions as F

from voxelmill.catalog.study import Study


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_study_looks_specks_up_in_compiled_code(spark):
    """F24, F26 and the other study queries: an interpreted lambda searched the map of a plane for each voxel."""
    study = Study(spark, "/root/testdata/sf0.001")
    text = plan(study.voxels())
    assert "lambdafunction" not in text and "RoundRobin" not in text
    got = study.voxels().agg(F.count("*").alias("n"), F.sum("q").alias("q")).first()
    lines = study.table("lineitem").join(study.volumes, F.col("l_suppkey") == F.col("k"))
    assert got.q == lines.agg(F.sum(F.col("l_quantity").cast("bigint"))).first()[0]
    assert got.n == study.volumes.agg(F.sum(F.expr("nz * ny * nx"))).first()[0]
