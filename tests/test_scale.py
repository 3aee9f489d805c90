"""Steps whose work must not be dealt out by the size of the few rows it is made from."""

import pytest
from pyspark.sql import functions as F

from voxelmill.operators import displacement as dp, geometry as g, inference, morphology as mo


@pytest.fixture(scope="module")
def volumes(spark):
    return spark.range(6).select(F.format_string("c%d", "id").alias("case_id"), *[F.lit(n).alias(k) for k, n in (
        ("nz", 4), ("ny", 8), ("nx", 8))])


@pytest.fixture(scope="module")
def labels(volumes):
    grid = g.target_grid(volumes.select("case_id", F.lit(4).alias("mz"), F.lit(8).alias("my"), F.lit(8).alias("mx")))
    return grid.filter("(z + y + x) % 2 = 0").select("case_id", "z", "y", "x", F.lit(1).alias("label"))


def merged(d):
    """Whether the plan that ran sorts and merges, and the number of its rows."""
    n = len(d.collect())
    return "SortMergeJoin" in d._jdf.queryExecution().executedPlan().toString(), n


def test_points_are_not_broadcast(volumes, labels):
    """the points of all grids are made from a few rows and were taken for small."""
    still = volumes.select("case_id", *[F.lit(0.0).alias(k) for k in ("rz", "ry", "rx", "tz", "ty", "tx")])
    assert merged(g.sample_nearest(g.affine_points(volumes, still), labels)) == (True, 6 * 128)
    assert merged(g.rotate(labels, volumes, 0.0, mask=True)) == (True, 6 * 128)


def test_displacements_are_not_broadcast(volumes, labels):
    """a field comes from a few parameters a case."""
    params = volumes.select("case_id", F.lit(1.0).alias("sigma"), F.lit(0.0).alias("magnitude"))
    moved = g.warp(labels, volumes, dp.elastic_displacement(volumes, params), mask=True)
    assert merged(moved)[1] == 6 * 128
    assert moved._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("SortMergeJoin") == 2


def test_grids_are_spread(spark, volumes):
    """planes were merged into one task before their voxels were made."""
    least = spark.sparkContext.defaultParallelism
    grid = g.target_grid(volumes.select("case_id", *[F.col(f"n{a}").alias(f"m{a}") for a in "zyx"]))
    assert grid.rdd.getNumPartitions() >= least
    steps = volumes.select("case_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("z"), *[
        F.array(*[F.lit(1.0)] * 3).alias(f"{a}steps") for a in "yx"])
    assert dp.grid_displacement(volumes, steps).rdd.getNumPartitions() >= least


def test_closing_moves_a_voxel_once(spark):
    """one exchange, where every axis step was shuffled; blocks agree with the whole."""
    import numpy as np
    rng = np.random.default_rng(3)
    shape = (37, 131, 9)
    mask = rng.random(shape) < 0.35
    rows = [("c", 1, *map(int, p)) for p in np.argwhere(mask)]
    d = spark.createDataFrame(rows, "case_id string, label int, z int, y int, x int")
    vol = spark.createDataFrame([("c", *shape)], "case_id string, nz int, ny int, nx int")
    out = mo.close3(d, vol)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    wide = np.pad(mask, 1)
    grown = np.zeros_like(mask)
    near = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    for a, b, c in near:
        grown |= wide[a:a + shape[0], b:b + shape[1], c:c + shape[2]]
    wide, want = np.pad(grown, 1), np.ones_like(mask)
    for a, b, c in near:
        want &= wide[a:a + shape[0], b:b + shape[1], c:c + shape[2]]
    assert sorted((r.z, r.y, r.x) for r in out.collect()) == [tuple(p) for p in np.argwhere(want).tolist()]


def test_a_tile_row_holds_all_classes(spark, volumes):
    """F8: tiles sent a row a class; now a row holds the logits of all classes, and the long form is made from it."""
    import numpy as np
    grid = g.target_grid(volumes.select("case_id", *[F.col(f"n{a}").alias(f"m{a}") for a in "zyx"]))
    image = grid.select("case_id", "z", "y", "x", (F.col("z") + 0.5 * F.col("x")).alias("value"))
    model = lambda p: np.stack([p * 0, p - 2, 3 - p])
    wide = inference.tile_logits(image, volumes, (4, 8, 6), model)
    tiles = g.tile_voxels(image, volumes, (4, 8, 6)).count()
    assert wide.count() == tiles and {len(r.logits) for r in wide.collect()} == {3}
    assert inference.predict_tiles(image, volumes, (4, 8, 6), model).count() == 3 * tiles
    got = {(r.z, r.x, r.label) for r in inference.segment(image, volumes, (4, 8, 6), model, classes=(0, 1, 2)).collect()}
    scores = lambda v: [0, v - 2, 3 - v]
    best = {(z, x, int(np.argmax(scores(z + 0.5 * x)))) for z in range(4) for x in range(8)}
    assert got == {b for b in best if b[2]}
