"""Displacement tables for ``geometry.warp``: elastic fields and grid distortion.

A displacement is (case_id, z, y, x, dz, dy, dx): the value of a voxel is read at its place plus
(dz, dy, dx). Both kinds are made where they are needed, without a shuffle of voxels: the noise of an
elastic field is a hash of the place, so every block works out the noise around it by itself; a
distorted grid is a short list of mapped nodes per plane.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.functions.arrays import BLOCK_CELLS, blurred_noise
from voxelmill.model import AXES, CASE, python_partitions

#: Rows (y) of a block at most; planes follow from BLOCK_CELLS.
BLOCK_ROWS = 64


def _uniform(seed, *parts):
    """Seeded uniform number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)) / 1_000_003.0


def random_elastic(volumes: DataFrame, seed=42, p=0.1, sigma=(5.0, 8.0), magnitude=(80.0, 100.0)) -> DataFrame:
    """(case_id, sigma, magnitude) of the cases drawn by a seeded hash; the others are not displaced."""
    between = lambda k, ends: F.lit(ends[0]) + _uniform(seed, F.lit(k), CASE) * (ends[1] - ends[0])
    return volumes.filter(_uniform(seed, F.lit(0), CASE) < p).select(
        CASE, between(1, sigma).alias("sigma"), between(2, magnitude).alias("magnitude"))


def elastic_displacement(volumes: DataFrame, params: DataFrame, seed=42, planar=False) -> DataFrame:
    """Smooth random displacement of every voxel of the cases in ``params`` (case_id, sigma, magnitude).

    Uniform noise in [-1, 1) per voxel and axis, blurred by a Gaussian of ``sigma`` voxels cut off at
    3 sigma (nothing comes from beyond the grid), times ``magnitude``. ``planar`` blurs and moves
    within planes only. Noise depends on seed, case and place alone, so blocks, tasks and repeated
    runs agree. Blocks are BLOCK_ROWS rows of whole lines and as many planes as BLOCK_CELLS allows.
    """
    d = params.select(CASE, "sigma", "magnitude").join(volumes.select(CASE, "nz", "ny", "nx"), CASE)
    rows = F.least(F.col("ny"), F.lit(BLOCK_ROWS))
    planes = F.greatest(F.lit(1), F.expr(f"cast({BLOCK_CELLS} div (least(ny, {BLOCK_ROWS}) * nx) as int)"))
    key = F.crc32(F.concat_ws("/", F.lit(str(seed)), CASE))
    blocks = (d.withColumn("key", key).withColumn("planes", planes).withColumn("rows", rows)
              .withColumn("z0", F.explode(F.sequence(F.lit(0), F.col("nz") - 1, F.col("planes"))))
              .withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("ny") - 1, F.col("rows"))))
              .withColumn("z1", F.least(F.col("z0") + F.col("planes"), F.col("nz")))
              .withColumn("y1", F.least(F.col("y0") + F.col("rows"), F.col("ny"))))

    def field(batches):
        for b in batches:
            for r in b.to_pylist():
                shape = r["nz"], r["ny"], r["nx"]
                box = (r["z0"], r["z1"]), (r["y0"], r["y1"]), (0, r["nx"])
                size = [hi - lo for lo, hi in box]
                moved = [np.zeros(size) if planar and axis == 0 else
                         r["magnitude"] * blurred_noise(r["key"], axis, shape, box, r["sigma"], (1, 2) if planar else (0, 1, 2))
                         for axis in range(3)]
                at = np.indices(size, np.int32).reshape(3, -1)
                n = at.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[CASE]]).take(pa.array(np.zeros(n, np.int32)))]
                    + [pa.array(at[k] + np.int32(box[k][0])) for k in range(3)] + [pa.array(m.reshape(-1)) for m in moved],
                    names=[CASE, *AXES, "dz", "dy", "dx"])
    return python_partitions(blocks, CASE, "z0", "y0").mapInArrow(
        field, f"{CASE} string, z int, y int, x int, dz double, dy double, dx double")


def random_grid(volumes: DataFrame, seed=42, p=0.3, steps=5, limit=0.2) -> DataFrame:
    """(case_id, z, ysteps, xsteps): stretch of each cell, 1 +- limit, for the planes drawn by a seeded hash."""
    planes = volumes.select(CASE, F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z"))
    stretch = lambda axis: F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.lit(1.0 - limit) + 2 * limit * _uniform(
        seed, F.lit(axis), CASE, "z", i)).alias(f"{axis}steps")
    return planes.filter(_uniform(seed, F.lit("p"), CASE, "z") < p).select(CASE, "z", stretch("y"), stretch("x"))


def _nodes(axis):
    """Mapped places of the cell ends: each cell is its width times its stretch, one beyond the edge ends there."""
    n, step = F.col(f"n{axis}"), F.col(f"{axis}step")

    def grow(done, i):
        own = F.element_at(f"{axis}steps", F.least(i + 1, F.size(f"{axis}steps")))
        return F.concat(done, F.array(F.when((i + 1) * step > n, n.cast("double")).otherwise(F.element_at(done, -1) + step * own)))
    cells = F.ceil(n / step).cast("int")
    return F.aggregate(F.sequence(F.lit(0), cells - 1), F.array(F.lit(0.0)), grow)


def grid_displacement(volumes: DataFrame, steps: DataFrame) -> DataFrame:
    """Displacement of planes whose grid lines are moved: ``steps`` is (case_id, z, ysteps, xsteps).

    A side of n voxels has cells of n div (number of stretches - 1) voxels, one at least. Within a cell
    places are spread evenly from its mapped beginning to its mapped end, both included; a cell cut off
    by the edge ends at the edge. Planes without a row are not displaced. Planes are spread over the
    tasks before their voxels are made.
    """
    d = steps.select(CASE, "z", "ysteps", "xsteps").join(volumes.select(CASE, "ny", "nx"), CASE)
    d = python_partitions(d, CASE, "z")
    for a in "yx":
        d = d.withColumn(f"{a}step", F.greatest(F.lit(1), F.expr(f"cast(n{a} div (size({a}steps) - 1) as int)")))
    # nodes are generated columns: computed once a plane, not once a voxel
    d = d.withColumn("nodes", F.explode(F.array(F.struct(_nodes("y").alias("y"), _nodes("x").alias("x")))))
    for a in "yx":
        d = d.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"n{a}") - 1)))
    moved = []
    for a in "yx":
        step, at = F.col(f"{a}step"), F.col(a)
        cell = F.floor(at / step).cast("int")
        width = F.least(step, F.col(f"n{a}") - cell * step) - 1
        begin, end = F.get(f"nodes.{a}", cell), F.get(f"nodes.{a}", cell + 1)
        share = F.when(width > 0, (at - cell * step) / width).otherwise(0.0)
        moved.append((begin + (end - begin) * share - at).alias(f"d{a}"))
    return d.select(CASE, *AXES, F.lit(0.0).alias("dz"), *moved)
