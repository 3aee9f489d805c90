"""What is sent between tasks: packed rows, planes that are looked up, broadcasts that their size allows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill import model
from voxelmill.functions import planes
from voxelmill.functions.grouped import map_groups
from voxelmill.operators import geometry as g, intensity as it, texture as tx

SHAPE = (37, 6, 5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.fixture(scope="module")
def volumes(spark):
    return spark.createDataFrame([(c, *SHAPE) for c in ("a", "b")], "case_id string, nz int, ny int, nx int")


@pytest.fixture(scope="module")
def pixels():
    return np.random.default_rng(5).random((2, *SHAPE))


@pytest.fixture(scope="module")
def image(spark, pixels):
    rows = [("ab"[c], z, y, x, float(v)) for (c, z, y, x), v in np.ndenumerate(pixels) if (z + y) % 7]
    return spark.createDataFrame(rows, "case_id string, z int, y int, x int, value double")


def trilinear(pixels, place):
    """By the eight corners; all beyond the grid is 0."""
    total = 0.0
    for corner in np.ndindex(2, 2, 2):
        at = [int(np.floor(f)) + c for f, c in zip(place, corner)]
        if all(0 <= p < n for p, n in zip(at, pixels.shape)):
            total += pixels[tuple(at)] * np.prod([(f - np.floor(f)) if c else 1 - (f - np.floor(f)) for f, c in zip(place, corner)])
    return total


def sparse(pixels):
    z, y, _ = np.indices(SHAPE)
    return np.where((z + y) % 7, pixels, 0.0)


def test_rows_of_groups_are_sent_packed(spark):
    """a row a voxel was sent, with its case name and full numbers."""
    d = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), (F.col("id") % 3 - 1).alias("j"),
        F.when(F.col("id") % 11 > 0, F.col("id").cast("int")).alias("i"), (F.col("id") * 70000 - 5).alias("l"),
        (F.col("id") % 2 == 0).alias("b"), F.when(F.col("id") % 4 == 1, F.lit(float("nan"))).when(
            F.col("id") % 4 > 1, F.col("id") / 3.0).alias("v"), F.when(F.col("id") == 9, F.lit(-0.0)).otherwise(F.col("id") % 200 + 0.0).alias("w"))

    def fn(at):
        total = [float(np.nansum(at[c])) for c in "ilbvw"]
        return {"n": np.array([len(at["b"])]), "nulls": np.array([int(np.isnan(at["v"]).sum() + np.isnan(at["i"].astype("f8")).sum())]),
                "minus": np.array([int(np.signbit(at["w"]).sum())]), "total": np.array([total])}
    got = map_groups(d, ["k", "j"], fn, "k string, j long, n long, nulls long, minus long, total array<double>")
    assert plan(got).count("MapInArrow") == 2 and plan(got).count("Exchange hashpartitioning") == 1
    rows = {}
    for r in d.collect():
        n, nulls, minus, total = rows.get((r.k, r.j), (0, 0, 0, np.zeros(5)))
        gone = int(r.v is None or np.isnan(r.v)) + (r.i is None)
        add = [0 if x is None or np.isnan(x) else x for x in (r.i, r.l, r.b, r.v, r.w)]
        rows[r.k, r.j] = n + 1, nulls + gone, minus + bool(np.signbit(r.w)), total + np.array(add, "f8")
    assert len(rows) == 18 and {(r.k, r.j): (r.n, r.nulls, r.minus) for r in got.collect()} == {k: v[:3] for k, v in rows.items()}
    assert all(np.allclose(r.total, rows[r.k, r.j][3], rtol=1e-12) for r in got.collect())


def test_points_stay_and_planes_are_looked_up(spark, volumes, image, pixels, monkeypatch):
    """points and voxels were sent to the planes, a row each."""
    monkeypatch.setattr(planes, "CELLS", 200)  # a few planes at a time
    places = np.random.default_rng(6).uniform(-2, 8, (300, 3)) * [5, 1, 1]
    places = np.concatenate([places, [[3.0, 2.0, 1.0], [36.0, 5.0, 4.0], [1e12, 0, 0], [-1e12, 1, 1]]])
    rows = [(c, i, 0, 0, *map(float, p)) for i, p in enumerate(places) for c in ("a", "b", "none", None)]
    points = spark.createDataFrame(rows, "case_id string, z int, y int, x int, fz double, fy double, fx double")
    got = g.sample_linear(points, image)
    assert "Exchange" not in plan(got)
    got = {(r.case_id, r.z): r.value for r in got.collect()}
    assert len(got) == len(rows)
    for (case, i), value in got.items():
        want = trilinear(sparse(pixels["ab".index(case)]), places[i]) if case in ("a", "b") else 0.0
        assert value == pytest.approx(want, abs=1e-12)


def test_displacements_are_read_where_they_are(spark, volumes, image, pixels):
    """the grid and every displacement were sent to be joined, then once more as points."""
    rng = np.random.default_rng(7)
    moved = {(c, z, y, x): rng.uniform(-3, 3, 3) for c, z, y, x in np.ndindex(2, *SHAPE) if (c + z) % 3 and (y + x) % 2}
    rows = [("ab"[c], z, y, x, *map(float, d)) for (c, z, y, x), d in moved.items()]
    rows += [("a", 99, 0, 0, 0.0, 0.0, 0.0), ("a", 0, -1, 0, 0.0, 0.0, 0.0), ("none", 0, 0, 0, 0.0, 0.0, 0.0), ("a", 1, 0, 1, 0.0, None, 0.0)]
    first = moved.pop((0, 1, 0, 1))  # there twice: two rows
    field = spark.createDataFrame(rows, "case_id string, z int, y int, x int, dz double, dy double, dx double")
    out = g.warp(image, volumes, field)
    assert "SortMergeJoin" not in plan(out) and "hashpartitioning(case_id#" in plan(out)
    got = {}
    for r in out.collect():
        got.setdefault(("ab".index(r.case_id), r.z, r.y, r.x), []).append(r.value)
    assert len(got) == 2 * np.prod(SHAPE)
    for (c, *at), values in got.items():
        by = [moved.get((c, *at), np.zeros(3))] if (c, *at) != (0, 1, 0, 1) else [first, np.zeros(3)]
        assert sorted(values) == pytest.approx(sorted(trilinear(sparse(pixels[c]), at + d) for d in by), abs=1e-12)


def test_salted_tables_are_not_broadcast(volumes, image, monkeypatch):
    """By its statistics a table with 32 rows a case was taken for a row a case, and broadcast."""
    monkeypatch.setattr(model, "BROADCAST_CASES", 0)
    joined = model.attach(image, volumes.select("case_id", "nz"), volumes)
    joined.collect()
    assert "Broadcast" not in plan(joined) and "_salt" in plan(joined)


def test_broadcasts_are_bounded_by_bytes(spark, volumes, image, monkeypatch):
    """360,000 cases of a few numbers each are 17 MB, yet every voxel was moved to join them."""
    many = {volumes: 360_000}
    monkeypatch.setattr(model, "_case_counts", many)
    assert "Broadcast" in plan(model.attach(image, volumes, volumes))
    monkeypatch.setattr(model, "BROADCAST_BYTES", 1 << 20)
    assert "Broadcast" not in plan(model.attach(image, volumes, volumes))
    want = np.sort(sparse(1 + np.zeros(SHAPE)).ravel())  # whatever the way, the same numbers
    assert it.guarded_zscore(image, volumes).count() == 2 * int(want.sum())


def test_affine_moves_image_and_mask(spark):
    """F16: only the mask was moved."""
    from voxelmill.catalog import load_all
    sf = "/root/testdata/sf0.001"
    got = load_all()[0]["geo_affine"](spark, sf).collect()
    from voxelmill.catalog.study import study
    s = study(spark, sf)
    params = {r.case_id: r for r in g.random_affine(s.volumes).collect()}
    image = {r.case_id: (r.n, r.total) for r in s.image().groupBy("case_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert {r.case_id for r in got} == set(image) and all(r.voxels == image[r.case_id][0] for r in got)
    still = {c for c, p in params.items() if not any((p.rz, p.ry, p.rx, p.tz, p.ty, p.tx))}
    assert 0 < len(still) < len(image)
    assert all((abs(r.total - image[r.case_id][1]) < 1e-3) == (r.case_id in still) for r in got)
