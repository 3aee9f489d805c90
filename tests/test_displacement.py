"""Displacement generators, overlay geometry, distance envelopes, rank selection and padded tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import image_df, mask_df, volumes
from voxelmill.functions import arrays
from voxelmill.model import exact_quantiles
from voxelmill.operators import displacement as dp, geometry as g, inference, intensity as it


# --- elastic fields -----------------------------------------------------------------------------

def whole_field(key, axis, shape, sigma, axes=(0, 1, 2)):
    """The blurred noise of a whole grid at once, by plain convolution."""
    f = arrays.place_noise(key, axis, [np.arange(n) for n in shape])
    w = arrays.gaussian(sigma)
    for k in axes:
        f = np.apply_along_axis(lambda v: np.convolve(v, w)[len(w) // 2:len(w) // 2 + len(v)], k, f)
    return f


@pytest.mark.parametrize("axes", [(0, 1, 2), (1, 2)])
def test_blocks_of_noise_fit_together(axes):
    shape, sigma = (9, 70, 5), 1.7
    whole = whole_field(99, 1, shape, sigma, axes)
    for box in (((0, 9), (0, 70), (0, 5)), ((3, 5), (64, 70), (0, 5)), ((8, 9), (0, 1), (0, 5))):
        part = arrays.blurred_noise(99, 1, shape, box, sigma, axes)
        assert np.allclose(part, whole[tuple(slice(*b) for b in box)], atol=1e-14)
    noise = arrays.place_noise(99, 1, [np.arange(40)] * 3)
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 3 ** -0.5) < 0.01 and -1 <= noise.min() <= noise.max() < 1


def test_elastic_displacement_does_not_depend_on_blocks(spark, monkeypatch):
    vol = volumes(spark, 2, (5, 9, 6))
    params = spark.createDataFrame([("c1", 1.3, 4.0)], "case_id string, sigma double, magnitude double")
    field = lambda **k: {tuple(r[:4]): tuple(r[4:]) for r in dp.elastic_displacement(vol, params, 3, **k).collect()}
    one = field()
    assert len(one) == 5 * 9 * 6 and {k[0] for k in one} == {"c1"}
    monkeypatch.setattr(dp, "BLOCK_ROWS", 4)
    monkeypatch.setattr(dp, "BLOCK_CELLS", 50)
    many = field()
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k], atol=1e-12) for k in one)
    assert max(abs(d) for v in one.values() for d in v) > 0.1
    flat = field(planar=True)
    assert {v[0] for v in flat.values()} == {0.0} and len({v[1] for v in flat.values()}) > 100
    again = dp.elastic_displacement(vol, params, 4).filter("dy != 0").count()
    assert again == 5 * 9 * 6 and field() == many
    assert dp.elastic_displacement(vol, params.limit(0)).count() == 0


def test_drawn_cases_and_planes(spark):
    vol = volumes(spark, 200, (3, 4, 4))
    drawn = dp.random_elastic(vol, p=0.3).collect()
    assert 35 < len(drawn) < 85
    assert all(5 <= r["sigma"] <= 8 and 80 <= r["magnitude"] <= 100 for r in drawn)
    planes = dp.random_grid(vol, p=0.5).collect()
    assert 230 < len(planes) < 370 and all(len(r["ysteps"]) == 6 for r in planes)
    assert all(0.8 <= s <= 1.2 for r in planes for s in r["ysteps"] + r["xsteps"])
    assert dp.random_grid(vol, p=0.5).collect() == planes


# --- grid distortion ----------------------------------------------------------------------------

def mapped(n, stretch):
    step = max(n // (len(stretch) - 1), 1)
    out, before = np.zeros(n), 0.0
    for i, start in enumerate(range(0, n, step)):
        end = start + step
        after = float(n) if end > n else before + step * stretch[min(i, len(stretch) - 1)]
        end = min(end, n)
        out[start:end] = np.linspace(before, after, end - start)
        before = after
    return out


@pytest.mark.parametrize("shape", [(2, 20, 14), (1, 3, 11)])
def test_grid_displacement_is_piecewise_linear(spark, shape):
    vol = volumes(spark, 1, shape)
    ys, xs = [1.2, 0.8, 1.1, 0.9, 1.0, 1.15], [0.8, 1.0, 1.2, 0.85, 1.05, 0.95]
    steps = spark.createDataFrame([("c0", 0, ys, xs)], "case_id string, z int, ysteps array<double>, xsteps array<double>")
    got = {(r["z"], r["y"], r["x"]): (r["dz"], r["dy"], r["dx"]) for r in dp.grid_displacement(vol, steps).collect()}
    assert len(got) == shape[1] * shape[2]
    my, mx = mapped(shape[1], ys), mapped(shape[2], xs)
    for (_, y, x), d in got.items():
        assert np.allclose(d, (0, my[y] - y, mx[x] - x), atol=1e-12)


def test_even_grid_moves_nothing_but_cell_ends(spark):
    """With stretches of 1 the whole image is kept where cells are one voxel wide."""
    vol = volumes(spark, 1, (1, 5, 5))
    image = np.arange(25.0).reshape(1, 5, 5)
    steps = spark.createDataFrame([("c0", 0, [1.0] * 6, [1.0] * 6)], "case_id string, z int, ysteps array<double>, xsteps array<double>")
    out = g.warp(image_df(spark, [image]), vol, dp.grid_displacement(vol, steps)).collect()
    assert {(r["y"], r["x"]): r["value"] for r in out} == {(y, x): image[0, y, x] for y in range(5) for x in range(5)}


# --- distances ------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 17, 18, 60])
@pytest.mark.parametrize("step", [0.5, 1.0, 3.0])
def test_spread_is_the_least_parabola(n, step):
    rng = np.random.default_rng(n)
    f = rng.random((n, 40)) * rng.choice([1, 50, 4_000], 40)
    f[rng.random(f.shape) < rng.random(40)] = np.inf
    f[:, 0] = np.inf
    i = np.arange(n)
    want = np.stack([np.min(f + ((step * (i - k)) ** 2)[:, None], 0) for k in range(n)])
    assert np.allclose(arrays.spread(f, step), want, rtol=1e-12)
    assert np.allclose(arrays.spread(f.reshape(n, 8, 5), step), want.reshape(n, 8, 5), rtol=1e-12)
    some = np.isfinite(f).any(0)
    assert np.allclose(arrays.envelope(f[:, some], step), want[:, some], rtol=1e-12)


def test_one_far_point_on_a_long_line_is_linear_work(monkeypatch):
    calls = []
    real = np.minimum
    monkeypatch.setattr(arrays.np, "minimum", lambda *a, **k: calls.append(1) or real(*a, **k))
    for n in (2_000, 4_000):
        f = np.full((n, 3), np.inf)
        f[0, :2] = 0.0
        calls.clear()
        out = arrays.spread(f, 0.5)
        assert out[-1, 0] == (0.5 * (n - 1)) ** 2 and np.isinf(out[:, 2]).all()
        # the nearest places, then a step or two a place: not one per distance and place
        assert len(calls) <= 2 * arrays.NEAR + 3 * n


# --- rank selection ---------------------------------------------------------------------------------

@pytest.mark.parametrize("known", [True, False])
def test_quantiles_of_all_kinds_of_values(spark, known):
    rng = np.random.default_rng(5)
    kinds = [rng.integers(0, 50, 500).astype(float), rng.normal(size=701), 1e9 + rng.random(300), -np.exp(rng.normal(0, 30, 400)),
             np.array([3.5]), np.zeros(10), np.array([-1e308, -5e-324, 0.0, 5e-324, 1e308, 1e-300, 7.0]), np.repeat([1.0, 2.0], 200)]
    rows = [(f"c{i}", float(v)) for i, k in enumerate(kinds) for v in k] + [("c0", None)] * 5
    df = spark.createDataFrame(rows, "case_id string, value double").repartition(6)
    probs = [0.0, 0.005, 0.1, 0.5, 2 / 3, 0.995, 1.0]
    vol = volumes(spark, len(kinds)) if known else None
    got = {(r["case_id"], r["prob"]): r["q"] for r in exact_quantiles(df, ["case_id"], "value", probs, vol).collect()}
    assert len(got) == len(kinds) * len(probs)
    for i, k in enumerate(kinds):
        s = np.sort(k)
        for p in probs:
            at = p * (len(s) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert np.isclose(got[f"c{i}", p], low + (high - low) * (at - np.floor(at)), rtol=1e-12, atol=0), (i, p)


# --- variants of operators --------------------------------------------------------------------------

def test_paste_resizes_small_planes(spark):
    vol = spark.createDataFrame([("c0", 1, 8, 9, 1.0, 1.0, 1.0), ("c1", 1, 3, 9, 1.0, 1.0, 1.0)],
                                "case_id string, nz int, ny int, nx int, sz double, sy double, sx double")
    square = np.zeros((1, 6, 6), bool)
    square[0, 2:5, 1:4] = True
    pred = mask_df(spark, [square, square])
    spots = lambda fit: {(r["case_id"], r["y"], r["x"]) for r in g.paste2(pred, vol, 6, fit).collect()}
    pasted = {("c0", y + 1, x + 1) for y in range(2, 5) for x in range(1, 4)}
    assert spots("empty") == pasted
    near = lambda i, n: int(np.round(np.clip((i + 0.5) * 6 / n - 0.5, 0, 5)))
    resized = {("c1", y, x) for y in range(3) for x in range(9) if square[0, near(y, 3), near(x, 9)]}
    assert spots("resize") == pasted | resized and resized
    values = pred.withColumn("value", F.lit(2.0)).drop("label")
    linear = g.paste2(values, vol, 6, "resize").filter("case_id = 'c1' and value > 0").count()
    assert linear >= len(resized)


def test_small_volumes_lie_in_the_middle_of_the_window(spark):
    image = np.arange(1.0, 13.0).reshape(2, 2, 3)
    seen = inference.predict_tiles(image_df(spark, [image]), volumes(spark, 1, (2, 2, 3)), (5, 2, 6),
                                   lambda patch: np.stack([np.indices(patch.shape)[0] * 100.0 + np.indices(patch.shape)[2], patch]))
    got = {(r["z"], r["y"], r["x"], r["cls"]): r["logit"] for r in seen.collect()}
    for z, y, x in np.ndindex(image.shape):
        assert got[z, y, x, 0] == (z + 1) * 100 + x + 1 and got[z, y, x, 1] == image[z, y, x]


def test_scaled_affine_and_contrast(spark):
    vol = volumes(spark, 300, (3, 4, 4))
    drawn = g.random_affine(vol, max_scale=0.1).collect()
    scales = [r["scale"] for r in drawn]
    assert 100 < sum(s != 1.0 for s in scales) < 200 and all(0.9 <= s <= 1.1 for s in scales)
    assert "scale" not in g.random_affine(vol).columns
    image = np.random.default_rng(1).random((2, 3, 3))
    vox, one = image_df(spark, [image] * 40), volumes(spark, 40, (2, 3, 3))
    out = {(r["case_id"], r["z"], r["y"], r["x"]): r["value"] for r in it.brightness_contrast(vox, p=0.5).collect()}
    changed = 0
    for i in range(40):
        v = np.array([out[f"c{i}", z, y, x] for z, y, x in np.ndindex(image.shape)])
        slope, shift = np.polyfit(image.ravel(), v, 1)
        assert 0.8 <= slope <= 1.2 and -0.2 <= shift <= 0.2 and np.allclose(slope * image.ravel() + shift, v)
        changed += not np.allclose(v, image.ravel())
    assert 8 < changed < 32
    same = it.gamma(vox, one, g=2.0, normalised=True).agg(F.min("value"), F.max("value")).first()
    assert np.allclose(list(same), [image.min(), image.max()], atol=1e-6)


def test_overlay_of_a_case_without_ligament(spark):
    from voxelmill.plans.overlay import overlay
    tibia = np.zeros((9, 8, 7), bool)
    tibia[2:7, 5:8, 1:6] = True
    rows = overlay(mask_df(spark, [tibia], 3), volumes(spark, 1)).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["kind"], []).append(r)
    assert {k: len(v) for k, v in kinds.items()} == {
        "fallback_long": 5, "fallback_short": 5, "plane_i": 1, "plane_j": 1, "plane_n": 1, "plane_edge": 4}
    assert {(r["az"], r["ay"], r["bx"]) for r in kinds["fallback_long"]} == {(50.0, 40.0 + 10 * k, 100.0) for k in range(5)}
    axes = [np.array([kinds[f"plane_{k}"][0][f"b{a}"] - kinds[f"plane_{k}"][0][f"a{a}"] for a in "zyx"]) for k in "ijn"]
    assert np.allclose(np.array(axes) @ np.array(axes).T, np.eye(3), atol=1e-9) and np.allclose(axes[0], [1, 0, 0])
    side = [np.linalg.norm([r[f"b{a}"] - r[f"a{a}"] for a in "zyx"]) for r in kinds["plane_edge"]]
    assert np.allclose(side, 60.0)
    assert overlay(mask_df(spark, [tibia], 3).limit(0), volumes(spark, 1).limit(0)).count() == 0


# --- streamed groups ----------------------------------------------------------------------------------

def test_groups_never_come_in_parts(monkeypatch):
    import pyarrow as pa
    from voxelmill.functions import grouped
    monkeypatch.setattr(grouped, "PART", 10)
    rng = np.random.default_rng(2)
    sizes = [1, 3, 40, 2, 1, 25, 7]
    key = np.repeat([f"k{i}" for i in range(len(sizes))], sizes)
    lists = [rng.random(rng.integers(0, 3)).tolist() for _ in key]
    table = pa.table({"k": pa.array(key), "v": pa.array(np.arange(len(key))), "g": pa.array(lists, pa.list_(pa.float64()))})
    for cut in (1, 4, 100):
        got = list(grouped._groups(table.to_batches(max_chunksize=cut), ["k"]))
        assert [k for k, _ in got] == [(f"k{i}",) for i in range(len(sizes))]
        assert np.concatenate([a["v"] for _, a in got]).tolist() == list(range(len(key)))
        assert [len(a["v"]) for _, a in got] == sizes
        assert np.concatenate([a["g"] for _, a in got]).tolist() == [v for x in lists for v in x]


def test_surface_over_block_faces(spark):
    from voxelmill.operators.morphology import surface
    rng = np.random.default_rng(4)
    a = rng.random((35, 70, 5)) < 0.9
    a[10:20, 50:68, 1:4] = True
    p = np.pad(a, 1)
    inner = np.ones(a.shape, bool)
    for axis in range(3):
        for d in (0, 2):
            cut = [slice(1, -1)] * 3
            cut[axis] = slice(d, d + a.shape[axis])
            inner &= p[tuple(cut)]
    got = {(r["z"], r["y"], r["x"]) for r in surface(mask_df(spark, [a])).collect()}
    assert got == {tuple(map(int, q)) for q in np.argwhere(a & ~inner)}


@pytest.mark.parametrize("block, rows", [(4, 5), (16, 64), (3, 100)])
def test_one_component_over_blocks_of_both_axes(spark, block, rows):
    from voxelmill.operators.morphology import components
    nz, ny, nx = 13, 17, 3
    snake = np.zeros((nz, ny, nx), bool)
    for z in range(0, nz, 2):  # a line to and fro through all planes, and one voxel apart from it
        snake[z, :, 0] = True
        if z + 1 < nz:
            snake[z + 1, ny - 1 if z % 4 == 0 else 0, 0] = True
    snake[6, 8, 2] = True
    got = components(mask_df(spark, [snake]), volumes(spark, 1, (nz, ny, nx)), block, rows).collect()
    assert len(got) == snake.sum()
    assert {r["comp"] for r in got} == {0, (6 * ny + 8) * nx + 2} and sum(r["comp"] == 0 for r in got) == snake.sum() - 1


@pytest.mark.parametrize("n", [1, 3])
def test_dilation_over_block_faces(spark, n):
    from voxelmill.operators.morphology import dilate
    rng = np.random.default_rng(6)
    shape = (34, 67, 6)
    a = rng.random(shape) < 0.002
    a[15, 63, 0] = a[0, 0, 5] = a[33, 66, 5] = True
    want = a
    for _ in range(n):
        p = np.pad(want, 1)
        want = p[1:-1, 1:-1, 1:-1] | p[:-2, 1:-1, 1:-1] | p[2:, 1:-1, 1:-1] | p[1:-1, :-2, 1:-1] | p[1:-1, 2:, 1:-1] | p[1:-1, 1:-1, :-2] | p[1:-1, 1:-1, 2:]
    got = [(r["z"], r["y"], r["x"]) for r in dilate(mask_df(spark, [a]), volumes(spark, 1, shape), n).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(map(int, q)) for q in np.argwhere(want)}


def test_points_anywhere_are_interpolated(spark):
    rng = np.random.default_rng(8)
    image = rng.random((4, 5, 6))
    f = np.vstack([rng.uniform(-3, 8, (200, 3)), np.argwhere(np.ones((4, 5, 6))), [[-1, -1, -1], [3.5, 4.5, 5.5], [-0.5, 2, 2], [99, -99, 1]]]).astype(float)
    rows = [("c0", 0, 0, i, *map(float, p)) for i, p in enumerate(f)]
    pts = spark.createDataFrame(rows, "case_id string, z int, y int, x int, fz double, fy double, fx double")
    got = {r["x"]: r["value"] for r in g.sample_linear(pts, image_df(spark, [image])).collect()}
    padded = np.pad(image, 120)
    for i, p in enumerate(f):
        low = np.floor(p).astype(int)
        w = p - low
        want = sum(padded[tuple(low + k + 120)] * np.prod(np.where(k, w, 1 - w)) for k in np.ndindex(2, 2, 2) for k in [np.array(k)])
        assert np.isclose(got[i], want, atol=1e-12), p
    assert len(got) == len(f)
    assert g.sample_linear(pts, image_df(spark, [image]).limit(0)).agg(F.sum("value")).first()[0] == 0.0
