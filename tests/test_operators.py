"""Operators against brute force on small fixtures, and invariants."""

import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelmill.functions.nifti import decode, encode
from voxelmill.model import bucket_rank, exact_quantiles, global_rank, running
from voxelmill.operators import (geometry as g, intensity as it, manifests as mf, metrics as m,
                                 morphology as mo, sampling as sm)
from voxelmill.plans import knee
from voxelmill.sources import volumes as src

RNG = np.random.default_rng(7)
NZ, NY, NX = 9, 8, 7


def volumes(spark, n=2, shape=(NZ, NY, NX), spacing=(0.5, 1.0, 1.5)):
    return spark.createDataFrame([(f"c{i}", *shape, *spacing) for i in range(n)],
                                 "case_id string, nz int, ny int, nx int, sz double, sy double, sx double")


def mask_df(spark, masks, label=1):
    rows = [(f"c{i}", label, *map(int, p)) for i, a in enumerate(masks) for p in np.argwhere(a)]
    return spark.createDataFrame(rows, "case_id string, label int, z int, y int, x int")


def image_df(spark, images):
    rows = [(f"c{i}", *map(int, p), float(a[tuple(p)])) for i, a in enumerate(images) for p in np.argwhere(np.ones(a.shape))]
    return spark.createDataFrame(rows, "case_id string, z int, y int, x int, value double")


def flood(a):
    """Component number (smallest linear index) of each set voxel."""
    out, todo = {}, {tuple(p) for p in np.argwhere(a)}
    while todo:
        seed = min(todo)
        group, stack = {seed}, [seed]
        todo.discard(seed)
        while stack:
            p = stack.pop()
            for d in mo.FACES:
                q = tuple(np.add(p, d))
                if q in todo:
                    todo.discard(q)
                    group.add(q)
                    stack.append(q)
        root = min((z * NY + y) * NX + x for z, y, x in group)
        out.update({p: root for p in group})
    return out


@pytest.mark.parametrize("block", [2, 16])
def test_components_match_flood_fill(spark, block):
    snake = np.zeros((NZ, NY, NX), bool)
    for z in range(NZ):  # one long winding component across all blocks
        snake[z, 0 if z % 4 < 2 else NY - 1, 0] = True
        if z % 2 == 1:
            snake[z, :, 0] = True
    masks = [RNG.random((NZ, NY, NX)) < 0.35, snake]
    got = mo.components(mask_df(spark, masks), volumes(spark), block).toPandas()
    for i, a in enumerate(masks):
        want = flood(a)
        part = got[got.case_id == f"c{i}"]
        assert {(r.z, r.y, r.x): r.comp for r in part.itertuples()} == want


def test_nearest_distance_matches_brute_force(spark):
    a, b = (RNG.random((NZ, NY, NX)) < p for p in (0.1, 0.05))
    vol = volumes(spark, 1)
    got = mo.nearest_distance(mask_df(spark, [a]), mask_df(spark, [b]), vol).toPandas()
    step = np.array([0.5, 1.0, 1.5])
    pb = np.argwhere(b) * step
    for r in got.itertuples():
        want = np.sqrt((((np.array([r.z, r.y, r.x]) * step) - pb) ** 2).sum(1)).min()
        assert abs(r.dist - want) < 1e-9
    assert len(got) == a.sum()


def test_distance_to_empty_is_null(spark):
    a = RNG.random((NZ, NY, NX)) < 0.1
    vol = volumes(spark, 1)
    got = mo.nearest_distance(mask_df(spark, [a]), mask_df(spark, [a]).filter("z < 0"), vol)
    assert got.filter("dist is not null").count() == 0 and got.count() == a.sum()


def test_exact_quantiles_match_numpy(spark):
    v = np.concatenate([RNG.normal(size=500), np.full(300, 0.25), [1e9]])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": v}))
    got = {r.prob: r.q for r in exact_quantiles(df, ["k"], "v", [0, .005, .25, .5, .995, 1]).collect()}
    for p, q in got.items():
        assert abs(q - np.quantile(v, p)) < 1e-6 * max(1, abs(q))


def test_running_blocks_match_naive(spark):
    v = RNG.integers(0, 100, 50)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(50), "v": v}))
    d = running(df, ["k"], "i", {"mx": ("max", "v", True), "mn": ("min", "v", False), "s": ("sum", "v", True)}, block=7)
    d = d.orderBy("i").toPandas()
    assert list(d.mx) == list(np.maximum.accumulate(v)) and list(d.s) == list(np.cumsum(v))
    assert list(d.mn[1:]) == list(np.minimum.accumulate(v)[:-1]) and pd.isna(d.mn[0])


def test_ranks_are_dense(spark):
    df = spark.range(1000).withColumn("p", F.concat(F.lit("f"), (F.col("id") * 7919 % 1000).cast("string")))
    r = global_rank(df, ["p"]).toPandas().sort_values("p")
    assert list(r["rank"]) == list(range(1, 1001))
    b = bucket_rank(df, [], F.col("id") % 5, ["id"]).toPandas()
    assert sorted(b["rank"]) == list(range(1, 1001))


def test_kfold_and_split_sizes(spark):
    df = spark.range(23).withColumn("sex", F.when(F.col("id") < 16, "M").otherwise("F"))
    assert sorted(r["count"] for r in mf.kfold(df, "id").groupBy("fold").count().collect()) == [4, 4, 5, 5, 5]
    s = mf.stratified_split(df, "sex", "id")
    assert s.count() == 23 and s.filter("split <> 'train'").count() == 7
    assert mf.check_split(df, s, "id").first()[:2] == (0, 0)
    again = mf.stratified_split(df, "sex", "id")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))


def test_mirror_and_crop_restore_are_identities(spark):
    a = RNG.random((NZ, NY, NX)) < 0.3
    vol, df = volumes(spark, 1), mask_df(spark, [a])
    key = lambda d: sorted(map(tuple, d.select("z", "y", "x").collect()))
    assert key(g.mirror(g.mirror(df, vol), vol)) == key(df)
    size = (NZ + 2, NY, NX + 1)
    crop = g.center_crop3(df.drop("label").withColumn("value", F.lit(1.0)), vol, size).filter("value > 0")
    assert key(g.restore3(crop, vol, size)) == key(df)


def test_resize_rotate_identity(spark):
    a = RNG.random((NZ, NY, NX))
    vol, df = volumes(spark, 1), image_df(spark, [a])
    for d in (g.resize(df, vol, (NZ, NY, NX)), g.rotate(df, vol, 0.0)):
        got = {(r.z, r.y, r.x): r.value for r in d.collect()}
        assert all(abs(got[tuple(p)] - a[tuple(p)]) < 1e-9 for p in np.argwhere(np.ones(a.shape)))
    sq = volumes(spark, 1, (2, 5, 5))
    b = RNG.random((2, 5, 5))
    got = {(r.z, r.y, r.x): r.value for r in g.rotate(image_df(spark, [b]), sq, 90.0).collect()}
    turned = np.rot90(b, axes=(1, 2))
    flat = np.array([[[got[z, y, x] for x in range(5)] for y in range(5)] for z in range(2)])
    assert np.allclose(flat, turned) or np.allclose(flat, np.rot90(b, -1, axes=(1, 2)))


def test_plane_fit_matches_svd(spark):
    p = RNG.normal(size=(40, 3)) * [3, 0.2, 5] @ np.linalg.qr(RNG.normal(size=(3, 3)))[0]
    df = spark.createDataFrame(pd.DataFrame({"case_id": "c", "pz": p[:, 0], "py": p[:, 1], "px": p[:, 2]}))
    r = knee.plane_fit(df).first()
    n = np.linalg.svd(p - p.mean(0))[2][2]
    assert abs(abs(np.dot(n, [r.nz, r.ny, r.nx])) - 1) < 1e-9


def test_plateau_of_degenerate_and_missing_tibia(spark):
    a = np.zeros((NZ, NY, NX), bool)
    a[3, 2, 1] = True
    b = np.zeros((NZ, NY, NX), bool)
    p = knee.tibial_plane(mask_df(spark, [a, b], 3), volumes(spark, 2)).orderBy("case_id").collect()
    assert (p[0].nz, p[0].ny, p[0].nx) == (0, -1, 0) and p[0].gz == 1.5
    assert (p[1].nz, p[1].ny, p[1].nx) == (0, 1, 0)


def test_dice_of_itself_and_empty(spark):
    a = [RNG.random((NZ, NY, NX)) < 0.3, np.zeros((NZ, NY, NX), bool)]
    df, vol = mask_df(spark, a), volumes(spark, 2)
    assert {r.dice for r in m.dice_binary(df, df, vol).collect()} == {1.0}
    assert {r.dice for r in m.dice_per_class(df, df, vol, (1,)).collect()} == {1.0, None}


def test_closing_contains_inner_input(spark):
    a = np.zeros((NZ, NY, NX), bool)
    a[2:6, 2:6, 2:5] = RNG.random((4, 4, 3)) < 0.6
    got = {tuple(r) for r in mo.close3(mask_df(spark, [a]), volumes(spark, 1)).select("z", "y", "x").collect()}
    assert {tuple(p) for p in np.argwhere(a)} <= got


def test_hist_match_hits_landmarks(spark):
    a = RNG.random((NZ, NY, NX)) * 100
    df, vol = image_df(spark, [a]), volumes(spark, 1)
    lm = it.hist_landmarks(df)
    out = it.hist_match(df, lm, vol).agg(F.percentile("value", F.lit(0.99))).first()[0]
    assert abs(out - 100) < 1e-6 and abs(lm.first()["l1"]) < 1e-9


def test_patches_stay_in_grid_and_hit_foreground(spark):
    a = RNG.random((NZ, NY, NX)) < 0.1
    vol, df = volumes(spark, 1), mask_df(spark, [a])
    p = sm.sample_patches(df, vol, (4, 4, 4), 200).toPandas()
    assert len(p) == 200 and (p[["z0", "y0", "x0"]] >= 0).all().all()
    assert (p.z1 <= NZ).all() and (p.y1 <= NY).all() and (p.x1 <= NX).all() and 0.5 < p.fg.mean() < 0.8
    c = sm.pos_neg_crops(df, vol, (4, 4, 4), per_case=60).toPandas()
    assert len(c) == 60 and all(a[int(r.cz), int(r.cy), int(r.cx)] == r.fg for r in c.itertuples())


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 1, 1, 8])], "k long, w double")
    s = sm.weighted_sample(df, "k", "w", n=2000).toPandas()
    share = s.k.value_counts(normalize=True)
    assert len(s) == 2000 and 0 not in share and abs(share[3] - 0.8) < 0.05


def test_volume_files_round_trip_and_bad_file(spark, tmp_path):
    a = RNG.random((3, 4, 5))
    affine = np.diag([1.0, 2, 3, 1])
    (tmp_path / "mask_k1.nii.gz").write_bytes(encode(a, (1, 2, 3), affine))
    (tmp_path / "k2.nii").write_bytes(gzip.decompress(encode(a[..., None].repeat(2, 3), (1, 2, 3))))
    (tmp_path / "k3.nii").write_bytes(b"junk")
    (tmp_path / "note.txt").write_text("x")
    assert np.array_equal(decode(encode(a, (1, 2, 3), affine))[0], a)
    for recursive in (False, True):
        d = src.read_volumes(spark, str(tmp_path), recursive, on_error="keep")
        assert {r.case_id for r in d.filter("error is not null").collect()} == {"k3"}
    v = mf.first_frame(src.explode_slices(src.read_volumes(spark, str(tmp_path)))).toPandas()
    assert len(v) == 120 and set(v.case_id) == {"k1", "k2"}
    assert all(abs(a[r.z, r.y, r.x] - r.value) < 1e-12 for r in v.itertuples())


def test_missing_csv_is_empty(spark, tmp_path):
    assert src.read_csv(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_strict_positional_pairing_refuses_unequal_lists(spark):
    a, b = (spark.createDataFrame([(f"p{i}",) for i in range(n)], "path string") for n in (3, 2))
    assert mf.pair_by_rank(a, b).count() == 2
    with pytest.raises(ValueError):
        mf.pair_by_rank(a, b, strict=True)


# --- no data lost or merged at scale ---------------------------------------------------

def test_padding_never_cuts(spark):
    from voxelmill.functions.scalars import zero_padded
    keys = [5, 999_999, 1_000_000, 12_345_678]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select(zero_padded(F.col("k"), 6).alias("s"))
    assert [r["s"] for r in df.collect()] == ["000005", "999999", "1000000", "12345678"]


@pytest.mark.parametrize("depth", [0, 6, 40])
def test_find_key_at_any_depth(spark, depth):
    text = '{"x": {"n": 1}, "a": ' * depth + '{"age": "7Y"}' + "}" * depth
    df = spark.createDataFrame([("h", text), ("none", '{"b": [1, 2]}'), ("null", None)], "id string, j string")
    got = {r["id"]: r["value"] for r in mf.find_key(df, "id", "j", "age").collect()}
    assert got == {"h": "7Y", "none": None, "null": None}


def test_slices_redraw_in_both_modes(spark):
    """Half of the cases have no positive plane: eleven draws nearly always find one that has."""
    masks = [np.zeros((NZ, NY, NX), int) for _ in range(8)]
    for a in masks[:4]:
        a[4, 4, 4] = 1
    labels, vols = mask_df(spark, masks), volumes(spark, 8)
    for draw in (sm.sample_slices, sm.sample_val_slices):
        cases = [r["case_id"] for r in draw(labels, vols, 200).collect()]
        assert len(cases) == 200 and set(cases) <= {"c0", "c1", "c2", "c3"}


def test_weighted_draws_all_land(spark):
    rows = spark.createDataFrame([(i, 0.1 * (i % 7)) for i in range(300)], "k long, w double")
    got = sm.weighted_sample(rows, "k", "w", n=5000).collect()
    assert len(got) == 5000 and all(r["k"] is not None and r["k"] % 7 for r in got)


def test_texture_keeps_isolated_voxels(spark):
    from voxelmill.operators.texture import texture
    roi = spark.createDataFrame([("c0", 1, 1, x, 30.0 * x) for x in range(4)] + [("c1", 1, 1, 1, 60.0)],
                                "case_id string, z int, y int, x int, value double")
    got = {r["case_id"]: r.asDict() for r in texture(roi, volumes(spark)).collect()}
    assert set(got) == {"c0", "c1"}
    assert got["c1"]["original_firstorder_Mean"] == 60.0 and got["c1"]["original_glcm_Contrast"] is None


@pytest.mark.parametrize("n", [0, 2])
def test_matching_needs_one_reference(spark, n):
    image = image_df(spark, [RNG.random((NZ, NY, NX)) * 100])
    marks = it.hist_landmarks(image.withColumn("value", F.col("value") + 1))
    marks = marks.limit(0) if n == 0 else marks.union(marks)
    with pytest.raises(Exception, match="exactly one volume"):
        it.hist_match(image, marks, volumes(spark, 1)).collect()


def test_argmax_ties_go_to_the_lower_class(spark):
    logits = {(0, 0, 0): [1, 1, 0, 0], (0, 0, 1): [0, 1, 3, 3], (0, 0, 2): [0, 0, 0, 1]}
    rows = [("c0", *p, c, float(v)) for p, vs in logits.items() for c, v in enumerate(vs)]
    df = m.argmax_class(spark.createDataFrame(rows, "case_id string, z int, y int, x int, cls int, logit double"))
    assert {r["x"]: r["label"] for r in df.collect()} == {0: 0, 1: 2, 2: 3}
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from voxelmill.session import ensure_checkpoint_dir
    named = []
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=named.append)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
    ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: "hdfs:///shared")))
    assert named == ["hdfs:///shared"]


def test_salted_branch_gives_the_same(spark, monkeypatch):
    from voxelmill import model
    mask = RNG.random((2, NZ, NY, NX)) < 0.4
    labels, vols, image = mask_df(spark, mask), volumes(spark), image_df(spark, RNG.random((2, NZ, NY, NX)))

    def results():
        return [sorted(map(tuple, d.collect())) for d in (
            mo.clean_mask(labels, vols), it.minmax(image, vols), g.slice_at(image, vols, "z", flip="y"))]
    plain = results()
    monkeypatch.setattr(model, "BROADCAST_CASES", 0)
    assert results() == plain


def test_quantiles_of_a_stretched_range(spark):
    """Nearly all values within a billionth of the range: they still do not end in one cell."""
    from voxelmill import model
    values = np.concatenate([RNG.random(500), [1e12, -1e12]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0)], "g string, v double")
    got = {(r["g"], r["prob"]): r["q"] for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99]).collect()}
    for p in (0.1, 0.5, 0.99):
        assert np.isclose(got["a", p], np.quantile(values, p), rtol=1e-12) and got["b", p] == 3.0
    assert len(got) == 6 and model.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
