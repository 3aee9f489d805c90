"""Volume files read in ranges against the arrays they were made of."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions.nifti import encode
from voxelmill.sources import slabs


def plain(data, spacing=(0.5, 1.0, 1.5), **k):
    return gzip.decompress(encode(data, spacing, **k))


def voxels(df):
    return {(r["case_id"], r["t"], r["z"], r["y"], r["x"]): r["value"] for r in slabs.explode_slabs(df).collect()}


def wanted(name, data, frames=None, xs=None):
    stack = data if data.ndim == 4 else data[..., None]
    return {(name, t, z, y, x): stack[z, y, x, t] for z, y, x, t in np.ndindex(stack.shape)
            if (frames is None or t in frames) and (xs is None or xs[0] <= x < xs[1])}


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    data = {"a": rng.random((4, 3, 100)), "b": rng.random((2, 5, 7, 3)), "c": rng.random((3, 2, 6))}
    (tmp_path / "a.nii").write_bytes(plain(data["a"]))
    (tmp_path / "b.nii").write_bytes(plain(data["b"]))
    (tmp_path / "c.nii.gz").write_bytes(encode(data["c"], (1, 1, 1), np.diag([1.0, 2.0, 3.0, 1.0])))
    (tmp_path / "notes.txt").write_text("no volume")
    return tmp_path, data


@pytest.mark.parametrize("range_bytes", [1, 700, 1 << 25])
def test_slabs_hold_all_voxels(spark, folder, range_bytes):
    path, data = folder
    got = voxels(slabs.read_slabs(spark, str(path), range_bytes=range_bytes))
    want = {}
    for name, d in data.items():
        want |= wanted(name, d)
    assert got == want


def test_frames_and_slabs_are_chosen_before_reading(spark, folder):
    path, data = folder
    ranges = slabs.slab_ranges(slabs.read_headers(spark, str(path)), frames=(0, 2), xs=(2, 5)).collect()
    by_file = {}
    for r in ranges:
        by_file.setdefault(r["path"].split("/")[-1], []).append((r["first"], r["last"]))
    assert sorted(by_file["a.nii"]) == [(2, 5)] and sorted(by_file["b.nii"]) == [(2, 5), (16, 19)]
    assert by_file["c.nii.gz"] == [(2, 5)]
    got = voxels(slabs.read_slabs(spark, str(path), frames=(0, 2), xs=(2, 5)))
    want = {}
    for name, d in data.items():
        want |= wanted(name, d, (0, 2), (2, 5))
    assert got == want
    assert voxels(slabs.read_slabs(spark, str(path), frames=(7,))) == {}


def test_one_file_is_read_by_several_tasks(spark, folder):
    path, _ = folder
    read = slabs.read_slabs(spark, str(path), range_bytes=10 * 4 * 3 * 8).filter("case_id = 'a'")
    tasks = read.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 3 and sum(r["n"] for r in tasks) == 100


def test_reading_holds_one_slab(tmp_path):
    """A packed file is inflated in a stream; nothing like its whole size is held."""
    import tracemalloc
    data = np.zeros((64, 64, 400))
    (tmp_path / "big.nii.gz").write_bytes(encode(data, (1, 1, 1)))
    h = dict(zip(("packed", "kind", "offset", "slope", "inter", "nz", "ny", "nx", "nt"), slabs.header(str(tmp_path / "big.nii.gz"))))
    tracemalloc.start()
    n = sum(1 for _ in slabs._slabs(h | {"path": str(tmp_path / "big.nii.gz"), "first": 0, "last": 400, "ts": [0], "x0": 0, "x1": 400}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 and peak < data.nbytes / 8


def test_broken_files(spark, folder):
    path, data = folder
    (path / "junk.nii").write_bytes(b"junk")
    (path / "short.nii").write_bytes(plain(data["c"])[:-10])
    (path / "torn.nii.gz").write_bytes(encode(data["a"], (1, 1, 1))[:-400])
    kept = slabs.read_slabs(spark, str(path), on_error="keep", range_bytes=100).cache()
    failed = {r["case_id"] for r in kept.filter("error is not null").collect()}
    assert failed == {"junk", "short", "torn"}
    assert kept.filter("case_id = 'short' and error is null").count() == 5
    assert {r["case_id"] for r in slabs.read_slabs(spark, str(path)).select("case_id").distinct().collect()} >= {"a", "b", "c"}


def test_scaled_big_endian_integers(spark, tmp_path):
    import struct
    head = bytearray(352)
    struct.pack_into(">i", head, 0, 348)
    struct.pack_into(">8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into(">2h", head, 70, 4, 16)
    struct.pack_into(">8f", head, 76, 1.0, 0.5, 0.5, 2.0, 1, 1, 1, 1)
    struct.pack_into(">3f", head, 108, 352.0, 2.0, -1.0)
    values = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    (tmp_path / "s.nii").write_bytes(bytes(head) + values.tobytes(order="F"))
    assert voxels(slabs.read_slabs(spark, str(tmp_path))) == wanted("s", values * 2.0 - 1.0)
    assert slabs.read_slabs(spark, str(tmp_path)).first()["spacing"] == [0.5, 0.5, 2.0]
