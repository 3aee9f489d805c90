"""Sidecars by the base names of their directory."""

from voxelmill.operators import manifests as mf


def test_only_substrings_that_begin_like_a_base_name_are_keys(spark, monkeypatch):
    """every substring of every sidecar name was shuffled and sorted."""
    files = spark.createDataFrame([("d", "knee_1.nii"), ("d", "knee_2.nii.gz"), ("d", "a.nii"), ("e", "knee_1.nii")], "dir string, name string")
    side = spark.createDataFrame([("d", "x_knee_1_h0.mat"), ("d", "b_knee_1_h0.mat"), ("d", "x_gone_2.mat"), ("e", "x_knee_9.mat")], "dir string, name string")
    got = mf.find_sidecar(files, side)
    assert {(r.dir, r.name): r.sidecar for r in got.collect()} == {
        ("d", "knee_1.nii"): "b_knee_1_h0.mat", ("d", "knee_2.nii.gz"): "_knee_2_dicom_header.mat",
        ("d", "a.nii"): "b_knee_1_h0.mat", ("e", "knee_1.nii"): "_knee_1_dicom_header.mat"}
    seen = []
    group = type(side).groupBy

    def counted(self, *by):
        if all(isinstance(b, str) for b in by):
            seen.append(self.count())
        return group(self, *by)
    monkeypatch.setattr(type(side), "groupBy", counted)
    mf.find_sidecar(files, side)
    # knee_1 twice, knee_9 once, the "a" of each ".mat" of d
    assert seen == [6]
