"""The full case record: geometry plus texture, one wide row per case."""

from pyspark.sql import DataFrame, functions as F

from voxelmill.model import AXES, CASE, VOXEL, attach
from voxelmill.operators.intensity import hist_landmarks, hist_match
from voxelmill.operators.texture import texture
from voxelmill.plans.knee import ACL, measures
from voxelmill.session import ensure_checkpoint_dir


def acl_region(image: DataFrame, labels: DataFrame, reference: DataFrame, volumes: DataFrame) -> DataFrame:
    """ACL voxels with histogram-matched values; percentiles come from the whole image.

    The image is cut to the box of each case's ligament before it meets the voxels."""
    acl = labels.filter(F.col("label") == ACL).select(*VOXEL)
    box = acl.groupBy(CASE).agg(*[f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    cut = attach(image, box, volumes)
    for a in AXES:
        cut = cut.filter(F.col(a).between(F.col(f"_lo{a}"), F.col(f"_hi{a}")))
    inside = cut.select(*image.columns).join(acl, VOXEL, "left_semi")
    return hist_match(image, hist_landmarks(reference), volumes, only=inside)


def record(image: DataFrame, labels: DataFrame, reference: DataFrame, volumes: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(image.sparkSession)
    features = texture(acl_region(image, labels, reference, volumes), volumes)
    return measures(labels, volumes).join(features, CASE, "left")
