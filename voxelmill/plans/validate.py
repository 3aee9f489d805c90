"""Image/mask validation: failed checks per pair and their summary."""

from pyspark.sql import DataFrame, functions as F

from voxelmill.model import CASE


def validate_pairs(images: DataFrame, masks: DataFrame, allowed=(0, 1, 2, 3),
                   atol=1e-3, rtol=1e-5) -> DataFrame:
    """List of failed checks per pair.

    images(case_id, shape, affine, bad_values, error), masks(case_id, shape, affine, labels,
    error): one row per file, aggregated from its voxels. Too few labels is reported as
    missing only while no foreign label keeps the count up."""
    m = masks.select(CASE, *[F.col(c).alias(f"m_{c}") for c in ("shape", "affine", "labels", "error")])
    d = images.join(m, CASE)
    ok = F.array(*[F.lit(v) for v in allowed])
    near = F.forall(F.zip_with("affine", "m_affine", lambda a, b: F.abs(a - b) <= atol + rtol * F.abs(b)), lambda t: t)
    loaded = F.col("error").isNull() & F.col("m_error").isNull()
    checks = [("shape", F.col("shape") != F.col("m_shape")), ("affine", ~near),
              ("foreign_label", F.size(F.array_except("m_labels", ok)) > 0),
              ("missing_label", F.size("m_labels") < len(allowed)),
              ("non_finite", F.col("bad_values")), ("ndim", F.size("shape") != 3)]
    issues = F.array_compact(F.array(*[F.when(c, n) for n, c in checks]))
    return d.select(CASE, F.when(loaded, issues).otherwise(F.array(F.lit("load"))).alias("issues"))


def validation_summary(images: DataFrame, masks: DataFrame, checked: DataFrame) -> DataFrame:
    alone = images.join(masks, CASE, "left_anti").agg(F.count("*").alias("images_without_mask"))
    c = checked.agg(F.count("*").alias("pairs"), F.count_if(F.size("issues") == 0).alias("clean"),
                    F.count_if(F.size("issues") > 0).alias("with_problems"))
    return c.join(F.broadcast(alone))  # two one-row tables
