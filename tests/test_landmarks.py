"""Histogram matching at the percentiles themselves."""

from pyspark.sql import functions as F

from voxelmill.operators import intensity as it


def test_a_percentile_becomes_its_landmark(spark):
    """The places of the landmarks were off by the last bits, and fell into the grey level below."""
    vox = spark.range(11 * 40).select(F.format_string("c%02d", F.col("id") % 40).alias("case_id"), F.lit(0).alias("z"), F.lit(0).alias("y"),
                                      F.floor(F.col("id") / 40).cast("int").alias("x"))
    # eleven values a case: the tenth percentiles are values of the case
    vox = vox.withColumn("value", 0.5 * F.pmod(F.xxhash64("case_id"), F.lit(97)) + 0.5 * F.col("x") * (F.pmod(F.xxhash64("case_id"), F.lit(31)) + 3))
    volumes = vox.select("case_id").distinct()
    marks = {p: 100.0 * (p / 99.0) ** 1.3 for p in it.LANDMARKS}
    landmarks = spark.createDataFrame([("r", *marks.values())], ["case_id", *[f"l{p}" for p in marks]])
    got = it.hist_match(vox, landmarks, volumes).filter("x between 1 and 9").collect()
    assert len(got) == 9 * 40
    assert [r for r in got if r.value != marks[10 * r.x]] == []
