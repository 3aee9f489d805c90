"""Surface distance metrics."""

from pyspark.sql import DataFrame, functions as F

from voxelmill.model import CASE
from voxelmill.session import stored
from voxelmill.operators.morphology import nearest_distance, surface


def hd95(labels: DataFrame, pred: DataFrame, volumes: DataFrame, spacing=False,
         classes=(1, 2, 3), q=0.95) -> DataFrame:
    """95th percentile Hausdorff distance per case and class.

    Voxel units unless ``spacing`` is set: the reference passes no spacing. NULL when
    either mask of the class is empty.
    """
    wanted = F.col("label").isin(list(classes))
    # both surfaces are read twice, so they are written once
    a, b = (stored(surface(m.filter(wanted)), "surface") for m in (labels, pred))
    there = nearest_distance(a, b, volumes, spacing).withColumn("side", F.lit("ab"))
    back = nearest_distance(b, a, volumes, spacing).withColumn("side", F.lit("ba"))
    both = there.unionByName(back).filter("dist is not null")
    # percentile counts equal values map-side; squared grid distances are few distinct numbers
    per_side = both.groupBy(CASE, "label", "side").agg(F.percentile("dist", F.lit(q)).alias("d"))
    found = per_side.groupBy(CASE, "label").agg(F.max("d").alias("hd95"))
    every = volumes.select(CASE, F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("label"))
    return every.join(found, [CASE, "label"], "left")
