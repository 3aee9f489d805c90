"""Patch and slice draws. Every draw comes from a seeded hash, so it is reproducible."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from voxelmill.model import AXES, CASE, bucket_rank, shuffled_rank
from voxelmill.operators.intensity import uniform
from voxelmill.operators.metrics import positive_slices

SHAPE = ["nz", "ny", "nx"]


def _pick(u, n):
    """Index 0..n-1 from a uniform number."""
    return F.least(F.floor(u * n), n - 1)


def _corner(df, size):
    for a, d in zip(AXES, size):
        c = F.col(f"c{a}") - d // 2
        df = df.withColumn(f"{a}0", F.greatest(F.lit(0), F.least(c, F.col(f"n{a}") - d)).cast("int"))
        df = df.withColumn(f"{a}1", F.least(F.col(f"{a}0") + d, F.col(f"n{a}")))
    return df


def indexed_foreground(labels: DataFrame) -> DataFrame:
    """Foreground voxels numbered from 0 per case in (z, y, x) order, ranked plane by plane."""
    return bucket_rank(labels.select(CASE, *AXES), [CASE], "z", ["y", "x"], "i").withColumn("i", F.col("i") - 1)


def _with_cases(draws: DataFrame, volumes: DataFrame, u, n_cases: int) -> DataFrame:
    numbered = shuffled_rank(volumes.select(CASE, *SHAPE), [], CASE, 7, "_no")
    return draws.withColumn("_no", _pick(u, F.lit(n_cases)) + 1).join(numbered, "_no").drop("_no")


def sample_patches(labels: DataFrame, volumes: DataFrame, size, n, p=0.66, seed=42) -> DataFrame:
    """n patches from random volumes: with probability p around a random foreground voxel
    (the middle when there is none), else anywhere; corners clamped to the grid."""
    spark = volumes.sparkSession
    draws = spark.range(n).withColumnRenamed("id", "draw")
    d = _with_cases(draws, volumes, uniform(seed, 0, "draw"), volumes.count())
    count = labels.groupBy(CASE).agg(F.count("*").alias("_n"))
    d = d.join(count, CASE, "left").withColumn("fg", uniform(seed, 1, "draw") < p)
    d = d.withColumn("i", F.when(F.col("fg"), _pick(uniform(seed, 2, "draw"), F.col("_n"))))
    at = indexed_foreground(labels).select(CASE, "i", *[F.col(a).alias(f"v{a}") for a in AXES])
    d = d.join(at, [CASE, "i"], "left")
    for k, a in enumerate(AXES):
        anywhere = _pick(uniform(seed, 3 + k, "draw"), F.col(f"n{a}"))
        d = d.withColumn(f"c{a}", F.when(F.col("fg"), F.coalesce(f"v{a}", F.floor(F.col(f"n{a}") / 2))).otherwise(anywhere))
    return _corner(d, size).select("draw", CASE, "fg", *[f"{a}{s}" for s in (0, 1) for a in AXES])


def pos_neg_crops(labels: DataFrame, volumes: DataFrame, size, per_case=4, pos=2, neg=1, seed=42) -> DataFrame:
    """Crops per volume centred on foreground or background voxels at pos : neg.

    The r-th background voxel of a plane is found from that plane's foreground positions,
    so background rows are never built."""
    d = volumes.select(CASE, *SHAPE, F.explode(F.sequence(F.lit(0), F.lit(per_case - 1))).alias("draw"))
    planes = labels.groupBy(CASE, "z").agg(F.count("*").alias("m"))
    every = volumes.select(CASE, "ny", "nx", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z"))
    every = every.join(planes, [CASE, "z"], "left").fillna(0, ["m"])
    every = every.withColumn("b", F.col("ny") * F.col("nx") - F.col("m"))
    w = W.partitionBy(CASE).orderBy("z")  # one row per plane
    every = every.withColumn("b_end", F.sum("b").over(w)).withColumn("f_end", F.sum("m").over(w))
    totals = every.groupBy(CASE).agg(F.sum("m").alias("fg_n"), F.sum("b").alias("bg_n"))
    d = d.join(totals, CASE)
    want = uniform(seed, 0, CASE, "draw") < pos / (pos + neg)
    fg = (want & (F.col("fg_n") > 0)) | (F.col("bg_n") == 0)
    d = d.withColumn("fg", fg).withColumn("r", _pick(uniform(seed, 1, CASE, "draw"), F.when(fg, F.col("fg_n")).otherwise(F.col("bg_n"))))
    end, size_ = F.when(F.col("fg"), F.col("f_end")).otherwise(F.col("b_end")), F.when(F.col("fg"), F.col("m")).otherwise(F.col("b"))
    d = (d.join(every.select(CASE, "z", "m", "b", "b_end", "f_end"), CASE)
         .filter((F.col("r") < end) & (F.col("r") >= end - size_)).withColumn("r", F.col("r") - (end - size_)))
    spot = labels.join(d.select(CASE, "z").distinct(), [CASE, "z"], "left_semi")
    spot = spot.join(volumes.select(CASE, F.col("nx").alias("_w")), CASE)
    spot = spot.select(CASE, "z", (F.col("y") * F.col("_w") + F.col("x")).alias("p"))
    spot = spot.withColumn("i", F.row_number().over(W.partitionBy(CASE, "z").orderBy("p")) - 1)
    j = d.join(spot, [CASE, "z"], "left")
    keys = [CASE, "draw", "fg", "z", "r", *SHAPE]
    j = j.groupBy(*keys).agg(F.max(F.when(F.col("i") == F.col("r"), F.col("p"))).alias("hit"),
                             F.count_if(F.col("p") - F.col("i") <= F.col("r")).alias("skip"))
    at = F.when(F.col("fg"), F.col("hit")).otherwise(F.col("r") + F.col("skip"))
    j = (j.withColumn("_p", at.cast("int")).withColumn("cz", F.col("z"))
         .withColumn("cy", F.floor(F.col("_p") / F.col("nx"))).withColumn("cx", F.col("_p") % F.col("nx")))
    return _corner(j, size).select(CASE, "draw", "fg", "cz", "cy", "cx", *[f"{a}{s}" for s in (0, 1) for a in AXES])


def _slice_table(labels, volumes, margin):
    s = positive_slices(labels)
    any_ = F.sequence(F.lit(0), F.col("nz") - 1)
    d = volumes.select(CASE, *SHAPE).join(s, CASE, "left")
    near = F.filter(any_, lambda z: ((z < F.col("first")) & (z >= F.col("first") - margin))
                    | ((z > F.col("last")) & (z < F.col("last") + margin)))
    return d.select(CASE, "nz", "slices", near.alias("near"))


def sample_slices(labels: DataFrame, volumes: DataFrame, n, seed=42, margin=15, redraws=10,
                  positive=0.7, nearby=0.2) -> DataFrame:
    """Slice draws: positive planes, planes within the margin of them, or any plane.

    A volume without positives is redrawn up to ``redraws`` times, in training and validation alike."""
    tries = 1 + redraws
    spark = volumes.sparkSession
    table = _slice_table(labels, volumes, margin)
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn(
        "try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    d = _with_cases(draws, volumes.select(CASE, *SHAPE), uniform(seed, 0, "draw", "try"), volumes.count())
    flag = labels.select(CASE).distinct().withColumn("_pos", F.lit(1))
    d = d.join(flag, CASE, "left").groupBy("draw").agg(
        F.min_by(CASE, F.when(F.col("_pos") == 1, F.col("try")).otherwise(F.lit(tries) - F.col("try") + tries)).alias(CASE))
    d = d.join(table, CASE)
    u = uniform(seed, 1, "draw")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    kind = (F.when((u < positive) & F.col("slices").isNotNull(), "positive")
            .when((u >= positive) & (u < positive + nearby) & F.col("near").isNotNull() & has("near"), "near").otherwise("any"))
    d = d.withColumn("kind", kind)
    pool = (F.when(F.col("kind") == "positive", F.col("slices")).when(F.col("kind") == "near", F.col("near"))
            .otherwise(F.sequence(F.lit(0), F.col("nz") - 1)))
    d = d.withColumn("_pool", pool)
    z = F.element_at("_pool", (_pick(uniform(seed, 2, "draw"), F.size("_pool")) + 1).cast("int"))
    return d.select("draw", CASE, "kind", z.alias("z"))


def sample_val_slices(labels, volumes, n, seed=42) -> DataFrame:
    return sample_slices(labels, volumes, n, seed, positive=0.5, nearby=0.0)


def weighted_sample(df: DataFrame, key: str, weight: str, n=None, seed=42, per_bucket=20_000) -> DataFrame:
    """Draws with replacement in proportion to the weight, as many as rows by default.

    Weights are accumulated per hash bucket of about ``per_bucket`` rows and inside it; each draw
    looks its bucket up in the totals and takes the last row starting at or before it, by one
    ordered pass per bucket. The totals are read once, so bounds are the same for all draws."""
    spark = df.sparkSession
    total = df.count()
    buckets = max(1, -(-total // per_bucket))
    rows = df.filter(F.col(weight) > 0).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    per = rows.groupBy("_b").agg(F.sum(weight).alias("_w")).orderBy("_b").toPandas()  # one row a bucket
    if not len(per):
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), key)
    ends = per["_w"].to_numpy().cumsum()
    number = per["_b"].to_numpy()

    def place(batches):
        for pdf in batches:
            u = pdf["_u"].to_numpy() * ends[-1]
            at = np.minimum(np.searchsorted(ends, u, "right"), len(ends) - 1)  # the last bucket has no end
            yield pd.DataFrame({"_b": number[at], "_t": u - np.where(at > 0, ends[at - 1], 0.0), "draw": pdf["draw"]})
    start = F.coalesce(F.sum(weight).over(
        W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.select("_b", F.col(key).alias("_key"), start.alias("_t"), F.lit(None).cast("long").alias("draw"))
    draws = spark.range(n if n is not None else total).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_u", uniform(seed, 0, "draw")).mapInPandas(place, "_b long, _t double, draw long")
    draws = draws.select("_b", F.lit(None).cast(df.schema[key].dataType).alias("_key"), "_t", "draw")
    order = W.partitionBy("_b").orderBy("_t", F.col("draw").asc_nulls_first())
    return (rows.unionByName(draws).withColumn(key, F.last("_key", True).over(order))
            .filter("draw is not null").select("draw", key))
