"""Intensity normalisation and augmentation on dense voxels(case_id, z, y, x, value)."""

from pyspark.sql import DataFrame, functions as F

from voxelmill.functions.scalars import clip
from voxelmill.model import AXES, CASE, VOXEL, attach, wide_quantiles
from voxelmill.operators.metrics import mean_std, percentiles

BAND = (("p_low", 0.005), ("p_high", 0.995))


def _with(vox, stats, volumes, value):
    cols = vox.columns
    return attach(vox, stats, volumes).withColumn("value", value).select(*cols)


def pct_scale(vox: DataFrame, volumes: DataFrame, band=BAND) -> DataFrame:
    """Percentile band to 0..1, clipped (public MONAI rule; an empty band only shifts)."""
    lo, hi = F.col("p_low"), F.col("p_high")
    scaled = F.when(hi > lo, clip((F.col("value") - lo) / (hi - lo), 0.0, 1.0)).otherwise(F.col("value") - lo)
    return _with(vox, percentiles(vox, band, volumes=volumes), volumes, scaled)


def nonzero_zscore(vox: DataFrame, volumes: DataFrame) -> DataFrame:
    """z-score over non-zero voxels; zeros stay, a zero deviation divides by 1."""
    s = mean_std(vox.filter(F.col("value") != 0))
    sd = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    keep = vox.columns
    d = attach(vox, s, volumes, "left")
    return d.withColumn("value", F.when(F.col("value") != 0, (F.col("value") - F.col("mean")) / sd).otherwise(F.col("value"))).select(*keep)


def clipped(vox: DataFrame, volumes: DataFrame, band=BAND) -> DataFrame:
    return _with(vox, percentiles(vox, band, volumes=volumes), volumes, clip(F.col("value"), F.col("p_low"), F.col("p_high")))


def clip_zscore(vox: DataFrame, volumes: DataFrame, band=BAND) -> DataFrame:
    """Clip to the band, then (v - mean) / (std + 1e-8) of the clipped values."""
    c = clipped(vox, volumes, band)
    return _with(c, mean_std(c), volumes, (F.col("value") - F.col("mean")) / (F.col("std") + 1e-8))


def guarded_zscore(vox: DataFrame, volumes: DataFrame, band=BAND) -> DataFrame:
    c = clipped(vox, volumes, band)
    d = F.col("value") - F.col("mean")
    return _with(c, mean_std(c), volumes, F.when(F.col("std") > 1e-8, d / F.col("std")).otherwise(d))


def pct_minmax(vox: DataFrame, volumes: DataFrame, band=BAND) -> DataFrame:
    lo, hi = F.col("p_low"), F.col("p_high")
    scaled = F.when(hi - lo < 1e-8, 0.0).otherwise((clip(F.col("value"), lo, hi) - lo) / (hi - lo))
    return _with(vox, percentiles(vox, band, volumes=volumes), volumes, scaled)


def minmax(vox: DataFrame, volumes: DataFrame) -> DataFrame:
    s = vox.groupBy(CASE).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return _with(vox, s, volumes, F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.0))


# Histogram percentiles; 25 and 75 are trained but the map does not use them.
LANDMARKS = (1, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 99)
MAPPED = (1, 10, 20, 30, 40, 50, 60, 70, 80, 90, 99)


def hist_landmarks(ref: DataFrame, where=None) -> DataFrame:
    """Percentiles of the reference voxels (default value > 0) scaled so that 1 -> 0, 99 -> 100."""
    q = percentiles(ref, [(f"l{p}", p / 100.0) for p in LANDMARKS], F.col("value") > 0 if where is None else where)
    lo, hi = F.col("l1"), F.col("l99")
    return q.select(CASE, *[F.try_divide((F.col(f"l{p}") - lo) * 100.0, hi - lo).alias(f"l{p}") for p in LANDMARKS])


def hist_match(vox: DataFrame, landmarks: DataFrame, volumes: DataFrame, only=None) -> DataFrame:
    """Piecewise linear map of each case's percentiles to the landmarks (one row); the end
    segments extrapolate. Percentiles use all voxels of ``vox``; ``only`` maps a subset."""
    q = wide_quantiles(vox, [CASE], "value", [(f"p{p}", p / 100.0) for p in MAPPED], volumes)
    # an aggregate is one row even of an empty table, so a wrong number of landmarks is seen
    names = [f"l{p}" for p in MAPPED]
    one = landmarks.agg(F.count("*").alias("_n"), *[F.first(n).alias(n) for n in names])
    wrong = F.raise_error(F.lit("histogram matching needs the landmarks of exactly one volume"))
    one = one.select(*[F.when(F.col("_n") == 1, F.col(n)).otherwise(wrong).alias(n) for n in names])
    q = q.join(F.broadcast(one))
    slope = []
    for a, b in zip(MAPPED, MAPPED[1:]):
        run = F.col(f"p{b}") - F.col(f"p{a}")
        slope.append(F.when(run != 0, (F.col(f"l{b}") - F.col(f"l{a}")) / run).otherwise(0.0))
    inner = MAPPED[1:-1]
    ends = [F.array(*[F.col(f"{c}{a}") for a in MAPPED[:-1]]) for c in "pl"]
    q = q.select(CASE, F.array(*slope).alias("_k"), ends[0].alias("_p"), ends[1].alias("_l"), *[f"p{p}" for p in inner])
    seg = sum(((F.col("value") >= F.col(f"p{p}")).cast("int") for p in inner), F.lit(1))
    # from the beginning of the segment, so that a percentile becomes its landmark to the last bit
    value = (F.col("value") - F.element_at("_p", seg)) * F.element_at("_k", seg) + F.element_at("_l", seg)
    return _with(vox if only is None else only, q, volumes, value)


# --- augmentation: parameters per case from a seeded hash -----------------------------

def uniform(seed, slot, *keys):
    """0 <= u < 1 from the seeded hash of the keys; the same after a task is re-run."""
    return F.pmod(F.xxhash64(F.lit(int(seed)), F.lit(int(slot)), *keys), F.lit(1 << 30)) / float(1 << 30)


def add_noise(vox, p=0.2, sd=0.1, seed=42, variance=None) -> DataFrame:
    """Gaussian noise in a share p of the cases (Box-Muller on voxel hashes).

    With ``variance`` (low, high) each case draws its own variance between the two instead of ``sd``."""
    if variance is not None:
        sd = F.sqrt(variance[0] + (variance[1] - variance[0]) * uniform(seed, 3, CASE))
    u1 = 1.0 - uniform(seed, 1, *VOXEL)
    g = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * uniform(seed, 2, *VOXEL))
    return vox.withColumn("value", F.when(uniform(seed, 0, CASE) < p, F.col("value") + sd * g).otherwise(F.col("value")))


def gamma(vox: DataFrame, volumes: DataFrame, g=None, seed=42, p=1.0, span=(0.7, 1.3), normalised=False) -> DataFrame:
    """(v - min + 1e-5) ** g + min; g drawn per case unless given.

    ``normalised`` takes the power of the share of the range instead: ((v - min) / (range + 1e-7)) ** g
    * range + min, so the ends stay where they are (the library form, span 0.5 to 1.5)."""
    low = vox.groupBy(CASE).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    power = F.lit(float(g)) if g is not None else span[0] + (span[1] - span[0]) * uniform(seed, 1, CASE)
    v = F.pow(F.col("value") - F.col("lo") + 1e-5, power) + F.col("lo")
    if normalised:
        span_of = F.col("hi") - F.col("lo")
        v = F.pow((F.col("value") - F.col("lo")) / (span_of + 1e-7), power) * span_of + F.col("lo")
    return _with(vox, low, volumes, v if p >= 1 else F.when(uniform(seed, 0, CASE) < p, v).otherwise(F.col("value")))


def brightness(vox, shift=None, seed=42, p=0.9, span=0.1) -> DataFrame:
    if shift is not None:
        return vox.withColumn("value", F.col("value") + float(shift))
    s = (2.0 * uniform(seed, 1, CASE) - 1.0) * span
    return vox.withColumn("value", F.when(uniform(seed, 0, CASE) < p, F.col("value") + s).otherwise(F.col("value")))


def brightness_contrast(vox, contrast=None, shift=None, seed=42, p=0.2, limits=(0.2, 0.2), unit=1.0) -> DataFrame:
    """value * contrast + shift * unit: contrast 1 +- limits[0] and shift +- limits[1] drawn per case unless given.

    ``unit`` is the largest value of the scale, 1 for real-valued images."""
    drawn = lambda slot, limit: (2.0 * uniform(seed, slot, CASE) - 1.0) * limit
    factor = F.lit(float(contrast)) if contrast is not None else 1.0 + drawn(1, limits[0])
    offset = F.lit(float(shift)) if shift is not None else drawn(2, limits[1])
    v = F.col("value") * factor + offset * unit
    fixed = contrast is not None and shift is not None
    return vox.withColumn("value", v if fixed else F.when(uniform(seed, 0, CASE) < p, v).otherwise(F.col("value")))


def mult_noise(vox, seed=42, p=0.2, span=(0.9, 1.1)) -> DataFrame:
    m = span[0] + (span[1] - span[0]) * uniform(seed, 1, CASE)
    return vox.withColumn("value", F.when(uniform(seed, 0, CASE) < p, F.col("value") * m).otherwise(F.col("value")))


def bias_powers(order=3):
    """Exponents (i, j, k) with i + j + k <= order, the last running fastest."""
    return [(i, j, k) for i in range(order + 1) for j in range(order + 1 - i)
            for k in range(order + 1 - i - j)]


def bias_field(vox: DataFrame, volumes: DataFrame, coefficients, order=3, before=None) -> DataFrame:
    """value * exp(polynomial) in coordinates scaled to -1..1 (public TorchIO form).

    ``before`` names a column that keeps the value as it was."""
    if before:
        vox = vox.withColumn(before, F.col("value"))
    cols = vox.columns
    d = attach(vox, volumes.select(CASE, "nz", "ny", "nx"), volumes)
    t = {}
    for a in AXES:
        half = F.col(f"n{a}") / 2.0
        t[a] = F.when(F.col(f"n{a}") > 1, (F.col(a) - half + 0.5) / (half - 0.5)).otherwise(0.0)
    for a in AXES:
        d = d.withColumn(f"t{a}", t[a])
    poly = F.lit(0.0)
    for c, powers in zip(coefficients, bias_powers(order)):
        term = F.lit(float(c))
        for a, n in zip(AXES, powers):
            for _ in range(n):
                term = term * F.col(f"t{a}")
        poly = poly + term
    return d.withColumn("value", F.col("value") * F.exp(poly)).select(*cols)


def bias_difference(vox: DataFrame, volumes: DataFrame, coefficients, order=3) -> DataFrame:
    """What the bias field adds to each value, in the pass that computes it."""
    d = bias_field(vox, volumes, coefficients, order, "_before")
    return d.withColumn("value", F.col("value") - F.col("_before")).drop("_before")


def diff_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of two images that come from different tables."""
    return a.join(b.select(*VOXEL, F.col("value").alias("_b")), VOXEL).select(
        *VOXEL, (F.col("value") - F.col("_b")).alias("value"))
