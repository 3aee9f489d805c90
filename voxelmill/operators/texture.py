"""Texture features of a region: first order, co-occurrence and run length.

Formulas follow the public IBSI / PyRadiomics documentation. Matrices are small tables
(case, direction, level, ...), so every feature is a weighted sum over their rows.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from voxelmill.functions import arrays
from voxelmill.functions.grouped import map_groups
from voxelmill.model import AXES, CASE, VOXEL, attach, wide_quantiles

BIN_WIDTH = 25.0
# one of each opposite pair, so that the first non-zero step is +1
DIRECTIONS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)
              if (a, b, c) > (0, 0, 0)]


def discretise(roi: DataFrame, volumes: DataFrame, width=BIN_WIDTH) -> DataFrame:
    """Grey level g = floor(v / width) - floor(min / width) + 1 per region voxel."""
    low = roi.groupBy(CASE).agg(F.floor(F.min("value") / width).alias("_lo"))
    g = (F.floor(F.col("value") / width) - F.col("_lo") + 1).cast("int")
    return attach(roi, low, volumes).withColumn("g", g).drop("_lo")


def firstorder(levels: DataFrame, volumes: DataFrame) -> DataFrame:
    """18 first-order features of voxels (value, g)."""
    v = F.col("value")
    q = wide_quantiles(levels, [CASE], "value", (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9)), volumes)
    known = attach(levels, q, volumes)
    inside = (v >= F.col("p10")) & (v <= F.col("p90"))
    base = known.groupBy(CASE).agg(
        F.count("*").alias("n"), F.sum(v * v).alias("Energy"), F.min(v).alias("Minimum"),
        F.max(v).alias("Maximum"), F.avg(v).alias("Mean"), F.avg(F.when(inside, v)).alias("_mid"))
    d = v - F.col("Mean")
    moments = attach(known, base.select(CASE, "Mean", "_mid"), volumes).groupBy(CASE).agg(
        F.avg(F.abs(d)).alias("MeanAbsoluteDeviation"),
        F.avg(F.when(inside, F.abs(v - F.col("_mid")))).alias("RobustMeanAbsoluteDeviation"),
        F.avg(d * d).alias("Variance"), F.avg(d * d * d).alias("_m3"), F.avg(d * d * d * d).alias("_m4"))
    hist = levels.groupBy(CASE, "g").agg(F.count("*").alias("c")).join(base.select(CASE, "n"), CASE)
    p = F.col("c") / F.col("n")
    shape = hist.groupBy(CASE).agg((-F.sum(p * F.log2(p))).alias("Entropy"), F.sum(p * p).alias("Uniformity"))
    d = (base.join(q, CASE).join(moments, CASE).join(shape, CASE)
         .join(volumes.select(CASE, (F.col("sz") * F.col("sy") * F.col("sx")).alias("_vol")), CASE))
    var = F.col("Variance")
    ratio = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    return d.select(
        CASE, "Energy", (F.col("Energy") * F.col("_vol")).alias("TotalEnergy"), "Entropy", "Minimum",
        F.col("p10").alias("10Percentile"), F.col("p90").alias("90Percentile"), "Maximum", "Mean",
        F.col("p50").alias("Median"), (F.col("p75") - F.col("p25")).alias("InterquartileRange"),
        (F.col("Maximum") - F.col("Minimum")).alias("Range"), "MeanAbsoluteDeviation",
        "RobustMeanAbsoluteDeviation", F.sqrt(F.col("Energy") / F.col("n")).alias("RootMeanSquared"),
        ratio(F.col("_m3"), F.pow(var, 1.5)).alias("Skewness"), ratio(F.col("_m4"), var * var).alias("Kurtosis"),
        "Variance", "Uniformity")


def glcm_matrix(levels: DataFrame) -> DataFrame:
    """p(g1, g2) per case and direction at distance 1, symmetric and normalised."""
    dirs = F.explode(F.array(*[F.struct(F.lit(i).alias("dir"), *[F.lit(s).alias(f"d{a}") for a, s in zip(AXES, d)])
                               for i, d in enumerate(DIRECTIONS)]))
    src = levels.select(*VOXEL, F.col("g").alias("g1"), dirs.alias("o"))
    src = src.select(CASE, *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], "o.dir", "g1")
    pairs = src.join(levels.select(*VOXEL, F.col("g").alias("g2")), VOXEL)
    counts = pairs.groupBy(CASE, "dir", "g1", "g2").agg(F.count("*").alias("c"))
    both = counts.unionByName(counts.select(CASE, "dir", F.col("g2").alias("g1"), F.col("g1").alias("g2"), "c"))
    sym = both.groupBy(CASE, "dir", "g1", "g2").agg(F.sum("c").alias("c"))
    # the window holds one matrix: levels squared rows
    return sym.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy(CASE, "dir"))).drop("c")


def _entropy(p):
    return -F.sum(p * F.log2(p))


def glcm(matrix: DataFrame, levels: DataFrame) -> DataFrame:
    """23 co-occurrence features per case, averaged over directions (MCC: glcm_mcc)."""
    key = [CASE, "dir"]
    i, j, p = F.col("g1").cast("double"), F.col("g2").cast("double"), F.col("p")
    ng = levels.groupBy(CASE).agg(F.max("g").cast("double").alias("ng"))
    px = matrix.groupBy(*key, "g1").agg(F.sum("p").alias("px"))
    mean = px.groupBy(*key).agg(F.sum(F.col("g1") * F.col("px")).alias("u"), _entropy(F.col("px")).alias("hx"))
    m = matrix.join(mean, key).join(ng, CASE)
    dev, gap, u = i + j - 2 * F.col("u"), i - j, F.col("u")
    s = m.groupBy(*key).agg(
        F.first("u").alias("u"), F.first("hx").alias("hx"), F.sum(p * i * j).alias("Autocorrelation"),
        F.sum(p * dev * dev * dev * dev).alias("ClusterProminence"), F.sum(p * dev * dev * dev).alias("ClusterShade"),
        F.sum(p * dev * dev).alias("ClusterTendency"), F.sum(p * gap * gap).alias("Contrast"),
        F.sum(p * (i - u) * (i - u)).alias("SumSquares"), F.sum(p * p).alias("JointEnergy"),
        _entropy(p).alias("JointEntropy"), F.sum(p / (1 + gap * gap)).alias("Idm"),
        F.sum(p / (1 + gap * gap / (F.col("ng") * F.col("ng")))).alias("Idmn"),
        F.sum(p / (1 + F.abs(gap))).alias("Id"), F.sum(p / (1 + F.abs(gap) / F.col("ng"))).alias("Idn"),
        F.sum(F.when(gap != 0, p / (gap * gap)).otherwise(0.0)).alias("InverseVariance"),
        F.max(p).alias("MaximumProbability"), F.sum(p * (i + j)).alias("SumAverage"))
    diff = matrix.groupBy(*key, F.abs(gap).alias("k")).agg(F.sum("p").alias("pd"))
    k, pd = F.col("k"), F.col("pd")
    diff = diff.groupBy(*key).agg(F.sum(k * pd).alias("DifferenceAverage"), F.sum(k * k * pd).alias("_k2"),
                                  _entropy(pd).alias("DifferenceEntropy"))
    plus = matrix.groupBy(*key, (i + j).alias("k")).agg(F.sum("p").alias("ps")).groupBy(*key).agg(
        _entropy(F.col("ps")).alias("SumEntropy"))
    d = s.join(diff, key).join(plus, key)
    hx, hxy = F.col("hx"), F.col("JointEntropy")
    # with p > 0 both HXY1 and HXY2 equal HX + HY, and HX = HY by symmetry
    d = (d.withColumn("JointAverage", F.col("u"))
         .withColumn("Correlation", F.when(F.col("SumSquares") > 0, (F.col("Autocorrelation") - u * u)
                                           / F.col("SumSquares")).otherwise(1.0))
         .withColumn("DifferenceVariance", F.col("_k2") - F.col("DifferenceAverage") * F.col("DifferenceAverage"))
         .withColumn("Imc1", F.when(hx > 0, (hxy - 2 * hx) / hx).otherwise(0.0))
         .withColumn("Imc2", F.when(2 * hx > hxy, F.sqrt(1 - F.exp(-2 * (2 * hx - hxy)))).otherwise(0.0)))
    return d.groupBy(CASE).agg(*[F.avg(n).alias(n) for n in GLCM_NAMES])


# Feature names.
GLCM_NAMES = """Autocorrelation JointAverage ClusterProminence ClusterShade ClusterTendency Contrast
Correlation DifferenceAverage DifferenceEntropy DifferenceVariance JointEnergy JointEntropy Imc1 Imc2 Idm
Idmn Id Idn InverseVariance MaximumProbability SumAverage SumEntropy SumSquares""".split()


def glcm_mcc(matrix: DataFrame) -> DataFrame:
    """Maximal correlation coefficient: second eigenvalue of each small matrix, mean over directions."""
    per = map_groups(matrix.select(CASE, "dir", "g1", "g2", "p"), [CASE, "dir"], arrays.second_eigen,
                     f"{CASE} string, dir int, mcc double")
    return per.groupBy(CASE).agg(F.avg("mcc").alias("MCC"))


def run_lengths(levels: DataFrame) -> DataFrame:
    """Maximal runs of equal grey level along each direction: (case, dir, g, len, runs).

    Position minus rank is constant inside a run; a window holds one ray of the grid.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("dir"), *[F.lit(s).alias(f"d{a}") for a, s in zip(AXES, d)])
                                for i, d in enumerate(DIRECTIONS)]))
    d = levels.select(*VOXEL, "g", parts.alias("o")).select(*VOXEL, "g", "o.*")
    pos = F.when(F.col("dz") != 0, F.col("z")).when(F.col("dy") != 0, F.col("y")).otherwise(F.col("x"))
    d = d.withColumn("pos", pos)
    ray = [(F.col(a) - F.col("pos") * F.col(f"d{a}")).alias(f"r{a}") for a in AXES]
    d = d.select(CASE, "dir", "g", "pos", *ray)
    key = [CASE, "dir", "g", "rz", "ry", "rx"]
    island = F.col("pos") - F.row_number().over(W.partitionBy(*key).orderBy("pos"))
    runs = d.withColumn("island", island).groupBy(*key, "island").agg(F.count("*").alias("len"))
    return runs.groupBy(CASE, "dir", "g", "len").agg(F.count("*").alias("runs"))


GLRLM_NAMES = """ShortRunEmphasis LongRunEmphasis GrayLevelNonUniformity GrayLevelNonUniformityNormalized
RunLengthNonUniformity RunLengthNonUniformityNormalized RunPercentage GrayLevelVariance RunVariance RunEntropy
LowGrayLevelRunEmphasis HighGrayLevelRunEmphasis ShortRunLowGrayLevelEmphasis ShortRunHighGrayLevelEmphasis
LongRunLowGrayLevelEmphasis LongRunHighGrayLevelEmphasis""".split()


def glrlm(runs: DataFrame) -> DataFrame:
    """16 run-length features per case, averaged over directions."""
    key = [CASE, "dir"]
    g, n, c = F.col("g").cast("double"), F.col("len").cast("double"), F.col("runs").cast("double")
    tot = runs.groupBy(*key).agg(F.sum(c).alias("nr"), F.sum(c * n).alias("np"), F.sum(c * g).alias("_g"),
                                 F.sum(c * n).alias("_l"))
    d = runs.join(tot, key)
    nr = F.col("nr")
    p = c / nr
    mg, ml = F.col("_g") / nr, F.col("_l") / nr
    s = d.groupBy(*key).agg(
        F.first("nr").alias("nr"), F.first("np").alias("np"), F.sum(p / (n * n)).alias("ShortRunEmphasis"),
        F.sum(p * n * n).alias("LongRunEmphasis"), F.sum(p * (g - mg) * (g - mg)).alias("GrayLevelVariance"),
        F.sum(p * (n - ml) * (n - ml)).alias("RunVariance"), _entropy(p).alias("RunEntropy"),
        F.sum(p / (g * g)).alias("LowGrayLevelRunEmphasis"), F.sum(p * g * g).alias("HighGrayLevelRunEmphasis"),
        F.sum(p / (g * g * n * n)).alias("ShortRunLowGrayLevelEmphasis"),
        F.sum(p * g * g / (n * n)).alias("ShortRunHighGrayLevelEmphasis"),
        F.sum(p * n * n / (g * g)).alias("LongRunLowGrayLevelEmphasis"),
        F.sum(p * g * g * n * n).alias("LongRunHighGrayLevelEmphasis"))
    square = lambda col, name: runs.groupBy(*key, col).agg(F.sum(c).alias("m")).groupBy(*key).agg(
        F.sum(F.col("m") * F.col("m")).alias(name))
    d = s.join(square("g", "_gln"), key).join(square("len", "_rln"), key)
    d = (d.withColumn("GrayLevelNonUniformity", F.col("_gln") / nr)
         .withColumn("GrayLevelNonUniformityNormalized", F.col("_gln") / (nr * nr))
         .withColumn("RunLengthNonUniformity", F.col("_rln") / nr)
         .withColumn("RunLengthNonUniformityNormalized", F.col("_rln") / (nr * nr))
         .withColumn("RunPercentage", nr / F.col("np")))
    return d.groupBy(CASE).agg(*[F.avg(x).alias(x) for x in GLRLM_NAMES])


def texture(roi: DataFrame, volumes: DataFrame) -> DataFrame:
    """All 58 features of a region's voxels (value), prefixed by their class."""
    levels = discretise(roi, volumes).checkpoint()  # read by four feature groups
    matrix = glcm_matrix(levels).checkpoint()
    parts = [("firstorder", firstorder(levels, volumes)), ("glcm", glcm(matrix, levels)),
             ("glcm", glcm_mcc(matrix)), ("glrlm", glrlm(run_lengths(levels)))]
    out = levels.select(CASE).distinct()  # a group without values leaves its columns NULL
    for prefix, d in parts:
        d = d.select(CASE, *[F.col(f"`{c}`").alias(f"original_{prefix}_{c}") for c in d.columns if c != CASE])
        d = d.checkpoint()  # small per-case table; keeps the joined plan short
        out = out.join(d, CASE, "left")
    return out
