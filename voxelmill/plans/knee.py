"""Knee measures, one row per case, composed from the operators.

Every measure is an aggregate over label voxels with the few per-case scalars it needs
attached; NULL stands for a measure that cannot be taken.
"""

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from voxelmill.functions import scalars as fn
from voxelmill.model import AXES, CASE, attach
from voxelmill.operators.metrics import arg_extreme, label_volume
from voxelmill.operators.morphology import contact, nearest_distance

ACL, FEMUR, TIBIA = 1, 2, 3


def to_mm(df: DataFrame, volumes: DataFrame) -> DataFrame:
    d = attach(df, volumes.select(CASE, "sz", "sy", "sx"), volumes)
    return d.select(*df.columns, *[(F.col(a) * F.col(f"s{a}")).alias(f"p{a}") for a in AXES])


def footprints(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per case: femoral (f*), tibial (t*) contact and ACL (a*) centroids in voxels, the
    same in mm (mf*, mt*, ma*), with grid and spacing columns for the later measures."""
    touch = contact(labels, volumes, ACL, (FEMUR, TIBIA))
    mean = lambda pre, lab: [F.avg(F.when(F.col("label") == lab, F.col(a))).alias(f"{pre}{a}") for a in AXES]
    feet = touch.groupBy(CASE).agg(*mean("f", FEMUR), *mean("t", TIBIA))
    acl = labels.filter(F.col("label") == ACL).groupBy(CASE).agg(*mean("a", ACL))
    d = volumes.select(CASE, "nz", "ny", "nx", "sz", "sy", "sx").join(feet, CASE, "left").join(acl, CASE, "left")
    return d.select("*", *[(F.col(f"{p}{a}") * F.col(f"s{a}")).alias(f"m{p}{a}") for p in "fta" for a in AXES])


def laterality(labels: DataFrame, volumes: DataFrame, feet: DataFrame = None) -> DataFrame:
    """Right when the tibial contact lies at a higher dim0 than the femoral one, else Left.

    Without contacts the ACL halves above and below its mean dim1 stand in; else Unknown."""
    feet = feet if feet is not None else footprints(labels, volumes)
    acl = labels.filter(F.col("label") == ACL)
    mid = acl.groupBy(CASE).agg(F.avg("y").alias("mid"))
    upper = F.col("y") < F.col("mid")
    halves = attach(acl, mid, volumes).groupBy(CASE).agg(
        F.avg(F.when(upper, F.col("z"))).alias("uz"), F.avg(F.when(~upper, F.col("z"))).alias("lz"))
    both = F.col("fz").isNotNull() & F.col("tz").isNotNull()
    f = F.when(both, F.col("fz")).otherwise(F.col("uz"))
    t = F.when(both, F.col("tz")).otherwise(F.col("lz"))
    side = F.when(f.isNull() | t.isNull(), "Unknown").when(t > f, "Right").otherwise("Left")
    return feet.join(halves, CASE, "left").select(CASE, side.alias("laterality"))


def canonicalise(df: DataFrame, sides: DataFrame, volumes: DataFrame) -> DataFrame:
    """Right cases mirrored along dim0, all others unchanged."""
    cols = df.columns
    plan = volumes.select(CASE, "nz").join(sides, CASE)
    z = F.when(F.col("laterality") == "Right", F.col("nz") - 1 - F.col("z")).otherwise(F.col("z"))
    return attach(df, plan, volumes).withColumn("z", z).select(*cols)


def _sign(c, zero):
    return F.when(c > 0, 1).when(c < 0, -1).otherwise(zero)


def blumensaat(labels: DataFrame, volumes: DataFrame, feet: DataFrame) -> DataFrame:
    """Line through the last femur voxel before the contact on each ray of one sagittal slice."""
    fallback = F.col("fz") + 10 * _sign(F.col("tz") - F.col("fz"), 1)
    cut = fn.clip(fn.round_index(F.coalesce("az", fallback)), 0, F.col("nz") - 1)
    p = feet.filter("fy is not null").select(
        CASE, cut.alias("cut"), fn.trunc_index(F.col("fy")).alias("yc"), fn.trunc_index(F.col("fx")).alias("xc"))
    hit = attach(labels.filter(F.col("label") == FEMUR), p, volumes).filter(
        (F.col("z") == F.col("cut")) & (F.col("y") >= F.col("yc") - 20) & (F.col("y") < F.col("yc") + 20)
        & (F.col("x") < F.col("xc")))
    edge = hit.groupBy(CASE, "cut", "y").agg(F.max("x").alias("x"))
    line = edge.groupBy(CASE, "cut").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("icpt"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    line = line.filter("n >= 2 and slope is not null").join(volumes.select(CASE, "sz", "sy", "sx"), CASE)
    y = lambda x: (F.col("slope") * F.col(x) + F.col("icpt")) * F.col("sy")
    return line.select(CASE, "cut", (F.col("cut") * F.col("sz")).alias("bz"), y("x0").alias("p1y"),
                       (F.col("x0") * F.col("sx")).alias("p1x"), y("x1").alias("p2y"),
                       (F.col("x1") * F.col("sx")).alias("p2x"))


def bh_grid(labels: DataFrame, volumes: DataFrame, feet: DataFrame, line: DataFrame) -> DataFrame:
    """Grid over the lateral condyle: origin, unit axes, length and depth."""
    dy, dx = F.col("p2y") - F.col("p1y"), F.col("p2x") - F.col("p1x")
    p = line.withColumn("len0", F.sqrt(dy * dy + dx * dx)).filter("len0 > 0")
    p = p.withColumn("ly", dy / F.col("len0")).withColumn("lx", dx / F.col("len0"))
    turn = F.when(-F.col("lx") < 0, -1.0).otherwise(1.0)
    p = p.withColumn("hy", -F.col("lx") * turn).withColumn("hx", F.col("ly") * turn)
    p = p.join(feet.select(CASE, "fz", "tz", "sy", "sx"), CASE).withColumn(
        "lat", -_sign(F.col("tz") - F.col("fz"), 1))
    slab = attach(labels.filter(F.col("label") == FEMUR), p, volumes).filter(
        F.when(F.col("lat") > 0, F.col("z") >= F.col("cut")).otherwise(F.col("z") <= F.col("cut")))
    y, x = F.col("y") * F.col("sy") - F.col("p1y"), F.col("x") * F.col("sx") - F.col("p1x")
    proj = slab.select(CASE, (y * F.col("ly") + x * F.col("lx")).alias("u"),
                       (y * F.col("hy") + x * F.col("hx")).alias("v")).filter("v > -5.0")
    ends = proj.groupBy(CASE).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.max("v").alias("v1"))
    g = p.join(ends, CASE, "left")
    u0 = F.coalesce("u0", F.lit(0.0))
    v1 = F.coalesce("v1", "len0")
    return g.select(CASE, F.col("bz").alias("oz"), (F.col("p1y") + u0 * F.col("ly")).alias("oy"),
                    (F.col("p1x") + u0 * F.col("lx")).alias("ox"), "ly", "lx", "hy", "hx",
                    (F.coalesce("u1", "len0") - u0).alias("length"),
                    F.when(v1 <= 0, F.col("len0")).otherwise(v1).alias("depth"))


def grid_lines(grid: DataFrame) -> DataFrame:
    """Five lines each way across the grid, as start and end points in mm."""
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i / 4.0))
    g = grid.withColumn("t", t)
    point = lambda u, v: (F.col("oz"), F.col("oy") + u * F.col("ly") + v * F.col("hy"),
                          F.col("ox") + u * F.col("lx") + v * F.col("hx"))
    rows = []
    for kind, a, b in (("long", (0.0, F.col("t") * F.col("depth")), (F.col("length"), F.col("t") * F.col("depth"))),
                       ("short", (F.col("t") * F.col("length"), 0.0), (F.col("t") * F.col("length"), F.col("depth")))):
        start, end = point(*a), point(*b)
        rows.append(g.select(CASE, F.lit(kind).alias("kind"), "t",
                             *[c.alias(f"a{n}") for c, n in zip(start, AXES)],
                             *[c.alias(f"b{n}") for c, n in zip(end, AXES)]))
    return rows[0].unionByName(rows[1])


def bh_percent(grid: DataFrame, feet: DataFrame) -> DataFrame:
    d = grid.join(feet.select(CASE, "mfy", "mfx", "mty", "mtx"), CASE)
    y, x = F.col("mfy") - F.col("oy"), F.col("mfx") - F.col("ox")
    raw = (y * F.col("ly") + x * F.col("lx")) / F.col("length") * 100.0
    ahead = F.col("ly") * (F.col("mty") - F.col("mfy")) + F.col("lx") * (F.col("mtx") - F.col("mfx")) > 0
    return d.select(
        CASE, F.when(F.col("length") > 0, F.when(ahead, raw).otherwise(100.0 - raw)).alias("BH_Length_pct"),
        F.when(F.col("depth") > 0, (y * F.col("hy") + x * F.col("hx")) / F.col("depth") * 100.0)
        .alias("BH_Depth_pct"))


# --- tibial plateau ------------------------------------------------------------------

def top_fraction(points: DataFrame, fraction=0.15, least=3) -> DataFrame:
    """The first int(fraction * n) rows of each case by y (then z, x), at least min(least, n).

    Whole y planes are taken by their counts; only the plane at the cut is ranked."""
    cols = points.columns
    n = points.groupBy(CASE).agg(F.count("*").alias("_n"))
    want = F.floor(F.round(F.col("_n") * fraction, 9))
    quota = n.select(CASE, F.when(want < least, F.least(F.lit(least), F.col("_n"))).otherwise(want).alias("_want"))
    planes = points.groupBy(CASE, "y").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(W.partitionBy(CASE).orderBy("y"))  # one row per plane
    planes = planes.withColumn("_end", upto).join(quota, CASE).withColumn(
        "_left", F.col("_want") - (F.col("_end") - F.col("_m"))).filter("_left > 0")
    kept = points.join(planes.select(CASE, "y", "_m", "_left"), [CASE, "y"])
    whole = kept.filter("_m <= _left")
    order = F.row_number().over(W.partitionBy(CASE, "y").orderBy("z", "x"))
    part = kept.filter("_m > _left").withColumn("_r", order).filter("_r <= _left")
    return whole.select(*cols).unionByName(part.select(*cols))


def smallest_eigenvalue(czz, cyy, cxx, czy, czx, cyx):
    """Of a symmetric 3x3 matrix, by the trigonometric closed form; NULL for a multiple
    of the identity, which has no direction."""
    q = (czz + cyy + cxx) / 3.0
    off = czy * czy + czx * czx + cyx * cyx
    dev = F.sqrt(((czz - q) * (czz - q) + (cyy - q) * (cyy - q) + (cxx - q) * (cxx - q) + 2.0 * off) / 6.0)
    b = [F.try_divide(c, dev) for c in (czz - q, cyy - q, cxx - q, czy, czx, cyx)]
    det = (b[0] * (b[1] * b[2] - b[5] * b[5]) - b[3] * (b[3] * b[2] - b[5] * b[4])
           + b[4] * (b[3] * b[5] - b[1] * b[4]))
    third_turn = 2.0 * math.pi / 3.0
    return q + 2.0 * dev * F.cos(F.acos(fn.clip(det / 2.0, -1.0, 1.0)) / 3.0 + third_turn)


def plane_fit(points: DataFrame, by=(CASE,)) -> DataFrame:
    """Centroid and normal (direction of least variance) of physical points pz, py, px.

    The normal is the longest cross product of two rows of C - l*I."""
    c = lambda a, b: F.covar_pop(f"p{a}", f"p{b}").alias(f"c{a}{b}")
    d = points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f"p{a}").alias(f"g{a}") for a in AXES],
                                c("z", "z"), c("y", "y"), c("x", "x"), c("z", "y"), c("z", "x"), c("y", "x"))
    col = F.col
    low = smallest_eigenvalue(*[col(f"c{k}") for k in ("zz", "yy", "xx", "zy", "zx", "yx")])
    d = d.withColumn("low", low)
    rows = [(col("czz") - col("low"), col("czy"), col("czx")), (col("czy"), col("cyy") - col("low"), col("cyx")),
            (col("czx"), col("cyx"), col("cxx") - col("low"))]
    for i, (p, r) in enumerate(((0, 1), (0, 2), (1, 2))):
        v = fn.cross(rows[p], rows[r])
        for a, comp in zip(AXES, v):
            d = d.withColumn(f"k{i}{a}", comp)
        d = d.withColumn(f"k{i}", fn.dot(v, v))
    best = F.greatest("k0", "k1", "k2")
    for a in AXES:
        pick = F.when(col("k0") == best, col(f"k0{a}")).when(col("k1") == best, col(f"k1{a}")).otherwise(col(f"k2{a}"))
        d = d.withColumn(f"n{a}", F.when(best > 0, pick / F.sqrt(best)))
    return d.select(*by, "n", "gz", "gy", "gx", "nz", "ny", "nx")


def tibial_plane(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Plateau normal (pointing to smaller dim1) and centre from the top 15 % of the tibia."""
    tib = labels.filter(F.col("label") == TIBIA)
    top = plane_fit(to_mm(top_fraction(tib), volumes)).select(
        CASE, "n", *[F.col(f"g{a}").alias(f"g{a}") for a in AXES], *[F.col(f"n{a}").alias(f"v{a}") for a in AXES])
    every = to_mm(tib, volumes).groupBy(CASE).agg(*[F.avg(f"p{a}").alias(f"e{a}") for a in AXES])
    d = volumes.select(CASE).join(top, CASE, "left").join(every, CASE, "left")
    fitted = (F.col("n") >= 3) & F.col("vy").isNotNull()
    turn = F.when(F.col("vy") > 0, -1.0).otherwise(1.0)
    flat = {"z": 0.0, "y": -1.0, "x": 0.0}
    empty = {"z": 0.0, "y": 1.0, "x": 0.0}
    return d.select(CASE, *[F.when(F.col("n").isNull(), empty[a]).when(fitted, F.col(f"v{a}") * turn)
                            .otherwise(flat[a]).alias(f"n{a}") for a in AXES],
                    *[F.when(F.col("n").isNull(), 0.0).when(F.col("n") >= 3, F.col(f"g{a}"))
                      .otherwise(F.col(f"e{a}")).alias(f"g{a}") for a in AXES])


def acl_angles(feet: DataFrame, plane: DataFrame) -> DataFrame:
    """Angle of the ACL to the plateau and, seen from the side and front, to the vertical."""
    d = feet.join(plane.select(CASE, *[F.col(f"n{a}").alias(f"v{a}") for a in AXES]), CASE)
    v = fn.unit(fn.sub(fn.cols("mf"), fn.cols("mt")))
    up = fn.vec(0, -1, 0)
    return d.select(CASE, (90.0 - fn.angle(v, fn.cols("v"))).alias("angle_to_plateau_deg"),
                    fn.angle(fn.unit(fn.vec(0, v[1], v[2])), up).alias("sagittal_angle_deg"),
                    fn.angle(fn.unit(fn.vec(v[0], v[1], 0)), up).alias("coronal_angle_deg"))


def impingement(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    one = lambda k: labels.filter(F.col("label") == k).withColumn("label", F.lit(0))
    return nearest_distance(one(ACL), one(FEMUR), volumes).groupBy(CASE).agg(
        F.min("dist").alias("min_dist_to_femur_mm"))


def notch_width(labels: DataFrame, volumes: DataFrame, feet: DataFrame) -> DataFrame:
    """Gap between the femur walls on the dim0 ray through the rounded ACL centroid."""
    from voxelmill.operators.geometry import ray_hits
    p = feet.filter("az is not null").select(CASE, *[fn.round_index(F.col(f"a{a}")).alias(f"r{a}") for a in AXES])
    ray = attach(labels.filter(F.col("label") == FEMUR), p, volumes).filter("y = ry and x = rx")
    walls = attach(ray_hits(ray, p.select(CASE, F.col("rz").alias("at")), volumes), volumes.select(CASE, "sz"), volumes)
    return walls.select(CASE, ((F.col("after") - F.col("before")) * F.col("sz")).alias("notch_width_mm"))


def path_length(points: DataFrame, order: str, by=(CASE,)) -> DataFrame:
    """Sum of the distances between consecutive points (pz, py, px)."""
    w = W.partitionBy(*by).orderBy(order)
    step = fn.norm(tuple(F.col(f"p{a}") - F.lag(f"p{a}").over(w) for a in AXES))
    return points.withColumn("_d", step).groupBy(*by).agg(
        F.sum("_d").alias("path"), F.count("*").alias("n_points"))


def tortuosity(labels: DataFrame, feet: DataFrame, volumes: DataFrame) -> DataFrame:
    """Path through the ACL slice centroids over the straight footprint distance, at least 1."""
    acl = to_mm(labels.filter(F.col("label") == ACL), volumes)
    slices = acl.groupBy(CASE, "y").agg(*[F.avg(f"p{a}").alias(f"p{a}") for a in AXES])
    d = feet.join(path_length(slices, "y"), CASE, "left")
    straight = fn.norm(fn.sub(fn.cols("mf"), fn.cols("mt")))
    value = F.when(straight > 0, F.when(F.coalesce("n_points", F.lit(0)) < 2, 1.0)
                   .otherwise(F.greatest(F.lit(1.0), F.col("path") / straight)))
    return d.select(CASE, value.alias("Tortuosity_Index"))


def _anterior(d: DataFrame) -> DataFrame:
    """Adds qz, qy, qx: the dim2 axis towards the tibial contact, laid into the plateau."""
    s = F.when(F.col("mtx") - F.col("mfx") < 0, -1.0).otherwise(1.0)
    axis = (F.lit(0.0), F.lit(0.0), s)
    v = fn.reject(axis, fn.cols("v"))
    n = fn.norm(v)
    for a, comp, raw in zip(AXES, v, axis):
        d = d.withColumn(f"q{a}", F.when(n > 0, comp / n).otherwise(raw))
    return d


def frame(feet, plane):
    """Cases with both contacts: plateau normal v and anterior direction q."""
    d = feet.filter("mfz is not null and mtz is not null").join(
        plane.select(CASE, *[F.col(f"n{a}").alias(f"v{a}") for a in AXES]), CASE)
    return _anterior(d)


def att(labels: DataFrame, volumes: DataFrame, feet: DataFrame, plane: DataFrame) -> DataFrame:
    """Anterior tibial translation, with the two posterior edge points (mm)."""
    f0, t0 = fn.round_index(F.col("fz")), fn.round_index(F.col("tz"))
    p = frame(feet, plane).select(CASE, "qz", "qy", "qx", "sz", "sy", "sx", "vz", "vy", "vx",
                                   fn.clip(f0, 0, F.col("nz") - 1).alias("cut"),
                                   (-_sign(t0 - f0, 1)).alias("lat"))
    bones = attach(labels.filter(F.col("label").isin(FEMUR, TIBIA)), p, volumes).filter(
        (F.col("label") == TIBIA)
        | F.when(F.col("lat") > 0, F.col("z") >= F.col("cut")).otherwise(F.col("z") <= F.col("cut")))
    # rounded: voxels that tie but for the last bits are told apart by their place
    proj = F.round(sum(F.col(a) * F.col(f"s{a}") * F.col(f"q{a}") for a in AXES), 9)
    ends = arg_extreme(bones, proj, "min", (CASE, "label"))
    part = lambda lab, pre: ends.filter(F.col("label") == lab).select(
        CASE, F.col("projection").alias(f"{pre}_edge"), *[F.col(a).alias(f"{pre}{a}") for a in AXES])
    d = part(TIBIA, "tib").join(part(FEMUR, "fem"), CASE).join(p, CASE)
    mm = [(F.col(f"{k}{a}") * F.col(f"s{a}")).alias(f"{k}_p{a}") for k in ("tib", "fem") for a in AXES]
    return d.select(CASE, (F.col("tib_edge") - F.col("fem_edge")).alias("ATT_mm"), *mm,
                    "qz", "qy", "qx", "vz", "vy", "vx")


def staubli(labels: DataFrame, volumes: DataFrame, feet: DataFrame, plane: DataFrame) -> DataFrame:
    """Tibial contact between the anterior (0 %) and posterior (100 %) edge of its slice."""
    d = frame(feet, plane)
    n = F.sqrt(F.col("qy") * F.col("qy") + F.col("qx") * F.col("qx"))
    s = F.when(F.col("mtx") - F.col("mfx") < 0, -1.0).otherwise(1.0)
    p = d.select(CASE, "sz", "sy", "sx", "mty", "mtx",
                 F.when(n > 0, F.col("qy") / n).otherwise(0.0).alias("ay"),
                 F.when(n > 0, F.col("qx") / n).otherwise(s).alias("ax"),
                 fn.clip(fn.round_index(F.col("tz")), 0, F.col("nz") - 1).alias("cut"))
    cut = attach(labels.filter(F.col("label") == TIBIA), p, volumes).filter("z = cut")
    proj = F.col("y") * F.col("sy") * F.col("ay") + F.col("x") * F.col("sx") * F.col("ax")
    ends = cut.groupBy(CASE).agg(F.max(proj).alias("ant"), F.min(proj).alias("post"))
    centre = F.col("mty") * F.col("ay") + F.col("mtx") * F.col("ax")
    pct = fn.clip((F.col("ant") - centre) / (F.col("ant") - F.col("post")) * 100.0, 0.0, 100.0)
    return ends.join(p, CASE).select(CASE, F.when(F.col("ant") > F.col("post"), pct).alias("Staubli_Tibial_pct"))


def measures(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """All geometric measures in one row per case.

    Each part is a small table written on its own: one plan over all of them would be
    re-optimised as a whole after every stage.
    """
    feet = footprints(labels, volumes).checkpoint()
    plane = tibial_plane(labels, volumes).checkpoint()
    line = blumensaat(labels, volumes, feet)
    parts = [staubli(labels, volumes, feet, plane), tortuosity(labels, feet, volumes),
             att(labels, volumes, feet, plane).select(CASE, "ATT_mm"),
             bh_percent(bh_grid(labels, volumes, feet, line), feet), acl_angles(feet, plane),
             label_volume(labels, volumes, ACL).withColumnRenamed("volume_mm3", "acl_volume_mm3"),
             impingement(labels, volumes), notch_width(labels, volumes, feet)]
    out = volumes.select(CASE)
    for p in parts:
        out = out.join(p.checkpoint(), CASE, "left")
    return out


def canonical_labels(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    return canonicalise(labels, laterality(labels, volumes), volumes)
