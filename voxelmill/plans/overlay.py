"""Coordinates (mm) of everything a viewer draws over a knee, one row per line.

Rows are (case_id, kind, t, az, ay, ax, bz, by, bx): the line from a to b; ``t`` numbers the lines of a
kind, 0 for single ones. A line whose ends cannot be measured has no row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.functions import scalars as fn
from voxelmill.model import AXES, CASE, attach
from voxelmill.operators.metrics import arg_extreme
from voxelmill.plans import knee
from voxelmill.session import ensure_checkpoint_dir

# Half length of the normals and half side of the drawn plateau plane; sagittal position and
# ranges of the stand-in grid.
NORMAL_MM, PLANE_MM = 40.0, 30.0
FALLBACK_Z, FALLBACK_Y, FALLBACK_X = 50.0, (40.0, 80.0), (60.0, 100.0)


def _line(d: DataFrame, kind, start, end, t=None) -> DataFrame:
    number = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    ends = [number(c).alias(f"{k}{a}") for k, p in (("a", start), ("b", end)) for c, a in zip(p, AXES)]
    return d.select(CASE, F.lit(kind).alias("kind"), (number(t) if t is not None else F.lit(0.0)).alias("t"), *ends)


def _along(point, direction, by):
    return tuple(p + by * d for p, d in zip(point, direction))


def _with_vector(d: DataFrame, name, vector) -> DataFrame:
    """Adds the components of a vector as generated columns: what reads them does not copy their expressions."""
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(f"{name}{a}") for c, a in zip(vector, AXES)]))))


def fallback_grid(cases: DataFrame) -> DataFrame:
    """Five lines each way of a fixed grid in the sagittal plane of the femoral centroid (mfz, null: FALLBACK_Z)."""
    d = cases.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i / 4.0)))
    z = F.coalesce("mfz", F.lit(FALLBACK_Z))
    at = lambda ends: F.lit(ends[0]) + F.col("t") * (ends[1] - ends[0])
    (y0, y1), (x0, x1) = FALLBACK_Y, FALLBACK_X
    return _line(d, "fallback_long", (z, at(FALLBACK_Y), x0), (z, at(FALLBACK_Y), x1), F.col("t")).unionByName(
        _line(d, "fallback_short", (z, y0, at(FALLBACK_X)), (z, y1, at(FALLBACK_X)), F.col("t")))


def plane_frame(plane: DataFrame) -> DataFrame:
    """Unit axes i (dim0 laid into the plane), j and normal n of the plateau at its centre, and its four drawn edges."""
    d = plane.select(CASE, *[F.col(f"g{a}") for a in AXES], *[F.col(f"n{a}").alias(f"u{a}") for a in AXES])
    d = _with_vector(d, "n", fn.unit(fn.cols("u")))
    laid = fn.reject(fn.vec(1, 0, 0), fn.cols("n"))
    size = fn.norm(laid)
    d = _with_vector(d, "i", [F.when(size > 0, c / size).otherwise(stand_in) for c, stand_in in zip(laid, (0.0, 0.0, 1.0))])
    d = _with_vector(d, "j", fn.unit(fn.cross(fn.cols("n"), fn.cols("i"))))
    d = d.filter("nz is not null and jz is not null")
    centre, i, j = fn.cols("g"), fn.cols("i"), fn.cols("j")
    rows = [_line(d, f"plane_{k}", centre, _along(centre, fn.cols(k), 1.0)) for k in "ijn"]
    corner = lambda p, q: _along(_along(centre, i, p * PLANE_MM), j, q * PLANE_MM)
    around = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    rows += [_line(d, "plane_edge", corner(*p), corner(*q), k) for k, (p, q) in enumerate(zip(around, around[1:] + around[:1]))]
    return reduce(DataFrame.unionByName, rows)


def translation_lines(att: DataFrame) -> DataFrame:
    """The normals through both posterior edge points, and from the femoral one the way to the level of the tibial one."""
    tibia, femur, n, q = (fn.cols(k) for k in ("tib_p", "fem_p", "v", "q"))
    way = fn.dot(fn.sub(tibia, femur), q)
    rows = [_line(att, f"normal_{k}", _along(p, n, -NORMAL_MM), _along(p, n, NORMAL_MM))
            for k, p in (("tibia", tibia), ("femur", femur))]
    return reduce(DataFrame.unionByName, [*rows, _line(att, "measure", femur, _along(femur, q, way))])


def tibial_edges(labels: DataFrame, volumes: DataFrame, feet: DataFrame, plane: DataFrame) -> DataFrame:
    """Anterior and posterior point of the tibia (mm) in the slice of its contact, with the sagittal axis qy, qx."""
    d = knee.frame(feet, plane)
    size = F.sqrt(F.col("qy") * F.col("qy") + F.col("qx") * F.col("qx"))
    p = d.filter(size > 0).select(CASE, "sz", "sy", "sx", "mtz", "mty", "mtx", (F.col("qy") / size).alias("ay"),
                                  (F.col("qx") / size).alias("ax"),
                                  fn.clip(fn.round_index(F.col("tz")), 0, F.col("nz") - 1).alias("cut"))
    cut = attach(labels.filter(F.col("label") == knee.TIBIA), p, volumes).filter("z = cut")
    along = F.round(F.col("y") * F.col("sy") * F.col("ay") + F.col("x") * F.col("sx") * F.col("ax"), 9)
    for k, mode in (("ant", "max"), ("post", "min")):
        end = arg_extreme(cut, along, mode).select(
            CASE, *[F.col(a).alias(f"{k}_{a}") for a in AXES], F.col("projection").alias(f"{k}_at"))
        p = p.join(end, CASE)
    return p.filter("ant_at > post_at").select(
        CASE, "mtz", "mty", "mtx", "ay", "ax",
        *[(F.col(f"{k}_{a}") * F.col(f"s{a}")).alias(f"{k}_p{a}") for k in ("ant", "post") for a in AXES])


def tibial_lines(edges: DataFrame) -> DataFrame:
    """The anterior-posterior line of the tibia, and from the tibial contact to its projection on that line."""
    front, back, centre = fn.cols("ant_p"), fn.cols("post_p"), fn.cols("mt")
    axis = (F.lit(0.0), F.col("ay"), F.col("ax"))
    foot = _along(front, axis, fn.dot(fn.sub(centre, front), axis))
    return _line(edges, "tibial_line", front, back).unionByName(_line(edges, "tibial_centroid", centre, foot))


def overlay(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """All lines of every case; a case without a condyle grid gets the fixed one.

    The parts are small tables (a row per case), each written on its own: one plan over all of them
    would be optimised as a whole after every stage.
    """
    ensure_checkpoint_dir(labels.sparkSession)
    feet = knee.footprints(labels, volumes).checkpoint()
    plane = knee.tibial_plane(labels, volumes).checkpoint()
    line = knee.blumensaat(labels, volumes, feet).checkpoint()
    grid = knee.bh_grid(labels, volumes, feet, line).checkpoint()
    att = knee.att(labels, volumes, feet, plane).checkpoint()
    edges = tibial_edges(labels, volumes, feet, plane).checkpoint()
    lines = knee.grid_lines(grid)
    origin, axis = fn.cols("o"), (F.lit(0.0), F.col("ly"), F.col("lx"))
    rows = [lines.withColumn("kind", F.concat(F.lit("grid_"), F.col("kind"))),
            fallback_grid(feet.join(grid, CASE, "left_anti")),
            _line(grid, "reference_edge", origin, _along(origin, axis, F.col("length"))),
            _line(line, "blumensaat", (F.col("bz"), F.col("p1y"), F.col("p1x")), (F.col("bz"), F.col("p2y"), F.col("p2x"))),
            _line(feet.filter("mfz is not null and mtz is not null"), "ligament", fn.cols("mf"), fn.cols("mt")),
            plane_frame(plane), translation_lines(att), tibial_lines(edges)]
    return reduce(DataFrame.unionByName, rows)
