"""Displacement generators (2.8) and the full overlay geometry (2.2)."""

from pyspark.sql import functions as F

from voxelmill.catalog import query
from voxelmill.catalog.measures import BLUM, FEET, FRAME, GRID, PLANE, rounded
from voxelmill.catalog.study import VOLUMES_SQL, study, vox_ctes
from voxelmill.catalog.volumes import CONTACT, DIAMOND2, sum_sql, voxel_sum
from voxelmill.model import CASE
from voxelmill.operators import displacement as dp, geometry as g
from voxelmill.plans.overlay import overlay

SEED, SIGMA = 42, 1.0
M32 = 4294967295


def _mix_sql(x, name):
    """Three chained columns of the 32-bit finaliser of ``x``; the last is ``name``."""
    times = lambda v, c: f"CAST((CAST({v} AS HUGEINT) * {c}) % {M32 + 1} AS BIGINT)"
    return (f"{times(f'xor({x}, ({x}) >> 16)', 2146121005)} AS {name}_1, "
            f"{times(f'xor({name}_1, {name}_1 >> 15)', 2221713035)} AS {name}_2, xor({name}_2, {name}_2 >> 16) AS {name}")


def _blur_sql(src, axis, values):
    """The values of a table blurred along an axis: seven weights of a Gaussian of one voxel, nothing beyond the ends."""
    others = ", ".join(a for a in "zyx" if a != axis)
    line = f"OVER (PARTITION BY case_id, {others} ORDER BY {axis})"
    terms = lambda v: " + ".join(f"g{abs(t)} * coalesce({'lag' if t < 0 else 'lead'}({v}, {abs(t)}) {line}, 0)" if t else f"g0 * {v}"
                                 for t in range(-3, 4))
    return f"SELECT case_id, z, y, x, magnitude, g0, g1, g2, g3, {', '.join(f'{terms(v)} AS {v}' for v in values)} FROM {src}"


# crc32 of seed and case id, bit by bit, is the key of a case
ELASTIC = f""", keyed AS MATERIALIZED (SELECT *, xor(list_reduce(list_prepend(CAST({M32} AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), {M32}) AS key
  FROM (SELECT *, '{SEED}/' || case_id AS name FROM volumes)),
weight AS (SELECT 1 / s AS g0, exp(-0.5) / s AS g1, exp(-2.0) / s AS g2, exp(-4.5) / s AS g3 FROM (SELECT 1 + 2 * (exp(-0.5) + exp(-2.0) + exp(-4.5)) AS s)),
cells AS MATERIALIZED (SELECT case_id, k, key, axis, z, y, x FROM keyed, (SELECT unnest([0, 1, 2]) AS axis), (SELECT range AS z FROM range(14)), (SELECT range AS y FROM range(21)), (SELECT range AS x FROM range(16))
  WHERE z < nz AND y < ny AND x < nx),
h0 AS MATERIALIZED (SELECT case_id, k, axis, z, y, x, {_mix_sql('xor(key, axis)', 'a')} FROM cells),
h1 AS MATERIALIZED (SELECT case_id, k, axis, z, y, x, {_mix_sql('xor(a, z)', 'b')} FROM h0),
h2 AS MATERIALIZED (SELECT case_id, k, axis, z, y, x, {_mix_sql('xor(b, y)', 'c')} FROM h1),
h3 AS MATERIALIZED (SELECT case_id, k, axis, z, y, x, {_mix_sql('xor(c, x)', 'd')} FROM h2),
noise AS MATERIALIZED (SELECT case_id, z, y, x, any_value(2.0 + k % 3) AS magnitude, {', '.join(f"max(CASE WHEN axis = {i} THEN CAST(d AS DOUBLE) / 2147483648 - 1 END) AS d{a}" for i, a in enumerate('zyx'))}
  FROM h3 GROUP BY case_id, z, y, x),
f0 AS (SELECT * FROM noise, weight), f1 AS MATERIALIZED ({_blur_sql('f0', 'z', ('dz', 'dy', 'dx'))}), f2 AS MATERIALIZED ({_blur_sql('f1', 'y', ('dz', 'dy', 'dx'))}),
f3 AS MATERIALIZED ({_blur_sql('f2', 'x', ('dz', 'dy', 'dx'))}),
field AS MATERIALIZED (SELECT case_id, z, y, x, {', '.join(f'magnitude * d{a} AS d{a}' for a in 'zyx')} FROM f3)"""


def _elastic(s):
    params = s.volumes.select(CASE, F.lit(SIGMA).alias("sigma"), (2.0 + F.col("k") % 3).alias("magnitude"))
    return dp.elastic_displacement(s.volumes, params, SEED)


@query("geo_elastic", "WITH RECURSIVE " + VOLUMES_SQL + ELASTIC + """
SELECT case_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(dz, 6) AS dz, round(dy, 6) AS dy, round(dx, 6) AS dx FROM field""")
def geo_elastic(spark, sf):
    """The elastic field of every case, voxel by voxel."""
    return rounded(_elastic(study(spark, sf)), 6)


def _warped_sql(field):
    """The image read at voxel + displacement, by the eight corners around it."""
    return f"""pts AS (SELECT f.case_id, f.z, f.y, f.x, f.z + dz AS fz, f.y + dy AS fy, f.x + dx AS fx FROM {field} f),
corner AS (SELECT p.case_id, p.z, p.y, p.x, CAST(floor(fz) AS INTEGER) + a AS sz, CAST(floor(fy) AS INTEGER) + b AS sy, CAST(floor(fx) AS INTEGER) + c AS sx,
    abs(1 - a - (fz - floor(fz))) * abs(1 - b - (fy - floor(fy))) * abs(1 - c - (fx - floor(fx))) AS w
  FROM pts p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)),
warped AS (SELECT c.case_id, c.z, c.y, c.x, coalesce(sum(w * value), 0) AS value FROM corner c
  LEFT JOIN vox v ON v.case_id = c.case_id AND v.z = sz AND v.y = sy AND v.x = sx GROUP BY 1, 2, 3, 4)"""


@query("geo_warp_elastic", vox_ctes(ELASTIC.lstrip(", "), _warped_sql("field"), select=sum_sql("warped")))
def geo_warp_elastic(spark, sf):
    """Images moved by their elastic field."""
    s = study(spark, sf)
    return voxel_sum(g.warp(s.image(), s.volumes, _elastic(s)))


# --- grid distortion ---------------------------------------------------------------------------

def _steps(s):
    """Fixed stretches of 0.8 to 1.2 in two of three planes."""
    planes = s.volumes.select(CASE, "k", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z")).filter("(k + z) % 3 > 0")
    stretch = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: 0.8 + ((F.col("k") * a + F.col("z") * b + i * 5) % 9) / 20.0)
    return planes.select(CASE, "z", stretch(7, 3).alias("ysteps"), stretch(2, 11).alias("xsteps"))


def _mapped_sql(axis, a, b):
    """Places of the nodes of an axis by adding up cells, and of every place between them."""
    return f"""{axis}node AS (
  SELECT case_id, k, z, n, step, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS pos FROM (SELECT case_id, k, z, n{axis} AS n, greatest(n{axis} // 5, 1) AS step FROM plane)
  UNION ALL SELECT case_id, k, z, n, step, i + 1, CASE WHEN (i + 1) * step > n THEN n ELSE pos + step * (0.8 + ((k * {a} + z * {b} + least(i, 5) * 5) % 9) / CAST(20 AS DOUBLE)) END
  FROM {axis}node WHERE i * step < n),
{axis}map AS (SELECT p.case_id, p.z, v AS {axis}, p.pos + (q.pos - p.pos) * CASE WHEN least(p.step, p.n - p.i * p.step) > 1 THEN (v - p.i * p.step) / CAST(least(p.step, p.n - p.i * p.step) - 1 AS DOUBLE) ELSE 0 END - v AS d{axis}
  FROM {axis}node p JOIN {axis}node q ON p.case_id = q.case_id AND p.z = q.z AND q.i = p.i + 1, (SELECT CAST(range AS INTEGER) AS v FROM range(21)) WHERE v < p.n AND v // p.step = p.i)"""


DISTORTED = ("plane AS (SELECT case_id, k, ny, nx, CAST(range AS INTEGER) AS z FROM volumes, range(14) WHERE range < nz AND (k + range) % 3 > 0),\n"
             + _mapped_sql("y", 7, 3) + ",\n" + _mapped_sql("x", 2, 11)
             + ",\nmoved AS (SELECT a.case_id, a.z, y, x, CAST(0 AS DOUBLE) AS dz, dy, dx FROM ymap a JOIN xmap b ON a.case_id = b.case_id AND a.z = b.z)")


@query("geo_grid_distort", "WITH RECURSIVE " + VOLUMES_SQL + ",\n" + DISTORTED + """
SELECT case_id, z, y, x, dz, round(dy, 6) AS dy, round(dx, 6) AS dx FROM moved""")
def geo_grid_distort(spark, sf):
    """The displacement of planes with moved grid lines, voxel by voxel."""
    s = study(spark, sf)
    return rounded(dp.grid_displacement(s.volumes, _steps(s)), 6)


@query("geo_warp_grid", vox_ctes(DISTORTED, """every AS (SELECT v.case_id, v.z, v.y, v.x, coalesce(dz, 0) AS dz, coalesce(dy, 0) AS dy, coalesce(dx, 0) AS dx
  FROM vox v LEFT JOIN moved m ON v.case_id = m.case_id AND v.z = m.z AND v.y = m.y AND v.x = m.x)""", _warped_sql("every"), select=sum_sql("warped")))
def geo_warp_grid(spark, sf):
    """Images of distorted planes; the other planes stay."""
    s = study(spark, sf)
    return voxel_sum(g.warp(s.image(), s.volumes, dp.grid_displacement(s.volumes, _steps(s))))


# --- overlay -------------------------------------------------------------------------------------

#: Keeps binary fractions off the rounding edge.
OFF = 0.0000137


def _rows_sql(kind, src, a, b, t="CAST(0 AS DOUBLE)"):
    ends = ", ".join(f"round({e} + CAST({OFF} AS DOUBLE), 3) AS {k}{n}" for k, p in (("a", a), ("b", b)) for n, e in zip("zyx", p))
    return f"SELECT case_id, '{kind}' AS kind, {t} AS t, {ends} FROM {src}"


def _on(point, direction, by):
    return tuple(f"({p}) + ({by}) * ({d})" for p, d in zip(point, direction))


def _named(prefix):
    return tuple(prefix + a for a in "zyx")


_QUARTERS = ", (SELECT CAST(range AS DOUBLE) / 4 AS t FROM range(5))"
_LONG, _SHORT, _ORIGIN = ("0", "ly", "lx"), ("0", "hy", "hx"), ("oz", "oy", "ox")
_CORNERS = [(-30, -30), (30, -30), (30, 30), (-30, 30)]
_corner = lambda c: _on(_on(_named("g"), _named("i"), c[0]), _named("j"), c[1])

OVERLAY_PARTS = ("""gm AS MATERIALIZED (SELECT * FROM gr), lm AS MATERIALIZED (SELECT * FROM line), pm AS MATERIALIZED (SELECT * FROM plane), fm AS MATERIALIZED (SELECT * FROM fr),
bare AS (SELECT f.case_id, coalesce(f.fz * f.sz, 50) AS m FROM feet f WHERE f.case_id NOT IN (SELECT case_id FROM gm)),
pf AS (SELECT *, uy * iz_x - ux * iz_y AS kz, ux * iz_z - uz * iz_x AS ky, uz * iz_y - uy * iz_z AS kx, iz_z AS iz, iz_y AS iy, iz_x AS ix FROM (
  SELECT *, CASE WHEN m > 0 THEN (1 - uz * uz) / m ELSE 0 END AS iz_z, CASE WHEN m > 0 THEN -uz * uy / m ELSE 0 END AS iz_y, CASE WHEN m > 0 THEN -uz * ux / m ELSE 1 END AS iz_x
  FROM (SELECT *, sqrt((1 - uz * uz) * (1 - uz * uz) + uz * uy * uz * uy + uz * ux * uz * ux) AS m FROM pm))),
pl AS MATERIALIZED (SELECT *, kz / r AS jz, ky / r AS jy, kx / r AS jx FROM (SELECT *, sqrt(kz * kz + ky * ky + kx * kx) AS r FROM pf)),
bp AS MATERIALIZED (SELECT l.case_id, label, l.z * sz AS pz, l.y * sy AS py, l.x * sx AS px, l.z, l.y, l.x, round(l.z*sz*qz + l.y*sy*qy + l.x*sx*qx, 9) AS p, uz, uy, ux, qz, qy, qx FROM labels l JOIN fm fr ON l.case_id = fr.case_id
  WHERE label = 3 OR (label = 2 AND CASE WHEN t0 < f0 THEN l.z >= f0 ELSE l.z <= f0 END)),
be AS (SELECT DISTINCT ON (case_id, label) * FROM bp ORDER BY case_id, label, p, z, y, x),
tr AS MATERIALIZED (SELECT a.*, b.pz AS ez, b.py AS ey, b.px AS ex, (a.pz - b.pz) * a.qz + (a.py - b.py) * a.qy + (a.px - b.px) * a.qx AS way FROM be a JOIN be b ON a.case_id = b.case_id WHERE a.label = 3 AND b.label = 2),
sp AS MATERIALIZED (SELECT l.case_id, l.z * sz AS pz, l.y * sy AS py, l.x * sx AS px, l.z, l.y, l.x, round(l.y*sy*cy + l.x*sx*cx, 9) AS p, cy, cx, tz * sz AS mz, ty * sy AS my, tx * sx AS mx
  FROM labels l JOIN (SELECT *, qy / sqrt(qy*qy + qx*qx) AS cy, qx / sqrt(qy*qy + qx*qx) AS cx FROM fm) f ON l.case_id = f.case_id WHERE label = 3 AND l.z = t0),
lo AS (SELECT DISTINCT ON (case_id) * FROM sp ORDER BY case_id, p, z, y, x), hi AS (SELECT DISTINCT ON (case_id) * FROM sp ORDER BY case_id, p DESC, z, y, x),
tl AS MATERIALIZED (SELECT hi.*, lo.pz AS ez, lo.py AS ey, lo.px AS ex, (hi.my - hi.py) * hi.cy + (hi.mx - hi.px) * hi.cx AS way FROM hi JOIN lo ON hi.case_id = lo.case_id WHERE hi.p > lo.p)""")
OVERLAY_ROWS = "\nUNION ALL ".join([
    _rows_sql("grid_long", "gm" + _QUARTERS, _on(_ORIGIN, _SHORT, "t * depth"), _on(_on(_ORIGIN, _SHORT, "t * depth"), _LONG, "length"), "t"),
    _rows_sql("grid_short", "gm" + _QUARTERS, _on(_ORIGIN, _LONG, "t * length"), _on(_on(_ORIGIN, _LONG, "t * length"), _SHORT, "depth"), "t"),
    _rows_sql("fallback_long", "bare" + _QUARTERS, ("m", "40 + 40 * t", "60.0"), ("m", "40 + 40 * t", "100.0"), "t"),
    _rows_sql("fallback_short", "bare" + _QUARTERS, ("m", "40.0", "60 + 40 * t"), ("m", "80.0", "60 + 40 * t"), "t"),
    _rows_sql("reference_edge", "gm", _ORIGIN, _on(_ORIGIN, _LONG, "length")),
    _rows_sql("blumensaat", "lm", ("bz", "p1y", "p1x"), ("bz", "p2y", "p2x")),
    _rows_sql("ligament", "feet WHERE fz IS NOT NULL AND tz IS NOT NULL", ("fz * sz", "fy * sy", "fx * sx"), ("tz * sz", "ty * sy", "tx * sx")),
    *[_rows_sql(f"plane_{k}", "pl", _named("g"), _on(_named("g"), _named(c), 1)) for k, c in (("i", "i"), ("j", "j"), ("n", "u"))],
    *[_rows_sql("plane_edge", "pl", _corner(p), _corner(q), f"CAST({k} AS DOUBLE)") for k, (p, q) in enumerate(zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))],
    _rows_sql("normal_tibia", "tr", _on(_named("p"), _named("u"), -40), _on(_named("p"), _named("u"), 40)),
    _rows_sql("normal_femur", "tr", _on(_named("e"), _named("u"), -40), _on(_named("e"), _named("u"), 40)),
    _rows_sql("measure", "tr", _named("e"), _on(_named("e"), _named("q"), "way")),
    _rows_sql("tibial_line", "tl", _named("p"), _named("e")),
    _rows_sql("tibial_centroid", "tl", _named("m"), _on(_named("p"), ("0", "cy", "cx"), "way"))])


@query("fn_overlay", vox_ctes(DIAMOND2, CONTACT, FEET, BLUM, GRID, PLANE, FRAME, OVERLAY_PARTS, select=OVERLAY_ROWS))
def fn_overlay(spark, sf):
    """Every line drawn over a knee."""
    s = study(spark, sf)
    lines = overlay(s.labels(), s.volumes)
    return lines.select(CASE, "kind", "t", *[F.round(F.col(k + a) + OFF, 3).alias(k + a) for k in "ab" for a in "zyx"])
