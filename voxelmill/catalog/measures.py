"""Inventory 2.11, validation (2.4) and the overlay geometry of 2.2."""

from pyspark.sql import functions as F

from voxelmill.catalog import query
from voxelmill.catalog.study import study, vox_ctes, vox_sql
from voxelmill.catalog.volumes import CONTACT, DIAMOND2, NEAREST, voxel_sum
from voxelmill.model import CASE
from voxelmill.plans import knee
from voxelmill.session import ensure_checkpoint_dir, stored


def rounded(df, digits=5):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


FEET = """feet AS MATERIALIZED (SELECT v.case_id, v.k, nz, ny, nx, sz, sy, sx, fz, fy, fx, tz, ty, tx, az, ay, ax FROM volumes v
  LEFT JOIN (SELECT case_id, avg(z) FILTER (label = 2) AS fz, avg(y) FILTER (label = 2) AS fy, avg(x) FILTER (label = 2) AS fx,
    avg(z) FILTER (label = 3) AS tz, avg(y) FILTER (label = 3) AS ty, avg(x) FILTER (label = 3) AS tx FROM contact GROUP BY 1) c ON v.case_id = c.case_id
  LEFT JOIN (SELECT case_id, avg(z) AS az, avg(y) AS ay, avg(x) AS ax FROM labels WHERE label = 1 GROUP BY 1) a ON v.case_id = a.case_id)"""


@query("knee_footprints", vox_ctes(DIAMOND2, CONTACT, FEET, select="""
SELECT case_id, round(fz * sz, 5) AS mfz, round(fy * sy, 5) AS mfy, round(fx * sx, 5) AS mfx, round(tz * sz, 5) AS mtz, round(ty * sy, 5) AS mty, round(tx * sx, 5) AS mtx,
  round(az * sz, 5) AS maz, round(ay * sy, 5) AS may, round(ax * sx, 5) AS max FROM feet"""))
def knee_footprints(spark, sf):
    s = study(spark, sf)
    f = knee.footprints(s.labels(), s.volumes)
    return rounded(f.select(CASE, *[f"m{p}{a}" for p in "fta" for a in "zyx"]))


SIDE = """half AS (SELECT l.case_id, avg(CASE WHEN y < mid THEN z END) AS uz, avg(CASE WHEN y >= mid THEN z END) AS lz FROM labels l
  JOIN (SELECT case_id, avg(y) AS mid FROM labels WHERE label = 1 GROUP BY 1) m ON l.case_id = m.case_id WHERE label = 1 GROUP BY 1),
side AS (SELECT f.case_id, nz, CASE WHEN fz IS NOT NULL AND tz IS NOT NULL THEN CASE WHEN tz > fz THEN 'Right' ELSE 'Left' END
  WHEN uz IS NULL OR lz IS NULL THEN 'Unknown' WHEN lz > uz THEN 'Right' ELSE 'Left' END AS laterality FROM feet f LEFT JOIN half h ON f.case_id = h.case_id)"""


@query("knee_laterality", vox_ctes(DIAMOND2, CONTACT, FEET, SIDE, select="SELECT case_id, laterality FROM side"))
def knee_laterality(spark, sf):
    s = study(spark, sf)
    return knee.laterality(s.labels(), s.volumes)


@query("knee_canonical", vox_ctes(DIAMOND2, CONTACT, FEET, SIDE, select="""
SELECT l.case_id, CASE WHEN laterality = 'Right' THEN nz - 1 - z ELSE z END AS z, y, x, label FROM labels l JOIN side s ON l.case_id = s.case_id"""))
def knee_canonical(spark, sf):
    s = study(spark, sf)
    return knee.canonical_labels(s.labels(), s.volumes)


BLUM = """cutp AS (SELECT *, greatest(0, least(nz - 1, CAST(round_even(coalesce(az, fz + 10 * CASE WHEN tz < fz THEN -1 ELSE 1 END), 0) AS INTEGER))) AS cut,
    CAST(trunc(fy) AS INTEGER) AS yc, CAST(trunc(fx) AS INTEGER) AS xc FROM feet WHERE fy IS NOT NULL),
edge AS (SELECT l.case_id, cut, l.y, max(l.x) AS x FROM labels l JOIN cutp p ON l.case_id = p.case_id
  WHERE label = 2 AND z = cut AND l.y >= yc - 20 AND l.y < yc + 20 AND l.x < xc GROUP BY 1, 2, 3),
line AS (SELECT e.case_id, cut, cut * sz AS bz, (s * x0 + i) * sy AS p1y, x0 * sx AS p1x, (s * x1 + i) * sy AS p2y, x1 * sx AS p2x, sy, sx FROM (
  SELECT case_id, cut, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, min(x) AS x0, max(x) AS x1 FROM edge GROUP BY 1, 2 HAVING count(*) >= 2 AND min(x) < max(x)) e
  JOIN volumes v ON e.case_id = v.case_id)"""
GRID = """ln AS (SELECT l.*, f.fz, f.tz, fy, fx, ty, tx, sqrt((p2y-p1y)*(p2y-p1y) + (p2x-p1x)*(p2x-p1x)) AS len0 FROM line l JOIN feet f ON l.case_id = f.case_id),
ax AS (SELECT *, (p2y-p1y)/len0 AS ly, (p2x-p1x)/len0 AS lx, CASE WHEN -(p2x-p1x) < 0 THEN -1 ELSE 1 END AS tn FROM ln WHERE len0 > 0),
ax2 AS (SELECT *, -lx * tn AS hy, ly * tn AS hx FROM ax),
pj AS (SELECT a.case_id, min((l.y*sy-p1y)*ly + (l.x*sx-p1x)*lx) AS u0, max((l.y*sy-p1y)*ly + (l.x*sx-p1x)*lx) AS u1, max((l.y*sy-p1y)*hy + (l.x*sx-p1x)*hx) AS v1
  FROM labels l JOIN ax2 a ON l.case_id = a.case_id WHERE label = 2 AND CASE WHEN tz < fz THEN z >= cut ELSE z <= cut END AND (l.y*sy-p1y)*hy + (l.x*sx-p1x)*hx > -5 GROUP BY 1),
gr AS (SELECT a.case_id, bz AS oz, p1y + coalesce(u0, 0) * ly AS oy, p1x + coalesce(u0, 0) * lx AS ox, ly, lx, hy, hx, coalesce(u1, len0) - coalesce(u0, 0) AS length,
  CASE WHEN coalesce(v1, len0) <= 0 THEN len0 ELSE coalesce(v1, len0) END AS depth, fy*sy AS mfy, fx*sx AS mfx, ty*sy AS mty, tx*sx AS mtx FROM ax2 a LEFT JOIN pj ON a.case_id = pj.case_id)"""


def _line(s):
    ensure_checkpoint_dir(s.spark)
    lab = s.labels()
    feet = knee.footprints(lab, s.volumes)
    return lab, feet, knee.blumensaat(lab, s.volumes, feet)


@query("knee_blumensaat", vox_ctes(DIAMOND2, CONTACT, FEET, BLUM, select="""
SELECT case_id, cut, round(bz, 5) AS bz, round(p1y, 5) AS p1y, round(p1x, 5) AS p1x, round(p2y, 5) AS p2y, round(p2x, 5) AS p2x FROM line"""))
def knee_blumensaat(spark, sf):
    return rounded(_line(study(spark, sf))[2])


@query("knee_bh_grid", vox_ctes(DIAMOND2, CONTACT, FEET, BLUM, GRID, select="SELECT case_id, " + ", ".join(
    f"round({c}, 5) AS {c}" for c in ("oz", "oy", "ox", "ly", "lx", "hy", "hx", "length", "depth")) + " FROM gr"))
def knee_bh_grid(spark, sf):
    s = study(spark, sf)
    lab, feet, line = _line(s)
    return rounded(knee.bh_grid(lab, s.volumes, feet, line))


@query("knee_bh_pct", vox_ctes(DIAMOND2, CONTACT, FEET, BLUM, GRID, select="""
SELECT case_id, round(CASE WHEN length > 0 THEN CASE WHEN ly * (mty - mfy) + lx * (mtx - mfx) > 0 THEN r ELSE 100 - r END END, 5) AS "BH_Length_pct", round(d, 5) AS "BH_Depth_pct"
FROM (SELECT *, ((mfy-oy)*ly + (mfx-ox)*lx) / length * 100 AS r, CASE WHEN depth > 0 THEN ((mfy-oy)*hy + (mfx-ox)*hx) / depth * 100 END AS d FROM gr)"""))
def knee_bh_pct(spark, sf):
    s = study(spark, sf)
    lab, feet, line = _line(s)
    return rounded(knee.bh_percent(knee.bh_grid(lab, s.volumes, feet, line), feet))


@query("fn_plot_geometry", vox_ctes(DIAMOND2, CONTACT, FEET, BLUM, GRID, select="""
SELECT case_id, 'long' AS kind, t, round(oz, 5) AS az, round(oy + t*depth*hy, 5) AS ay, round(ox + t*depth*hx, 5) AS ax,
  round(oz, 5) AS bz, round(oy + length*ly + t*depth*hy, 5) AS by, round(ox + length*lx + t*depth*hx, 5) AS bx FROM gr, (SELECT CAST(range AS DOUBLE) / 4 AS t FROM range(5))
UNION ALL SELECT case_id, 'short', t, round(oz, 5), round(oy + t*length*ly, 5), round(ox + t*length*lx, 5), round(oz, 5), round(oy + t*length*ly + depth*hy, 5), round(ox + t*length*lx + depth*hx, 5)
FROM gr, (SELECT CAST(range AS DOUBLE) / 4 AS t FROM range(5))"""))
def fn_plot_geometry(spark, sf):
    s = study(spark, sf)
    lab, feet, line = _line(s)
    return rounded(knee.grid_lines(knee.bh_grid(lab, s.volumes, feet, line)))


# --- plateau: the same rule in SQL -----------------------------------------------------

PLANE = """tibr AS (SELECT l.case_id, z*sz AS pz, y*sy AS py, x*sx AS px, row_number() OVER (PARTITION BY l.case_id ORDER BY y, z, x) AS rn, count(*) OVER (PARTITION BY l.case_id) AS n
  FROM labels l JOIN volumes v ON l.case_id = v.case_id WHERE label = 3),
tops AS (SELECT * FROM tibr WHERE rn <= CASE WHEN floor(n * 0.15) < 3 THEN least(3, n) ELSE floor(n * 0.15) END),
cv AS (SELECT case_id, count(*) AS n, avg(pz) AS gz, avg(py) AS gy, avg(px) AS gx, covar_pop(pz,pz) AS a, covar_pop(py,py) AS b, covar_pop(px,px) AS c,
  covar_pop(pz,py) AS d, covar_pop(pz,px) AS e, covar_pop(py,px) AS f FROM tops GROUP BY 1),
ev0 AS (SELECT *, (a+b+c)/3 AS q, sqrt((((a-(a+b+c)/3)*(a-(a+b+c)/3)) + ((b-(a+b+c)/3)*(b-(a+b+c)/3)) + ((c-(a+b+c)/3)*(c-(a+b+c)/3)) + 2*(d*d+e*e+f*f))/6) AS p FROM cv),
ev AS (SELECT *, q + 2*p*cos(acos(greatest(-1, least(1, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e))/(p*p*p)/2)))/3 + 2*pi()/3) AS l FROM ev0),
cr AS (SELECT *, d*f-e*(b-l) AS z0, e*d-(a-l)*f AS y0, (a-l)*(b-l)-d*d AS x0, d*(c-l)-e*f AS z1, e*e-(a-l)*(c-l) AS y1, (a-l)*f-d*e AS x1,
  (b-l)*(c-l)-f*f AS z2, f*e-d*(c-l) AS y2, d*f-(b-l)*e AS x2 FROM ev),
ks AS (SELECT *, z0*z0+y0*y0+x0*x0 AS k0, z1*z1+y1*y1+x1*x1 AS k1, z2*z2+y2*y2+x2*x2 AS k2 FROM cr),
nv AS (SELECT case_id, gz, gy, gx, CASE WHEN k0 >= k1 AND k0 >= k2 THEN z0 WHEN k1 >= k2 THEN z1 ELSE z2 END / sqrt(greatest(k0,k1,k2)) AS wz,
  CASE WHEN k0 >= k1 AND k0 >= k2 THEN y0 WHEN k1 >= k2 THEN y1 ELSE y2 END / sqrt(greatest(k0,k1,k2)) AS wy,
  CASE WHEN k0 >= k1 AND k0 >= k2 THEN x0 WHEN k1 >= k2 THEN x1 ELSE x2 END / sqrt(greatest(k0,k1,k2)) AS wx FROM ks),
plane AS (SELECT v.case_id, coalesce(CASE WHEN wy > 0 THEN -wz ELSE wz END, 0) AS uz, coalesce(-abs(wy), 1) AS uy, coalesce(CASE WHEN wy > 0 THEN -wx ELSE wx END, 0) AS ux,
  coalesce(gz, 0) AS gz, coalesce(gy, 0) AS gy, coalesce(gx, 0) AS gx FROM volumes v LEFT JOIN nv ON v.case_id = nv.case_id)"""


@query("agg_plane_fit", vox_ctes(PLANE, select="SELECT case_id, round(gz, 4) AS gz, round(gy, 4) AS gy, round(gx, 4) AS gx, round(abs(wy), 4) AS slope FROM nv"))
def agg_plane_fit(spark, sf):
    s = study(spark, sf)
    tib = s.labels().filter("label = 3")
    fit = knee.plane_fit(knee.to_mm(knee.top_fraction(tib), s.volumes))
    return rounded(fit.select(CASE, "gz", "gy", "gx", F.abs("ny").alias("slope")), 4)


@query("win_top_fraction", vox_ctes(PLANE, select="SELECT t.case_id, CAST(pz / sz AS INTEGER) AS z, CAST(py / sy AS INTEGER) AS y, CAST(px / sx AS INTEGER) AS x FROM tops t JOIN volumes v ON t.case_id = v.case_id"))
def win_top_fraction(spark, sf):
    return knee.top_fraction(study(spark, sf).labels().filter("label = 3")).select(CASE, "z", "y", "x")


@query("knee_plateau", vox_ctes(PLANE, select="SELECT case_id, " + ", ".join(f"round({a}, 4) AS {b}" for a, b in (
    ("uz", "nz"), ("uy", "ny"), ("ux", "nx"), ("gz", "gz"), ("gy", "gy"), ("gx", "gx"))) + " FROM plane"))
def knee_plateau(spark, sf):
    s = study(spark, sf)
    return rounded(knee.tibial_plane(s.labels(), s.volumes), 4)


def _plane(s):
    lab = s.labels()
    return lab, knee.footprints(lab, s.volumes), knee.tibial_plane(lab, s.volumes)


ANGLE = """av AS (SELECT f.case_id, (fz-tz)*sz AS a, (fy-ty)*sy AS b, (fx-tx)*sx AS c, uz, uy, ux FROM feet f JOIN plane p ON f.case_id = p.case_id)"""


@query("knee_angles", vox_ctes(DIAMOND2, CONTACT, FEET, PLANE, ANGLE, select="""
SELECT case_id, round(CASE WHEN a IS NOT NULL THEN 90 - degrees(acos(least(1, abs(a*uz + b*uy + c*ux) / sqrt(a*a + b*b + c*c)))) END, 3) AS angle_to_plateau_deg,
  round(CASE WHEN b*b + c*c > 0 THEN degrees(acos(least(1, abs(b) / sqrt(b*b + c*c)))) END, 3) AS sagittal_angle_deg,
  round(CASE WHEN a*a + b*b > 0 THEN degrees(acos(least(1, abs(b) / sqrt(a*a + b*b)))) END, 3) AS coronal_angle_deg FROM av"""))
def knee_angles(spark, sf):
    _, feet, plane = _plane(study(spark, sf))
    return rounded(knee.acl_angles(feet, plane), 3)


FRAME = """fr0 AS (SELECT f.*, uz, uy, ux, CASE WHEN (tx-fx)*sx < 0 THEN -1 ELSE 1 END AS s FROM feet f JOIN plane p ON f.case_id = p.case_id WHERE fz IS NOT NULL AND tz IS NOT NULL),
fr1 AS (SELECT *, -s*ux*uz AS rz, -s*ux*uy AS ry, s - s*ux*ux AS rx FROM fr0),
fr AS (SELECT *, rz/sqrt(rz*rz+ry*ry+rx*rx) AS qz, ry/sqrt(rz*rz+ry*ry+rx*rx) AS qy, rx/sqrt(rz*rz+ry*ry+rx*rx) AS qx,
  CAST(round_even(fz, 0) AS INTEGER) AS f0, CAST(round_even(tz, 0) AS INTEGER) AS t0 FROM fr1)"""


@query("knee_att", vox_ctes(DIAMOND2, CONTACT, FEET, PLANE, FRAME, """pr AS (SELECT l.case_id, min(CASE WHEN label = 3 THEN l.z*sz*qz + l.y*sy*qy + l.x*sx*qx END) AS tb,
  min(CASE WHEN label = 2 AND CASE WHEN t0 < f0 THEN l.z >= f0 ELSE l.z <= f0 END THEN l.z*sz*qz + l.y*sy*qy + l.x*sx*qx END) AS fb FROM labels l JOIN fr ON l.case_id = fr.case_id GROUP BY 1)""",
       select="""SELECT case_id, round(tb - fb, 3) AS "ATT_mm" FROM pr WHERE tb IS NOT NULL AND fb IS NOT NULL"""))
def knee_att(spark, sf):
    s = study(spark, sf)
    return rounded(knee.att(s.labels(), s.volumes, *_plane(s)[1:]).select(CASE, "ATT_mm"), 3)


@query("knee_staubli", vox_ctes(DIAMOND2, CONTACT, FEET, PLANE, FRAME, """sl AS (SELECT l.case_id, max(l.y*sy*qy + l.x*sx*qx) AS hi, min(l.y*sy*qy + l.x*sx*qx) AS lo,
  any_value(ty*sy*qy + tx*sx*qx) AS c FROM labels l JOIN fr ON l.case_id = fr.case_id WHERE label = 3 AND l.z = t0 GROUP BY 1)""",
       select="""SELECT case_id, round(CASE WHEN hi > lo THEN least(100, greatest(0, (hi - c) / (hi - lo) * 100)) END, 3) AS "Staubli_Tibial_pct" FROM sl"""))
def knee_staubli(spark, sf):
    s = study(spark, sf)
    return rounded(knee.staubli(s.labels(), s.volumes, *_plane(s)[1:]), 3)


@query("knee_acl_volume", vox_sql("""SELECT v.case_id, round(count(l.label) * sz * sy * sx, 6) AS volume_mm3 FROM volumes v
LEFT JOIN labels l ON l.case_id = v.case_id AND l.label = 1 GROUP BY v.case_id, sz, sy, sx"""))
def knee_acl_volume(spark, sf):
    s = study(spark, sf)
    return rounded(knee.label_volume(s.labels(), s.volumes), 6)


@query("knee_impingement", vox_ctes(NEAREST, select="SELECT case_id, round(min(dist), 5) AS min_dist_to_femur_mm FROM near GROUP BY 1"))
def knee_impingement(spark, sf):
    s = study(spark, sf)
    return rounded(knee.impingement(s.labels(), s.volumes))


NOTCH = """ray AS (SELECT l.case_id, any_value(sz) AS sz, max(CASE WHEN l.z < r0 THEN l.z END) AS lw, min(CASE WHEN l.z >= r0 THEN l.z END) AS rw FROM labels l
  JOIN (SELECT *, round_even(az, 0) AS r0, round_even(ay, 0) AS r1, round_even(ax, 0) AS r2 FROM feet) f ON l.case_id = f.case_id WHERE label = 2 AND l.y = r1 AND l.x = r2 GROUP BY 1)"""


@query("knee_notch_width", vox_ctes(DIAMOND2, CONTACT, FEET, NOTCH, select="SELECT case_id, round((rw - lw) * sz, 5) AS notch_width_mm FROM ray"))
def knee_notch_width(spark, sf):
    s = study(spark, sf)
    return rounded(knee.notch_width(s.labels(), s.volumes, knee.footprints(s.labels(), s.volumes)))


PATH = """sc AS (SELECT l.case_id, y, avg(z)*any_value(sz) AS pz, y*any_value(sy) AS py, avg(x)*any_value(sx) AS px FROM labels l JOIN volumes v ON l.case_id = v.case_id WHERE label = 1 GROUP BY 1, 2),
pl AS (SELECT case_id, count(*) AS n_points, sum(d) AS path FROM (SELECT case_id, sqrt(pow(pz - lag(pz) OVER w, 2) + pow(py - lag(py) OVER w, 2) + pow(px - lag(px) OVER w, 2)) AS d
  FROM sc WINDOW w AS (PARTITION BY case_id ORDER BY y)) GROUP BY 1)"""


@query("win_path_length", vox_ctes(PATH, select="SELECT case_id, n_points, round(path, 5) AS path FROM pl"))
def win_path_length(spark, sf):
    s = study(spark, sf)
    acl = knee.to_mm(s.labels().filter("label = 1"), s.volumes)
    pts = acl.groupBy(CASE, "y").agg(*[F.avg(f"p{a}").alias(f"p{a}") for a in "zyx"])
    return rounded(knee.path_length(pts, "y"))


@query("knee_tortuosity", vox_ctes(DIAMOND2, CONTACT, FEET, PATH, select="""
SELECT f.case_id, round(CASE WHEN st > 0 THEN CASE WHEN coalesce(n_points, 0) < 2 THEN 1 ELSE greatest(1, path / st) END END, 5) AS "Tortuosity_Index"
FROM (SELECT *, sqrt(pow((fz-tz)*sz, 2) + pow((fy-ty)*sy, 2) + pow((fx-tx)*sx, 2)) AS st FROM feet) f LEFT JOIN pl ON f.case_id = pl.case_id"""))
def knee_tortuosity(spark, sf):
    s = study(spark, sf)
    return rounded(knee.tortuosity(s.labels(), knee.footprints(s.labels(), s.volumes), s.volumes))


@query("knee_record")
def knee_record(spark, sf):
    from voxelmill.plans.record import record
    s = study(spark, sf)
    # stands for the stored table that every measure scans
    vox = stored(s.voxels().select(CASE, "z", "y", "x", "k", "label", "value"), "voxels")
    img = vox.select(CASE, "z", "y", "x", "value")
    ref = vox.filter(F.col("k") == s.reference()).select(CASE, "z", "y", "x", "value")
    return record(img, vox.filter("label > 0").select(CASE, "z", "y", "x", "label"), ref, s.volumes)
