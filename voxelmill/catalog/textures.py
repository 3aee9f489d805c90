"""Inventory 2.12 on the histogram-matched ACL voxels."""

from pyspark.sql import functions as F

from voxelmill.catalog import query
from voxelmill.catalog.measures import rounded
from voxelmill.catalog.study import study, vox_ctes
from voxelmill.catalog.volumes import MATCH, TRAIN
from voxelmill.model import CASE, VOXEL
from voxelmill.operators import texture as tx
from voxelmill.plans.record import acl_region
from voxelmill.session import stored


def levels(spark, sf):
    s = study(spark, sf)
    # the image is read for percentiles, landmarks and the region
    vox = stored(s.voxels().select(*VOXEL, "k", "label", "value"), "voxels")
    img = vox.select(*VOXEL, "value")
    roi = acl_region(img, vox.filter("label > 0"), vox.filter(F.col("k") == s.reference()).select(*VOXEL, "value"), s.volumes)
    return tx.discretise(roi, s.volumes).checkpoint(), s


LV = """lv AS MATERIALIZED (SELECT m.case_id, z, y, x, value, CAST(floor(value / 25) - floor(min(value) OVER (PARTITION BY m.case_id) / 25) + 1 AS INTEGER) AS g FROM matched m WHERE label = 1)"""
_D = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(tx.DIRECTIONS))
MX = f"""dirs(dir, dz, dy, dx) AS (VALUES {_D}),
pr AS (SELECT a.case_id, dir, a.g AS g1, b.g AS g2, count(*) AS c FROM lv a, dirs JOIN lv b ON b.case_id = a.case_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4),
sy AS (SELECT case_id, dir, g1, g2, sum(c) AS c FROM (SELECT * FROM pr UNION ALL SELECT case_id, dir, g2, g1, c FROM pr) GROUP BY 1, 2, 3, 4),
mx AS MATERIALIZED (SELECT case_id, dir, g1, g2, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY case_id, dir) AS p FROM sy)"""
BASE = (TRAIN, MATCH, LV)


@query("tex_discretise", vox_ctes(*BASE, select="SELECT case_id, z, y, x, round(value, 4) AS value, g FROM lv"))
def tex_discretise(spark, sf):
    return levels(spark, sf)[0].withColumn("value", F.round("value", 4))


@query("tex_firstorder", vox_ctes(*BASE, """q AS (SELECT case_id, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) AS d,
  quantile_cont(value, 0.9) AS e, avg(value) AS m, count(*) AS n FROM lv GROUP BY 1)""",
  "qm AS (SELECT q.*, (SELECT avg(value) FROM lv WHERE lv.case_id = q.case_id AND value >= a AND value <= e) AS mid FROM q)",
  """mo AS (SELECT l.case_id, sum(value * value) AS en, min(value) AS lo, max(value) AS hi, avg(abs(value - m)) AS mad, avg(CASE WHEN value >= a AND value <= e THEN abs(value - mid) END) AS rmad,
    avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4 FROM lv l JOIN qm ON l.case_id = qm.case_id GROUP BY 1)""",
  """hh AS (SELECT h.case_id, -sum(h.c / n * log2(h.c / n)) AS ent, sum(h.c / n * h.c / n) AS uni FROM (SELECT case_id, g, CAST(count(*) AS DOUBLE) AS c FROM lv GROUP BY 1, 2) h JOIN q ON h.case_id = q.case_id GROUP BY 1)""",
  select="""SELECT v.case_id, round(en, 3) AS "Energy", round(en * sz * sy * sx, 3) AS "TotalEnergy", round(ent, 5) AS "Entropy", round(lo, 4) AS "Minimum", round(a, 4) AS "10Percentile", round(e, 4) AS "90Percentile",
  round(hi, 4) AS "Maximum", round(m, 4) AS "Mean", round(c, 4) AS "Median", round(d - b, 4) AS "InterquartileRange", round(hi - lo, 4) AS "Range", round(mad, 4) AS "MeanAbsoluteDeviation",
  round(rmad, 4) AS "RobustMeanAbsoluteDeviation", round(sqrt(en / n), 4) AS "RootMeanSquared", round(m3 / pow(m2, 1.5), 4) AS "Skewness", round(m4 / (m2 * m2), 4) AS "Kurtosis", round(m2, 4) AS "Variance", round(uni, 5) AS "Uniformity"
FROM volumes v JOIN qm ON v.case_id = qm.case_id JOIN mo ON v.case_id = mo.case_id JOIN hh ON v.case_id = hh.case_id"""))
def tex_firstorder(spark, sf):
    lv, s = levels(spark, sf)
    d = tx.firstorder(lv, s.volumes)
    digits = {"Energy": 3, "TotalEnergy": 3, "Entropy": 5, "Uniformity": 5}
    return d.select(CASE, *[F.round(f"`{c}`", digits.get(c, 4)).alias(c) for c in d.columns if c != CASE])


@query("tex_glcm_matrix", vox_ctes(*BASE, MX, select="SELECT case_id, dir, g1, g2, round(p, 6) AS p FROM mx"))
def tex_glcm_matrix(spark, sf):
    return tx.glcm_matrix(levels(spark, sf)[0]).withColumn("p", F.round("p", 6))


@query("tex_glcm", vox_ctes(*BASE, MX, "ng AS (SELECT case_id, max(g) AS ng FROM lv GROUP BY 1)",
  """mu AS (SELECT case_id, dir, sum(g1 * px) AS u, -sum(px * log2(px)) AS hx FROM (SELECT case_id, dir, g1, sum(p) AS px FROM mx GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
  """f1 AS (SELECT m.case_id, m.dir, any_value(u) AS u, any_value(hx) AS hx, sum(p*g1*g2) AS ac, sum(p*pow(g1+g2-2*u, 4)) AS cp, sum(p*pow(g1+g2-2*u, 3)) AS cs, sum(p*pow(g1+g2-2*u, 2)) AS ct,
    sum(p*(g1-g2)*(g1-g2)) AS con, sum(p*pow(g1-u, 2)) AS ss, sum(p*p) AS je, -sum(p*log2(p)) AS jh, sum(p/(1+(g1-g2)*(g1-g2))) AS idm, sum(p/(1+CAST((g1-g2)*(g1-g2) AS DOUBLE)/(ng*ng))) AS idmn,
    sum(p/(1+abs(g1-g2))) AS id, sum(p/(1+CAST(abs(g1-g2) AS DOUBLE)/ng)) AS idn, sum(CASE WHEN g1 <> g2 THEN p/((g1-g2)*(g1-g2)) ELSE 0 END) AS iv, max(p) AS mp, sum(p*(g1+g2)) AS sa
    FROM mx m JOIN mu ON m.case_id = mu.case_id AND m.dir = mu.dir JOIN ng ON m.case_id = ng.case_id GROUP BY 1, 2)""",
  """df AS (SELECT case_id, dir, sum(k*q) AS da, sum(k*k*q) - pow(sum(k*q), 2) AS dv, -sum(q*log2(q)) AS de FROM (SELECT case_id, dir, abs(g1-g2) AS k, sum(p) AS q FROM mx GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
  """pl AS (SELECT case_id, dir, -sum(q*log2(q)) AS se FROM (SELECT case_id, dir, g1+g2 AS k, sum(p) AS q FROM mx GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
  """al AS (SELECT *, CASE WHEN ss > 0 THEN (ac - u*u) / ss ELSE 1 END AS cor, CASE WHEN hx > 0 THEN (jh - 2*hx) / hx ELSE 0 END AS i1, CASE WHEN 2*hx > jh THEN sqrt(1 - exp(-2*(2*hx - jh))) ELSE 0 END AS i2
    FROM f1 JOIN df USING (case_id, dir) JOIN pl USING (case_id, dir))""",
  select="SELECT case_id, " + ", ".join(f'round(avg({c}), 4) AS "{n}"' for c, n in zip(
      "ac u cp cs ct con cor da de dv je jh i1 i2 idm idmn id idn iv mp sa se ss".split(), tx.GLCM_NAMES)) + " FROM al GROUP BY 1"))
def tex_glcm(spark, sf):
    lv, _ = levels(spark, sf)
    return rounded(tx.glcm(tx.glcm_matrix(lv), lv), 4)


@query("tex_glcm_mcc")
def tex_glcm_mcc(spark, sf):
    return rounded(tx.glcm_mcc(tx.glcm_matrix(levels(spark, sf)[0])), 4)


RUNS = f"""dirs(dir, dz, dy, dx) AS (VALUES {_D}),
rp AS (SELECT l.*, dir, dz, dy, dx, CASE WHEN dz <> 0 THEN z WHEN dy <> 0 THEN y ELSE x END AS pos FROM lv l, dirs),
ry AS (SELECT case_id, dir, g, z - pos*dz AS rz, y - pos*dy AS r1, x - pos*dx AS rx, pos, pos - row_number() OVER (PARTITION BY case_id, dir, g, z - pos*dz, y - pos*dy, x - pos*dx ORDER BY pos) AS isl FROM rp),
rn AS (SELECT case_id, dir, g, len, count(*) AS runs FROM (SELECT case_id, dir, g, count(*) AS len FROM ry GROUP BY case_id, dir, g, rz, r1, rx, isl) GROUP BY 1, 2, 3, 4)"""


@query("win_runs", vox_ctes(*BASE, RUNS, select="SELECT case_id, g, len, CAST(sum(runs) AS BIGINT) AS runs FROM rn GROUP BY 1, 2, 3"))
def win_runs(spark, sf):
    return tx.run_lengths(levels(spark, sf)[0]).groupBy(CASE, "g", "len").agg(F.sum("runs").alias("runs"))


@query("tex_glrlm_matrix", vox_ctes(*BASE, RUNS, select="SELECT * FROM rn"))
def tex_glrlm_matrix(spark, sf):
    return tx.run_lengths(levels(spark, sf)[0])


@query("tex_glrlm", vox_ctes(*BASE, RUNS, "tt AS (SELECT case_id, dir, CAST(sum(runs) AS DOUBLE) AS nr, sum(runs*len) AS np, CAST(sum(runs*g) AS DOUBLE) AS sg FROM rn GROUP BY 1, 2)",
  """fs AS (SELECT r.case_id, r.dir, any_value(nr) AS nr, any_value(np) AS np, sum(runs/nr/(len*len)) AS sre, sum(runs/nr*len*len) AS lre, sum(runs/nr*pow(g - sg/nr, 2)) AS glv, sum(runs/nr*pow(len - np/nr, 2)) AS rv,
    -sum(runs/nr*log2(runs/nr)) AS re, sum(runs/nr/(g*g)) AS lg, sum(runs/nr*g*g) AS hg, sum(runs/nr/(g*g*len*len)) AS slg, sum(runs/nr*g*g/(len*len)) AS shg, sum(runs/nr*len*len/(g*g)) AS llg, sum(runs/nr*g*g*len*len) AS lhg
    FROM rn r JOIN tt ON r.case_id = tt.case_id AND r.dir = tt.dir GROUP BY 1, 2)""",
  "ga AS (SELECT case_id, dir, sum(m*m) AS gln FROM (SELECT case_id, dir, g, sum(runs) AS m FROM rn GROUP BY 1, 2, 3) GROUP BY 1, 2)",
  "ra AS (SELECT case_id, dir, sum(m*m) AS rln FROM (SELECT case_id, dir, len, sum(runs) AS m FROM rn GROUP BY 1, 2, 3) GROUP BY 1, 2)",
  "al AS (SELECT *, gln/nr AS gn, gln/(nr*nr) AS gnn, rln/nr AS rl, rln/(nr*nr) AS rnn, nr/np AS rp FROM fs JOIN ga USING (case_id, dir) JOIN ra USING (case_id, dir))",
  select="SELECT case_id, " + ", ".join(f'round(avg({c}), 4) AS "{n}"' for c, n in zip(
      "sre lre gn gnn rl rnn rp glv rv re lg hg slg shg llg lhg".split(), tx.GLRLM_NAMES)) + " FROM al GROUP BY 1"))
def tex_glrlm(spark, sf):
    return rounded(tx.glrlm(tx.run_lengths(levels(spark, sf)[0])), 4)


@query("top_features", vox_ctes(*BASE, MX, "jh AS (SELECT case_id, dir, sum(p*g1*g2) AS ac, sum(p*(g1-g2)*(g1-g2)) AS con, sum(p*p) AS je FROM mx GROUP BY 1, 2)",
  "av AS (SELECT case_id, avg(ac) AS ac, avg(con) AS con, avg(je) AS je FROM jh GROUP BY 1)", select="""
SELECT case_id, 'glcm_Autocorrelation' AS feature, round(ac, 4) AS value FROM av UNION ALL SELECT case_id, 'glcm_Contrast', round(con, 4) FROM av UNION ALL SELECT case_id, 'glcm_JointEnergy', round(je, 4) FROM av"""))
def top_features(spark, sf):
    from voxelmill.operators.logs import head_features
    lv, _ = levels(spark, sf)
    d = tx.glcm(tx.glcm_matrix(lv), lv)
    names = ("Contrast", "JointEnergy", "Autocorrelation", "SumSquares")
    m = F.create_map(*[c for n in names for c in (F.lit(f"glcm_{n}"), F.col(n))],
                     F.lit("firstorder_Mean"), F.lit(0.0))
    return rounded(head_features(d.select(CASE, m.alias("features"))), 4)
