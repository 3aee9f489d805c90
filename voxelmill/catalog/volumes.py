"""Inventory 2.2 (volume functions), 2.3 (voxel joins), 2.7-2.9."""

from pyspark.sql import functions as F

from voxelmill.catalog import query
from voxelmill.catalog.study import study, vox_ctes, vox_sql
from voxelmill.model import CASE, VOXEL
from voxelmill.operators import geometry as g, intensity as it, morphology as mo
from voxelmill.operators.surface_distance import hd95

OFF = lambda cond: f"""offs AS (SELECT a AS dz, b AS dy, c AS dx FROM (SELECT CAST(range AS INTEGER) AS a FROM range(-2, 3)),
  (SELECT CAST(range AS INTEGER) AS b FROM range(-2, 3)), (SELECT CAST(range AS INTEGER) AS c FROM range(-2, 3)) WHERE {cond})"""
DIAMOND2 = OFF("abs(a) + abs(b) + abs(c) <= 2")
FACES6 = OFF("abs(a) + abs(b) + abs(c) = 1")
BOX27 = OFF("abs(a) <= 1 AND abs(b) <= 1 AND abs(c) <= 1")


def voxel_sum(df, value="value"):
    """Fold a dense result to one checksum row per case and plane: every voxel counts.

    The small offset keeps sums of binary fractions off the rounding edge."""
    w = F.col("y") * 31 + F.col("x") * 7 + 1
    return df.groupBy(CASE, "z").agg(F.count("*").alias("n"), F.round(F.sum(value) + 0.000013, 4).alias("total"),
                                     F.round(F.sum(F.col(value) * w) + 0.00013, 3).alias("weighted"))


def sum_sql(src, value="value"):
    return (f"SELECT case_id, z, count(*) AS n, round(sum({value}) + CAST(0.000013 AS DOUBLE), 4) AS total, "
            f"round(sum({value} * (y * 31 + x * 7 + 1)) + CAST(0.00013 AS DOUBLE), 3) AS weighted FROM {src} GROUP BY 1, 2")


# --- functions on voxels ------------------------------------------------------------

@query("fn_physical", vox_sql("""
SELECT l.case_id, l.z, l.y, l.x, l.z * sz AS pz, l.y * sy AS py, l.x * sx AS px FROM labels l JOIN volumes v ON l.case_id = v.case_id"""))
def fn_physical(spark, sf):
    from voxelmill.plans.knee import to_mm
    s = study(spark, sf)
    return to_mm(s.labels(), s.volumes).drop("label")


@query("src_first_frame", vox_ctes("f4 AS (SELECT case_id, coalesce(q, 0) % 3 AS t, z, y, x, value FROM vox)",
                                   select="SELECT case_id, z, y, x, value FROM f4 WHERE t = 0"))
def src_first_frame(spark, sf):
    from voxelmill.operators.manifests import first_frame
    v = study(spark, sf).voxels().withColumn("t", F.coalesce("q", F.lit(0)) % 3)
    return first_frame(v.select(CASE, "t", "z", "y", "x", "value"))


@query("fn_mirror", vox_sql("""
SELECT l.case_id, nz - 1 - z AS z, y, x, label FROM labels l JOIN volumes v ON l.case_id = v.case_id"""))
def fn_mirror(spark, sf):
    s = study(spark, sf)
    return g.mirror(s.labels(), s.volumes)


@query("fn_permute", vox_sql("SELECT case_id, x AS z, z AS y, y AS x, label FROM labels"))
def fn_permute(spark, sf):
    return g.permute(study(spark, sf).labels(), "xzy")


@query("fn_slice", vox_sql("""
SELECT l.case_id, z, ny - 1 - y AS y, x, value FROM vox l JOIN volumes v ON l.case_id = v.case_id WHERE z = nz // 2"""))
def fn_slice(spark, sf):
    s = study(spark, sf)
    return g.slice_at(s.image(), s.volumes, "z", flip="y")


# --- voxel joins -------------------------------------------------------------------------

@query("join_voxel", vox_sql("SELECT case_id, z, y, x, label, pred FROM vox WHERE label > 0 AND pred > 0"))
def join_voxel(spark, sf):
    s = study(spark, sf)
    return s.labels().join(s.preds().withColumnRenamed("label", "pred"), VOXEL)


@query("join_offsets", vox_ctes(FACES6, select="""
SELECT l.case_id, l.label, l.z AS from_z, l.y AS from_y, l.x AS from_x, l.z + dz AS z, l.y + dy AS y, l.x + dx AS x
FROM labels l JOIN volumes v ON l.case_id = v.case_id, offs
WHERE l.z + dz BETWEEN 0 AND nz - 1 AND l.y + dy BETWEEN 0 AND ny - 1 AND l.x + dx BETWEEN 0 AND nx - 1"""))
def join_offsets(spark, sf):
    s = study(spark, sf)
    return mo.neighbours(s.labels(), mo.FACES, s.volumes)


NEAREST = """near AS (SELECT a.case_id, a.z, a.y, a.x, min(sqrt((a.z-b.z)*(a.z-b.z)*sz*sz + (a.y-b.y)*(a.y-b.y)*sy*sy + (a.x-b.x)*(a.x-b.x)*sx*sx)) AS dist
  FROM labels a JOIN volumes v ON a.case_id = v.case_id LEFT JOIN labels b ON a.case_id = b.case_id AND b.label = 2 WHERE a.label = 1 GROUP BY 1, 2, 3, 4)"""


def acl_to_femur(s):
    one = lambda k: s.labels().filter(F.col("label") == k).withColumn("label", F.lit(0))
    return mo.nearest_distance(one(1), one(2), s.volumes).drop("label")


@query("join_nearest", vox_ctes(NEAREST, select="SELECT case_id, z, y, x, round(dist, 6) AS dist FROM near"))
def join_nearest(spark, sf):
    return acl_to_femur(study(spark, sf)).withColumn("dist", F.round("dist", 6))


@query("morph_distance", vox_ctes(NEAREST, select="SELECT case_id, round(min(dist), 6) AS min_dist FROM near GROUP BY 1"))
def morph_distance(spark, sf):
    return acl_to_femur(study(spark, sf)).groupBy(CASE).agg(F.round(F.min("dist"), 6).alias("min_dist"))


STACK = """st AS (SELECT case_id, z, y, x, lag(value) OVER w AS p, value AS cur, lead(value) OVER w AS n
  FROM vox WINDOW w AS (PARTITION BY case_id, y, x ORDER BY z))"""


@query("join_slice_stack", vox_ctes(STACK, select="""
SELECT case_id, z, count(*) AS n, round(sum(coalesce(p, cur) * (y + 1)), 4) AS s_prev, round(sum(cur * (x + 1)), 4) AS s_cur,
  round(sum(coalesce(n, cur) * (y + 2 * x + 1)), 4) AS s_next FROM st GROUP BY 1, 2"""))
def join_slice_stack(spark, sf):
    s = study(spark, sf)
    return _stack_sums(g.stack_slices(s.image(), s.volumes))


@query("join_slice_stack_drop", vox_ctes(STACK, select="""
SELECT case_id, z, count(*) AS n, round(sum(p * (y + 1)), 4) AS s_prev, round(sum(cur * (x + 1)), 4) AS s_cur,
  round(sum(n * (y + 2 * x + 1)), 4) AS s_next FROM st WHERE p IS NOT NULL AND n IS NOT NULL GROUP BY 1, 2"""))
def join_slice_stack_drop(spark, sf):
    s = study(spark, sf)
    return _stack_sums(g.stack_slices(s.image(), s.volumes, "drop"))


def _stack_sums(d):
    y, x = F.col("y"), F.col("x")
    return d.groupBy(CASE, "z").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("prev") * (y + 1)), 4).alias("s_prev"),
        F.round(F.sum(F.col("cur") * (x + 1)), 4).alias("s_cur"),
        F.round(F.sum(F.col("next") * (y + 2 * x + 1)), 4).alias("s_next"))


def patches(s):
    """Four boxes per case, placed by its key."""
    p = s.volumes.withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    start = lambda m, n: ((F.col("k") * m + F.col("patch_id") * 3) % (F.col(n) - 6)).cast("int")
    p = p.select(CASE, "patch_id", start(5, "nz").alias("z0"), start(7, "ny").alias("y0"), start(3, "nx").alias("x0"))
    return p.select("*", *[(F.col(f"{a}0") + 6).alias(f"{a}1") for a in "zyx"])


@query("join_patch", vox_ctes("""pt AS (SELECT case_id, p AS patch_id, (k*5 + p*3) % (nz-6) AS z0, (k*7 + p*3) % (ny-6) AS y0, (k*3 + p*3) % (nx-6) AS x0
  FROM volumes, (SELECT CAST(range AS INTEGER) AS p FROM range(4)))""", select="""
SELECT v.case_id, patch_id, z - z0 AS z, y - y0 AS y, x - x0 AS x, value FROM vox v JOIN pt ON v.case_id = pt.case_id
 AND z >= z0 AND z < z0 + 6 AND y >= y0 AND y < y0 + 6 AND x >= x0 AND x < x0 + 6"""))
def join_patch(spark, sf):
    s = study(spark, sf)
    return g.extract_patches(s.image(), patches(s))


@query("join_bbox_crop", vox_ctes("""b AS (SELECT a.case_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
  FROM vox a JOIN (SELECT case_id, max(value) AS mx FROM vox GROUP BY 1) t ON a.case_id = t.case_id AND value > mx * 0.3 GROUP BY 1)""", select="""
SELECT l.case_id, z - z0 AS z, y - y0 AS y, x - x0 AS x, label FROM preds l JOIN b ON l.case_id = b.case_id
 AND z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"""))
def join_bbox_crop(spark, sf):
    from voxelmill.operators.metrics import content_bbox
    s = study(spark, sf)
    return g.crop_to(s.preds(), content_bbox(s.image(), s.volumes, 0.3), s.volumes)


# --- set operations --------------------------------------------------------------------------

@query("set_subset_diff", vox_ctes("l AS (SELECT case_id, list(DISTINCT label) AS s FROM vox GROUP BY 1)", select="""
SELECT case_id, len(list_filter(s, lambda e: NOT list_contains([0, 1, 2], e))) = 0 AS subset,
  array_to_string(list_filter([0, 1, 2, 3], lambda e: NOT list_contains(s, e)), ',') AS missing FROM l"""))
def set_subset_diff(spark, sf):
    from voxelmill.operators.metrics import unique_labels
    s = study(spark, sf)
    arr = lambda *v: F.array(*[F.lit(i) for i in v])
    return unique_labels(s.labels(), s.volumes).select(
        CASE, (F.size(F.array_except("labels", arr(0, 1, 2))) == 0).alias("subset"),
        F.array_join(F.array_except(arr(0, 1, 2, 3), "labels").cast("array<string>"), ",").alias("missing"))


@query("set_intersect", vox_sql("SELECT case_id, z, y, x FROM vox WHERE label = 2 AND pred = 2"))
def set_intersect(spark, sf):
    s = study(spark, sf)
    only = lambda d: d.filter("label = 2").select(*VOXEL)
    return only(s.labels()).join(only(s.preds()), VOXEL, "left_semi")


@query("set_complement", vox_sql("SELECT case_id, z, y, x FROM vox WHERE label = 0"))
def set_complement(spark, sf):
    s = study(spark, sf)
    grid = g.target_grid(s.volumes.select(CASE, *[F.col(f"n{a}").alias(f"m{a}") for a in "zyx"]))
    return grid.select(*VOXEL).join(s.labels(), VOXEL, "left_anti")


@query("set_priority_union", vox_sql("SELECT case_id, z, y, x, greatest(label, pred) AS label FROM vox WHERE label > 0 OR pred > 0"))
def set_priority_union(spark, sf):
    s = study(spark, sf)
    return mo.overlay(s.labels().unionByName(s.preds()))


# --- morphology ------------------------------------------------------------------------------

@query("morph_dilate", vox_ctes(DIAMOND2, select="""
SELECT DISTINCT l.case_id, label, l.z + dz AS z, l.y + dy AS y, l.x + dx AS x FROM labels l JOIN volumes v ON l.case_id = v.case_id, offs
WHERE l.z + dz BETWEEN 0 AND nz - 1 AND l.y + dy BETWEEN 0 AND ny - 1 AND l.x + dx BETWEEN 0 AND nx - 1"""))
def morph_dilate(spark, sf):
    s = study(spark, sf)
    return mo.dilate(s.labels(), s.volumes, 2)


CONTACT = """contact AS (SELECT b.* FROM labels b JOIN (SELECT DISTINCT l.case_id, l.z + dz AS z, l.y + dy AS y, l.x + dx AS x FROM labels l, offs WHERE label = 1) a
  ON a.case_id = b.case_id AND a.z = b.z AND a.y = b.y AND a.x = b.x WHERE b.label IN (2, 3))"""


@query("morph_contact", vox_ctes(DIAMOND2, CONTACT, select="SELECT case_id, label, z, y, x FROM contact"))
def morph_contact(spark, sf):
    s = study(spark, sf)
    return mo.contact(s.labels(), s.volumes)


CLOSED = """dil AS (SELECT DISTINCT p.case_id, label, p.z + dz AS z, p.y + dy AS y, p.x + dx AS x FROM preds p JOIN volumes v ON p.case_id = v.case_id, offs
  WHERE p.z + dz BETWEEN 0 AND nz - 1 AND p.y + dy BETWEEN 0 AND ny - 1 AND p.x + dx BETWEEN 0 AND nx - 1),
closed AS (SELECT case_id, label, z + dz AS z, y + dy AS y, x + dx AS x FROM dil, offs GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 27)"""


@query("morph_close", vox_ctes(BOX27, CLOSED, select="SELECT * FROM closed"))
def morph_close(spark, sf):
    s = study(spark, sf)
    return mo.close3(s.preds(), s.volumes)


def _comps_sql(rounds=5):
    """Minimum linear index over whole x, y and z runs, ``rounds`` times and once more: the oracle
    fails if that last round still changes an index."""
    ctes = ["""m AS MATERIALIZED (SELECT c.*, (CAST(c.z AS BIGINT) * ny + c.y) * nx + c.x AS lin,
    c.x - row_number() OVER (PARTITION BY c.case_id, label, c.z, c.y ORDER BY c.x) AS rx,
    c.y - row_number() OVER (PARTITION BY c.case_id, label, c.z, c.x ORDER BY c.y) AS ry,
    c.z - row_number() OVER (PARTITION BY c.case_id, label, c.y, c.x ORDER BY c.z) AS rz
  FROM closed c JOIN volumes v ON c.case_id = v.case_id)"""]
    prev = "m"
    for i in range(rounds + 1):
        before = ", lin AS before" if i == rounds else ""
        if before:
            ctes.append(f"settled AS (SELECT *{before} FROM {prev})")
            prev = "settled"
        for part in ("z, y, rx", "z, x, ry", "y, x, rz"):
            name = f"r{len(ctes)}"
            kept = ", before" if i == rounds else ""
            ctes.append(f"{name} AS (SELECT case_id, label, z, y, x, rx, ry, rz{kept}, "
                        f"min(lin) OVER (PARTITION BY case_id, label, {part}) AS lin FROM {prev})")
            prev = name
    ctes.append(f"comps AS MATERIALIZED (SELECT case_id, label, z, y, x, "
                f"CASE WHEN lin = before THEN lin ELSE error('more rounds needed') END AS comp FROM {prev})")
    return ",\n".join(ctes)


COMPS = _comps_sql()


@query("morph_components", vox_ctes(BOX27, CLOSED, COMPS, select="SELECT * FROM comps"))
def morph_components(spark, sf):
    s = study(spark, sf)
    return mo.components(mo.close3(s.preds(), s.volumes), s.volumes, block=5)


@query("agg_component_sizes", vox_ctes(BOX27, CLOSED, COMPS, select="SELECT case_id, label, comp, count(*) AS size FROM comps GROUP BY 1, 2, 3"))
def agg_component_sizes(spark, sf):
    from voxelmill.operators.metrics import component_sizes
    s = study(spark, sf)
    return component_sizes(mo.components(mo.close3(s.preds(), s.volumes), s.volumes))


BEST = """best AS MATERIALIZED (SELECT case_id, label, comp, size FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY size DESC, comp) AS rn
  FROM (SELECT case_id, label, comp, count(*) AS size FROM comps GROUP BY 1, 2, 3)) WHERE rn = 1)"""


@query("top_largest", vox_ctes(BOX27, CLOSED, COMPS, BEST, select="SELECT * FROM best"))
def top_largest(spark, sf):
    s = study(spark, sf)
    return mo.largest_component(mo.components(mo.close3(s.preds(), s.volumes), s.volumes))


@query("morph_clean", vox_ctes(BOX27, CLOSED, COMPS, BEST, select="""
SELECT c.case_id, z, y, x, max(c.label) AS label FROM comps c JOIN best b ON c.case_id = b.case_id AND c.label = b.label AND c.comp = b.comp GROUP BY 1, 2, 3, 4"""))
def morph_clean(spark, sf):
    s = study(spark, sf)
    return mo.clean_mask(s.preds(), s.volumes)


@query("morph_clean_binary", vox_ctes("thin AS (SELECT case_id, 1 AS label, z, y, x FROM preds)", BOX27,
       CLOSED.replace("FROM preds p", "FROM thin p"), COMPS, BEST, select="""
SELECT c.case_id, z, y, x, 1 AS label FROM comps c JOIN best b ON c.case_id = b.case_id AND c.comp = b.comp
UNION ALL SELECT case_id, z, y, x, 1 FROM thin WHERE case_id NOT IN (SELECT case_id FROM best)"""))
def morph_clean_binary(spark, sf):
    s = study(spark, sf)
    return mo.clean_binary(s.preds(), s.volumes).select(*VOXEL, "label")


SURF = lambda src, name: f"""{name} AS (SELECT a.case_id, a.label, a.z, a.y, a.x FROM {src} a JOIN offs ON true LEFT JOIN {src} b
  ON a.case_id = b.case_id AND a.label = b.label AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx
  GROUP BY 1, 2, 3, 4, 5 HAVING count(b.z) < 6)"""


@query("morph_surface", vox_ctes(FACES6, SURF("labels", "sf"), select="SELECT * FROM sf"))
def morph_surface(spark, sf):
    return mo.surface(study(spark, sf).labels())


def _dist(a, b):
    return f"""SELECT a.case_id, a.label, a.z, a.y, a.x, min(sqrt((a.z-b.z)*(a.z-b.z) + (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x))) AS d
  FROM {a} a JOIN {b} b ON a.case_id = b.case_id AND a.label = b.label GROUP BY 1, 2, 3, 4, 5"""


HD = f"""hd AS (SELECT case_id, label, max(d) AS hd95 FROM (
  SELECT case_id, label, quantile_cont(d, 0.95) AS d FROM ({_dist('sl', 'sp')}) GROUP BY 1, 2 UNION ALL
  SELECT case_id, label, quantile_cont(d, 0.95) AS d FROM ({_dist('sp', 'sl')}) GROUP BY 1, 2) GROUP BY 1, 2)"""
CLS = "(SELECT CAST(range AS INTEGER) AS label FROM range(1, 4)) c"


@query("agg_hd95", vox_ctes(FACES6, SURF("labels", "sl"), SURF("preds", "sp"), HD, select=f"""
SELECT v.case_id, c.label, round(hd95, 6) AS hd95 FROM volumes v JOIN {CLS} ON true LEFT JOIN hd ON hd.case_id = v.case_id AND hd.label = c.label"""))
def agg_hd95(spark, sf):
    s = study(spark, sf)
    return hd95(s.labels(), s.preds(), s.volumes).withColumn("hd95", F.round("hd95", 6))


@query("agg_result_rows", vox_ctes(FACES6, SURF("labels", "sl"), SURF("preds", "sp"), HD, """conf AS (
  SELECT v.case_id, c.label, sum(CASE WHEN v.label = c.label AND pred = c.label THEN 1 ELSE 0 END) AS tp,
   sum(CASE WHEN v.label = c.label THEN 1 ELSE 0 END) AS nt, sum(CASE WHEN pred = c.label THEN 1 ELSE 0 END) AS np
  FROM vox v, (SELECT CAST(range AS INTEGER) AS label FROM range(1, 4)) c GROUP BY 1, 2)""", select="""
SELECT k % 5 AS fold, v.case_id || '.nii.gz' AS file, round(CAST(k % 100 AS DOUBLE) / 7, 2) AS seconds,
  CASE c.label WHEN 1 THEN 'ACL' WHEN 2 THEN 'Femur' ELSE 'Tibia' END AS structure,
  round(CASE WHEN nt > 0 THEN CAST(2 * tp AS DOUBLE) / (nt + np) ELSE 0 END, 6) AS dice, round(hd95, 6) AS hd95
FROM conf c JOIN volumes v ON c.case_id = v.case_id LEFT JOIN hd ON hd.case_id = c.case_id AND hd.label = c.label"""))
def agg_result_rows(spark, sf):
    from voxelmill.operators.metrics import dice_per_class, structure_name
    s = study(spark, sf)
    d = dice_per_class(s.labels(), s.preds(), s.volumes).withColumnRenamed("cls", "label")
    h = hd95(s.labels(), s.preds(), s.volumes)
    return d.join(h, [CASE, "label"], "left").join(s.volumes.select(CASE, "k"), CASE).select(
        (F.col("k") % 5).alias("fold"), F.concat(CASE, F.lit(".nii.gz")).alias("file"),
        F.bround((F.col("k") % 100) / 7.0, 2).alias("seconds"), structure_name(F.col("label")).alias("structure"),
        F.round(F.coalesce("dice", F.lit(0.0)), 6).alias("dice"), F.round("hd95", 6).alias("hd95"))


# --- crops, pads, tiles ----------------------------------------------------------------------

def _crop3_sql(src="vox"):
    st = lambda n, s: f"greatest(0, n{n} // 2 - {s})"
    return f"""crop AS (SELECT v.case_id, z - {st('z', 4)} AS z, y - {st('y', 12)} AS y, x - {st('x', 5)} AS x, value FROM {src} v JOIN volumes w ON v.case_id = w.case_id
  WHERE z >= {st('z', 4)} AND z < least(nz, {st('z', 4)} + 8) AND y >= {st('y', 12)} AND y < least(ny, {st('y', 12)} + 24) AND x >= {st('x', 5)} AND x < least(nx, {st('x', 5)} + 10)),
full3 AS (SELECT c.case_id, c.z, c.y, c.x, coalesce(crop.value, 0) AS value FROM (SELECT case_id, z, y, x FROM volumes, (SELECT CAST(range AS INTEGER) AS z FROM range(8)),
  (SELECT CAST(range AS INTEGER) AS y FROM range(24)), (SELECT CAST(range AS INTEGER) AS x FROM range(10))) c
  LEFT JOIN crop ON c.case_id = crop.case_id AND c.z = crop.z AND c.y = crop.y AND c.x = crop.x)"""


@query("geo_center_crop3", vox_ctes(_crop3_sql(), select=sum_sql("full3")))
def geo_center_crop3(spark, sf):
    s = study(spark, sf)
    return voxel_sum(g.center_crop3(s.image(), s.volumes, (8, 24, 10)))


@query("geo_restore3", vox_sql("""
SELECT l.case_id, z, y, x, label FROM labels l JOIN volumes v ON l.case_id = v.case_id
WHERE z >= nz // 2 - 4 AND z < nz // 2 + 4 AND x >= nx // 2 - 5 AND x < nx // 2 + 5"""))
def geo_restore3(spark, sf):
    s = study(spark, sf)
    size = (8, 24, 10)
    crop = g.center_crop3(s.labels(), s.volumes, size, "label").filter("label > 0")
    return g.restore3(crop.withColumn("label", F.col("label").cast("int")), s.volumes, size)


@query("geo_pad", vox_ctes("""pads AS (SELECT p.case_id, p.z, p.y, p.x, coalesce(v.value, 0) AS value FROM (
  SELECT w.*, z, y, x FROM volumes w, (SELECT CAST(range AS INTEGER) AS z FROM range(16)), (SELECT CAST(range AS INTEGER) AS y FROM range(21)), (SELECT CAST(range AS INTEGER) AS x FROM range(18))
  WHERE z < greatest(nz, 16) AND y < greatest(ny, 20) AND x < greatest(nx, 18)) p
  LEFT JOIN vox v ON v.case_id = p.case_id AND v.z = p.z - greatest(16 - nz, 0) // 2 AND v.y = p.y - greatest(20 - ny, 0) // 2 AND v.x = p.x - greatest(18 - nx, 0) // 2)""",
       select=sum_sql("pads")))
def geo_pad(spark, sf):
    s = study(spark, sf)
    return voxel_sum(g.pad_to(s.image(), s.volumes, (16, 20, 18)))


@query("geo_unpad", vox_sql("""SELECT l.case_id, z + (16 - nz) // 2 AS z, y, x, label FROM labels l JOIN volumes v ON l.case_id = v.case_id WHERE z + (16 - nz) // 2 < nz"""))
def geo_unpad(spark, sf):
    s = study(spark, sf)
    p = g.pad_to(s.labels(), s.volumes, (16, 0, 0), "label").filter("label > 0")
    return g.unpad(p.withColumn("label", F.col("label").cast("int")), s.volumes)


@query("geo_center_crop2", vox_ctes("""c2 AS (SELECT p.case_id, p.z, p.y, p.x, coalesce(v.value, 0) AS value FROM (
  SELECT w.*, z, y, x FROM volumes w, (SELECT CAST(range AS INTEGER) AS z FROM range(14)), (SELECT CAST(range AS INTEGER) AS y FROM range(16)), (SELECT CAST(range AS INTEGER) AS x FROM range(16)) WHERE z < nz) p
  LEFT JOIN vox v ON v.case_id = p.case_id AND v.z = p.z AND v.y = p.y + (greatest(ny, 16) - 16) // 2 - greatest(16 - ny, 0) // 2
   AND v.x = p.x + (greatest(nx, 16) - 16) // 2 - greatest(16 - nx, 0) // 2)""", select=sum_sql("c2")))
def geo_center_crop2(spark, sf):
    s = study(spark, sf)
    return voxel_sum(g.center_crop2(s.image(), s.volumes, 16))


@query("geo_paste2", vox_sql("""SELECT l.case_id, z, y + (ny - 15) // 2 AS y, x + (nx - 15) // 2 AS x, label FROM labels l JOIN volumes v ON l.case_id = v.case_id
WHERE y < 15 AND x < 15 AND nx >= 15 AND ny >= 15"""))
def geo_paste2(spark, sf):
    s = study(spark, sf)
    return g.paste2(s.labels().filter("y < 15 and x < 15"), s.volumes, 15)


@query("geo_paste2_resize", vox_sql("""SELECT l.case_id, z, y + (ny - 15) // 2 AS y, x + (nx - 15) // 2 AS x, label FROM labels l JOIN volumes v ON l.case_id = v.case_id
WHERE y < 15 AND x < 15 AND nx >= 15 AND ny >= 15
UNION ALL SELECT l.case_id, l.z, p.y, p.x, label FROM (
  SELECT case_id, y, x, CAST(round_even(least(greatest((y + 0.5::DOUBLE) * 15 / ny - 0.5::DOUBLE, 0), 14), 0) AS INTEGER) AS sy,
    CAST(round_even(least(greatest((x + 0.5::DOUBLE) * 15 / nx - 0.5::DOUBLE, 0), 14), 0) AS INTEGER) AS sx
  FROM volumes, (SELECT CAST(range AS INTEGER) AS y FROM range(21)), (SELECT CAST(range AS INTEGER) AS x FROM range(16)) WHERE y < ny AND x < nx AND (nx < 15 OR ny < 15)) p
JOIN labels l ON l.case_id = p.case_id AND l.y = sy AND l.x = sx"""))
def geo_paste2_resize(spark, sf):
    """Squares of 15 back on their planes, resized where a plane is smaller."""
    s = study(spark, sf)
    return g.paste2(s.labels().filter("y < 15 and x < 15"), s.volumes, 15, fit="resize")


TILES = """ax AS (SELECT case_id, a, least(i * st, last) AS s0 FROM (
  SELECT case_id, 'z' AS a, greatest(nz - 8, 0) AS last, 4 AS st FROM volumes UNION ALL SELECT case_id, 'y', greatest(ny - 8, 0), 4 FROM volumes
  UNION ALL SELECT case_id, 'x', greatest(nx - 16, 0), 8 FROM volumes), (SELECT CAST(range AS INTEGER) AS i FROM range(9)) WHERE (i - 1) * st < last OR i = 0 GROUP BY ALL),
tl AS (SELECT z.case_id, z.s0 AS z0, y.s0 AS y0, x.s0 AS x0 FROM ax z JOIN ax y ON z.case_id = y.case_id JOIN ax x ON z.case_id = x.case_id WHERE z.a = 'z' AND y.a = 'y' AND x.a = 'x')"""
ROI = (8, 8, 16)


@query("geo_tiles", vox_ctes(TILES, select="""SELECT t.case_id, z0, y0, x0, least(z0 + 8, nz) AS z1, least(y0 + 8, ny) AS y1, least(x0 + 16, nx) AS x1
FROM tl t JOIN volumes v ON t.case_id = v.case_id"""))
def geo_tiles(spark, sf):
    return g.tiles(study(spark, sf).volumes, ROI)


@query("geo_stitch", vox_ctes(TILES, """ts AS (SELECT v.case_id, z, y, x, cls, avg(((CAST(value AS DOUBLE) * 4 + 13 * cls + 3 * z0 + y0 * cls) % 64) / 8) AS logit
  FROM vox v JOIN tl ON v.case_id = tl.case_id AND z >= z0 AND z < z0 + 8 AND y >= y0 AND y < y0 + 8 AND x >= x0 AND x < x0 + 16, (SELECT CAST(range AS INTEGER) AS cls FROM range(4)) GROUP BY 1, 2, 3, 4, 5)""",
       select="""SELECT case_id, z, y, x, label FROM (SELECT case_id, z, y, x, cls AS label, row_number() OVER (PARTITION BY case_id, z, y, x ORDER BY logit DESC, cls) AS rn FROM ts) WHERE rn = 1 AND label > 0"""))
def geo_stitch(spark, sf):
    s = study(spark, sf)
    t = g.tile_voxels(s.image(), s.volumes, ROI).withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(3))))
    logit = ((F.col("value") * 4 + 13 * F.col("cls") + 3 * F.col("z0") + F.col("y0") * F.col("cls")) % 64) / 8
    return g.stitch(t.withColumn("logit", logit)).filter("label > 0")


# --- intensity ---------------------------------------------------------------------------------

PCT = """pc AS (SELECT case_id, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM vox GROUP BY 1)"""
CLIPPED = """cl AS (SELECT v.case_id, z, y, x, least(greatest(value, lo), hi) AS value FROM vox v JOIN pc ON v.case_id = pc.case_id),
cs AS (SELECT case_id, avg(value) AS m, stddev_pop(value) AS s FROM cl GROUP BY 1)"""


def _intensity(name, fn, *ctes):
    def run(spark, sf):
        s = study(spark, sf)
        return voxel_sum(fn(s.image(), s.volumes))
    query(name, vox_ctes(*ctes, select=sum_sql("out")))(run)


_intensity("int_pct_scale", it.pct_scale, PCT,
           "out AS (SELECT v.case_id, z, y, x, CASE WHEN hi > lo THEN least(greatest((value - lo) / (hi - lo), 0), 1) ELSE value - lo END AS value FROM vox v JOIN pc ON v.case_id = pc.case_id)")
_intensity("int_nonzero_z", it.nonzero_zscore, "st AS (SELECT case_id, avg(value) AS m, stddev_pop(value) AS s FROM vox WHERE value <> 0 GROUP BY 1)",
           "out AS (SELECT v.case_id, z, y, x, CASE WHEN value <> 0 THEN (value - m) / (CASE WHEN s = 0 THEN 1 ELSE s END) ELSE value END AS value FROM vox v LEFT JOIN st ON v.case_id = st.case_id)")
_intensity("int_clip_z", it.clip_zscore, PCT, CLIPPED,
           "out AS (SELECT v.case_id, z, y, x, (value - m) / (s + CAST(1e-8 AS DOUBLE)) AS value FROM cl v JOIN cs ON v.case_id = cs.case_id)")
_intensity("int_guard_z", it.guarded_zscore, PCT, CLIPPED,
           "out AS (SELECT v.case_id, z, y, x, CASE WHEN s > 1e-8 THEN (value - m) / s ELSE value - m END AS value FROM cl v JOIN cs ON v.case_id = cs.case_id)")
_intensity("int_pct_minmax", it.pct_minmax, PCT,
           "out AS (SELECT v.case_id, z, y, x, CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (least(greatest(value, lo), hi) - lo) / (hi - lo) END AS value FROM vox v JOIN pc ON v.case_id = pc.case_id)")
_intensity("int_minmax", it.minmax, "mm AS (SELECT case_id, min(value) AS lo, max(value) AS hi FROM vox GROUP BY 1)",
           "out AS (SELECT v.case_id, z, y, x, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS value FROM vox v JOIN mm ON v.case_id = mm.case_id)")
_intensity("int_gamma", lambda v, vol: it.gamma(v, vol, g=0.8), "mm AS (SELECT case_id, min(value) AS lo FROM vox GROUP BY 1)",
           "out AS (SELECT v.case_id, z, y, x, pow(value - lo + CAST(1e-5 AS DOUBLE), CAST(0.8 AS DOUBLE)) + lo AS value FROM vox v JOIN mm ON v.case_id = mm.case_id)")
_intensity("int_brightness", lambda v, vol: it.brightness(v, 0.0625),
           "out AS (SELECT case_id, z, y, x, value + CAST(0.0625 AS DOUBLE) AS value FROM vox)")

_intensity("int_gamma_range", lambda v, vol: it.gamma(v, vol, g=1.4, normalised=True), "mm AS (SELECT case_id, min(value) AS lo, max(value) - min(value) AS r FROM vox GROUP BY 1)",
           "out AS (SELECT v.case_id, z, y, x, pow((value - lo) / (r + CAST(1e-7 AS DOUBLE)), CAST(1.4 AS DOUBLE)) * r + lo AS value FROM vox v JOIN mm ON v.case_id = mm.case_id)")
_intensity("int_brightness_contrast", lambda v, vol: it.brightness_contrast(v, 1.125, -0.0625),
           "out AS (SELECT case_id, z, y, x, value * CAST(1.125 AS DOUBLE) - CAST(0.0625 AS DOUBLE) AS value FROM vox)")

COEF = [0.3 + 0.01 * i for i in range(20)]
_poly = " + ".join(f"CAST({c:.2f} AS DOUBLE)" + "".join(f" * t{a}" * n for a, n in zip("zyx", p))
                   for c, p in zip(COEF, it.bias_powers()))
BIAS = f"""co AS (SELECT v.case_id, z, y, x, value, (z - nz / 2.0::DOUBLE + 0.5::DOUBLE) / (nz / 2.0::DOUBLE - 0.5::DOUBLE) AS tz, (y - ny / 2.0::DOUBLE + 0.5::DOUBLE) / (ny / 2.0::DOUBLE - 0.5::DOUBLE) AS ty,
  (x - nx / 2.0::DOUBLE + 0.5::DOUBLE) / (nx / 2.0::DOUBLE - 0.5::DOUBLE) AS tx FROM vox v JOIN volumes w ON v.case_id = w.case_id),
bf AS (SELECT case_id, z, y, x, value AS old, value * exp({_poly}) AS value FROM co)"""
_intensity("int_bias_field", lambda v, vol: it.bias_field(v, vol, COEF), BIAS,
           "out AS (SELECT case_id, z, y, x, value FROM bf)")


@query("int_bias_diff", vox_ctes(BIAS, "out AS (SELECT case_id, z, y, x, value - old AS value FROM bf)", select=sum_sql("out")))
def int_bias_diff(spark, sf):
    s = study(spark, sf)
    return voxel_sum(it.bias_difference(s.image(), s.volumes, COEF))


_LM = ", ".join(f"quantile_cont(value, {p / 100}) AS l{p}" for p in it.LANDMARKS)
_LMS = ", ".join(f"(l{p} - l1) * 100 / (l99 - l1) AS l{p}" for p in it.LANDMARKS)
TRAIN = f"lm0 AS (SELECT {_LM} FROM vox WHERE k = (SELECT min(k) FROM volumes) AND value > 0), lm AS (SELECT {_LMS} FROM lm0)"
_MP = ", ".join(f"quantile_cont(value, {p / 100}) AS p{p}" for p in it.MAPPED)
_SEG = "CASE " + " ".join(
    f"WHEN value < p{b} THEN (value - p{a}) * coalesce((l{b} - l{a}) / nullif(p{b} - p{a}, 0), 0) + l{a}"
    for a, b in zip(it.MAPPED[:-2], it.MAPPED[1:-1])) + (
    " ELSE (value - p90) * coalesce((l99 - l90) / nullif(p99 - p90, 0), 0) + l90 END")
MATCH = f"""mp AS (SELECT case_id, {_MP} FROM vox GROUP BY 1),
matched AS (SELECT v.case_id, z, y, x, label, {_SEG} AS value FROM vox v JOIN mp ON v.case_id = mp.case_id, lm)"""


def landmarks(s):
    """Landmarks of the reference volume, the case of the least supplier."""
    return it.hist_landmarks(s.voxels().filter(F.col("k") == s.reference()).select(*VOXEL, "value"))


@query("int_hist_train", vox_ctes(TRAIN, select="SELECT " + ", ".join(f"round(l{p}, 6) AS l{p}" for p in it.LANDMARKS) + " FROM lm"))
def int_hist_train(spark, sf):
    return landmarks(study(spark, sf)).select(*[F.round(f"l{p}", 6).alias(f"l{p}") for p in it.LANDMARKS])


@query("udf_mask_fn", vox_sql("SELECT case_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM vox WHERE value > 0 GROUP BY 1"))
def udf_mask_fn(spark, sf):
    from voxelmill.operators.metrics import mean_std
    where = F.col("value") > 0  # any boolean column plays the masking function
    return mean_std(study(spark, sf).image().filter(where)).select(
        CASE, F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("int_hist_match", vox_ctes(TRAIN, MATCH, select=sum_sql("matched")))
def int_hist_match(spark, sf):
    s = study(spark, sf)
    return voxel_sum(it.hist_match(s.image(), landmarks(s), s.volumes))
