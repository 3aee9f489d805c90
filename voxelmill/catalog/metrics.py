"""Inventory 2.4 and the mask set operations of 2.7."""

from pyspark.sql import functions as F

from voxelmill.catalog import query
from voxelmill.catalog.study import study, vox_ctes, vox_sql
from voxelmill.model import CASE
from voxelmill.operators import metrics as m
from voxelmill.session import ensure_checkpoint_dir


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


CONF = """conf AS (
  SELECT v.case_id, c.cls, coalesce(sum(CASE WHEN label = cls AND pred = cls THEN 1 ELSE 0 END), 0) AS tp,
         coalesce(sum(CASE WHEN label = cls THEN 1 ELSE 0 END), 0) AS n_true,
         coalesce(sum(CASE WHEN pred = cls THEN 1 ELSE 0 END), 0) AS n_pred
  FROM vox v, (SELECT CAST(range AS INTEGER) AS cls FROM range(1, 4)) c GROUP BY 1, 2)"""
CONF1 = """conf AS (
  SELECT case_id, sum(CASE WHEN label > 0 AND pred > 0 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS n_true,
         sum(CASE WHEN pred > 0 THEN 1 ELSE 0 END) AS n_pred FROM vox GROUP BY 1)"""


@query("agg_volume", vox_sql("""
SELECT v.case_id, round(count(l.label) * sz * sy * sx, 6) AS volume_mm3
FROM volumes v LEFT JOIN labels l ON l.case_id = v.case_id AND l.label = 1
GROUP BY v.case_id, sz, sy, sx"""))
def agg_volume(spark, sf):
    s = study(spark, sf)
    return m.label_volume(s.labels(), s.volumes).select(CASE, *r6("volume_mm3"))


@query("agg_centroid", vox_sql("""
SELECT case_id, label, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx
FROM labels GROUP BY 1, 2"""))
def agg_centroid(spark, sf):
    return m.centroid(study(spark, sf).labels(), (CASE, "label")).select(
        CASE, "label", *r6("cz", "cy", "cx"))


@query("agg_bbox", vox_sql("""
SELECT v.case_id, coalesce(min(b.z), 0) AS z0, coalesce(max(b.z), nz - 1) AS z1, coalesce(min(b.y), 0) AS y0,
       coalesce(max(b.y), ny - 1) AS y1, coalesce(min(b.x), 0) AS x0, coalesce(max(b.x), nx - 1) AS x1
FROM volumes v LEFT JOIN (SELECT a.* FROM vox a JOIN (SELECT case_id, max(value) AS mx FROM vox GROUP BY 1) t
  ON a.case_id = t.case_id AND a.value > mx * 0.05) b ON v.case_id = b.case_id
GROUP BY v.case_id, nz, ny, nx"""))
def agg_bbox(spark, sf):
    s = study(spark, sf)
    return m.content_bbox(s.image(), s.volumes)


@query("agg_unique_labels", vox_sql("""
SELECT case_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM vox GROUP BY 1"""))
def agg_unique_labels(spark, sf):
    s = study(spark, sf)
    return m.unique_labels(s.labels(), s.volumes).select(
        CASE, F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("agg_shape", vox_sql(
    "SELECT case_id, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM vox GROUP BY 1"))
def agg_shape(spark, sf):
    return m.volume_shapes(study(spark, sf).image())


@query("agg_percentiles", vox_sql("""
SELECT case_id, round(quantile_cont(value, 0.005), 6) AS p_low, round(quantile_cont(value, 0.995), 6) AS p_high
FROM vox GROUP BY 1"""))
def agg_percentiles(spark, sf):
    s = study(spark, sf)
    return m.percentiles(s.image(), volumes=s.volumes).select(CASE, *r6("p_low", "p_high"))


@query("agg_mean_std", vox_sql("""
SELECT case_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM vox GROUP BY 1"""))
def agg_mean_std(spark, sf):
    return m.mean_std(study(spark, sf).image()).select(CASE, *r6("mean", "std"))


@query("agg_dice_binary", vox_ctes(CONF1, select="""
SELECT case_id, round(CASE WHEN n_true + n_pred = 0 THEN 1.0 ELSE 2.0 * tp / (n_true + n_pred) END, 6) AS dice
FROM conf"""))
def agg_dice_binary(spark, sf):
    s = study(spark, sf)
    return m.dice_binary(s.labels(), s.preds(), s.volumes).select(CASE, *r6("dice"))


@query("agg_dice_variants", vox_ctes(CONF, select="""
SELECT case_id, cls, round(CAST(2 * tp AS DOUBLE) / nullif(n_true + n_pred, 0), 6) AS dice_plain,
       round(CAST(2 * tp AS DOUBLE) / (n_true + n_pred + CAST(1e-8 AS DOUBLE)), 6) AS dice_den8,
       round((2 * tp + CAST(1e-6 AS DOUBLE)) / (n_true + n_pred + CAST(1e-6 AS DOUBLE)), 6) AS dice_eps6,
       round((2 * tp + CAST(1e-5 AS DOUBLE)) / (n_true + n_pred + CAST(1e-5 AS DOUBLE)), 6) AS dice_eps5
FROM conf"""))
def agg_dice_variants(spark, sf):
    s = study(spark, sf)
    c = m.confusion(s.labels(), s.preds(), s.volumes)
    return c.select(CASE, "cls", *[F.round(m.dice_expr(*e), 6).alias(n) for n, e in (
        ("dice_plain", (0.0, 0.0)), ("dice_den8", (0.0, 1e-8)),
        ("dice_eps6", (1e-6, 1e-6)), ("dice_eps5", (1e-5, 1e-5)))])


@query("agg_dice_per_class", vox_ctes(CONF, select="""
SELECT case_id, CASE cls WHEN 1 THEN 'ACL' WHEN 2 THEN 'Femur' ELSE 'Tibia' END AS structure,
       round(CASE WHEN n_true = 0 THEN 0.0 ELSE 2.0 * tp / (n_true + n_pred) END, 6) AS dice FROM conf"""))
def agg_dice_per_class(spark, sf):
    s = study(spark, sf)
    return m.dice_per_class(s.labels(), s.preds(), s.volumes).select(
        CASE, m.structure_name(F.col("cls")).alias("structure"),
        F.round(F.coalesce("dice", F.lit(0.0)), 6).alias("dice"))


@query("agg_mean_dice", vox_ctes(CONF, select="""
SELECT round(coalesce(avg(d), 0.0), 6) AS mean_dice FROM (
  SELECT cls, avg(CASE WHEN n_true > 0 THEN CAST(2 * tp AS DOUBLE) / (n_true + n_pred) END) AS d FROM conf GROUP BY cls)"""))
def agg_mean_dice(spark, sf):
    s = study(spark, sf)
    return m.mean_dice(m.dice_per_class(s.labels(), s.preds(), s.volumes)).select(*r6("mean_dice"))


@query("agg_iou", vox_ctes(CONF, select="""
SELECT case_id, cls, round(CASE WHEN n_true + n_pred - tp > 0
  THEN CAST(tp AS DOUBLE) / (n_true + n_pred - tp) ELSE 0.0 END, 6) AS iou FROM conf"""))
def agg_iou(spark, sf):
    s = study(spark, sf)
    return m.overlap(s.labels(), s.preds(), s.volumes).select(CASE, "cls", *r6("iou"))


@query("agg_precision_recall", vox_ctes(CONF, select="""
SELECT cls, round(avg(CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0.0 END), 6) AS precision,
       round(avg(CASE WHEN n_true > 0 THEN CAST(tp AS DOUBLE) / n_true ELSE 0.0 END), 6) AS recall
FROM conf GROUP BY cls"""))
def agg_precision_recall(spark, sf):
    s = study(spark, sf)
    per = m.overlap(s.labels(), s.preds(), s.volumes)
    return per.groupBy("cls").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall")])


BCE = "(greatest(logit, 0.0) - logit * t + ln(1 + exp(-abs(logit))))"


@query("agg_accuracy", vox_ctes(
    "one AS (SELECT *, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM scores WHERE cls = 1)",
    select=f"""
SELECT case_id, sum(CASE WHEN (1 / (1 + exp(-logit)) > 0.5) = (t = 1) THEN 1 ELSE 0 END) AS correct,
  count(*) AS total, round(avg(CASE WHEN (1 / (1 + exp(-logit)) > 0.5) = (t = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
  round(avg({BCE}), 6) AS mean_loss FROM one GROUP BY 1"""))
def agg_accuracy(spark, sf):
    return m.accuracy(study(spark, sf).scores()).select(
        CASE, "correct", "total", *r6("accuracy", "mean_loss"))


@query("agg_soft_dice_loss", vox_ctes(
    "one AS (SELECT *, 1 / (1 + exp(-logit)) AS p, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM scores WHERE cls = 1)",
    f"""s AS (SELECT case_id, 1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1) AS d, avg({BCE}) AS b FROM one GROUP BY 1)""",
    select="SELECT case_id, round(d, 6) AS dice_loss, round(b, 6) AS bce, round(0.5 * d + 0.5 * b, 6) AS loss FROM s"))
def agg_soft_dice_loss(spark, sf):
    return m.soft_dice_bce(study(spark, sf).scores()).select(CASE, *r6("dice_loss", "bce", "loss"))


@query("agg_dice_ce_binary", vox_ctes(
    "one AS (SELECT *, 1 / (1 + exp(-logit)) AS p, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM scores WHERE cls = 1)",
    select=f"""SELECT case_id, round(1 - (2 * sum(p * t) + 1e-5::DOUBLE) / (sum(p * p) + sum(t) + 1e-5::DOUBLE)
  + avg({BCE}), 6) AS loss FROM one GROUP BY 1"""))
def agg_dice_ce_binary(spark, sf):
    return m.dice_ce_binary(study(spark, sf).scores()).select(CASE, *r6("loss"))


@query("agg_weighted_dice_ce", vox_ctes(
    "sm AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY case_id, z, y, x) AS p FROM scores)",
    """d AS (SELECT case_id, avg(dl) AS dice_loss FROM (
      SELECT case_id, cls, 1 - (2 * sum(CASE WHEN label = cls THEN p ELSE 0 END) + 1e-5::DOUBLE)
        / (sum(p * p) + sum(CASE WHEN label = cls THEN 1 ELSE 0 END) + 1e-5::DOUBLE) AS dl
      FROM sm WHERE cls > 0 GROUP BY 1, 2) GROUP BY 1)""",
    """c AS (SELECT case_id, sum(w * -ln(p)) / sum(w) AS ce FROM (SELECT *, CASE label WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM sm WHERE cls = label) GROUP BY 1)""",
    select="""SELECT d.case_id, round(dice_loss, 6) AS dice_loss, round(ce, 6) AS ce, round(dice_loss + ce, 6) AS loss
FROM d JOIN c ON d.case_id = c.case_id"""))
def agg_weighted_dice_ce(spark, sf):
    return m.weighted_dice_ce(study(spark, sf).scores()).select(CASE, *r6("dice_loss", "ce", "loss"))


@query("fn_argmax_class", vox_sql("""
SELECT case_id, z, y, x, label FROM (SELECT case_id, z, y, x, cls AS label,
  row_number() OVER (PARTITION BY case_id, z, y, x ORDER BY logit DESC, cls) AS rn FROM scores) WHERE rn = 1 AND label > 0"""))
def fn_argmax_class(spark, sf):
    return m.argmax_class(study(spark, sf).scores()).filter("label > 0")


FOLDS = """rows5 AS (SELECT c.*, v.k % 5 AS fold,
  CASE WHEN n_true > 0 THEN CAST(2 * tp AS DOUBLE) / (n_true + n_pred) END AS dice
  FROM conf c JOIN volumes v ON c.case_id = v.case_id)"""


def fold_rows(spark, sf):
    s = study(spark, sf)
    ensure_checkpoint_dir(spark)
    d = m.dice_per_class(s.labels(), s.preds(), s.volumes)
    # a row a case and class, read by every round of the quantiles
    return d.join(s.volumes.select(CASE, (F.col("k") % 5).alias("fold")), CASE).checkpoint()


@query("agg_box_stats", vox_ctes(CONF, FOLDS, """q AS (
  SELECT fold, cls, quantile_cont(dice, 0.25) AS q1, quantile_cont(dice, 0.5) AS median, quantile_cont(dice, 0.75) AS q3
  FROM rows5 WHERE dice IS NOT NULL GROUP BY 1, 2)""", select="""
SELECT q.fold, q.cls, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
  round(min(CASE WHEN dice >= q1 - 1.5 * (q3 - q1) AND dice <= q3 + 1.5 * (q3 - q1) THEN dice END), 6) AS whisker_low,
  round(max(CASE WHEN dice >= q1 - 1.5 * (q3 - q1) AND dice <= q3 + 1.5 * (q3 - q1) THEN dice END), 6) AS whisker_high,
  sum(CASE WHEN dice < q1 - 1.5 * (q3 - q1) OR dice > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS n_outliers
FROM q JOIN rows5 r ON q.fold = r.fold AND q.cls = r.cls WHERE dice IS NOT NULL
GROUP BY q.fold, q.cls, q1, median, q3"""))
def agg_box_stats(spark, sf):
    b = m.box_stats(fold_rows(spark, sf), ["fold", "cls"], "dice")
    return b.select("fold", "cls", "n", "n_outliers",
                    *r6("q1", "median", "q3", "whisker_low", "whisker_high"))


@query("agg_box_outliers", vox_ctes(CONF, FOLDS, """q AS (
  SELECT fold, cls, quantile_cont(dice, 0.25) AS q1, quantile_cont(dice, 0.75) AS q3
  FROM rows5 WHERE dice IS NOT NULL GROUP BY 1, 2)""", select="""
SELECT r.fold, r.cls, r.case_id, round(dice, 6) AS dice
FROM q JOIN rows5 r ON q.fold = r.fold AND q.cls = r.cls
WHERE dice < q1 - 1.5 * (q3 - q1) OR dice > q3 + 1.5 * (q3 - q1)"""))
def agg_box_outliers(spark, sf):
    return m.box_outliers(fold_rows(spark, sf), ["fold", "cls"], "dice").select(
        "fold", "cls", CASE, *r6("dice"))


@query("agg_linregress", vox_sql("""
SELECT case_id, label, count(*) AS n, round(regr_slope(value, y), 6) AS slope, round(regr_intercept(value, y), 6) AS intercept
FROM vox WHERE label > 0 GROUP BY 1, 2 HAVING count(*) >= 2"""))
def agg_linregress(spark, sf):
    v = study(spark, sf).voxels().filter("label > 0")
    return m.linreg(v, [CASE, "label"], "value", "y").select(
        CASE, "label", "n", *r6("slope", "intercept"))


@query("agg_argext", vox_sql("""
SELECT lo.case_id, lo.label, lo.z AS min_z, lo.y AS min_y, lo.x AS min_x, round(lo.p, 6) AS min_proj,
       hi.z AS max_z, hi.y AS max_y, hi.x AS max_x, round(hi.p, 6) AS max_proj
FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY p, z, y, x) AS rn
      FROM (SELECT case_id, label, z, y, x, CAST(0.5 * y + 0.25 * x AS DOUBLE) AS p FROM labels)) lo
JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY p DESC, z, y, x) AS rn
      FROM (SELECT case_id, label, z, y, x, CAST(0.5 * y + 0.25 * x AS DOUBLE) AS p FROM labels)) hi
ON lo.case_id = hi.case_id AND lo.label = hi.label AND lo.rn = 1 AND hi.rn = 1"""))
def agg_argext(spark, sf):
    t = study(spark, sf).labels()
    p = 0.5 * F.col("y") + 0.25 * F.col("x")
    ends = [m.arg_extreme(t, p, k, (CASE, "label")).select(CASE, "label", *[F.col(a).alias(f"{k}_{a}") for a in "zyx"],
                                          F.round("projection", 6).alias(f"{k}_proj"))
            for k in ("min", "max")]
    return ends[0].join(ends[1], [CASE, "label"])


@query("agg_sampler_weights", vox_ctes(
    "p AS (SELECT case_id, z, max(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos FROM vox GROUP BY 1, 2)",
    "n AS (SELECT case_id, sum(pos) AS np, count(*) AS na FROM p GROUP BY 1)", select="""
SELECT p.case_id, z, pos, round(CASE WHEN np = 0 THEN NULL WHEN pos = 1 THEN CAST(2.0 AS DOUBLE) / np
  ELSE CAST(1.0 AS DOUBLE) / (na - np) END, 6) AS weight FROM p JOIN n ON p.case_id = n.case_id"""))
def agg_sampler_weights(spark, sf):
    s = study(spark, sf)
    return m.sampler_weights(s.labels(), s.volumes, cls=1).select(CASE, "z", "pos", *r6("weight"))


@query("agg_positive_slices", vox_sql("""
SELECT case_id, min(z) AS first, max(z) AS last, count(DISTINCT z) AS n_slices,
       array_to_string(list_sort(list(DISTINCT z)), ',') AS slices FROM labels WHERE label = 1 GROUP BY 1"""))
def agg_positive_slices(spark, sf):
    return m.positive_slices(study(spark, sf).labels(), cls=1).withColumn(
        "slices", F.array_join(F.col("slices").cast("array<string>"), ","))


@query("fn_one_hot", vox_sql("""
SELECT case_id, z, y, x, CASE WHEN label = 1 THEN 1 ELSE 0 END AS is_1, CASE WHEN label = 2 THEN 1 ELSE 0 END AS is_2,
  CASE WHEN label = 3 THEN 1 ELSE 0 END AS is_3,
  CASE label WHEN 1 THEN 'ACL' WHEN 2 THEN 'Femur' ELSE 'Tibia' END AS structure FROM labels"""))
def fn_one_hot(spark, sf):
    from voxelmill.functions.scalars import one_hot
    return study(spark, sf).labels().select(
        CASE, "z", "y", "x", *one_hot(F.col("label"), (1, 2, 3)),
        m.structure_name(F.col("label")).alias("structure"))
