"""Overlap metrics, losses and per-volume aggregates."""

from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.model import CASE, VOXEL, attach, wide_quantiles

STRUCTURES = {1: "ACL", 2: "Femur", 3: "Tibia"}


def structure_name(cls) -> Column:
    pairs = [F.lit(v) for kv in STRUCTURES.items() for v in kv]
    return F.element_at(F.create_map(*pairs), cls)


def confusion(labels: DataFrame, pred: DataFrame, cases: DataFrame = None,
              classes=(1, 2, 3)) -> DataFrame:
    """tp, n_true, n_pred per case and class from two sparse masks.

    One hash aggregate over both tables replaces the outer join. ``cases`` adds the
    classes a case lacks, with zero counts.
    """
    side = lambda df, t: df.select(*VOXEL, F.col("label").cast("int").alias("cls"),
                                   F.lit(t).alias("t"), F.lit(1 - t).alias("p"))
    both = side(labels, 1).unionByName(side(pred, 0)).filter(F.col("cls").isin(list(classes)))
    hits = both.groupBy(*VOXEL, "cls").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    out = hits.groupBy(CASE, "cls").agg(F.sum(F.col("t") * F.col("p")).alias("tp"),
                                        F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    if cases is None:
        return out
    every = cases.select(CASE, F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("cls"))
    return every.join(out, [CASE, "cls"], "left").fillna(0, ["tp", "n_true", "n_pred"])


def binary(mask: DataFrame, threshold=0.5) -> DataFrame:
    """Any label above the threshold becomes class 1."""
    return mask.filter(F.col("label") > threshold).withColumn("label", F.lit(1))


def dice_expr(num_eps=0.0, den_eps=0.0, empty=None) -> Column:
    """2*tp / (n_true + n_pred) with the chosen smoothing; ``empty`` when both are empty."""
    total = (F.col("n_true") + F.col("n_pred")).cast("double")
    ratio = (2.0 * F.col("tp") + num_eps) / (total + den_eps)
    return F.when((total > 0) | F.lit(den_eps > 0), ratio).otherwise(
        F.lit(empty).cast("double"))


def dice_binary(a, b, cases, num_eps=0.0, den_eps=0.0, empty=1.0) -> DataFrame:
    counts = confusion(binary(a), binary(b), cases, classes=(1,))
    return counts.select(CASE, dice_expr(num_eps, den_eps, empty).alias("dice"))


def dice_per_class(labels, pred, cases, classes=(1, 2, 3)) -> DataFrame:
    """Dice per case and class; NULL where the true mask is empty (public MONAI rule:
    NaN for an absent ground truth)."""
    counts = confusion(labels, pred, cases, classes)
    value = F.when(F.col("n_true") > 0, dice_expr())
    return counts.select(CASE, "cls", value.alias("dice"))


def mean_dice(per_class: DataFrame) -> DataFrame:
    """Mean per class, then over classes, skipping missing values; all missing -> 0."""
    by_class = per_class.groupBy("cls").agg(F.avg("dice").alias("dice"))
    return by_class.agg(F.coalesce(F.avg("dice"), F.lit(0.0)).alias("mean_dice"))


def overlap(labels, pred, cases, classes=(1, 2, 3)) -> DataFrame:
    """IoU, precision and recall per case and class; an undefined ratio gives 0."""
    tp, t, p = F.col("tp"), F.col("n_true"), F.col("n_pred")
    ratio = lambda den: F.when(den > 0, tp / den).otherwise(0.0)
    return confusion(labels, pred, cases, classes).select(
        CASE, "cls", ratio(t + p - tp).alias("iou"), ratio(p).alias("precision"),
        ratio(t).alias("recall"))


def label_volume(labels, volumes, cls=1) -> DataFrame:
    """mm3 of one class per case, 0 where it is absent."""
    n = labels.filter(F.col("label") == cls).groupBy(CASE).agg(F.count("*").alias("n"))
    return volumes.join(n, CASE, "left").select(
        CASE, (F.coalesce("n", F.lit(0)) * F.col("sz") * F.col("sy") * F.col("sx")).alias("volume_mm3"))


def centroid(mask, by=(CASE,)) -> DataFrame:
    return mask.groupBy(*by).agg(*[F.avg(a).alias(f"c{a}") for a in "zyx"])


def content_bbox(vox, volumes, fraction=0.05) -> DataFrame:
    """Box of voxels strictly above ``fraction`` of the maximum; none -> whole volume."""
    top = vox.groupBy(CASE).agg((F.max("value") * fraction).alias("floor"))
    inside = attach(vox, top, volumes).filter(F.col("value") > F.col("floor"))
    box = inside.groupBy(CASE).agg(*[f(a).alias(f"{a}{s}") for a in "zyx"
                                     for f, s in ((F.min, 0), (F.max, 1))])
    return volumes.join(box, CASE, "left").select(CASE, *[
        c for a in "zyx" for c in (F.coalesce(f"{a}0", F.lit(0)).alias(f"{a}0"),
                                   F.coalesce(f"{a}1", F.col(f"n{a}") - 1).alias(f"{a}1"))])


def unique_labels(labels, volumes) -> DataFrame:
    """Sorted distinct labels per mask; 0 counts wherever the sparse rows leave a gap."""
    found = labels.groupBy(CASE).agg(F.collect_set(F.col("label").cast("int")).alias("s"),
                                     F.count("*").alias("n"))
    cells = F.col("nz").cast("long") * F.col("ny") * F.col("nx")
    s = F.coalesce("s", F.array().cast("array<int>"))
    zero = F.when(F.coalesce("n", F.lit(0)) < cells, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>"))
    return volumes.join(found, CASE, "left").select(
        CASE, F.sort_array(F.array_union(s, zero)).alias("labels"))


def volume_shapes(vox) -> DataFrame:
    return vox.groupBy(CASE).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "zyx"])


def percentiles(vox, names_probs=(("p_low", 0.005), ("p_high", 0.995)), where=None, volumes=None) -> DataFrame:
    """A column per percentile and case; ``volumes`` proves how many cases there are (see exact_quantiles)."""
    return wide_quantiles(vox if where is None else vox.filter(where), [CASE], "value", names_probs, volumes)


def mean_std(vox) -> DataFrame:
    return vox.groupBy(CASE).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def bce_with_logits(l, t) -> Column:
    return F.greatest(l, F.lit(0.0)) - l * t + F.log1p(F.exp(-F.abs(l)))


def soft_dice_bce(scores, cls=1, smooth=1.0) -> DataFrame:
    """Half soft Dice plus half mean BCE on the logit of one class, per case."""
    l, t = F.col("logit"), (F.col("label") == cls).cast("double")
    p = sigmoid(l)
    sums = scores.filter(F.col("cls") == cls).groupBy(CASE).agg(
        F.sum(p * t).alias("pt"), F.sum(p).alias("p"), F.sum(t).alias("t"),
        F.avg(bce_with_logits(l, t)).alias("bce"))
    dice = 1.0 - (2.0 * F.col("pt") + smooth) / (F.col("p") + F.col("t") + smooth)
    return sums.select(CASE, dice.alias("dice_loss"), F.col("bce"),
                       (0.5 * dice + 0.5 * F.col("bce")).alias("loss"))


def dice_ce_binary(scores, cls=1, smooth=1e-5) -> DataFrame:
    """Sigmoid Dice with squared denominator plus mean BCE (public MONAI DiceCE form)."""
    l, t = F.col("logit"), (F.col("label") == cls).cast("double")
    p = sigmoid(l)
    sums = scores.filter(F.col("cls") == cls).groupBy(CASE).agg(
        F.sum(p * t).alias("pt"), F.sum(p * p).alias("pp"), F.sum(t).alias("t"),
        F.avg(bce_with_logits(l, t)).alias("ce"))
    dice = 1.0 - (2.0 * F.col("pt") + smooth) / (F.col("pp") + F.col("t") + smooth)
    return sums.select(CASE, (dice + F.col("ce")).alias("loss"))


def class_columns(scores, classes=(0, 1, 2, 3)) -> DataFrame:
    """Logits of a voxel side by side; combines before the shuffle as classes are adjacent."""
    return scores.groupBy(*VOXEL).agg(F.max("label").alias("label"), *[
        F.max(F.when(F.col("cls") == c, F.col("logit"))).alias(f"l{c}") for c in classes])


def weighted_dice_ce(scores, weights=(0.1, 5.0, 1.0, 1.0), smooth=1e-5) -> DataFrame:
    """Softmax Dice (squared denominator, no background) plus class-weighted cross entropy."""
    ks = range(len(weights))
    d = class_columns(scores, ks)
    top = F.greatest(*[F.col(f"l{k}") for k in ks])
    norm = sum((F.exp(F.col(f"l{k}") - F.col("top")) for k in ks), F.lit(0.0))
    d = d.withColumn("top", top).withColumn("lse", F.col("top") + F.log(norm))
    w, own = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, v in enumerate(weights):
        w = F.when(F.col("label") == k, F.lit(float(v))).otherwise(w)
        own = F.when(F.col("label") == k, F.col(f"l{k}")).otherwise(own)
    aggs = [F.sum(w * (F.col("lse") - own)).alias("num"), F.sum(w).alias("den")]
    for k in ks[1:]:
        p, t = F.exp(F.col(f"l{k}") - F.col("lse")), (F.col("label") == k).cast("double")
        aggs += [F.sum(p * t).alias(f"pt{k}"), F.sum(p * p).alias(f"pp{k}"), F.sum(t).alias(f"t{k}")]
    s = d.groupBy(CASE).agg(*aggs)
    dice = sum((1.0 - (2.0 * F.col(f"pt{k}") + smooth) / (F.col(f"pp{k}") + F.col(f"t{k}") + smooth)
                for k in ks[1:]), F.lit(0.0)) / float(len(weights) - 1)
    return s.select(CASE, dice.alias("dice_loss"), (F.col("num") / F.col("den")).alias("ce"),
                    (dice + F.col("num") / F.col("den")).alias("loss"))


def argmax_class(scores, classes=(0, 1, 2, 3)) -> DataFrame:
    """Class of the highest logit per voxel, lowest class on ties.

    Plain maxima side by side: a maximum by a struct would sort every voxel.
    """
    return best_class(scores.groupBy(*VOXEL).agg(*[
        F.max(F.when(F.col("cls") == c, F.col("logit"))).alias(f"l{c}") for c in classes]), classes)


def best_class(side, classes) -> DataFrame:
    """Class of the highest of the columns l<class>, the first on ties."""
    top = F.greatest(*[F.col(f"l{c}") for c in classes])
    return side.select(*VOXEL, F.coalesce(*[F.when(F.col(f"l{c}") == top, F.lit(c)) for c in classes]).alias("label"))


def accuracy(scores, cls=1, by=(CASE,)) -> DataFrame:
    l, t = F.col("logit"), (F.col("label") == cls).cast("double")
    right = ((sigmoid(l) > 0.5).cast("double") == t).cast("int")
    return scores.filter(F.col("cls") == cls).groupBy(*by).agg(
        F.sum(right).alias("correct"), F.count("*").alias("total"),
        (F.sum(right) / F.count("*")).alias("accuracy"),
        F.avg(bce_with_logits(l, t)).alias("mean_loss"))


def box_stats(rows, by, value) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group."""
    by = list(by)
    q = wide_quantiles(rows, by, value, (("q1", .25), ("median", .5), ("q3", .75)))
    v = F.col(value)
    fenced = _with_fences(rows, q, by)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    ends = fenced.filter(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
    return q.join(ends, by)


def box_outliers(rows, by, value) -> DataFrame:
    by = list(by)
    q = wide_quantiles(rows, by, value, (("q1", .25), ("q3", .75)))
    v = F.col(value)
    return (_with_fences(rows, q, by).filter((v < F.col("_lo")) | (v > F.col("_hi")))
            .select(*rows.columns))


def _with_fences(rows, q, by):
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(*by, (F.col("q1") - 1.5 * iqr).alias("_lo"), (F.col("q3") + 1.5 * iqr).alias("_hi"))
    return attach(rows, fences, on=by)  # salted: a group may hold most rows


def linreg(points, by, y, x) -> DataFrame:
    """Least squares per group; under two points no row, constant x gives NULLs."""
    return (points.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"),
                                    F.regr_intercept(y, x).alias("intercept"))
            .filter("n >= 2"))


def component_sizes(components) -> DataFrame:
    return components.groupBy(CASE, "label", "comp").agg(F.count("*").alias("size"))


def sampler_weights(labels, volumes, cls=None, boost=2.0) -> DataFrame:
    """Draw weight per z plane: boost/n_pos with foreground, 1/n_neg without; a case
    with no positive plane has NULL weights."""
    fg = labels if cls is None else labels.filter(F.col("label") == cls)
    pos = fg.select(CASE, "z").distinct().withColumn("pos", F.lit(1))
    planes = volumes.select(CASE, F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z"))
    flagged = planes.join(pos, [CASE, "z"], "left").fillna(0, ["pos"])
    n = flagged.groupBy(CASE).agg(F.sum("pos").alias("n_pos"), F.count("*").alias("n_all"))
    out = flagged.join(n, CASE)
    w = F.when(F.col("n_pos") == 0, None).when(
        F.col("pos") == 1, boost / F.col("n_pos")).otherwise(1.0 / (F.col("n_all") - F.col("n_pos")))
    return out.select(CASE, "z", "pos", w.cast("double").alias("weight"))


def positive_slices(labels, axis="z", cls=None) -> DataFrame:
    """Planes with foreground, with the first and last one (at most one entry per plane)."""
    fg = labels if cls is None else labels.filter(F.col("label") == cls)
    planes = fg.groupBy(CASE, axis).agg(F.count("*").alias("n"))
    return planes.groupBy(CASE).agg(
        F.min(axis).alias("first"), F.max(axis).alias("last"), F.count("*").alias("n_slices"),
        F.sort_array(F.collect_list(axis)).alias("slices"))


def arg_extreme(points, projection, mode="min", by=(CASE,)) -> DataFrame:
    """Point of the lowest or highest projection, first in (z, y, x) order on ties."""
    proj = points.withColumn("_p", projection)
    key = F.col("_p") if mode == "min" else -F.col("_p")
    return proj.groupBy(*by).agg(
        F.min_by(F.struct("z", "y", "x", "_p"),
                 F.struct(key.alias("k"), "z", "y", "x")).alias("b")).select(
        *by, "b.z", "b.y", "b.x", F.col("b._p").alias("projection"))
