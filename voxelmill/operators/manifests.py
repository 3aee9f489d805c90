"""File manifests, series catalogues, pairing joins, splits."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxelmill.functions import scalars as fn
from voxelmill.model import SALTS, attach, global_rank, shuffled_rank
from voxelmill.session import ensure_checkpoint_dir


# --- series -----------------------------------------------------------------

def series_catalog(headers: DataFrame) -> DataFrame:
    """Files of each (dir, series) numbered in path order, with the series size.

    Long form: a series may hold most files, so it is never gathered into one array.
    """
    ranked = global_rank(headers.select("dir", "series_uid", "path"),
                         ["dir", "series_uid", "path"], "_rank")
    sizes = ranked.groupBy("dir", "series_uid").agg(
        F.min("_rank").alias("_first"), F.count("*").alias("n_files"))
    salted = sizes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (ranked.withColumn("_s", F.pmod(F.hash("path"), F.lit(SALTS)))
            .join(salted, ["dir", "series_uid", "_s"])
            .select("dir", "series_uid", "path",
                    (F.col("_rank") - F.col("_first") + 1).alias("file_no"), "n_files"))


def series_description(headers: DataFrame) -> DataFrame:
    """Description of the first file of each series; missing -> N/A."""
    first = F.min_by(F.struct(F.col("description").alias("d")), F.col("path"))
    return headers.groupBy("dir", "series_uid").agg(
        F.coalesce(first["d"], F.lit("N/A")).alias("description"))


def first_frame(vox4d: DataFrame) -> DataFrame:
    return vox4d.filter(F.col("t") == 0).drop("t")


# --- names and headers --------------------------------------------------------

def assign_case_ids(files: DataFrame) -> DataFrame:
    """case_001, case_002, ... in path order."""
    n = F.col("_n").cast("string")
    padded = F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0"))
    return global_rank(files, ["path"], "_n").withColumn(
        "case_id", F.concat(F.lit("case_"), padded)).drop("_n")


def find_key(headers: DataFrame, id_col: str, json_col: str, key: str) -> DataFrame:
    """First non-null value of ``key`` in a nested header, depth first, at any depth.

    A level that holds the key is not searched deeper; one-element arrays are looked
    through. Each nesting level is one explode, siblings keep document order. Levels are
    written one by one until none is left to search.
    """
    ensure_checkpoint_dir(headers.sparkSession)
    level = headers.select(id_col, F.col(json_col).alias("_j"), F.lit("").alias("_rank"))
    found = []
    while True:
        one = F.from_json("_j", "array<string>")
        text = F.when(F.col("_j").startswith("[") & (F.size(one) == 1), one[0]).otherwise(F.col("_j"))
        node = level.withColumn("_m", F.from_json(text, "map<string,string>"))
        has = F.array_contains(F.map_keys("_m"), key)
        found.append(node.filter(has & F.col("_m")[key].isNotNull())
                     .select(id_col, "_rank", F.col("_m")[key].alias("value")))
        level = (node.filter(~has)
                 .select(id_col, "_rank", F.posexplode("_m").alias("_p", "_k", "_j"))
                 .filter(F.col("_j").rlike(r"^\s*[\[{]"))
                 .select(id_col, "_j", F.concat("_rank", F.lpad(F.col("_p").cast("string"), 10, "0"))
                         .alias("_rank"))).checkpoint()  # ten digits hold every position
        if level.isEmpty():
            break
    hits = reduce(DataFrame.unionByName, found)
    best = hits.groupBy(id_col).agg(F.min_by("value", "_rank").alias("value"))
    return headers.select(id_col).join(best, id_col, "left")


# --- pairing --------------------------------------------------------------------

def pair_by_id(images: DataFrame, masks: DataFrame):
    """Pairs on the case id of the names, and the images without a mask."""
    img = images.select(fn.case_id(F.col("name")).alias("id"), F.col("path").alias("image"))
    msk = masks.select(fn.case_id(F.col("name"), True).alias("id"), F.col("path").alias("mask"))
    img, msk = (d.groupBy("id").agg(F.max(c).alias(c)) for d, c in ((img, "image"), (msk, "mask")))
    return img.join(msk, "id"), img.join(msk, "id", "left_anti")


def pair_by_digits(images: DataFrame, masks: DataFrame, invalid: DataFrame = None):
    """Every mask with the image of the same first digit run (last path wins);
    masks listed in ``invalid`` are dropped. Second result: masks without image."""
    img = (images.select(fn.digit_id(F.col("name")).alias("id"), F.col("path").alias("image"))
           .filter("id is not null").groupBy("id").agg(F.max("image").alias("image")))
    msk = (masks.select(fn.digit_id(F.col("name")).alias("id"), F.col("path").alias("mask"))
           .filter("id is not null"))
    pairs = msk.join(img, "id")
    if invalid is not None:
        pairs = pairs.join(invalid.select(F.col("path").alias("mask")), "mask", "left_anti")
    return pairs, msk.join(img, "id", "left_anti")


def pair_by_rank(a: DataFrame, b: DataFrame, order="path", strict=False) -> DataFrame:
    """i-th with i-th of two sorted lists; the longer tail is dropped or, strict, refused."""
    if strict and a.count() != b.count():
        raise ValueError("lists differ in length")
    ra = global_rank(a.select(F.col(order).alias("image")), ["image"], "pos")
    rb = global_rank(b.select(F.col(order).alias("mask")), ["mask"], "pos")
    return ra.join(rb, "pos")


def pair_with_fallback(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Mask named like the image, else mask_<name>; neither -> mask is NULL."""
    m = masks.select(F.col("name").alias("_m")).distinct()
    same = m.withColumnRenamed("_m", "_same")
    pre = m.withColumnRenamed("_m", "_pre")
    return (images.join(same, F.col("name") == F.col("_same"), "left")
            .join(pre, F.concat(F.lit("mask_"), F.col("name")) == F.col("_pre"), "left")
            .select("name", F.coalesce("_same", "_pre").alias("mask")))


def find_sidecar(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """First *.mat of the same directory whose name contains the file's base name,
    else the default name.

    Contains-matching becomes an equi join: the substrings of a sidecar name that are as
    long as some base name of the directory, and begin like one, are its keys. Beginnings are
    two characters, so their list is bounded by the alphabet, and other substrings are not shuffled.
    """
    base = F.replace("name", fn.extension(F.col("name")), F.lit(""))
    f = files.select("dir", "name", base.alias("base"))
    lens = f.groupBy("dir", F.length("base").alias("_len")).agg(F.collect_set(F.substring("base", 1, 2)).alias("_heads"))
    n = F.length("sidecar")
    mats = sidecars.filter(F.col("name").endswith(".mat")).select("dir", F.col("name").alias("sidecar"))
    keys = (attach(mats, lens, on=["dir"]).filter(n >= F.col("_len"))
            .withColumn("_at", F.explode(F.sequence(F.lit(1), n - F.col("_len") + 1)))
            .filter(F.array_contains("_heads", F.substring("sidecar", F.col("_at"), F.least(F.lit(2), F.col("_len")))))
            .select("dir", "sidecar", F.substring("sidecar", F.col("_at"), F.col("_len")).alias("base"))
            .groupBy("dir", "base").agg(F.min("sidecar").alias("sidecar")))
    default = F.concat(F.lit("_"), F.col("base"), F.lit("_dicom_header.mat"))
    return f.join(keys, ["dir", "base"], "left").select(
        "dir", "name", F.coalesce("sidecar", default).alias("sidecar"))


def existing_file(cases: DataFrame, files: DataFrame):
    """<case>.nii.gz, else <case>.nii; and the cases with neither."""
    names = files.select(F.col("name").alias("file"), fn.case_id(F.col("name")).alias("case_id"))
    best = names.filter(F.col("file").rlike(r"\.nii(\.gz)?$")).groupBy("case_id").agg(
        F.min_by("file", F.when(F.col("file").endswith(".gz"), 0).otherwise(1)).alias("file"))
    return cases.join(best, "case_id"), cases.join(best, "case_id", "left_anti")


def first_mask(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """First .nii.gz per directory, with a flag when there are several; none -> NULL."""
    m = files.filter(F.col("name").endswith(".nii.gz")).groupBy("dir").agg(
        F.min("path").alias("mask"), F.count("*").alias("n"))
    return dirs.join(m, "dir", "left").select(
        "dir", "mask", (F.coalesce("n", F.lit(0)) > 1).alias("several"))


def plan_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per case: files missing at the target by base name, and all files."""
    there = target.select("case_id", "name").distinct().withColumn("_there", F.lit(1))
    return (source.join(there, ["case_id", "name"], "left").groupBy("case_id")
            .agg(F.count_if(F.col("_there").isNull()).alias("copied"), F.count("*").alias("total")))


def assign_condition(dirs: DataFrame) -> DataFrame:
    """First UID directory of a patient = zdrave, second = po_rekonstrukci (name order).

    ``n_dirs`` above 2 marks ignored directories. Two min aggregates find both names, so
    a patient with very many directories is not sorted in one task.
    """
    d = dirs.filter(fn.is_uid_dir(F.col("name"))).select("patient", "name")
    first = d.groupBy("patient").agg(F.min("name").alias("name"), F.count("*").alias("n_dirs"))
    later = (attach(d, first.select("patient", F.col("name").alias("_first")), on=["patient"])
             .filter(F.col("name") > F.col("_first")).groupBy("patient").agg(F.min("name").alias("name"))
             .join(first.select("patient", "n_dirs"), "patient"))
    tag = lambda df, c: df.select("patient", F.lit(c).alias("condition"), "name", "n_dirs",
                                  (F.col("n_dirs") > 2).alias("extra_dirs"))
    return tag(first, "zdrave").unionByName(tag(later, "po_rekonstrukci"))


def first_match(series: DataFrame, wanted: str, mode="trim"):
    """First series of (patient, condition) with the wanted description; pairs with none."""
    hit = fn.match_series(F.col("description"), F.lit(wanted), mode)
    found = series.filter(hit).groupBy("patient", "condition").agg(F.min("series_uid").alias("series_uid"))
    keys = series.select("patient", "condition").distinct()
    return found, keys.join(found, ["patient", "condition"], "left_anti")


def param_grid(spark, options: dict) -> DataFrame:
    """All combinations of the option lists, numbered with the last option fastest."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("run_idx"))
    for name, values in options.items():
        arr = F.array(*[F.lit(v) for v in values])
        df = df.select("*", F.posexplode(arr).alias("_i", name)).withColumn(
            "run_idx", F.col("run_idx") * len(values) + F.col("_i")).drop("_i")
    return df


# --- splits -----------------------------------------------------------------------

def kfold(df: DataFrame, key: str, k=5, seed=42) -> DataFrame:
    """Fold 0..k-1 after a seeded shuffle; the first n % k folds hold one row more."""
    n = df.agg(F.count("*").alias("_n"))  # one row
    r = shuffled_rank(df, [], key, seed, "_r").join(F.broadcast(n))
    base, extra, i = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_r") - 1
    cut = extra * (base + 1)
    fold = F.when(i < cut, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - cut) / base))
    return r.withColumn("fold", fold.cast("int")).drop("_r", "_n")


def leave_one_out(files: DataFrame) -> DataFrame:
    """One row per fold: row i validates, the other n_train rows train."""
    ranked = global_rank(files.select("path"), ["path"], "fold")
    n = files.agg((F.count("*") - 1).alias("n_train"))  # one row
    return ranked.join(F.broadcast(n)).select("fold", F.col("path").alias("val_path"), "n_train")


def stratified_split(df: DataFrame, by: str, key: str, held=0.3, second=0.5, seed=42) -> DataFrame:
    """train / val / test: ``held`` of each stratum leaves training, ``second`` of it tests.

    Held-out totals follow the largest remainder over the strata.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    quota = _largest_remainder(counts, by, "_n", held, "_h")
    quota = _largest_remainder(quota, by, "_h", second, "_t")
    r = shuffled_rank(df, [by], key, seed, "_r")
    q = quota.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = r.withColumn("_s", F.pmod(F.hash(key), F.lit(SALTS))).join(q, [by, "_s"])
    split = (F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_h"), "val")
             .otherwise("train"))
    return r.withColumn("split", split).drop("_n", "_h", "_t", "_r", "_s")


def _largest_remainder(strata: DataFrame, by, n_col, fraction, name) -> DataFrame:
    """Integer shares of ceil(total * fraction); one row per stratum, a small table."""
    total = strata.agg(F.sum(n_col).alias("_all"))
    s = strata.join(F.broadcast(total))
    want = F.ceil(F.round(F.col("_all") * fraction, 9))
    exact = F.col(n_col) * want / F.col("_all")
    s = s.withColumn("_f", F.floor(exact)).withColumn("_rem", exact - F.col("_f")).withColumn("_w", want)
    given = s.agg(F.sum("_f").alias("_given"))
    s = s.join(F.broadcast(given))
    place = F.row_number().over(W.orderBy(F.desc("_rem"), F.col(by)))
    return (s.withColumn(name, F.col("_f") + (place <= F.col("_w") - F.col("_given")).cast("long"))
            .drop("_all", "_f", "_rem", "_w", "_given"))


def random_split_exact(df: DataFrame, key: str, fraction=0.2, seed=42) -> DataFrame:
    """test = ceil(n * fraction) rows in seeded-hash order, the rest train."""
    n = df.agg(F.ceil(F.round(F.count("*") * fraction, 9)).alias("_cut"))  # one row
    r = shuffled_rank(df, [], key, seed, "_r").join(F.broadcast(n))
    return r.withColumn("split", F.when(F.col("_r") <= F.col("_cut"), "test").otherwise("train")
                        ).drop("_r", "_cut")


def holdout(df: DataFrame, rule: str, seed=42) -> DataFrame:
    """Fixed hold-outs by path: "last" file, "first2" after a seeded shuffle,
    or "five_two" (first 5 train, next 2 validate, rest unused)."""
    paths = df.select("path")
    if rule == "last":
        val = paths.orderBy(F.desc("path")).limit(1)
        picks = val.withColumn("split", F.lit("val"))
        rest = "train"
    elif rule == "first2":
        if paths.limit(3).count() < 3:
            raise ValueError("fewer than 3 pairs")
        picks = (paths.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(2)
                 .withColumn("split", F.lit("val")))
        rest = "train"
    else:
        seven = paths.orderBy("path").limit(7)  # at most seven rows
        no = F.row_number().over(W.orderBy("path"))
        picks = seven.withColumn("split", F.when(no <= 5, "train").otherwise("val"))
        rest = "unused"
    return paths.join(F.broadcast(picks), "path", "left").fillna(rest, ["split"])


def check_split(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows in more than one split, and rows in none."""
    n = splits.groupBy(key).agg(F.count_distinct("split").alias("_n"))
    j = rows.select(key).distinct().join(n, key, "left")
    return j.agg(F.count_if(F.col("_n") > 1).alias("in_several"),
                 F.count_if(F.col("_n").isNull()).alias("in_none"), F.count("*").alias("n_rows"))


def split_counts(splits: DataFrame, sex="sex") -> DataFrame:
    return splits.groupBy("split").agg(*[
        F.count_if(F.col(sex) == v).alias(v) for v in ("M", "F", "Unknown")])


def sample_report(missing: DataFrame, order: str, n=10) -> DataFrame:
    """First n ids and how many more there are."""
    total = missing.agg(F.count("*").alias("_n"))  # one row
    return (missing.select(order).orderBy(order).limit(n).join(F.broadcast(total))
            .select(order, F.greatest(F.col("_n") - n, F.lit(0)).alias("more")))


def job_counts(jobs: DataFrame, ok: Column) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"),
                    (F.count_if(~ok) > 0).alias("any_failed"))
