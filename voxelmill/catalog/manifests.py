"""Inventory 2.1-2.3 and 2.5-2.7 over file, header and metadata tables.

File lists derive from customer and lineitem rows, so their size follows the tables.
"""

from pyspark.sql import functions as F

from voxelmill.catalog import query
from voxelmill.functions import scalars as fn
from voxelmill.operators import manifests as mf


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


IMAGES_SQL = """images AS (
  SELECT c_custkey AS k, 'site_' || c_nationkey AS dir, CASE WHEN c_custkey % 10 = 3 THEN 'lost_' ELSE '' END || 'knee_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(7, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0')
         || CASE WHEN c_custkey % 4 = 0 THEN '.nii' ELSE '.nii.gz' END AS name FROM customer),
img AS (SELECT *, dir || '/' || name AS path FROM images)"""
MASKS_SQL = """masks AS (
  SELECT c_custkey AS k, 'site_' || c_nationkey AS dir, CASE WHEN c_custkey % 7 = 2 THEN 'gone_' WHEN c_custkey % 3 = 0 THEN '' ELSE 'mask_' END || 'knee_'
         || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(7, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || CASE WHEN c_custkey % 4 = 0 THEN '.nii' ELSE '.nii.gz' END AS name
  FROM customer),
msk AS (SELECT *, dir || '/' || name AS path FROM masks)"""
FILES = f"WITH {IMAGES_SQL}, {MASKS_SQL}\n"


def _named(df, name):
    k = F.col("c_custkey")
    ext = F.when(k % 4 == 0, ".nii").otherwise(".nii.gz")
    stem = F.concat(F.lit("knee_"), fn.zero_padded(k, 7), ext)
    d = F.concat(F.lit("site_"), F.col("c_nationkey").cast("string"))
    full = F.concat(name, stem)
    return df.select(k.alias("k"), d.alias("dir"), full.alias("name"),
                     F.concat(d, F.lit("/"), full).alias("path"))


def images(spark, sf):
    """Every tenth image has a name that no mask has."""
    return _named(table(spark, sf, "customer"), F.when(F.col("c_custkey") % 10 == 3, "lost_").otherwise(""))


def masks(spark, sf):
    k = F.col("c_custkey")
    return _named(table(spark, sf, "customer"),
                  F.when(k % 7 == 2, "gone_").when(k % 3 == 0, "").otherwise("mask_"))


HEADERS_SQL = """WITH headers AS (
  SELECT 'study_' || l_suppkey AS dir, '1.2.840.' || (l_partkey % 5) AS series_uid,
    'IM_' || l_orderkey || '_' || l_partkey || '_' || l_linenumber AS path,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE ' pd_' || lower(l_returnflag) || ' ' END AS description FROM lineitem)
"""


def headers(spark, sf):
    c = lambda n: F.col(n).cast("string")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("study_"), c("l_suppkey")).alias("dir"),
        F.concat(F.lit("1.2.840."), (F.col("l_partkey") % 5).cast("string")).alias("series_uid"),
        F.concat(F.lit("IM_"), c("l_orderkey"), F.lit("_"), c("l_partkey"), F.lit("_"),
                 c("l_linenumber")).alias("path"),
        F.when(F.col("l_linenumber") != 1, F.concat(F.lit(" pd_"), F.lower("l_returnflag"), F.lit(" ")))
        .alias("description"))


@query("src_series_catalog", HEADERS_SQL + """
SELECT dir, series_uid, path, row_number() OVER (PARTITION BY dir, series_uid ORDER BY path) AS file_no,
       count(*) OVER (PARTITION BY dir, series_uid) AS n_files FROM headers""")
def src_series_catalog(spark, sf):
    return mf.series_catalog(headers(spark, sf))


@query("src_series_desc", HEADERS_SQL + """
SELECT dir, series_uid, coalesce(description, 'N/A') AS description FROM (
  SELECT *, row_number() OVER (PARTITION BY dir, series_uid ORDER BY path) AS rn FROM (
    SELECT dir, series_uid, path, max(description) AS description FROM headers GROUP BY 1, 2, 3)) WHERE rn = 1""")
def src_series_desc(spark, sf):
    h = headers(spark, sf)
    one = h.groupBy("dir", "series_uid", "path").agg(F.max("description").alias("description"))
    return mf.series_description(one)


@query("snk_incremental", FILES + """
SELECT dir AS case_id, sum(CASE WHEN there THEN 0 ELSE 1 END) AS copied, count(*) AS total FROM (
  SELECT i.dir, EXISTS (SELECT 1 FROM msk m WHERE m.dir = i.dir AND m.name = i.name) AS there FROM img i) GROUP BY 1""")
def snk_incremental(spark, sf):
    a, b = (d.select(F.col("dir").alias("case_id"), "name") for d in (images(spark, sf), masks(spark, sf)))
    return mf.plan_copy(a, b)


@query("snk_config_json", """
SELECT '{"case":' || s_suppkey || ',"patch":[128,128,32],"site":"' || s_name || '"}' AS config FROM supplier""")
def snk_config_json(spark, sf):
    return table(spark, sf, "supplier").select(F.to_json(F.struct(
        F.col("s_suppkey").alias("case"), F.array(F.lit(128), F.lit(128), F.lit(32)).alias("patch"),
        F.col("s_name").alias("site"))).alias("config"))


@query("fn_case_id", FILES + """
SELECT name, regexp_replace(name, '\\.nii(\\.gz)?$', '') AS id, false AS is_mask FROM img UNION ALL
SELECT name, regexp_replace(regexp_replace(name, '\\.nii(\\.gz)?$', ''), '^mask_', ''), true FROM msk""")
def fn_case_id(spark, sf):
    one = lambda d, m: d.select("name", fn.case_id(F.col("name"), m).alias("id"), F.lit(m).alias("is_mask"))
    return one(images(spark, sf), False).unionByName(one(masks(spark, sf), True))


NAMES_SQL = """WITH names AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 9 THEN 'scan_' || lower(c_mktsegment) || '.nii'
  ELSE 'IM' || lpad(CAST(c_custkey % 500 AS VARCHAR), 3, '0') || '_t' || (c_custkey % 3) || '_' || c_custkey || '.nii.gz' END AS name FROM customer)
"""


def names(spark, sf):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    return table(spark, sf, "customer").select(k.alias("k"), F.when(
        k % 50 == 9, F.concat(F.lit("scan_"), F.lower("c_mktsegment"), F.lit(".nii"))).otherwise(
        F.concat(F.lit("IM"), F.lpad(s(k % 500), 3, "0"), F.lit("_t"), s(k % 3), F.lit("_"), s(k),
                 F.lit(".nii.gz"))).alias("name"))


@query("fn_digit_id", NAMES_SQL + "SELECT name, regexp_extract(name, '[0-9]+') AS id FROM names WHERE regexp_extract(name, '[0-9]+') <> ''")
def fn_digit_id(spark, sf):
    return names(spark, sf).select("name", fn.digit_id(F.col("name")).alias("id")).filter("id is not null")


@query("fn_seq_case", FILES + """
SELECT path, 'case_' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS case_id
FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM img)""")
def fn_seq_case(spark, sf):
    return mf.assign_case_ids(images(spark, sf).select("path"))


@query("fn_patient_id", """
SELECT name, CASE WHEN v = 0 THEN 'pacient_' || CASE WHEN k < 10 THEN lpad(CAST(k AS VARCHAR), 2, '0') ELSE CAST(k AS VARCHAR) END END AS patient
FROM (SELECT c_custkey AS k, c_custkey % 4 AS v, CASE c_custkey % 4 WHEN 0 THEN 'Pacient ' || c_custkey WHEN 1 THEN 'Pacient ' || c_custkey || ' b'
  WHEN 2 THEN 'Pacient x' || c_custkey ELSE 'Kontrola ' || c_custkey END AS name FROM customer)""")
def fn_patient_id(spark, sf):
    k = F.col("c_custkey")
    s = k.cast("string")
    name = (F.when(k % 4 == 0, F.concat(F.lit("Pacient "), s))
            .when(k % 4 == 1, F.concat(F.lit("Pacient "), s, F.lit(" b")))
            .when(k % 4 == 2, F.concat(F.lit("Pacient x"), s)).otherwise(F.concat(F.lit("Kontrola "), s)))
    return table(spark, sf, "customer").select(name.alias("name")).select(
        "name", fn.patient_id(F.col("name")).alias("patient"))


@query("fn_ext_base", FILES + """
SELECT name, CASE WHEN name LIKE '%.nii.gz' THEN '.nii.gz' ELSE '.nii' END AS ext, replace(replace(name, '.nii.gz', ''), '.nii', '') AS base FROM img""")
def fn_ext_base(spark, sf):
    return images(spark, sf).select("name", fn.extension(F.col("name")).alias("ext"),
                                    fn.case_id(F.col("name")).alias("base"))


@query("flt_any_substring", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'red')")
def flt_any_substring(spark, sf):
    return table(spark, sf, "part").filter(
        fn.contains_any(F.col("p_name"), ["ring", "red"])).select("p_partkey", "p_name")


@query("flt_uid_dir", "SELECT page_id, url FROM pages WHERE contains(url, '.') AND regexp_matches(url, '[0-9]')")
def flt_uid_dir(spark, sf):
    return table(spark, sf, "pages").filter(fn.is_uid_dir(F.col("url"))).select("page_id", "url")


@query("flt_exclude", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD')")
def flt_exclude(spark, sf):
    return table(spark, sf, "customer").filter(
        ~F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")).select("c_custkey", "c_mktsegment")


@query("flt_series_match", HEADERS_SQL + """
SELECT sum(CASE WHEN trim(description) = trim('pd_a ') THEN 1 ELSE 0 END) AS trimmed,
  sum(CASE WHEN description = ' pd_a ' THEN 1 ELSE 0 END) AS plain, sum(CASE WHEN contains(description, 'd_') THEN 1 ELSE 0 END) AS part FROM headers""")
def flt_series_match(spark, sf):
    d = F.col("description")
    return headers(spark, sf).agg(
        F.count_if(fn.match_series(d, F.lit("pd_a "), "trim")).alias("trimmed"),
        F.count_if(fn.match_series(d, F.lit(" pd_a "), "exact")).alias("plain"),
        F.count_if(fn.match_series(d, F.lit("d_"), "contains")).alias("part"))


@query("flt_not_mask", FILES + "SELECT path FROM (SELECT path, name FROM img UNION ALL SELECT path, name FROM msk) WHERE NOT contains(lower(name), 'mask')")
def flt_not_mask(spark, sf):
    both = images(spark, sf).unionByName(masks(spark, sf))
    return both.filter(fn.not_mask(F.col("name"))).select("path")


AGES = """WITH ages AS (SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN '0' || (c_custkey % 100) || 'Y' WHEN 1 THEN (c_custkey % 40) || 'M'
  WHEN 2 THEN (c_custkey % 90) || 'w' WHEN 3 THEN '00' || (c_custkey % 900) || 'D' WHEN 4 THEN ' ' || (c_custkey % 100) || '.5' WHEN 5 THEN '  '
  WHEN 6 THEN 'nan' WHEN 7 THEN (c_custkey % 50) || 'X' ELSE NULL END AS age FROM customer)
"""


def ages(spark, sf):
    k = F.col("c_custkey")
    n = lambda m: (k % m).cast("string")
    txt = (F.when(k % 9 == 0, F.concat(F.lit("0"), n(100), F.lit("Y"))).when(k % 9 == 1, F.concat(n(40), F.lit("M")))
           .when(k % 9 == 2, F.concat(n(90), F.lit("w"))).when(k % 9 == 3, F.concat(F.lit("00"), n(900), F.lit("D")))
           .when(k % 9 == 4, F.concat(F.lit(" "), n(100), F.lit(".5"))).when(k % 9 == 5, "  ")
           .when(k % 9 == 6, "nan").when(k % 9 == 7, F.concat(n(50), F.lit("X"))))
    return table(spark, sf, "customer").select(k.alias("k"), txt.alias("age"))


@query("fn_parse_age", AGES + """
SELECT k, age, CASE k % 9 WHEN 0 THEN CAST(k % 100 AS DOUBLE) WHEN 1 THEN round(CAST(k % 40 AS DOUBLE) / 12, 2) WHEN 2 THEN round(CAST(k % 90 AS DOUBLE) / CAST(52.14 AS DOUBLE), 2)
  WHEN 3 THEN round(CAST(k % 900 AS DOUBLE) / CAST(365.25 AS DOUBLE), 2) WHEN 4 THEN k % 100 + CAST(0.5 AS DOUBLE) END AS years FROM ages""")
def fn_parse_age(spark, sf):
    return ages(spark, sf).select("k", "age", fn.parse_age(F.col("age")).alias("years"))


@query("fn_parse_weight", """
SELECT k, w, CASE WHEN regexp_matches(c, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(c AS DOUBLE) END AS kg FROM (
  SELECT k, w, regexp_replace(w, '[^0-9.]', '', 'g') AS c FROM (SELECT c_custkey AS k, CASE c_custkey % 5
    WHEN 0 THEN '-' || (c_custkey % 120) || ' kg' WHEN 1 THEN (c_custkey % 120) || '.5.1' WHEN 2 THEN 'n/a' WHEN 3 THEN (c_custkey % 90) || '.25kg' END AS w FROM customer))""")
def fn_parse_weight(spark, sf):
    k = F.col("c_custkey")
    n = lambda m: (k % m).cast("string")
    w = (F.when(k % 5 == 0, F.concat(F.lit("-"), n(120), F.lit(" kg"))).when(k % 5 == 1, F.concat(n(120), F.lit(".5.1")))
         .when(k % 5 == 2, "n/a").when(k % 5 == 3, F.concat(n(90), F.lit(".25kg"))))
    return table(spark, sf, "customer").select(k.alias("k"), w.alias("w")).select(
        "k", "w", fn.parse_weight(F.col("w")).alias("kg"))


@query("fn_find_key", """
SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '045Y' WHEN 1 THEN c_custkey || 'M' WHEN 2 THEN '3D' WHEN 3 THEN '1Y' WHEN 5 THEN '7Y' END AS value FROM customer""")
def fn_find_key(spark, sf):
    k = F.col("c_custkey")
    j = (F.when(k % 6 == 0, '{"x":{"PatientAge":"wrong"},"PatientAge":"045Y"}')
         .when(k % 6 == 1, F.concat(F.lit('{"a":{"b":{"PatientAge":"'), k.cast("string"), F.lit('M"}},"PatientSex":"M"}')))
         .when(k % 6 == 2, '{"a":{"PatientAge":null,"c":{"PatientAge":"dead"}},"z":{"PatientAge":"3D"}}')
         .when(k % 6 == 3, '{"m":{"q":1},"z":{"PatientAge":"1Y"},"a":{"PatientAge":"2Y"}}')
         .when(k % 6 == 4, '{"m":{"q":1}}').otherwise('{"s":[{"t":{"PatientAge":"7Y"}}]}'))
    return mf.find_key(table(spark, sf, "customer").select(k.alias("k"), j.alias("header")), "k", "header", "PatientAge")


@query("fn_unwrap", """
SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name END AS v FROM customer""")
def fn_unwrap(spark, sf):
    k = F.col("c_custkey")
    arr = (F.when(k % 3 == 0, F.array(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "))))
           .when(k % 3 == 1, F.split("c_name", "")).otherwise(F.array().cast("array<string>")))
    return table(spark, sf, "customer").select(k.alias("k"), fn.unwrap(arr).alias("v"))


META_SQL = """WITH meta AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'M' WHEN 2 THEN 'M' ELSE 'F' END AS sex0 FROM customer),
metas AS (SELECT k, coalesce(sex0, 'Unknown') AS sex FROM meta)
"""


def meta(spark, sf):
    k = F.col("c_custkey")
    sex = F.when(k % 5 == 0, None).when(k % 5 < 3, "M").otherwise("F")
    return table(spark, sf, "customer").select(k.alias("k"), sex.alias("sex")).fillna({"sex": "Unknown"})


@query("fn_fill_unknown", META_SQL + "SELECT * FROM metas")
def fn_fill_unknown(spark, sf):
    return meta(spark, sf)


@query("fn_side_to_label", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y FROM labels""")
def fn_side_to_label(spark, sf):
    d = F.col("doc_id")
    side = F.when(d % 4 == 0, " RIGHT ").when(d % 4 == 1, "Left").when(d % 4 == 2, "Unknown").otherwise("ERROR")
    return table(spark, sf, "labels").select("doc_id", fn.side_label(side).alias("y"))


@query("fn_sigmoid_side", "SELECT s_suppkey, CASE WHEN s_acctbal > 4000 THEN 'Right' ELSE 'Left' END AS side FROM supplier")
def fn_sigmoid_side(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", fn.side_from_logit((F.col("s_acctbal") - 4000) / 1000).alias("side"))


@query("fn_binarise", """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS b FROM lineitem""")
def fn_binarise(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", fn.binarise(F.col("l_discount"), 0.05).alias("b"))


@query("fn_plane_name", """
SELECT p_partkey, CASE WHEN contains(n, 'sag') THEN 'sagittal' WHEN contains(n, 'cor') THEN 'coronal' WHEN contains(n, 'tra') OR contains(n, 'ax') THEN 'axial' ELSE 'sagittal' END AS plane,
  round(CAST(CASE WHEN contains(n, 'sag') THEN sz / sy WHEN contains(n, 'cor') THEN sz / sx WHEN contains(n, 'tra') OR contains(n, 'ax') THEN sy / sx ELSE 1 END AS DOUBLE), 6) AS aspect
FROM (SELECT p_partkey, lower(p_type || CASE p_partkey % 6 WHEN 0 THEN '_SAG_tra' WHEN 1 THEN '_Cor' WHEN 2 THEN '_tra' WHEN 3 THEN '_t2_AX' WHEN 4 THEN '_cor_ax' ELSE '' END) AS n,
  CAST(p_size AS DOUBLE) AS sz, CAST(p_size + 1 AS DOUBLE) AS sy, CAST(p_size + 3 AS DOUBLE) AS sx FROM part)""")
def fn_plane_name(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    tail = (F.when(k % 6 == 0, "_SAG_tra").when(k % 6 == 1, "_Cor").when(k % 6 == 2, "_tra")
            .when(k % 6 == 3, "_t2_AX").when(k % 6 == 4, "_cor_ax").otherwise(""))
    n = F.concat("p_type", tail)
    return table(spark, sf, "part").select(
        "p_partkey", fn.plane_of(n).alias("plane"),
        F.round(fn.plane_aspect(n, s, s + 1, s + 3), 6).alias("aspect"))


@query("fn_spacing_order", "SELECT p_partkey, p_size + 2 AS z, p_size + 1 AS y, p_size AS x FROM part")
def fn_spacing_order(spark, sf):
    h = F.array("p_size", F.col("p_size") + 1, F.col("p_size") + 2)
    return table(spark, sf, "part").select("p_partkey", fn.spacing_zyx(h).alias("s")).select("p_partkey", "s.*")


@query("fn_clip", "SELECT l_orderkey, l_partkey, l_linenumber, least(greatest(l_quantity, 10), 40) AS q FROM lineitem")
def fn_clip(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", fn.clip(F.col("l_quantity"), 10.0, 40.0).alias("q"))


@query("fn_round_index", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS i FROM lineitem")
def fn_round_index(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", fn.round_index(F.col("l_quantity") / 2).alias("i"))


@query("fn_trunc_index", "SELECT c_custkey, CAST(trunc(c_acctbal / 7) AS INTEGER) AS i FROM customer")
def fn_trunc_index(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.trunc_index(F.col("c_acctbal") / 7).alias("i"))


VECS = """WITH v AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_orderkey % 7 - 3 AS DOUBLE) AS az, CAST(l_partkey % 5 - 2 AS DOUBLE) AS ay, CAST(l_linenumber AS DOUBLE) AS ax,
  CAST(l_partkey % 3 + 1 AS DOUBLE) AS bz, CAST(l_orderkey % 4 AS DOUBLE) AS b1, l_quantity AS bx FROM lineitem),
u AS (SELECT *, sqrt(az*az + ay*ay + ax*ax) AS na, sqrt(bz*bz + b1*b1 + bx*bx) AS nb, az*bz + ay*b1 + ax*bx AS d FROM v)
"""


@query("fn_vec", VECS + """SELECT l_orderkey, l_partkey, l_linenumber, d AS dot, round(na, 6) AS norm_a, round(az / na, 6) AS unit_z,
  round(az - d / nb * bz / nb, 6) AS rej_z, round(degrees(acos(least(1, greatest(-1, abs(d / na / nb))))), 4) AS angle,
  round(CASE WHEN ay*ay + ax*ax > 0 THEN ay / sqrt(ay*ay + ax*ax) END, 6) AS sag_y FROM u""")
def fn_vec(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        *[c.cast("double").alias(n) for n, c in {
            "az": F.col("l_orderkey") % 7 - 3, "ay": F.col("l_partkey") % 5 - 2, "ax": F.col("l_linenumber"),
            "bz": F.col("l_partkey") % 3 + 1, "by": F.col("l_orderkey") % 4, "bx": F.col("l_quantity")}.items()])
    a, b = fn.cols("a"), fn.cols("b")
    ua, ub = fn.unit(a), fn.unit(b)
    sag = fn.unit(fn.vec(0, a[1], a[2]))
    return d.select("l_orderkey", "l_partkey", "l_linenumber", fn.dot(a, b).alias("dot"),
                    F.round(fn.norm(a), 6).alias("norm_a"), F.round(ua[0], 6).alias("unit_z"),
                    F.round(fn.reject(a, ub)[0], 6).alias("rej_z"),
                    F.round(fn.angle(ua, ub), 4).alias("angle"), F.round(sag[1], 6).alias("sag_y"))


@query("fn_status", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN 'ERROR' WHEN c_acctbal > 0 THEN 'Right' ELSE 'Left' END AS status FROM customer""")
def fn_status(spark, sf):
    text = F.when(F.col("c_custkey") % 13 == 0, "broken").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), fn.status(text).alias("status"))


# --- joins ------------------------------------------------------------------------

@query("join_pair_id", FILES + """, a AS (SELECT regexp_replace(name, '\\.nii(\\.gz)?$', '') AS id, path FROM img),
b AS (SELECT regexp_replace(regexp_replace(name, '\\.nii(\\.gz)?$', ''), '^mask_', '') AS id, path FROM msk)
SELECT a.id, a.path AS image, b.path AS mask FROM a LEFT JOIN b ON a.id = b.id""")
def join_pair_id(spark, sf):
    pairs, alone = mf.pair_by_id(images(spark, sf), masks(spark, sf))
    return pairs.unionByName(alone, allowMissingColumns=True)


@query("join_pair_digits", NAMES_SQL + """, n AS (SELECT k, name, regexp_extract(name, '[0-9]+') AS id FROM names),
i AS (SELECT id, max(name) AS image FROM n WHERE id <> '' GROUP BY id)
SELECT m.id, m.name AS mask, i.image FROM n m LEFT JOIN i ON m.id = i.id
WHERE m.id <> '' AND NOT (i.image IS NOT NULL AND m.k % 11 = 0)""")
def join_pair_digits(spark, sf):
    n = names(spark, sf).withColumn("path", F.col("name"))
    pairs, alone = mf.pair_by_digits(n, n, invalid=n.filter("k % 11 = 0"))
    return pairs.unionByName(alone, allowMissingColumns=True)


@query("join_positional", FILES + """
SELECT a.pos, image, mask FROM (SELECT path AS image, row_number() OVER (ORDER BY path) AS pos FROM img) a
JOIN (SELECT path AS mask, row_number() OVER (ORDER BY path) AS pos FROM msk) b ON a.pos = b.pos""")
def join_positional(spark, sf):
    return mf.pair_by_rank(images(spark, sf), masks(spark, sf))


@query("join_fallback_name", FILES + """
SELECT name, CASE WHEN EXISTS (SELECT 1 FROM msk m WHERE m.name = i.name) THEN name
  WHEN EXISTS (SELECT 1 FROM msk m WHERE m.name = 'mask_' || i.name) THEN 'mask_' || name END AS mask FROM img i""")
def join_fallback_name(spark, sf):
    return mf.pair_with_fallback(images(spark, sf), masks(spark, sf))


@query("join_meta_mapping", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_meta_mapping(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("case"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("case"), "c_mktsegment")
    return o.join(c, "case").withColumnRenamed("case", "o_custkey")


@query("join_wildcard", FILES + """, b AS (SELECT dir, name, regexp_replace(name, '\\.nii(\\.gz)?$', '') AS base FROM img),
s AS (SELECT 'site_' || c_nationkey AS dir, 'x' || (c_custkey % 2) || CASE WHEN c_custkey % 6 = 1 THEN '_gone_' ELSE '_knee_' END || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(7, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || '_h' || j || '.mat' AS sidecar
  FROM customer, (SELECT range AS j FROM range(2)))
SELECT b.dir, b.name, coalesce(min(sidecar), '_' || b.base || '_dicom_header.mat') AS sidecar
FROM b LEFT JOIN s ON b.dir = s.dir AND contains(s.sidecar, b.base) GROUP BY b.dir, b.name, b.base""")
def join_wildcard(spark, sf):
    k = F.col("c_custkey")
    side = table(spark, sf, "customer").select(
        F.concat(F.lit("site_"), F.col("c_nationkey").cast("string")).alias("dir"),
        F.explode(F.array(*[F.concat(F.lit("x"), (k % 2).cast("string"), F.when(k % 6 == 1, "_gone_").otherwise("_knee_"),
                                     fn.zero_padded(k, 7), F.lit(f"_h{j}.mat"))
                            for j in range(2)])).alias("name"))
    return mf.find_sidecar(images(spark, sf), side)


@query("join_exists", FILES + """, f AS (SELECT DISTINCT name, regexp_replace(name, '\\.nii(\\.gz)?$', '') AS id FROM img)
SELECT 'knee_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(7, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS case_id,
  (SELECT max(name) FROM f WHERE f.id = 'knee_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(7, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0')) AS file FROM customer""")
def join_exists(spark, sf):
    cases = table(spark, sf, "customer").select(
        F.concat(F.lit("knee_"), fn.zero_padded(F.col("c_custkey"), 7)).alias("case_id"))
    found, missing = mf.existing_file(cases, images(spark, sf))
    return found.unionByName(missing, allowMissingColumns=True)


@query("join_first_mask", FILES + """
SELECT 'site_' || n_nationkey AS dir, min(path) AS mask, count(path) > 1 AS several
FROM nation LEFT JOIN msk ON dir = 'site_' || n_nationkey AND name LIKE '%.nii.gz' GROUP BY 1""")
def join_first_mask(spark, sf):
    d = table(spark, sf, "nation").select(F.concat(F.lit("site_"), F.col("n_nationkey").cast("string")).alias("dir"))
    return mf.first_mask(d, masks(spark, sf))


@query("join_param_grid", """
SELECT s_suppkey * 12 + a * 6 + b * 3 + c AS run_idx, s_suppkey, CASE a WHEN 0 THEN CAST(0.001 AS DOUBLE) ELSE CAST(0.0001 AS DOUBLE) END AS lr,
  CASE b WHEN 0 THEN 16 ELSE 32 END AS base, CASE c WHEN 0 THEN 'relu' WHEN 1 THEN 'gelu' ELSE 'elu' END AS act
FROM supplier, (SELECT range AS a FROM range(2)), (SELECT range AS b FROM range(2)), (SELECT range AS c FROM range(3))""")
def join_param_grid(spark, sf):
    g = mf.param_grid(spark, {"lr": [0.001, 0.0001], "base": [16, 32], "act": ["relu", "gelu", "elu"]})
    s = table(spark, sf, "supplier").select("s_suppkey")
    return s.join(F.broadcast(g)).withColumn("run_idx", F.col("s_suppkey") * 12 + F.col("run_idx"))


# --- splits and ranks ----------------------------------------------------------------

@query("win_kfold", """
SELECT f AS fold, CASE WHEN f < n % 5 THEN n // 5 + 1 ELSE n // 5 END AS n_val FROM (SELECT count(*) AS n FROM customer), (SELECT CAST(range AS INTEGER) AS f FROM range(5))""")
def win_kfold(spark, sf):
    return mf.kfold(table(spark, sf, "customer").select("c_custkey"), "c_custkey").groupBy("fold").agg(
        F.count("*").alias("n_val"))


@query("win_leave_one_out", FILES + """
SELECT row_number() OVER (ORDER BY path) AS fold, path AS val_path, (SELECT count(*) FROM img) - 1 AS n_train FROM img""")
def win_leave_one_out(spark, sf):
    return mf.leave_one_out(images(spark, sf))


SPLIT_SQL = META_SQL + """, c AS (SELECT sex, count(*) AS n FROM metas GROUP BY 1),
e AS (SELECT *, ceil(round(sum(n) OVER () * CAST(0.3 AS DOUBLE), 9)) AS w, n * ceil(round(sum(n) OVER () * CAST(0.3 AS DOUBLE), 9)) / CAST(sum(n) OVER () AS DOUBLE) AS x FROM c),
h AS (SELECT sex, n, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, sex) <= w - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS h FROM e),
e2 AS (SELECT *, ceil(round(sum(h) OVER () * CAST(0.5 AS DOUBLE), 9)) AS w, h * ceil(round(sum(h) OVER () * CAST(0.5 AS DOUBLE), 9)) / CAST(sum(h) OVER () AS DOUBLE) AS x FROM h),
q AS (SELECT sex, n, h, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, sex) <= w - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS t FROM e2),
cells AS (SELECT 'train' AS split, sex, n - h AS c FROM q UNION ALL SELECT 'val', sex, h - t FROM q UNION ALL SELECT 'test', sex, t FROM q)
"""


@query("win_stratified_split", SPLIT_SQL + "SELECT split, sex, CAST(c AS BIGINT) AS n FROM cells WHERE c > 0")
def win_stratified_split(spark, sf):
    return mf.stratified_split(meta(spark, sf), "sex", "k").groupBy("split", "sex").agg(F.count("*").alias("n"))


@query("agg_split_counts", SPLIT_SQL + """
SELECT split, CAST(sum(CASE WHEN sex = 'M' THEN c ELSE 0 END) AS BIGINT) AS "M", CAST(sum(CASE WHEN sex = 'F' THEN c ELSE 0 END) AS BIGINT) AS "F",
  CAST(sum(CASE WHEN sex = 'Unknown' THEN c ELSE 0 END) AS BIGINT) AS "Unknown" FROM cells GROUP BY 1""")
def agg_split_counts(spark, sf):
    return mf.split_counts(mf.stratified_split(meta(spark, sf), "sex", "k"))


@query("set_partition", "SELECT 0 AS in_several, 0 AS in_none, count(*) AS n_rows FROM customer")
def set_partition(spark, sf):
    m = meta(spark, sf)
    return mf.check_split(m, mf.stratified_split(m, "sex", "k"), "k")


@query("win_random_split", """
SELECT 'test' AS split, CAST(ceil(round(count(*) * CAST(0.15 AS DOUBLE), 9)) AS BIGINT) AS n FROM orders UNION ALL
SELECT 'train', count(*) - CAST(ceil(round(count(*) * CAST(0.15 AS DOUBLE), 9)) AS BIGINT) FROM orders""")
def win_random_split(spark, sf):
    return mf.random_split_exact(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.15).groupBy(
        "split").agg(F.count("*").alias("n"))


@query("win_tail_split", FILES + """, r AS (SELECT path, row_number() OVER (ORDER BY path) AS a, row_number() OVER (ORDER BY path DESC) AS d FROM img)
SELECT path, 'last' AS rule, CASE WHEN d = 1 THEN 'val' ELSE 'train' END AS split FROM r UNION ALL
SELECT path, 'five_two', CASE WHEN a <= 5 THEN 'train' WHEN a <= 7 THEN 'val' ELSE 'unused' END FROM r""")
def win_tail_split(spark, sf):
    p = images(spark, sf)
    one = lambda r: mf.holdout(p, r).withColumn("rule", F.lit(r))
    return one("last").unionByName(one("five_two"))


DIRS_SQL = """WITH dirs AS (SELECT DISTINCT 'pacient_' || o_custkey AS patient, CASE WHEN o_orderkey % 5 = 0 THEN 'notes' ELSE '1.3.' || o_orderkey END AS name FROM orders)
"""


def dirs(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("pacient_"), F.col("o_custkey").cast("string")).alias("patient"),
        F.when(k % 5 == 0, "notes").otherwise(F.concat(F.lit("1.3."), k.cast("string"))).alias("name")).distinct()


@query("win_condition_rank", DIRS_SQL + """
SELECT patient, CASE rn WHEN 1 THEN 'zdrave' ELSE 'po_rekonstrukci' END AS condition, name, n_dirs, n_dirs > 2 AS extra_dirs FROM (
  SELECT patient, name, row_number() OVER (PARTITION BY patient ORDER BY name) AS rn, count(*) OVER (PARTITION BY patient) AS n_dirs
  FROM dirs WHERE contains(name, '.')) WHERE rn <= 2""")
def win_condition_rank(spark, sf):
    return mf.assign_condition(dirs(spark, sf))


SERIES_SQL = """WITH series AS (SELECT 'pacient_' || l_suppkey AS patient, CASE WHEN l_partkey % 2 = 0 THEN 'zdrave' ELSE 'po_rekonstrukci' END AS condition,
  '1.2.' || l_orderkey AS series_uid, ' pd_' || l_linenumber || '_' || (l_partkey % 37) AS description FROM lineitem)
"""


@query("win_first_match", SERIES_SQL + """
SELECT k.patient, k.condition, min(s.series_uid) AS series_uid FROM (SELECT DISTINCT patient, condition FROM series) k
LEFT JOIN series s ON s.patient = k.patient AND s.condition = k.condition AND trim(s.description) = 'pd_3_7' GROUP BY 1, 2""")
def win_first_match(spark, sf):
    s = lambda c: F.col(c).cast("string")
    series = table(spark, sf, "lineitem").select(
        F.concat(F.lit("pacient_"), s("l_suppkey")).alias("patient"),
        F.when(F.col("l_partkey") % 2 == 0, "zdrave").otherwise("po_rekonstrukci").alias("condition"),
        F.concat(F.lit("1.2."), s("l_orderkey")).alias("series_uid"),
        F.concat(F.lit(" pd_"), s("l_linenumber"), F.lit("_"), (F.col("l_partkey") % 37).cast("string")).alias("description"))
    found, none = mf.first_match(series, "pd_3_7")
    return found.unionByName(none, allowMissingColumns=True)


@query("top_sort_paths", FILES + "SELECT path FROM img ORDER BY path")
def top_sort_paths(spark, sf):
    return images(spark, sf).select("path").orderBy("path")


@query("top_limit_report", FILES + """, a AS (SELECT regexp_replace(name, '\\.nii(\\.gz)?$', '') AS id FROM img),
m AS (SELECT id FROM a WHERE id NOT IN (SELECT regexp_replace(regexp_replace(name, '\\.nii(\\.gz)?$', ''), '^mask_', '') FROM msk))
SELECT id, greatest((SELECT count(*) FROM m) - 10, 0) AS more FROM m ORDER BY id LIMIT 10""")
def top_limit_report(spark, sf):
    return mf.sample_report(mf.pair_by_id(images(spark, sf), masks(spark, sf))[1], "id")


@query("top_head", FILES + "SELECT path FROM img ORDER BY path LIMIT 4")
def top_head(spark, sf):
    return images(spark, sf).select("path").orderBy("path").limit(4)


@query("agg_conversion_counts", "SELECT count(*) AS total, count(*) - sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS succeeded, max(o_orderstatus = 'P') AS any_failed FROM orders")
def agg_conversion_counts(spark, sf):
    return mf.job_counts(table(spark, sf, "orders"), F.col("o_orderstatus") != "P")
