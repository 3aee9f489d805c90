"""Column functions: names, ages, weights, clipping, rounding, vectors."""

from functools import reduce

from pyspark.sql import Column, functions as F


def case_id(name: Column, is_mask=False) -> Column:
    base = F.regexp_replace(name, r"\.nii(\.gz)?$", "")
    return F.regexp_replace(base, "^mask_", "") if is_mask else base


def zero_padded(number: Column, width: int) -> Column:
    """The number as text of at least ``width`` digits; longer ones keep all of theirs."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def digit_id(name: Column) -> Column:
    """First run of digits as text; NULL where the name has none."""
    return F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit(""))


def patient_id(name: Column) -> Column:
    """"Pacient 7" -> pacient_07; NULL unless exactly two words, the second all digits."""
    parts = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    ok = ((F.size(parts) == 2) & parts[1].rlike(r"^\d+$")
          & F.lower(name).startswith("pacient"))
    return F.when(ok, F.concat(F.lit("pacient_"), zero_padded(parts[1].cast("bigint"), 2)))


def extension(name: Column) -> Column:
    return F.when(name.endswith(".nii.gz"), ".nii.gz").when(name.endswith(".nii"), ".nii")


def contains_any(col: Column, names) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(n) for n in names])


def is_uid_dir(name: Column) -> Column:
    return name.contains(".") & name.rlike(r"\d")


def not_mask(name: Column) -> Column:
    return ~F.lower(name).contains("mask")


def match_series(description: Column, wanted: Column, mode) -> Column:
    if mode == "trim":
        return F.trim(description) == F.trim(wanted)
    return description == wanted if mode == "exact" else description.contains(wanted)


# Units per year of an age text.
AGE_UNITS = {"Y": 1.0, "M": 12.0, "W": 52.14, "D": 365.25}


def parse_age(text: Column) -> Column:
    """Age text in years; only months, weeks and days are rounded (half even)."""
    s = F.trim(text)
    n = F.regexp_extract(s, r"^0*(\d+)([YMWDymwd])$", 1)
    unit = F.upper(F.regexp_extract(s, r"^0*(\d+)([YMWDymwd])$", 2))
    v = n.try_cast("double")
    years = F.when(unit == "Y", v)
    for u in "MWD":
        years = years.when(unit == u, F.bround(v / AGE_UNITS[u], 2))
    plain = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    return F.coalesce(plain, years)


def parse_weight(text: Column) -> Column:
    """Digits and dots only, so the sign is lost; empty or two dots -> NULL."""
    kept = F.regexp_replace(text, "[^0-9.]", "")
    return F.when(kept.rlike(r"^(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def unwrap(arr: Column) -> Column:
    """One element -> it, none -> NULL, several characters -> joined; trimmed."""
    return F.trim(F.when(F.size(arr) == 1, F.element_at(arr, 1))
                  .when(F.size(arr) > 1, F.array_join(arr, "")))


def side_label(side: Column) -> Column:
    return F.when(F.lower(F.trim(side)) == "right", 1.0).otherwise(0.0)


def side_from_logit(logit: Column) -> Column:
    return F.when(1.0 / (1.0 + F.exp(-logit)) > 0.5, "Right").otherwise("Left")


def binarise(c: Column, threshold=0.5) -> Column:
    return (c > threshold).cast("int")


def one_hot(label: Column, classes=(0, 1, 2, 3)):
    return [(label == k).cast("int").alias(f"is_{k}") for k in classes]


def plane_of(name: Column) -> Column:
    n = F.lower(name)
    return (F.when(n.contains("sag"), "sagittal").when(n.contains("cor"), "coronal")
            .when(n.contains("tra") | n.contains("ax"), "axial").otherwise("sagittal"))


def plane_aspect(name: Column, sz: Column, sy: Column, sx: Column) -> Column:
    n = F.lower(name)
    return (F.when(n.contains("sag"), sz / sy).when(n.contains("cor"), sz / sx)
            .when(n.contains("tra") | n.contains("ax"), sy / sx).otherwise(1.0))


def spacing_zyx(header_spacing: Column) -> Column:
    """Header order (x, y, z) turned to (z, y, x)."""
    return F.struct(header_spacing[2].alias("z"), header_spacing[1].alias("y"),
                    header_spacing[0].alias("x"))


def clip(c, lo, hi) -> Column:
    """Clamp; NULL stays NULL (least and greatest alone would skip it)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def round_index(c) -> Column:
    """Nearest integer, half to even."""
    return F.bround(c, 0).cast("int")


def trunc_index(c) -> Column:
    return c.cast("int")


def status(text: Column) -> Column:
    """Side of a logit given as text; anything that is no number is an ERROR."""
    logit = text.try_cast("double")
    return F.when(logit.isNull(), "ERROR").otherwise(side_from_logit(logit))


def vec(z, y, x):
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (lit(z), lit(y), lit(x))


def cols(prefix):
    return tuple(F.col(f"{prefix}{a}") for a in "zyx")


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def sub(a, b):
    return tuple(p - q for p, q in zip(a, b))


def unit(a):
    """NULL components for a zero vector."""
    n = norm(a)
    return tuple(F.when(n > 0, c / n) for c in a)


def reject(a, n):
    """Part of ``a`` in the plane with unit normal ``n``."""
    d = dot(a, n)
    return tuple(p - d * q for p, q in zip(a, n))


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def angle(a, b) -> Column:
    """Unsigned angle of two unit vectors in degrees, 0..90."""
    return F.degrees(F.acos(clip(F.abs(dot(a, b)), -1.0, 1.0)))
