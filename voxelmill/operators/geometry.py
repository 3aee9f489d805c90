"""Index geometry: mirror, crop, pad, tiles, patches and resampling."""

from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.functions import arrays, planes
from voxelmill.functions.grouped import map_groups
from voxelmill.model import AXES, CASE, VOXEL, attach, in_grid, python_partitions

SHAPE = ["nz", "ny", "nx"]


def mirror(df: DataFrame, volumes: DataFrame, axis="z") -> DataFrame:
    cols = df.columns
    d = attach(df, volumes.select(CASE, f"n{axis}"), volumes)
    return d.withColumn(axis, F.col(f"n{axis}") - 1 - F.col(axis)).select(*cols)


def permute(df: DataFrame, order="xzy") -> DataFrame:
    """New z, y, x taken from the named old axes."""
    rest = [c for c in df.columns if c not in AXES]
    return df.select(*rest, *[F.col(old).alias(new) for new, old in zip(AXES, order)])


def slice_at(df: DataFrame, volumes: DataFrame, axis="z", index=None, flip=None) -> DataFrame:
    """One plane, the middle one by default; ``flip`` turns an in-plane axis over."""
    if index is not None:
        d = df.filter(F.col(axis) == index)
    else:
        d = attach(df, volumes.select(CASE, F.floor(F.col(f"n{axis}") / 2).alias("_mid")), volumes)
        d = d.filter(F.col(axis) == F.col("_mid")).drop("_mid")
    return mirror(d, volumes, flip) if flip else d


def crop_to(df: DataFrame, box: DataFrame, volumes: DataFrame) -> DataFrame:
    cols = df.columns
    d = attach(df, box, volumes)
    for a in AXES:
        d = d.filter(F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1"))).withColumn(a, F.col(a) - F.col(f"{a}0"))
    return d.select(*cols)


def _zero_rows(ranges: DataFrame, size, value) -> DataFrame:
    """Grid rows of ``size`` (columns or numbers) outside the kept range lo..hi of each
    axis, as zeros.

    Cases that need no padding produce nothing."""
    size = [s if isinstance(s, Column) else F.lit(s) for s in size]
    short = None
    for a, s in zip(AXES, size):
        c = (F.col(f"lo_{a}") > 0) | (F.col(f"hi_{a}") < s)
        short = c if short is None else short | c
    d = ranges.filter(short)
    inside = F.lit(True)
    for a, s in zip(AXES, size):
        d = d.withColumn(a, F.explode(F.sequence(F.lit(0), s - 1)))
        inside = inside & (F.col(a) >= F.col(f"lo_{a}")) & (F.col(a) < F.col(f"hi_{a}"))
    return d.filter(~inside).select(*VOXEL, F.lit(0.0).alias(value))


def center_crop3(vox: DataFrame, volumes: DataFrame, size, value="value") -> DataFrame:
    """Central box: start max(0, n//2 - c//2), padded with zeros at the end if short."""
    d = volumes.select(CASE, *SHAPE)
    for a, s in zip(AXES, size):
        start = F.greatest(F.lit(0), F.expr(f"cast(n{a} div 2 as int)") - s // 2)
        d = (d.withColumn(f"s_{a}", start)
             .withColumn(f"hi_{a}", F.least(F.col(f"n{a}"), F.col(f"s_{a}") + s) - F.col(f"s_{a}"))
             .withColumn(f"lo_{a}", F.lit(0)))
    d = d.drop(*SHAPE)
    kept = attach(vox.select(*VOXEL, value), d, volumes)
    for a in AXES:
        kept = kept.withColumn(a, F.col(a) - F.col(f"s_{a}")).filter(
            (F.col(a) >= 0) & (F.col(a) < F.col(f"hi_{a}")))
    return kept.select(*VOXEL, value).unionByName(_zero_rows(d, size, value))


def restore3(crop: DataFrame, volumes: DataFrame, size) -> DataFrame:
    """Sparse crop back on the full grid; padding beyond the grid is dropped."""
    cols = crop.columns
    d = attach(crop, volumes.select(CASE, *SHAPE), volumes)
    for a, s in zip(AXES, size):
        start = F.greatest(F.lit(0), F.expr(f"cast(n{a} div 2 as int)") - s // 2)
        d = d.withColumn(a, F.col(a) + start).filter(F.col(a) < F.col(f"n{a}"))
    return d.select(*cols)


def pad_to(vox: DataFrame, volumes: DataFrame, size, value="value") -> DataFrame:
    """Zero pad each axis up to ``size``, half before and the rest after."""
    d = volumes.select(CASE, *SHAPE)
    for a, s in zip(AXES, size):
        before = F.expr(f"cast(greatest({s} - n{a}, 0) div 2 as int)")
        d = (d.withColumn(f"lo_{a}", before).withColumn(f"hi_{a}", F.col(f"lo_{a}") + F.col(f"n{a}"))
             .withColumn(f"m{a}", F.greatest(F.col(f"n{a}"), F.lit(s))))
    kept = attach(vox.select(*VOXEL, value), d.select(CASE, "lo_z", "lo_y", "lo_x"), volumes)
    for a in AXES:
        kept = kept.withColumn(a, F.col(a) + F.col(f"lo_{a}"))
    zeros = _zero_rows(d, [F.col(f"m{a}") for a in AXES], value)
    return kept.select(*VOXEL, value).unionByName(zeros)


def unpad(pred: DataFrame, volumes: DataFrame) -> DataFrame:
    """Cut to the original shape from index 0 (not the inverse of pad_to, as in the reference)."""
    cols = pred.columns
    d = attach(pred, volumes.select(CASE, *SHAPE), volumes)
    return d.filter("z < nz and y < ny and x < nx").select(*cols)


def center_crop2(vox: DataFrame, volumes: DataFrame, size, value="value") -> DataFrame:
    """Per z plane a central size x size window; short sides get p//2 zeros before, rest after."""
    d = volumes.select(CASE, "nz", "ny", "nx")
    for a in "yx":
        pad = F.greatest(F.lit(size) - F.col(f"n{a}"), F.lit(0))
        before = F.floor(pad / 2).cast("int")
        start = F.floor((F.col(f"n{a}") + pad - size) / 2).cast("int")
        d = (d.withColumn(f"m_{a}", before - start)
             .withColumn(f"lo_{a}", F.greatest(F.lit(0), F.col(f"m_{a}")))
             .withColumn(f"hi_{a}", F.least(F.lit(size), F.col(f"m_{a}") + F.col(f"n{a}"))))
    kept = attach(vox.select(*VOXEL, value), d.select(CASE, "m_y", "m_x"), volumes)
    for a in "yx":
        kept = kept.withColumn(a, F.col(a) + F.col(f"m_{a}")).filter((F.col(a) >= 0) & (F.col(a) < size))
    short = d.filter(f"lo_y > 0 or hi_y < {size} or lo_x > 0 or hi_x < {size}")
    zeros = short.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
    for a in "yx":
        zeros = zeros.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    zeros = zeros.filter("not (y >= lo_y and y < hi_y and x >= lo_x and x < hi_x)")
    return kept.select(*VOXEL, value).unionByName(zeros.select(*VOXEL, F.lit(0.0).alias(value)))


def paste2(pred: DataFrame, volumes: DataFrame, size, fit="empty") -> DataFrame:
    """Sparse square prediction back at ((ny - s)//2, (nx - s)//2).

    Planes that are smaller than the square on a side stay empty, or with ``fit="resize"`` take the
    whole square resized to the plane: cell centres aligned, labels from the nearest place (ties to
    the even one), other values linearly.
    """
    cols = pred.columns
    holds = f"ny >= {size} and nx >= {size}"
    d = attach(pred, volumes.select(CASE, "ny", "nx").filter(holds), volumes)
    for a in "yx":
        d = d.withColumn(a, F.col(a) + F.floor((F.col(f"n{a}") - size) / 2).cast("int"))
    pasted = d.select(*cols)
    if fit != "resize":
        return pasted
    small = volumes.filter(f"not ({holds})").select(CASE, *[F.col(n).alias("m" + n[1]) for n in SHAPE])
    pts = target_grid(small).withColumn("fz", F.col("z").cast("double"))
    for a in "yx":
        at = (F.col(a) + 0.5) * float(size) / F.col(f"m{a}") - 0.5
        pts = pts.withColumn(f"f{a}", F.least(F.greatest(at, F.lit(0.0)), F.lit(size - 1.0)))
    # the few cases with small planes are told by their manifest rows, so the square is read once more at most
    inside = pred.join(small.select(CASE), CASE, "left_semi")
    return pasted.unionByName((sample_nearest(pts, inside) if "label" in cols else sample_linear(pts, inside)).select(*cols))


def random_crop2(vox: DataFrame, volumes: DataFrame, size, seed=42) -> DataFrame:
    """Per z plane a size x size window at a place drawn by a seeded hash; a side that is too short is
    padded with zeros first, p//2 before and the rest after. Only stored voxels are kept: the padding is empty."""
    d = attach(vox, volumes.select(CASE, "ny", "nx"), volumes)
    cols = vox.columns
    for i, a in enumerate("yx"):
        pad = F.greatest(F.lit(size) - F.col(f"n{a}"), F.lit(0))
        room = F.greatest(F.col(f"n{a}") - size, F.lit(0)) + 1
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), CASE, "z"), F.lit(1_000_003)) / 1_000_003.0
        start = F.floor(u * room).cast("int") - F.floor(pad / 2).cast("int")
        d = d.withColumn(a, F.col(a) - start).filter((F.col(a) >= 0) & (F.col(a) < size))
    return d.select(*cols)


# --- stacks, tiles and patches ------------------------------------------------------

#: Planes and rows of a block whose slices are stacked at once.
STACK = {"z": 16, "y": 64}


def stack_slices(vox: DataFrame, volumes: DataFrame, edge="repeat") -> DataFrame:
    """Values of planes z-1, z, z+1. "repeat" copies the edge plane, "drop" leaves it out.

    Blocks of planes and rows are stacked on their own; only their first and last planes are sent
    to the block beside as well.
    """
    n = STACK["z"]
    block = F.floor(F.col("z") / n).cast("int")
    beside = F.when(F.col("z") % n == 0, block - 1).when(F.col("z") % n == n - 1, block + 1)
    d = vox.select(*VOXEL, F.col("value").cast("double").alias("value"), block.alias("own"),
                   F.explode(F.array_compact(F.array(block, beside))).alias("bz"),
                   F.floor(F.col("y") / STACK["y"]).cast("int").alias("by"))
    d = d.withColumn("own", F.col("own") == F.col("bz"))
    d = map_groups(d, [CASE, "bz", "by"], arrays.stacked, f"{CASE} string, z int, y int, x int, prev double, cur double, next double")
    # a plane that is not there is NaN in numpy
    d = d.select(*VOXEL, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("prev", "cur", "next")])
    if edge == "drop":
        return d.filter("prev is not null and next is not null")
    return d.withColumn("prev", F.coalesce("prev", "cur")).withColumn("next", F.coalesce("next", "cur"))


def _clamped(step, last):
    return lambda i: F.least(i * step, last)


def _covers(axis, length):
    return lambda start: (start <= F.col(axis)) & (F.col(axis) < start + length)


def tile_starts(volumes: DataFrame, roi, overlap=0.5) -> DataFrame:
    """Window starts per axis: step int(roi * (1 - overlap)), the last one clamped to the end."""
    d = volumes.select(CASE, *SHAPE)
    for a, r in zip(AXES, roi):
        step = max(1, int(r * (1 - overlap)))
        last = F.greatest(F.col(f"n{a}") - r, F.lit(0))
        count = F.ceil(last / step).cast("int")
        steps = F.sequence(F.lit(0), count)
        d = d.withColumn(f"{a}s", F.array_distinct(F.transform(steps, _clamped(step, last))))
    return d.select(CASE, "zs", "ys", "xs")


def tiles(volumes: DataFrame, roi, overlap=0.5) -> DataFrame:
    d = tile_starts(volumes, roi, overlap)
    for a in AXES:
        d = d.withColumn(f"{a}0", F.explode(f"{a}s"))
    d = attach(d.select(CASE, "z0", "y0", "x0"), volumes.select(CASE, *SHAPE), volumes)
    return d.select(CASE, "z0", "y0", "x0", *[
        F.least(F.col(f"{a}0") + r, F.col(f"n{a}")).alias(f"{a}1") for a, r in zip(AXES, roi)])


def tile_voxels(vox: DataFrame, volumes: DataFrame, roi, overlap=0.5) -> DataFrame:
    """Each voxel once per tile that covers it, found by arithmetic: only the shapes are attached, not the start lists."""
    cols = vox.columns
    d = attach(vox, volumes.select(CASE, *[F.col(n).alias(f"_{n}") for n in SHAPE]), volumes)
    for a, r in zip(AXES, roi):
        step = max(1, int(r * (1 - overlap)))
        last = F.greatest(F.col(f"_n{a}") - r, F.lit(0))
        first = F.greatest(F.floor((F.col(a) - r) / step).cast("int"), F.lit(0))
        # one beyond the place: the start that is clamped to the end may lie before it
        final = F.least(F.ceil(last / step), F.floor(F.col(a) / step) + 1).cast("int")
        d = d.withColumn("_i", F.explode(F.sequence(first, F.greatest(first, final))))
        d = d.withColumn(f"{a}0", F.least(F.col("_i") * step, last)).filter(_covers(a, r)(F.col(f"{a}0")))
    return d.select(*cols, "z0", "y0", "x0")


def stitch(tile_scores: DataFrame, classes=(0, 1, 2, 3)) -> DataFrame:
    """Mean logit of the overlapping tiles, then the best class per voxel, in one aggregate."""
    from voxelmill.operators.metrics import best_class
    side = tile_scores.groupBy(*VOXEL).agg(*[F.avg(F.when(F.col("cls") == c, F.col("logit"))).alias(f"l{c}") for c in classes])
    return best_class(side, classes)


def extract_patches(vox: DataFrame, patches: DataFrame) -> DataFrame:
    """Voxels inside each patch in patch-local coordinates.

    Patches are expanded to their z planes, so the join is an equi join on (case, plane).
    """
    planes = patches.withColumn("z", F.explode(F.sequence(F.col("z0"), F.col("z1") - 1)))
    rest = [c for c in vox.columns if c not in VOXEL]
    return (vox.join(planes, [CASE, "z"]).filter("y >= y0 and y < y1 and x >= x0 and x < x1")
            .select(CASE, "patch_id", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in AXES], *rest))


# --- resampling -------------------------------------------------------------------------

def target_grid(shapes: DataFrame) -> DataFrame:
    """Every voxel of shapes(case_id, mz, my, mx): planes are spread before the fan-out.

    Their partitions are a fixed count: by the size of the planes, before their voxels are made, they
    would be merged into a few tasks."""
    d = python_partitions(shapes.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("mz") - 1))), CASE, "z")
    return (d.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("my") - 1)))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("mx") - 1))))


def sample_linear(points: DataFrame, vox: DataFrame) -> DataFrame:
    """Trilinear value at (fz, fy, fx) for each point; voxels outside the grid count 0.

    Points stay where they are made. Voxels are written by plane and looked up.
    """
    return planes.interpolated(points, *planes.save_planes(vox))


def sample_nearest(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Label at the nearest voxel; only points that hit a foreground voxel remain.

    Points are made from a few rows a case, by whose size they would be taken for small and broadcast,
    so the join is told to move both sides."""
    d = points.select(*VOXEL, *[F.bround(f"f{a}", 0).cast("int").alias(f"s{a}") for a in AXES])
    src = labels.select(CASE, *[F.col(a).alias(f"s{a}") for a in AXES], "label")
    return d.join(src.hint("merge"), [CASE, "sz", "sy", "sx"]).select(*VOXEL, "label")


def resize(vox: DataFrame, volumes: DataFrame, size) -> DataFrame:
    """Trilinear resize, cell centres aligned, edges clamped."""
    shapes = volumes.select(CASE, *SHAPE, *[F.lit(s).alias(f"m{a}") for a, s in zip(AXES, size)])
    d = target_grid(shapes)
    for a, s in zip(AXES, size):
        f = (F.col(a) + 0.5) * F.col(f"n{a}") / float(s) - 0.5
        d = d.withColumn(f"f{a}", F.least(F.greatest(f, F.lit(0.0)), F.col(f"n{a}") - 1.0))
    return sample_linear(d, vox)


def _same_grid(volumes, extra=()):
    return target_grid(volumes.select(CASE, *SHAPE, *extra, *[F.col(f"n{a}").alias(f"m{a}") for a in AXES]))


def ray_hits(mask: DataFrame, at: DataFrame, volumes: DataFrame, axis="z") -> DataFrame:
    """On every ray along ``axis`` that meets the mask: the last set voxel before ``at`` (one row per case)
    and the first at or after it, NULL where that side has none."""
    others = [a for a in AXES if a != axis]
    d = attach(mask.select(*VOXEL), at.select(CASE, "at"), volumes)
    here = F.col(axis) < F.col("at")
    return d.groupBy(CASE, *others).agg(F.max(F.when(here, F.col(axis))).alias("before"),
                                        F.min(F.when(~here, F.col(axis))).alias("after"))


def rotate_points(volumes: DataFrame, degrees) -> DataFrame:
    """Source position of every voxel for an in-plane (y, x) turn about the centre."""
    d = _same_grid(volumes)
    t = F.radians(degrees if not isinstance(degrees, (int, float)) else F.lit(float(degrees)))
    cy, cx = (F.col("ny") - 1) / 2.0, (F.col("nx") - 1) / 2.0
    y, x = F.col("y") - cy, F.col("x") - cx
    return (d.withColumn("fz", F.col("z").cast("double"))
            .withColumn("fy", F.cos(t) * y - F.sin(t) * x + cy)
            .withColumn("fx", F.sin(t) * y + F.cos(t) * x + cx))


def rotate(vox: DataFrame, volumes: DataFrame, degrees, mask=False) -> DataFrame:
    pts = rotate_points(volumes, degrees)
    return sample_nearest(pts, vox) if mask else sample_linear(pts, vox)


def affine(image: DataFrame, labels: DataFrame, volumes: DataFrame, params: DataFrame):
    """Image and mask under the same movement (see ``affine_points``): the image linearly, the mask by its nearest
    voxel, zeros (no rows of the mask) outside."""
    points = affine_points(volumes, params)
    return sample_linear(points, image), sample_nearest(points, labels)


def affine_points(volumes: DataFrame, params: DataFrame) -> DataFrame:
    """Source positions for a rotation rz, ry, rx (degrees), shift tz, ty, tx and, if given, a scale per case.

    A scale above 1 enlarges about the centre."""
    scaled = ["scale"] if "scale" in params.columns else []
    # the turns are worked out once a case, not once a voxel
    turns = [f(F.radians(f"r{a}")).alias(f"{n}{a}") for a in AXES for n, f in (("cos_", F.cos), ("sin_", F.sin))]
    params = params.select(CASE, *turns, "tz", "ty", "tx", *scaled)
    d = _same_grid(volumes.join(params, CASE), [c for c in params.columns if c != CASE])
    c = {a: (F.col(f"n{a}") - 1) / 2.0 for a in AXES}
    p = {a: F.col(a) - c[a] - F.col(f"t{a}") for a in AXES}
    for axis, (u, v) in (("z", ("y", "x")), ("y", ("z", "x")), ("x", ("z", "y"))):
        cos, sin = F.col(f"cos_{axis}"), F.col(f"sin_{axis}")
        p[u], p[v] = cos * p[u] + sin * p[v], cos * p[v] - sin * p[u]
    for a in AXES:
        d = d.withColumn(f"f{a}", (p[a] / F.col("scale") if scaled else p[a]) + c[a])
    return d


def random_affine(volumes: DataFrame, seed=42, p=0.5, max_deg=15.0, max_shift=5.0, max_scale=0.0) -> DataFrame:
    """Per-case parameters from the seeded hash of the case id; zeros (scale 1) for unchosen cases.

    With ``max_scale`` there is a scale of 1 - max_scale to 1 + max_scale."""
    def u(i):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), CASE), F.lit(1_000_003)) / 1_000_003.0
    use = u(0) < p
    cols = [F.when(use, (2 * u(i) - 1) * (max_deg if n[0] == "r" else max_shift)).otherwise(0.0).alias(n)
            for i, n in enumerate(("rz", "ry", "rx", "tz", "ty", "tx"), 1)]
    if max_scale:
        cols.append(F.when(use, 1.0 + (2 * u(7) - 1) * max_scale).otherwise(1.0).alias("scale"))
    return volumes.select(CASE, *cols)


def warp(vox: DataFrame, volumes: DataFrame, displacement: DataFrame, mask=False) -> DataFrame:
    """Value at voxel + displacement(case_id, z, y, x, dz, dy, dx); missing entries are 0.

    A mask is joined at its places: both sides of the joins are made from a few rows a case and must not be
    taken for small. An image is read where the displacements are: only the places of the voxels that have one
    are sent to their planes, which add the others. The displacement is read twice."""
    if mask:
        d = _same_grid(volumes).join(displacement.hint("merge"), VOXEL, "left")
        for a in AXES:
            d = d.withColumn(f"f{a}", F.col(a) + F.coalesce(f"d{a}", F.lit(0.0)))
        return sample_nearest(d, vox)
    given = attach(displacement, volumes.select(CASE, *SHAPE), volumes).filter(in_grid())
    given = given.select(*VOXEL, *[(F.col(a) + F.coalesce(f"d{a}", F.lit(0.0))).alias(f"f{a}") for a in AXES])
    here = volumes.select(CASE, F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z"), "ny", "nx", F.lit(True).alias("plane"))
    none = F.lit(0).alias
    every = here.select(CASE, "z", none("y"), none("x"), "ny", "nx", "plane").unionByName(
        displacement.select(*[F.col(c) if c == CASE else F.col(c).cast("int").alias(c) for c in VOXEL],
                            none("ny"), none("nx"), F.lit(False).alias("plane")))
    left = map_groups(every, [CASE, "z"], arrays.uncovered, f"{CASE} string, z int, y int, x int")
    still = left.select(*VOXEL, *[F.col(a).cast("double").alias(f"f{a}") for a in AXES])
    return sample_linear(given.unionByName(still), vox)


def random_flip(df: DataFrame, volumes: DataFrame, p=0.5, seed=42, axis="x") -> DataFrame:
    """Mirror whole samples (case, z plane) with probability p, decided by a seeded hash."""
    cols = df.columns
    d = attach(df, volumes.select(CASE, f"n{axis}"), volumes)
    u = F.pmod(F.xxhash64(F.lit(seed), CASE, "z"), F.lit(1_000_003)) / 1_000_003.0
    return d.withColumn(axis, F.when(u < p, F.col(f"n{axis}") - 1 - F.col(axis)).otherwise(F.col(axis))).select(*cols)


def _affine(name):
    """Columns (as vectors) and origin of a row-major 4x4 array column."""
    a = lambda r, c: F.element_at(name, r * 4 + c + 1)
    return [tuple(a(r, c) for r in range(3)) for c in range(4)]


def resample_nearest(mask: DataFrame, source: DataFrame, reference: DataFrame) -> DataFrame:
    """Mask on the reference grid through both affines, nearest neighbour, outside = background.

    ``source``/``reference``: (case_id, nz, ny, nx, affine array<double> of 16, row-major).
    """
    from voxelmill.functions.scalars import cross, dot
    ref = reference.select(CASE, *[F.col(n).alias("m" + n[1]) for n in SHAPE], F.col("affine").alias("ra"))
    both = ref.join(source.select(CASE, F.col("affine").alias("sa")), CASE)
    rc, sc = _affine("ra"), _affine("sa")
    inverse = (cross(sc[1], sc[2]), cross(sc[2], sc[0]), cross(sc[0], sc[1]))
    # what is the same for all voxels of a case is worked out before they are made
    fixed = {"det": dot(sc[0], cross(sc[1], sc[2]))}
    for r in range(3):
        fixed |= {f"move{r}": rc[3][r], f"from{r}": sc[3][r]}
        for c in range(3):
            fixed |= {f"step{c}{r}": rc[c][r], f"inv{c}{r}": inverse[c][r]}
    d = target_grid(both.select(CASE, "mz", "my", "mx", *[v.alias(k) for k, v in fixed.items()]))
    world = tuple(F.col(f"step0{r}") * F.col("z") + F.col(f"step1{r}") * F.col("y") + F.col(f"step2{r}") * F.col("x")
                  + F.col(f"move{r}") - F.col(f"from{r}") for r in range(3))
    for i, a in enumerate(AXES):
        d = d.withColumn(f"f{a}", dot(tuple(F.col(f"inv{i}{r}") for r in range(3)), world) / F.col("det"))
    return sample_nearest(d, mask)


# Letter -> (world axis, sign) in the R-A-S convention.
AXIS_CODES = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}


def reorient(df: DataFrame, volumes: DataFrame, codes="PIL") -> DataFrame:
    """Permute and flip axes so that they point to ``codes``, read from each affine's
    dominant entry per column. ``volumes`` carries ``affine``."""
    cols = _affine("affine")
    d = volumes.select(CASE, *SHAPE, "affine")
    for a, c in zip(AXES, cols):
        top = F.greatest(*[F.abs(v) for v in c])
        world = F.when(F.abs(c[0]) == top, 0).when(F.abs(c[1]) == top, 1).otherwise(2)
        value = F.when(world == 0, c[0]).when(world == 1, c[1]).otherwise(c[2])
        d = d.withColumn(f"w{a}", world).withColumn(f"g{a}", F.signum(value))
    plan = d.drop("affine")
    out = attach(df, plan, volumes)
    rest = [c for c in df.columns if c not in VOXEL]
    new = []
    for name, code in zip(AXES, codes):
        axis, sign = AXIS_CODES[code]
        v = None
        for a in AXES:
            moved = F.when(F.col(f"g{a}") == sign, F.col(a)).otherwise(F.col(f"n{a}") - 1 - F.col(a))
            v = F.when(F.col(f"w{a}") == axis, moved) if v is None else v.when(F.col(f"w{a}") == axis, moved)
        new.append(v.alias(name))
    return out.select(CASE, *new, *rest)
