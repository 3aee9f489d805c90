"""Dilation, closing, surfaces, components, distances and mask clean-up.

Masks are sparse (case_id, label, z, y, x); every operator works per (case, label).
"""

from pyspark.sql import DataFrame, functions as F

from voxelmill.functions import arrays
from voxelmill.functions.grouped import map_groups
from voxelmill.model import CASE, VOXEL, attach, clip_to_grid, ensure_checkpoint_dir, expand_offsets
from voxelmill.session import stored

KEYS = [CASE, "label", "z", "y", "x"]
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def diamond(n):
    """Offsets reached by n dilations with the 6-connected element (25 for n = 2)."""
    r = range(-n, n + 1)
    return [(a, b, c) for a in r for b in r for c in r if abs(a) + abs(b) + abs(c) <= n]


BOX = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


#: Planes and rows of a block whose surface or dilation is taken at once.
SHELL = {"z": 16, "y": 64}


def _by_blocks(mask: DataFrame, volumes: DataFrame, n, fn) -> DataFrame:
    """``fn(name -> array)`` on blocks of planes and rows: a voxel goes to every block within ``n`` voxels of it."""
    d = attach(mask.select(*KEYS), volumes.select(CASE, "nz", "ny", "nx"), volumes)
    for a, size in SHELL.items():
        ends = F.greatest(F.col(a) - n, F.lit(0)), F.least(F.col(a) + n, F.col(f"n{a}") - 1)
        d = d.withColumn(f"b{a}", F.explode(F.sequence(*[F.floor(e / size).cast("int") for e in ends])))
    # the block is wanted inside as well, not only as a key
    d = d.withColumns({"kz": F.col("bz"), "ky": F.col("by")})
    return map_groups(d, [CASE, "label", "kz", "ky"], fn, f"{CASE} string, label int, z int, y int, x int").select(*KEYS)


def dilate(mask: DataFrame, volumes: DataFrame, n=1) -> DataFrame:
    """Voxels within n face steps of the mask, by blocks: a voxel goes to every block that it may grow into."""
    size = dict(SHELL)
    return _by_blocks(mask, volumes, n, lambda at: arrays.grown(at, n, size))


def neighbours(mask: DataFrame, offsets, volumes: DataFrame) -> DataFrame:
    """Every voxel paired with each neighbour position inside the grid."""
    kept = mask.select(*KEYS, *[F.col(a).alias(f"from_{a}") for a in "zyx"])
    return clip_to_grid(expand_offsets(kept, offsets), volumes)


def contact(labels: DataFrame, volumes: DataFrame, source=1, bones=(2, 3), n=2) -> DataFrame:
    """Bone voxels within n dilation steps of the source class.

    Bones are first cut to the source's bounding box, so only a thin shell is shuffled.
    """
    src = labels.filter(F.col("label") == source)
    box = src.groupBy(CASE).agg(*[f(a).alias(f"{a}{s}") for a in "zyx"
                                  for f, s in ((F.min, 0), (F.max, 1))])
    near = labels.filter(F.col("label").isin(list(bones)))
    near = attach(near, box, volumes)
    for a in "zyx":
        near = near.filter(F.col(a).between(F.col(f"{a}0") - n, F.col(f"{a}1") + n))
    reach = expand_offsets(src.select(*VOXEL), diamond(n)).distinct()
    return near.select(*KEYS).join(reach, VOXEL, "left_semi")


def close3(mask: DataFrame, volumes: DataFrame) -> DataFrame:
    """Closing with the full 3x3x3 element; outside the grid counts as empty.

    Blocks of planes and rows are closed on their own, with the voxels up to two places around them:
    a voxel is sent once, and again for each other block so near.
    """
    size = dict(SHELL)
    return _by_blocks(mask, volumes, 2, lambda at: arrays.closed(at, size))


def surface(mask: DataFrame) -> DataFrame:
    """Voxels with at least one face neighbour outside the mask.

    Blocks of planes and rows are judged on their own, with the voxels next to them in the
    neighbouring blocks: a voxel is sent once, and once more for each block face it lies at.
    """
    d = mask.select(*KEYS)
    here = [F.floor(F.col(a) / n).cast("int").alias(f"b{a}") for a, n in SHELL.items()]
    step = lambda a: F.when(F.col(a) % SHELL[a] == 0, -1).when(F.col(a) % SHELL[a] == SHELL[a] - 1, 1)
    places = [F.struct(F.lit(0).alias("z"), F.lit(0).alias("y"), F.lit(True).alias("own"))]
    for a in SHELL:
        beside = [F.coalesce(step(a), F.lit(0)).alias(a) if k == a else F.lit(0).alias(k) for k in SHELL]
        places.append(F.when(step(a).isNotNull(), F.struct(*beside, F.lit(False).alias("own"))))
    sent = d.select("*", *here, F.explode(F.array_compact(F.array(*places))).alias("to")).select(
        *KEYS, F.col("to.own").alias("own"), *[(F.col(f"b{a}") + F.col(f"to.{a}")).alias(f"b{a}") for a in SHELL])
    out = map_groups(sent, [CASE, "label", "bz", "by"], arrays.shell,
                     f"{CASE} string, label int, z int, y int, x int")
    return out.select(*KEYS)


# --- components ---------------------------------------------------------------

def components(mask: DataFrame, volumes: DataFrame, block=16, rows=64) -> DataFrame:
    """6-connected components per case and class, named by the smallest linear index.

    Blocks of ``block`` z planes and ``rows`` lines are labelled on their own; only the pairs of block
    components that touch across a block face are merged iteratively. Their names are joined back
    salted: one component may hold most voxels.
    """
    ensure_checkpoint_dir(mask.sparkSession)
    lin = ((F.col("z").cast("long") * F.col("ny") + F.col("y")) * F.col("nx") + F.col("x"))
    size = {"z": block, "y": rows}
    d = (attach(mask.select(*KEYS), volumes.select(CASE, "ny", "nx"), volumes).withColumn("lin", lin)
         .withColumns({f"b{a}": F.floor(F.col(a) / n) for a, n in size.items()}))
    local = stored(map_groups(d, [CASE, "label", "bz", "by"], arrays.label_block,
                              f"{CASE} string, label int, z int, y int, x int, comp long").select(*KEYS, "comp"), "blocks")
    edges = None
    for a, n in size.items():
        low = local.filter(F.col(a) % n == n - 1).withColumn(a, F.col(a) + 1).withColumnRenamed("comp", "a")
        high = local.filter(F.col(a) % n == 0).withColumnRenamed("comp", "b")
        touching = low.join(high, KEYS).select(CASE, "label", "a", "b").distinct()
        edges = touching if edges is None else edges.unionByName(touching)
    roots = merge_labels(edges)
    if roots is None:
        return local
    return (attach(local, roots, how="left", on=(CASE, "label", "comp"))
            .select(*KEYS, F.coalesce("root", "comp").alias("comp")))


def merge_labels(edges: DataFrame):
    """Smallest label reachable over ``edges`` (case_id, label, a, b); None without edges."""
    key = [CASE, "label"]
    both = edges.unionByName(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    if both.isEmpty():
        return None
    roots = both.groupBy(*key, F.col("a").alias("comp")).agg(
        F.least(F.first("a"), F.min("b")).alias("root")).checkpoint()
    while True:
        seen = both.join(roots.select(*key, F.col("comp").alias("b"), "root"), [*key, "b"])
        best = seen.groupBy(*key, F.col("a").alias("comp")).agg(F.min("root").alias("_m"))
        hooked = roots.join(best, [*key, "comp"]).select(
            *key, "comp", F.col("root").alias("_old"), F.least("root", "_m").alias("root"))
        up = hooked.select(*key, F.col("comp").alias("root"), F.col("root").alias("_up"))
        jumped = hooked.join(up, [*key, "root"], "left").select(
            *key, "comp", "_old", F.coalesce("_up", "root").alias("root")).checkpoint()
        roots = jumped.drop("_old")
        if jumped.filter("root <> _old").isEmpty():
            return roots


def largest_component(comps: DataFrame) -> DataFrame:
    """Biggest component per case and class; ties go to the earliest first voxel."""
    sizes = comps.groupBy(CASE, "label", "comp").agg(F.count("*").alias("size"))
    best = sizes.groupBy(CASE, "label").agg(
        F.min_by(F.struct("comp", "size"), F.struct((-F.col("size")).alias("s"), "comp")).alias("b"))
    return best.select(CASE, "label", "b.comp", "b.size")


def overlay(classes: DataFrame) -> DataFrame:
    """Later classes overwrite earlier ones: the highest class id wins per voxel."""
    return classes.groupBy(*VOXEL).agg(F.max("label").alias("label"))


def clean_mask(pred: DataFrame, volumes: DataFrame, classes=(1, 2, 3), block=16) -> DataFrame:
    """Per class: close, keep the largest component, overlay in class order."""
    closed = close3(pred.filter(F.col("label").isin(list(classes))), volumes)
    comps = components(closed, volumes, block)
    best = largest_component(comps).select(CASE, "label", F.col("comp").alias("_best"))
    kept = attach(comps, best, volumes, on=(CASE, "label")).filter("comp = _best")
    return overlay(kept.select(*KEYS))


def clean_binary(pred: DataFrame, volumes: DataFrame, block=16) -> DataFrame:
    """One-class variant; a case whose closing is empty keeps its input mask."""
    one = pred.select(*VOXEL).withColumn("label", F.lit(1))
    cleaned = clean_mask(one, volumes, (1,), block)
    done = cleaned.select(CASE).distinct().withColumn("_done", F.lit(1))
    untouched = attach(one, done, volumes, "left").filter("_done is null").drop("_done")
    return cleaned.unionByName(untouched.select(*cleaned.columns))


# --- distances ------------------------------------------------------------------

def nearest_distance(a: DataFrame, b: DataFrame, volumes: DataFrame, spacing=True) -> DataFrame:
    """Euclidean distance from each voxel of ``a`` to the nearest voxel of ``b`` with the
    same case and label; NULL where ``b`` is empty.

    An exact separable distance transform: first inside each z plane, then along z for
    the y planes that hold queries. Both passes work on blocks of at most BLOCK_CELLS
    cells (or one plane), whatever the size of the case, and emit no voxel pairs.
    """
    sp = {c: F.col(f"s{c}") if spacing else F.lit(1.0) for c in "zyx"}
    grid = volumes.select(CASE, "nz", "ny", "nx", *[sp[c].cast("double").alias(f"d{c}") for c in "zyx"])
    group = lambda axis, cells: F.expr(
        f"cast({axis} div greatest(1, {arrays.BLOCK_CELLS} div ({cells})) as int)")
    bz = attach(b.select(*KEYS), grid, volumes).withColumn("blk", group("z", "ny * nx"))
    keys = (CASE, "label", "blk")
    rows = map_groups(bz, keys, arrays.plane_distance, f"{CASE} string, label int, z int, y int, g array<double>")
    side = grid.select(CASE, "nz", "nx", "dz")
    far = attach(rows, side, volumes).select(CASE, "label", "z", "y", F.lit(0).alias("x"), "nz", "nx", "dz", "g",
                                             F.lit(False).alias("point"), group("y", "nz * nx").alias("blk"))
    near = attach(a.select(*KEYS), side, volumes).select(
        CASE, "label", "z", "y", "x", "nz", "nx", "dz", F.array().cast("array<double>").alias("g"),
        F.lit(True).alias("point"), group("y", "nz * nx").alias("blk"))
    out = map_groups(near.unionByName(far), keys, arrays.column_distance,
                     f"{CASE} string, label int, z int, y int, x int, dist double")
    return out.withColumn("dist", F.when(~F.isnan("dist"), F.col("dist")))
