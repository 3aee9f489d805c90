"""Table shapes and the distribution helpers every operator builds on.

Tables:
  volumes(case_id, nz, ny, nx, sz, sy, sx)      one row per case, spacing in mm
  voxels(case_id, z, y, x, value)               dense intensities
  labels(case_id, z, y, x, label)               sparse, background rows omitted

Axes: z = dim0 (right-left), y = dim1 (superior first), x = dim2 (antero-posterior).

One case may hold a third of all voxels, so nothing here groups, sorts or
collects a whole case in one task: aggregates combine map-side, ordered work
runs inside bounded pieces (a plane, a ray, a hash bucket) and joins the small
per-piece totals back.
"""

import weakref

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxelmill.session import ensure_checkpoint_dir

CASE = "case_id"
AXES = ["z", "y", "x"]
VOXEL = [CASE, *AXES]

#: Cases at most, and bytes of their rows, that are broadcast.
BROADCAST_CASES, BROADCAST_BYTES = 2_000_000, 128 << 20
SALTS = 32

_case_counts = weakref.WeakKeyDictionary()


def case_count(volumes: DataFrame) -> int:
    """Rows of the manifest, counted once (parquet answers from its footers)."""
    if volumes not in _case_counts:
        _case_counts[volumes] = volumes.count()
    return _case_counts[volumes]


def _row_bytes(schema) -> int:
    """About the bytes of a row in memory; a list counts as sixteen numbers."""
    return 16 + sum({"string": 24, "array": 144}.get(f.dataType.typeName(), 8) for f in schema.fields)


def few(volumes: DataFrame, row_bytes) -> bool:
    """Whether rows of such a size, one a case, may be broadcast."""
    cases = case_count(volumes)
    return cases <= BROADCAST_CASES and cases * row_bytes <= BROADCAST_BYTES


def attach(rows: DataFrame, params: DataFrame, volumes: DataFrame = None,
           how="inner", on=(CASE,)) -> DataFrame:
    """Join one-row-per-case ``params`` onto voxel rows.

    The manifest count proves the size of ``params``: up to BROADCAST_CASES cases and BROADCAST_BYTES
    they are broadcast and the voxels do not move. Beyond that the join is salted,
    so a case with very many voxels spreads over SALTS tasks. The salted table is SALTS times what its
    statistics say, so it must not be broadcast by them.
    """
    on = list(on)
    if volumes is not None and few(volumes, _row_bytes(params.schema)):
        return rows.join(F.broadcast(params), on, how)
    spread = [c for c in rows.columns if c not in on] or on
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(SALTS)))
    return out.join(salted.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def python_partitions(df: DataFrame, *keys) -> DataFrame:
    """Hash partitions for a Python stage or a fan-out: a fixed count, so that small but costly groups
    are not coalesced into one task."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def expand_offsets(df: DataFrame, offsets, sign=1) -> DataFrame:
    """One row per voxel and neighbour offset; the literal offset table never grows."""
    arr = F.array(*[F.struct(*[F.lit(int(v)).alias(n) for v, n in zip(o, ("dz", "dy", "dx"))])
                    for o in offsets])
    rest = [c for c in df.columns if c not in AXES]
    return (df.withColumn("_o", F.explode(arr))
            .select(*rest, *[(F.col(a) + sign * F.col(f"_o.d{a}")).cast("int").alias(a) for a in AXES]))


def in_grid() -> Column:
    return ((F.col("z") >= 0) & (F.col("z") < F.col("nz")) & (F.col("y") >= 0)
            & (F.col("y") < F.col("ny")) & (F.col("x") >= 0) & (F.col("x") < F.col("nx")))


def clip_to_grid(df: DataFrame, volumes: DataFrame) -> DataFrame:
    cols = df.columns
    shape = volumes.select(CASE, "nz", "ny", "nx")
    return attach(df, shape, volumes).filter(in_grid()).select(*cols)


#: Cells per doubling of the magnitude in the first histogram, and equal cells between the ends of one of those.
PER_OCTAVE, BETWEEN = 64, 4096


def _magnitude_cell(v) -> Column:
    """Number of a cell that grows with the value: by the logarithm of its magnitude, mirrored below zero."""
    far = 70_000  # beyond every finite logarithm times PER_OCTAVE
    size = F.least(F.greatest(F.floor(F.log2(F.abs(v)) * PER_OCTAVE), F.lit(-far)), F.lit(far)) + F.lit(far + 1)
    return F.when(F.isnan(v), 3 * far).when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")


def _cells(rows, keys, cell):
    """Histogram with the extremes of each cell; only this is shuffled."""
    return rows.groupBy(*keys, cell.alias("_c")).agg(F.sum("_n").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))


def _holding(hist, want, keys):
    """For each wanted rank the cell that holds it: its extremes and the number of values before it."""
    upto = F.sum("_m").over(W.partitionBy(*keys).orderBy("_c"))
    found = hist.withColumn("_upto", upto).join(want, keys)
    before = F.col("_start") + F.col("_upto") - F.col("_m")
    return found.filter((F.col("_rank") >= before) & (F.col("_rank") < before + F.col("_m"))).withColumn("_start", before)


def exact_quantiles(df: DataFrame, by, value, probs, volumes: DataFrame = None) -> DataFrame:
    """Exact linear-interpolated quantiles, long form (by..., prob, q).

    Ranks are selected by histograms, from coarse to fine: cells by magnitude; in those that hold a
    wanted rank equal cells between their extremes; in those of them the values themselves. A cell of
    one value settles its ranks at once, and rounds end when all are settled. Only counts are shuffled;
    what is written after a round is two rows a probability and group. The rows are read once a round.
    Where the manifest ``volumes`` proves the groups (cases) few, the wanted cells are broadcast to the
    rows. Without it values are counted first and the cells joined salted. No task ever sees all values
    of a group.
    """
    by = list(by)
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    # two cells a probability at most
    if volumes is not None and few(volumes, 64 + 48 * len(probs)):
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    else:
        volumes = None
        rows = rows.groupBy(*by, "_v").agg(F.count("*").alias("_n"))

    def inside(open_):
        """The rows in cells that are not settled, with the extremes of their cell; two cells a probability at most."""
        cells = open_.groupBy(*by).agg(F.collect_set(F.struct("_low", "_high")).alias("_open"))
        near = rows.join(F.broadcast(cells), by) if volumes is not None else attach(rows, cells, on=by)
        return near.select(*by, "_v", "_n", F.inline(F.filter("_open", lambda c: F.col("_v").between(c["_low"], c["_high"]))))

    first = _cells(rows, by, _magnitude_cell(F.col("_v"))).withColumn("_total", F.sum("_m").over(W.partitionBy(*by)))
    pos = F.col("prob") * (F.col("_total") - 1)
    upto = F.sum("_m").over(W.partitionBy(*by).orderBy("_c"))
    ranked = first.withColumn("_upto", upto).select(
        "*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).select(
        "*", pos.alias("_pos"), F.posexplode(F.array(F.floor(pos), F.ceil(pos))).alias("_end", "_rank"))
    start = F.col("_upto") - F.col("_m")
    keep = [*by, "prob", "_pos", "_end", "_rank"]
    found = ranked.filter((F.col("_rank") >= start) & (F.col("_rank") < F.col("_upto"))).select(
        *keep, "_low", "_high", start.alias("_start")).checkpoint()
    one = F.col("_low") == F.col("_high")
    settled = found.filter(one).select(*keep, F.col("_low").alias("_q"))
    for last in (False, True):
        left = found.filter(~one)
        if left.isEmpty():
            break
        # the cells left open are keys of the next round
        names, key = {"_low": "_l", "_high": "_h"}, [*by, "_l", "_h"]
        near, left = inside(left).withColumnsRenamed(names), left.withColumnsRenamed(names)
        at = F.col("_v") if last else F.floor((F.col("_v") - F.col("_l")) / (F.col("_h") - F.col("_l")) * BETWEEN)
        found = _holding(_cells(near, key, at), left, key).select(*keep, "_low", "_high", "_start").checkpoint()
        settled = settled.unionByName(found.filter(one).select(*keep, F.col("_low").alias("_q")))
    ends = settled.groupBy(*by, "prob").agg(F.first("_pos").alias("_pos"), *[
        F.max(F.when(F.col("_end") == e, F.col("_q"))).alias(f"_q{e}") for e in (0, 1)])
    return ends.select(*by, "prob", (F.col("_q0") + (F.col("_q1") - F.col("_q0"))
                                     * (F.col("_pos") - F.floor("_pos"))).alias("q"))


def wide_quantiles(df, by, value, names_probs, volumes: DataFrame = None) -> DataFrame:
    """One row per group with a column per quantile."""
    probs = [p for _, p in names_probs]
    long = exact_quantiles(df, by, value, probs, volumes)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == float(p), F.col("q"))).alias(n)
                                   for n, p in names_probs])


def bucket_rank(df: DataFrame, by, bucket, order, name="rank") -> DataFrame:
    """1-based rank within ``by`` ordered by (bucket, order...).

    Buckets carry the order and bound the sort: counts per bucket are accumulated,
    rows are only ordered inside their own bucket.
    """
    by = list(by)
    rows = df.withColumn("_b", bucket if isinstance(bucket, Column) else F.col(bucket))
    totals = rows.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(
        W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "_b", before.alias("_before"))
    local = F.row_number().over(W.partitionBy(*by, "_b").orderBy(*order))
    return (rows.withColumn("_local", local).join(totals, [*by, "_b"])
            .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
            .drop("_b", "_local", "_before"))


def shuffled_rank(df: DataFrame, by, key, seed, name="rank", per_bucket=20_000) -> DataFrame:
    """Rank in seeded-hash order: even buckets whatever the key looks like, as many as the rows need."""
    h = F.xxhash64(F.lit(int(seed)), F.col(key))
    bits = max(1, (df.count() // per_bucket).bit_length())
    ranked = bucket_rank(df.withColumn("_h", h), by, F.shiftrightunsigned("_h", 64 - bits),
                         ["_h", key], name)
    return ranked.drop("_h")


def global_rank(df: DataFrame, order, name="rank") -> DataFrame:
    """1-based rank over the whole table in the given order, without one sorting task.

    Rows are range-partitioned and written once (checkpoint), so the split points
    cannot change if an executor is lost; per-partition counts give the offsets.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranged = (df.repartitionByRange(*[F.col(c) for c in order])
              .sortWithinPartitions(*order)
              .withColumn("_id", F.monotonically_increasing_id())
              .checkpoint())
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)),
                        F.lit(0))
    # one row per shuffle partition: bounded by the partition count
    sizes = sizes.select("_p", before.alias("_before"))
    return (ranged.withColumn("_p", part).join(F.broadcast(sizes), "_p")
            .withColumn(name, F.col("_before") + F.col("_id") % F.lit(1 << 33) + 1)
            .drop("_p", "_id", "_before"))


PREFIX_BLOCK = 4096


def running(df: DataFrame, by, order, specs, block=PREFIX_BLOCK) -> DataFrame:
    """Running aggregates along an integer ``order`` column within ``by``.

    ``specs``: name -> (agg, column, inclusive) with agg in max, min, sum. Blocks of
    ``block`` order values are scanned on their own and the per-block totals carried
    over, so one long run does not end up in one task.
    """
    by = list(by)
    fn = {"max": F.max, "min": F.min, "sum": F.sum}
    rows = df.withColumn("_blk", F.floor(F.col(order) / block))
    totals = rows.groupBy(*by, "_blk").agg(*[fn[a](c).alias(f"_t_{n}")
                                             for n, (a, c, _) in specs.items()])
    prior = W.partitionBy(*by).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_blk", *[fn[a](f"_t_{n}").over(prior).alias(f"_c_{n}")
                                          for n, (a, _, _) in specs.items()])
    local = W.partitionBy(*by, "_blk").orderBy(order)
    upto, before = (local.rowsBetween(W.unboundedPreceding, e) for e in (0, -1))
    rows = rows.join(totals, [*by, "_blk"])
    for n, (a, c, inclusive) in specs.items():
        here, carried = fn[a](c).over(upto if inclusive else before), F.col(f"_c_{n}")
        joined = {"max": F.greatest, "min": F.least}.get(a)
        value = joined(here, carried) if joined else (
            F.when(here.isNull() & carried.isNull(), None)
            .otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))))
        rows = rows.withColumn(n, value)
    return rows.drop("_blk", *[f"_c_{n}" for n in specs])
