"""The study every volume query runs on, derived from the given tables.

Each supplier is a knee: its row sets the grid, spacing, side and tilt, and each of
its line items stamps one voxel ("speck") that changes the intensity, punches holes
in the mask and disturbs the prediction. Work grows with supplier and lineitem.
``SQL`` states the same derivation for the oracle.
"""

from pyspark.sql import DataFrame, functions as F

from voxelmill.functions import scalars as fn
from voxelmill.model import CASE

_studies = {}


class Study:
    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self._volumes = None

    def table(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    @property
    def volumes(self) -> DataFrame:
        if self._volumes is None:
            k = F.col("s_suppkey")
            self._volumes = self.table("supplier").select(
                k.alias("k"), F.concat(F.lit("case_"), fn.zero_padded(k, 6)).alias(CASE),
                (12 + k % 3).cast("int").alias("nz"), (18 + k % 4).cast("int").alias("ny"),
                (14 + k % 3).cast("int").alias("nx"),
                (0.5 + 0.25 * (k % 3)).alias("sz"), (0.5 + 0.25 * (k % 2)).alias("sy"),
                (0.5 + 0.5 * (k % 2)).alias("sx"), (k % 2).cast("int").alias("flip"),
                (F.floor(F.abs("s_acctbal")) % 3).cast("int").alias("tilt"))
        return self._volumes

    def reference(self) -> int:
        """Key of the first case, on whose volume histograms are trained."""
        first = self.volumes.agg(F.min("k")).first()[0]
        if first is None:
            raise ValueError("the study has no case to train histograms on")
        return first

    def slices(self) -> DataFrame:
        """One row per case and z plane, with the specks of that plane as a map.

        Planes and specks are dealt out alike over a fixed number of partitions, so a row moves once."""
        vol = self.volumes
        parts = max(2 * self.spark.sparkContext.defaultParallelism,
                    int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        li = self.table("lineitem").select(
            F.col("l_suppkey").alias("k"), "l_orderkey", "l_partkey", "l_linenumber",
            F.col("l_quantity").cast("bigint").alias("q"))
        specks = (li.join(F.broadcast(vol.select("k", "nz", "ny", "nx")), "k")
                  if self._small() else li.join(vol.select("k", "nz", "ny", "nx"), "k"))
        specks = (specks.select(
            "k", (F.col("l_orderkey") % F.col("nz")).cast("int").alias("z"),
            ((F.col("l_partkey") % F.col("ny")) * F.col("nx")
             + (F.floor(F.col("l_orderkey") / F.col("nz")) + 7 * F.col("l_linenumber"))
             % F.col("nx")).cast("int").alias("p"), "q")
            .repartition(parts, "k", "z").groupBy("k", "z", "p").agg(F.sum("q").cast("int").alias("q"))
            .groupBy("k", "z").agg(F.map_from_entries(F.collect_list(F.struct("p", "q"))).alias("specks")))
        planes = vol.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("nz") - 1))).repartition(parts, "k", "z")
        return planes.join(specks, ["k", "z"], "left")

    def _small(self):
        from voxelmill.model import few
        return few(self.volumes, 48)

    def voxels(self) -> DataFrame:
        """Dense rows (case_id, k, z, y, x, q, label, pred, value)."""
        d = (self.slices()
             .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ny") * F.col("nx") - 1)))
             .withColumn("q", F.element_at("specks", F.col("p")))
             .withColumn("y", F.expr("cast(p div nx as int)"))
             .withColumn("x", F.expr("cast(p % nx as int)")).drop("specks", "p"))
        zz = F.when(F.col("flip") == 1, F.col("nz") - 1 - F.col("z")).otherwise(F.col("z"))
        d = (d.withColumn("zc", zz - F.expr("cast(nz div 2 as int)"))
             .withColumn("xc", F.col("x") - F.expr("cast(nx div 2 as int)"))
             .withColumn("step", F.expr("cast((4 * (y - 6)) div (ny - 12) as int)")))
        femur = F.expr("k % 23 <> 11 and 3*zc*zc + 3*(y-5)*(y-5) + 3*xc*xc <= 130 "
                       "and not (abs(zc) <= 2 and 2*y + xc >= 13 and xc between -3 and 3)")
        tibia = F.expr("k % 19 <> 7 and 48*zc*zc + 9*(4*(y-(ny-3)) + tilt*xc)*(4*(y-(ny-3)) + tilt*xc) + 32*xc*xc <= 1760")
        acl = F.expr("k % 17 <> 5 and y between 6 and ny - 6 "
                     "and (zc + 2 - step)*(zc + 2 - step) + (xc + 2 - step)*(xc + 2 - step) <= 2")
        # generated column: evaluated once, filters above do not copy the expression
        shape = F.when(femur, 2).when(tibia, 3).when(acl, 1).otherwise(0)
        d = d.withColumn("shape", F.explode(F.array(shape)))
        d = d.withColumn("label", F.expr("case when q % 11 = 0 then 0 else shape end"))
        d = d.withColumn("pred", F.expr(
            "case when q % 3 = 0 then 0 when q % 7 = 1 then 1 + q % 3 "
            "when shape = 1 and (z + 2*x) % 7 = 0 then 0 else shape end"))
        d = d.withColumn("value", F.expr(
            "0.5D * (case when shape = 0 and zc*zc + xc*xc > 45 then 0 else "
            "case shape when 1 then 90 + 9*((3*z+5*y+7*x) % 17) when 2 then 160 when 3 then 140 else 10 end "
            "+ (3*z+5*y+7*x) % 17 + coalesce(q, 0) end)"))
        return d.select(CASE, "k", "z", "y", "x", "q", "label", "pred", "value")

    def labels(self) -> DataFrame:
        return self.voxels().filter("label > 0").select(CASE, "z", "y", "x", "label")

    def preds(self) -> DataFrame:
        return (self.voxels().filter("pred > 0")
                .select(CASE, "z", "y", "x", F.col("pred").alias("label")))

    def image(self) -> DataFrame:
        return self.voxels().select(CASE, "z", "y", "x", "value")

    def scores(self) -> DataFrame:
        """Logits of a stand-in network, one row per voxel and class."""
        return (self.voxels().withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(3))))
                .select(CASE, "z", "y", "x", "label", "cls", F.expr(
                    "case when pred = cls then 2.0D else 0.0D end "
                    "+ ((7*z + 3*y + 5*x + 11*cls) % 13) / 8.0D - 0.75D").alias("logit")))


def study(spark, sf) -> Study:
    """One Study per session and folder, so the manifest is counted once."""
    key = (spark.sparkContext.applicationId, id(spark), sf)
    if key not in _studies:
        _studies[key] = Study(spark, sf)
    return _studies[key]


VOLUMES_SQL = """
volumes AS (
  SELECT s_suppkey AS k, 'case_' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS case_id,
         CAST(12 + s_suppkey % 3 AS INTEGER) AS nz, CAST(18 + s_suppkey % 4 AS INTEGER) AS ny,
         CAST(14 + s_suppkey % 3 AS INTEGER) AS nx,
         CAST(0.5 + 0.25 * (s_suppkey % 3) AS DOUBLE) AS sz,
         CAST(0.5 + 0.25 * (s_suppkey % 2) AS DOUBLE) AS sy,
         CAST(0.5 + 0.5 * (s_suppkey % 2) AS DOUBLE) AS sx,
         CAST(s_suppkey % 2 AS INTEGER) AS flip,
         CAST(floor(abs(s_acctbal)) AS BIGINT) % 3 AS tilt
  FROM supplier)"""

VOX_SQL = "WITH RECURSIVE " + VOLUMES_SQL + """,
specks AS (
  SELECT l_suppkey AS k, CAST(l_orderkey % nz AS INTEGER) AS z, CAST(l_partkey % ny AS INTEGER) AS y,
         CAST((l_orderkey // nz + 7 * l_linenumber) % nx AS INTEGER) AS x,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS INTEGER) AS q
  FROM lineitem JOIN volumes ON l_suppkey = k GROUP BY 1, 2, 3, 4),
grid AS (
  SELECT v.*, z, y, x, (CASE WHEN flip = 1 THEN nz - 1 - z ELSE z END) - nz // 2 AS zc,
         x - nx // 2 AS xc, (4 * greatest(y - 6, 0)) // (ny - 12) AS step
  FROM volumes v, (SELECT CAST(range AS INTEGER) AS z FROM range(14)),
       (SELECT CAST(range AS INTEGER) AS y FROM range(21)), (SELECT CAST(range AS INTEGER) AS x FROM range(16))
  WHERE z < nz AND y < ny AND x < nx),
shaped AS (
  SELECT g.*, s.q, CASE
      WHEN g.k % 23 <> 11 AND 3*zc*zc + 3*(g.y-5)*(g.y-5) + 3*xc*xc <= 130
           AND NOT (abs(zc) <= 2 AND 2*g.y + xc >= 13 AND xc BETWEEN -3 AND 3) THEN 2
      WHEN g.k % 19 <> 7 AND 48*zc*zc + 9*(4*(g.y-(ny-3)) + tilt*xc)*(4*(g.y-(ny-3)) + tilt*xc) + 32*xc*xc <= 1760 THEN 3
      WHEN g.k % 17 <> 5 AND g.y BETWEEN 6 AND ny - 6
           AND (zc + 2 - step)*(zc + 2 - step) + (xc + 2 - step)*(xc + 2 - step) <= 2 THEN 1
      ELSE 0 END AS shape
  FROM grid g LEFT JOIN specks s ON g.k = s.k AND g.z = s.z AND g.y = s.y AND g.x = s.x),
vox AS MATERIALIZED (
  SELECT case_id, k, z, y, x, q,
    CASE WHEN q % 11 = 0 THEN 0 ELSE shape END AS label,
    CASE WHEN q % 3 = 0 THEN 0 WHEN q % 7 = 1 THEN 1 + q % 3
         WHEN shape = 1 AND (z + 2*x) % 7 = 0 THEN 0 ELSE shape END AS pred,
    CAST(0.5 AS DOUBLE) * (CASE WHEN shape = 0 AND zc*zc + xc*xc > 45 THEN 0 ELSE
      CASE shape WHEN 1 THEN 90 + 9*((3*z+5*y+7*x) % 17) WHEN 2 THEN 160 WHEN 3 THEN 140 ELSE 10 END
      + (3*z+5*y+7*x) % 17 + coalesce(q, 0) END) AS value
  FROM shaped),
labels AS (SELECT case_id, z, y, x, label FROM vox WHERE label > 0),
preds AS (SELECT case_id, z, y, x, pred AS label FROM vox WHERE pred > 0),
scores AS (
  SELECT case_id, z, y, x, label, cls, CASE WHEN pred = cls THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
    + ((7*z + 3*y + 5*x + 11*cls) % 13) / CAST(8.0 AS DOUBLE) - CAST(0.75 AS DOUBLE) AS logit
  FROM vox, (SELECT CAST(range AS INTEGER) AS cls FROM range(4)))
"""


def vox_sql(body):
    return VOX_SQL + body


def vox_ctes(*ctes, select):
    return VOX_SQL + "".join(",\n" + c for c in ctes) + "\n" + select
