"""Connected components of an edge table, without ever holding one component in a task."""

from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import written


def _star(edges: DataFrame, small) -> DataFrame:
    """Hang the neighbours of every node on the least node it sees.

    The large star moves neighbours greater than the node, the small star the node itself and its
    lesser neighbours. Only per-node minima are aggregated. They are written, so that the join shuffles
    both its sides anew and a node with very many neighbours can be split between tasks.
    """
    both = edges if small else edges.union(edges.select("b", "a"))
    least = written(both.groupBy("a").agg(F.min("b").alias("_m")).select(
        F.col("a").alias("_u"), F.least("a", "_m").alias("_m")), "least")
    seen = both.join(least, both["a"] == least["_u"])
    if small:
        moved = seen.filter("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        own = least.select(F.col("_u").alias("a"), F.col("_m").alias("b"))
        return moved.union(own).filter("a > b").distinct()
    return seen.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; the root is the least node of the component.

    Loops and repeated edges do no harm; a null end drops the edge; no edges give no rows. Each
    round is written to the shared folder. The rounds needed grow with the logarithm of the size.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.filter("a > b").distinct(), "edges")
    before = None
    while True:
        digest = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before:
            break
        before = digest
        edges = written(_star(written(_star(edges, False), "edges"), True), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
