"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample, every vector is then indexed under its leaf. A query walks
the tree with a priority queue: the closest node is opened first, and leaves come out in the order
in which they are worth visiting. How many are visited is calibrated: for a few queries the true
neighbours are found by brute force, and visits widen until the wanted share of them is reached.
Queries meet vectors leaf by leaf; a full leaf is cut into blocks of vectors and of queries. The
sample also bounds the distance of a query's k-th neighbour from above, so that leaves return no
vectors that cannot be among the nearest.
"""

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxelmill.llm.common import record_batch, written
from voxelmill.llm.minhash import run_bounds, runs

BRANCH = 8
#: Vectors the tree is fitted on, at most; vectors of a leaf on average; leaves at most.
SAMPLE, LEAF, LEAVES = 20_000, 100, 4_096
#: Queries whose true neighbours are computed, and the share of them that visits must reach.
CALIBRATION, RECALL = 100, 0.97
#: Vectors, and queries, that meet in one task.
BLOCK = 4_096


@dataclass
class Tree:
    centre: np.ndarray      # one row a node, the root first
    children: list          # node -> its child nodes, empty for a leaf
    leaf: np.ndarray        # node -> leaf number or -1
    points: np.ndarray      # the distinct vectors of the sample

    def bound(self, x, k):
        """For each row, itself perhaps in the sample, a square distance within which k others lie."""
        if len(self.points) <= k:
            return np.full(len(x), np.inf)
        out = [np.partition(_squares(x[i:i + 256], self.points), k, axis=1)[:, k] for i in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros(0)

    @property
    def leaves(self):
        return int(self.leaf.max()) + 1

    def assign(self, x):
        """Leaf of each row, going to the nearest child at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = _squares(x[rows], self.centre[kids]).argmin(1)
            todo += [(int(k), rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def best_first(self, x, visits, sizes=None, least=0):
        """For each row its first ``visits`` leaves in best-bin-first order, more if these hold too few vectors."""
        far = _squares(x, self.centre)
        for d in far:
            queue, found, held = [(d[0], 0)], [], 0
            while queue and (len(found) < visits or held < least):
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for k in self.children[node]:
                        heapq.heappush(queue, (d[k], k))
                else:
                    found.append(int(self.leaf[node]))
                    held += sizes[found[-1]] if least else 0
            yield found


def _squares(x, y):
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def fit_tree(x, leaves, branch=BRANCH, rounds=8, seed=7) -> Tree:
    """Splits the sample by k-means, always the fullest node, until there are ``leaves`` leaves."""
    rng = np.random.default_rng(seed)
    centre, children, count = [x.mean(0)], [[]], 1
    heap = [(-len(x), 0, np.arange(len(x)))]
    while heap and count < leaves:
        _, node, rows = heapq.heappop(heap)
        own = x[rows]
        distinct = np.unique(own, axis=0) if len(own) <= 4 * branch else own
        k = min(branch, len(distinct), leaves - count + 1)
        if k < 2:
            continue
        c = own[rng.choice(len(own), k, replace=False)]
        for _ in range(rounds):
            near = _squares(own, c).argmin(1)
            for j in range(k):
                if (near == j).any():
                    c[j] = own[near == j].mean(0)
        near = _squares(own, c).argmin(1)
        parts = [rows[near == j] for j in range(k)]
        if sum(len(p) > 0 for p in parts) < 2:
            continue
        for j, p in enumerate(parts):
            if len(p):
                centre.append(c[j])
                children.append([])
                children[node].append(len(centre) - 1)
                heapq.heappush(heap, (-len(p), len(centre) - 1, p))
        count += len(children[node]) - 1
    leaf = np.full(len(centre), -1)
    ends = [i for i, kids in enumerate(children) if not kids]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centre), children, leaf, x)


def _matrix(column, dim):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(q, q_uid, x, x_uid, x_id, k, bound=None):
    """(query row, vector row, distance) of the k nearest, up to a square distance ``bound`` for each query.

    Distances are exact, ties go to smaller ids.
    """
    out = []
    for i in range(0, len(q), 256):
        far = _squares(q[i:i + 256], x)
        far[q_uid[i:i + 256, None] == x_uid[None]] = np.inf
        kth = np.partition(far, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        if bound is not None:
            kth = np.minimum(kth, bound[i:i + 256])
        slack = 1e-9 * (1 + (q[i:i + 256] ** 2).sum(1) + np.minimum(kth, 1e300))
        for j in range(len(far)):
            near = np.flatnonzero((far[j] <= kth[j] + slack[j]) & np.isfinite(far[j]))
            exact = np.sqrt(((x[near] - q[i + j]) ** 2).sum(1))
            first = np.lexsort((x_uid[near], x_id[near], exact))[:k]
            out += [(i + j, near[f], exact[f]) for f in first]
    return out


def usable(vector) -> Column:
    """Not null, not empty, not zero, every component finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, query: Column, vec_id="vec_id", vector="embedding", k=10, recall=RECALL,
           sample=SAMPLE, leaf=LEAF) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row where ``query`` holds.

    score is the Euclidean distance in double precision; ties go to the smaller id. Candidates are all
    rows but the query's own, repeated ids and equal vectors included. Unusable vectors take no part,
    nor do those of another length than most. A repeated query row is a query of its own. Null ids
    are candidates, never queries. Fewer candidates than ``k`` are all returned.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          F.coalesce(query & F.col(vec_id).isNotNull(), F.lit(False)).alias("q")).filter(usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths["d"], lengths["n"]
    rows = rows.filter(F.size("v") == dim)
    draw = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / float(1 << 30)
    # a sample of the distinct vectors: one very frequent vector must not be all the tree sees
    drawn = rows.filter(draw < 1.2 * sample / n).select("v").limit(sample).toPandas()
    points = np.unique(np.array(drawn["v"].tolist(), float).reshape(-1, dim), axis=0)
    if not len(points):
        points = np.array([rows.first()["v"]])
    tree = fit_tree(points, int(min(LEAVES, max(1, n // leaf), max(1, len(points) // 4))))
    sent = spark.sparkContext.broadcast(tree)

    def index(batches):
        for b in batches:
            x = _matrix(b.column("v"), dim)
            yield record_batch(id=b.column("id"), v=b.column("v"), q=b.column("q"), leaf=sent.value.assign(x))
    indexed = written(rows.mapInArrow(index, f"id {id_type}, v array<double>, q boolean, leaf long")
                      .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    visits = _calibrated(indexed, tree, dim, k, recall)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).toLocalIterator():  # at most a row a leaf
        sizes[r["leaf"]] = r["n"]

    def walk(batches):
        for b in batches:
            x = _matrix(b.column("v"), dim)
            found = []
            for order, most in zip(sent.value.best_first(x, visits, sizes, k + 1), sent.value.bound(x, k).tolist()):
                # the first leaves return k vectors whatever their distance, so that none is missing
                before = np.cumsum(sizes[order]) - sizes[order]
                found.append([{"leaf": f, "bound": np.inf if held <= k else most} for f, held in zip(order, before.tolist())])
            yield record_batch(id=b.column("id"), uid=b.column("uid"), v=b.column("v"), leaves=pa.array(
                found, pa.list_(pa.struct([("leaf", pa.int64()), ("bound", pa.float64())]))))
    walked = written(indexed.filter("q").select("id", "uid", "v").mapInArrow(
        walk, f"id {id_type}, uid long, v array<double>, leaves array<struct<leaf:long,bound:double>>"), "queries")
    asked = walked.select("id", "uid", "v", F.explode("leaves").alias("_to")).select("id", "uid", "v", "_to.*")
    # at most one row a leaf: how many blocks its vectors and its queries are cut into
    load = (indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("vb"))
            .join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("qb")), "leaf"))
    load = F.broadcast(load)
    mine = indexed.join(load, "leaf").select(
        F.lit(False).alias("ask"), "id", "uid", "v", F.lit(None).cast("double").alias("bound"), "leaf", F.pmod(F.xxhash64("uid"), F.col("vb")).alias("vp"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("qp"))
    theirs = asked.join(load, "leaf").select(
        F.lit(True).alias("ask"), "id", "uid", "v", "bound", "leaf",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1)).alias("vp"),
        F.pmod(F.xxhash64("uid"), F.col("qb")).alias("qp"))
    keys = ["leaf", "vp", "qp"]
    dealt = mine.unionByName(theirs).repartition(*keys).sortWithinPartitions(*keys)

    def meet(batches):
        for t in runs(batches, keys):
            ask = t.column("ask").combine_chunks().to_numpy(zero_copy_only=False)
            ids, uid = (t.column(c).combine_chunks() for c in ("id", "uid"))
            uid, v = uid.to_numpy(), _matrix(t.column("v"), dim)
            bound = t.column("bound").to_numpy()
            order = ids.to_pandas().rank(method="dense").fillna(np.inf).to_numpy()
            found = []
            bounds = run_bounds(*(t.column(c).to_numpy() for c in keys))
            for lo, hi in zip(bounds, bounds[1:]):
                q, x = lo + np.flatnonzero(ask[lo:hi]), lo + np.flatnonzero(~ask[lo:hi])
                if len(q) and len(x):
                    found += [(q[i], x[j], d) for i, j, d in _nearest(v[q], uid[q], v[x], uid[x], order[x], k, bound[q])]
            q, x, d = ([f[c] for f in found] for c in range(3))
            q, x = pa.array(q, pa.int64()), pa.array(x, pa.int64())
            yield record_batch(query_id=ids.take(q), query=pa.array(uid).take(q), vec_id=ids.take(x),
                               uid=pa.array(uid).take(x), score=pa.array(d, pa.float64()))
    met = dealt.mapInArrow(meet, f"query_id {id_type}, query long, vec_id {id_type}, uid long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id"), "uid"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(indexed: DataFrame, tree: Tree, dim, k, recall) -> int:
    """Fewest leaves whose visit reaches ``recall`` of the true neighbours of some queries."""
    spark = indexed.sparkSession
    some = indexed.filter("q").orderBy(F.xxhash64("uid")).limit(CALIBRATION).select("uid", "v").toPandas()
    if not len(some):
        return 1
    q, q_uid = np.array(some["v"].tolist(), float).reshape(-1, dim), some["uid"].to_numpy()
    sent = spark.sparkContext.broadcast((q, q_uid))

    def brute(batches):
        q, q_uid = sent.value
        for b in batches:
            x, uid = _matrix(b.column("v"), dim), b.column("uid").to_numpy()
            leaf = b.column("leaf").to_numpy()
            for lo in range(0, len(x), BLOCK):
                own = slice(lo, lo + BLOCK)
                found = _nearest(q, q_uid, x[own], uid[own], uid[own], k)
                yield record_batch(query=np.array([f[0] for f in found], np.int64),
                                   leaf=leaf[own][[f[1] for f in found]] if found else np.zeros(0, np.int64),
                                   score=np.array([f[2] for f in found], float))
    near = indexed.select("uid", "v", "leaf").mapInArrow(brute, "query long, leaf long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("score", "leaf"))
    true = near.withColumn("r", rank).filter(F.col("r") <= k).toPandas()
    if not len(true):
        return 1
    place = np.zeros((len(q), tree.leaves), np.int64)
    for row, order in zip(place, tree.best_first(q, tree.leaves)):
        row[order] = np.arange(len(order))
    seen = place[true["query"].to_numpy(), true["leaf"].to_numpy()]
    visits = 1
    while (seen < visits).mean() < recall:
        visits += 1
    return visits
