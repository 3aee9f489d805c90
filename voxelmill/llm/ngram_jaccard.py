"""N-gram Jaccard self-join of documents by MinHash banding.

Documents with equal n-gram sets are one class and go on as one member. Members that share a band
are candidates; the number of bands and rows follows from the wanted recall. Signatures tell
hopeless candidates apart, the others form clusters. The n-gram sets travel once to their cluster,
where every pair is verified on the full sets. Pairs are counted where they are verified and never
leave the task; only a spanning forest of the links does.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import pin_scans, record_batch, shared_path, text_batches, written
from voxelmill.llm.components import components
from voxelmill.llm.hash_tables import save_rows, wanted
from voxelmill.llm.minhash import band_keys, bands_for, dealt_groups, roots, run_bounds, runs, signatures
from voxelmill.llm.text import ngrams, words

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Distinct n-grams of a cluster compared at once.
COLUMNS = 4096


def _sets(texts, size):
    """Distinct n-grams of the texts that have any: values, bounds and numbers of the texts."""
    h, doc, _ = ngrams(words(texts), size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    bounds = run_bounds(doc)
    return h, bounds, doc[bounds[:-1]] if len(h) else np.zeros(0, np.int64)


def sketches(docs: DataFrame, size=SIZE, bands=24, rows=5) -> DataFrame:
    """row, cls (digest of the n-gram set; null without words), keys (band keys), low (signature bytes)."""
    def run(batches):
        for b in text_batches(batches):
            h, bounds, own = _sets(b.column("text"), size)
            n = b.num_rows
            cls, keys, low = [None] * n, [None] * n, [None] * n
            if len(own):
                sig = signatures(h, bounds, bands * rows)
                key = band_keys(sig, bands, rows).view(np.int64)
                small = sig.astype(np.uint8)
                for i, d in enumerate(own.tolist()):
                    cls[d] = hashlib.blake2b(h[bounds[i]:bounds[i + 1]].tobytes(), digest_size=16).digest()
                    keys[d], low[d] = key[i], small[i].tobytes()
            yield record_batch(row=b.column("row"), doc_id=b.column("doc_id"), cls=pa.array(cls, pa.binary()),
                               keys=pa.array(keys, pa.list_(pa.int64())), low=pa.array(low, pa.binary()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {kind}, cls binary, keys array<long>, low binary")


def _spread(df, *keys):
    """Hash-partitioned and sorted by the keys, for run-wise work in tasks."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _likely_edges(members: DataFrame, threshold, hashes) -> DataFrame:
    """Spanning edges (a, b) of band partners whose signatures do not rule the threshold out."""
    # five standard deviations below the expected number of equal signature values
    least = threshold * hashes - 5 * (threshold * (1 - threshold) * hashes) ** 0.5
    banded = members.select(F.explode("keys").alias("key"), "cls")
    met = dealt_groups(banded, "key", "cls").select("key", "_part", "cls")
    # signatures join late: most band keys have one member only
    dealt = _spread(met.join(members.select("cls", "low"), "cls"), "key", "_part")

    def run(batches):
        for t in runs(batches, ["key", "_part"]):
            key, part = (t.column(c).to_numpy() for c in ("key", "_part"))
            cls = t.column("cls").to_pylist()
            low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(len(cls), -1)
            bounds = run_bounds(key, part)
            run_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            a, b, step = [], [], 1
            at = np.arange(len(cls))
            while True:
                at = at[at + step < len(cls)]
                at = at[run_of[at] == run_of[np.minimum(at + step, len(cls) - 1)]]
                if not len(at):
                    break
                for i in range(0, len(at), 1 << 16):
                    x = at[i:i + (1 << 16)]
                    x = x[(low[x] == low[x + step]).sum(1) >= least]
                    a.append(x)
                    b.append(x + step)
                step += 1
            if a:
                root = roots(len(cls), np.concatenate(a), np.concatenate(b))
                leaf = np.flatnonzero(root != np.arange(len(cls))).tolist()
                yield record_batch(a=pa.array([cls[i] for i in leaf], pa.binary()),
                                   b=pa.array([cls[root[i]] for i in leaf], pa.binary()))
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def similar(sets, threshold):
    """Boolean matrix of the pairs with a Jaccard similarity of at least ``threshold``."""
    size = np.array([len(s) for s in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, len(grams), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, len(grams) - start)), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    out = both >= threshold * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def _verified(cluster: DataFrame, threshold) -> DataFrame:
    """kind 'n': cls has n links; kind 'e': spanning edge cls - other."""
    dealt = _spread(dealt_groups(cluster, "root", "cls"), "root", "_part")

    def run(batches):
        for t in runs(batches, ["root", "_part"]):
            root, cls, grams = (t.column(c).to_pylist() for c in ("root", "cls", "grams"))
            part, many = t.column("_part").to_numpy(), t.column("copies").to_numpy()
            block, blocks = t.column("_own").to_numpy(), t.column("_blocks").to_numpy()
            change = [0] + [i for i in range(1, len(root)) if root[i] != root[i - 1] or part[i] != part[i - 1]]
            out = [[], [], [], []]
            for lo, hi in zip(change, [*change[1:], len(root)]):
                if hi - lo < 2:
                    continue
                linked = similar([np.frombuffer(g, np.uint64) for g in grams[lo:hi]], threshold)
                # a pair inside a block is seen with every other block; one of them counts it
                k, own = int(blocks[lo]), block[lo:hi]
                if k > 1:
                    first = np.where(own == 0, 1, 0)
                    other = part[lo] // k + part[lo] % k - own
                    here = (own[:, None] != own[None, :]) | (other == first)[:, None]
                else:
                    here = np.ones_like(linked)
                n = (linked & here) @ many[lo:hi]
                for i in np.flatnonzero(n).tolist():
                    for c, v in zip(out, ("n", cls[lo + i], None, int(n[i]))):
                        c.append(v)
                low = roots(hi - lo, *np.nonzero(linked))
                for i in np.flatnonzero(low != np.arange(hi - lo)).tolist():
                    for c, v in zip(out, ("e", cls[lo + i], cls[lo + low[i]], 0)):
                        c.append(v)
            yield record_batch(kind=pa.array(out[0], pa.string()), cls=pa.array(out[1], pa.binary()),
                               other=pa.array(out[2], pa.binary()), n=pa.array(out[3], pa.int64()))
    return dealt.mapInArrow(run, "kind string, cls binary, other binary, n long")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", size=SIZE, threshold=THRESHOLD,
                    recall=RECALL) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, copy_id, class_id, class_row, n_links.

    copy_id: least id of the rows with the same n-gram set; class_id: least id connected by links
    of at least ``threshold``; class_row: its row (the first); n_links: other rows with such a similarity to this one. ``row`` numbers
    the rows of ``docs`` (monotonically_increasing_id of its scan, so read it from stored files).

    Texts that are null, empty or without words have no n-grams: their own class, no links. A text of
    fewer than ``size`` words is one n-gram. Repeated rows are copies of each other and link. A null
    id takes part; it is never the least unless all are null. An empty table gives no rows.
    """
    pin_scans(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    kept = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    sketch = written(sketches(kept, size, bands, rows), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(sketch.filter("cls is not null").groupBy("cls").agg(
        F.min(first).alias("least"), F.count("*").alias("copies"), F.min("row").alias("row")), "classes")
    members = sketch.join(classes.select("row"), "row").select("cls", "keys", "low")
    clusters = components(_likely_edges(members, threshold, bands * rows))
    chosen = written(classes.join(clusters, classes["cls"] == clusters["node"]).select("row", "cls", "root", "copies"), "chosen")
    grams = written(_grams(kept, chosen, size).join(chosen, "row").drop("row"), "grams")
    links = written(_verified(grams, threshold), "links")
    groups = components(links.filter("kind = 'e'").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = (classes.join(groups, classes["cls"] == groups["node"], "left")
             .select("cls", "least", "copies", F.coalesce("root", "cls").alias("root")))
    leader = named.groupBy("root").agg(F.min("least").alias("leader"))
    counts = links.filter("kind = 'n'").groupBy("cls").agg(F.sum("n").alias("n"))
    per_class = (named.join(leader, "root").join(counts, "cls", "left")
                 .select("cls", "least", "leader", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n")))
    out = sketch.select("row", "doc_id", "cls").join(per_class, "cls", "left")
    known = F.col("cls").isNotNull()
    return out.select("row", "doc_id", F.when(known, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"),
                      F.when(known, F.col("leader.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(known, F.col("leader.row")).otherwise(F.col("row")).alias("class_row"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def _grams(docs: DataFrame, chosen: DataFrame, size) -> DataFrame:
    """(row, grams) of the chosen rows, in a second pass that leaves the texts where they are."""
    folder = shared_path(docs.sparkSession, "chosen")
    save_rows(chosen, folder)

    def run(batches):
        for b in text_batches(batches):
            at = wanted(folder, b.column("row").to_numpy())
            h, bounds, own = _sets(b.column("text").take(pa.array(at)), size)
            yield record_batch(row=b.column("row").take(pa.array(at[own])),
                               grams=pa.array([h[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary()))
    return docs.select("row", "text").mapInArrow(run, "row long, grams binary")
