"""MinHash signatures, band keys and pairwise work inside groups of candidates."""

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.text import mix

#: Hash functions of a signature at most.
HASHES = 128
#: Members of a group compared in one task; a larger group is dealt out as pairs of blocks.
BLOCK = 512


def bands_for(threshold, recall, hashes=HASHES):
    """(bands, rows): the most selective banding that finds a pair at ``threshold`` with ``recall``."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            best = bands, rows
    return best


@lru_cache(maxsize=4)
def _functions(n):
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(grams, first, n_hashes):
    """MinHash values of the sets ``grams[first[i]:first[i + 1]]``, none of them empty."""
    a, b = _functions(n_hashes)
    out = np.empty((len(first) - 1, n_hashes), np.uint64)
    for i in range(n_hashes):
        h = grams * a[i]
        h ^= h >> np.uint64(29)
        h *= b[i] | np.uint64(1)
        out[:, i] = np.minimum.reduceat(h, first[:-1])
    return out


def band_keys(signature, bands, rows):
    """One 64-bit key for each band of each signature."""
    keys = np.empty((len(signature), bands), np.uint64)
    for j in range(bands):
        h = np.full(len(signature), j, np.uint64)
        for k in range(rows):
            h = mix(h ^ signature[:, j * rows + k])
        keys[:, j] = h
    return keys


def dealt_groups(rows: DataFrame, key, order, block=BLOCK) -> DataFrame:
    """Rows of groups of two and more, dealt to tasks so that any two of a group meet.

    Adds _blocks, the blocks of the group, _own, the block of the row, and _part, the number of a
    pair of blocks (least * _blocks + greatest). Groups of at most ``block`` members have
    one part; members of larger ones go to one part for each other block.
    """
    size = rows.groupBy(key).agg(F.ceil(F.count("*") / block).alias("_blocks"), F.count("*").alias("_n"))
    others = F.when(F.col("_blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.expr(
        "transform(filter(sequence(0L, _blocks - 1), x -> x != _own), "
        "x -> least(x, _own) * _blocks + greatest(x, _own))"))
    return (rows.join(size.filter("_n > 1").drop("_n"), key)
            .withColumn("_own", F.pmod(F.xxhash64(order), F.col("_blocks")))
            .withColumn("_part", F.explode(others)))


def runs(batches, keys):
    """Record batches holding whole runs of equal ``keys``, from batches sorted by them."""
    import pyarrow as pa
    held = []

    def same(x, i, y, j):
        return all(x.column(k)[i].as_py() == y.column(k)[j].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        if held and not same(held[-1], held[-1].num_rows - 1, b, 0):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = b.num_rows
        while cut and same(b, cut - 1, b, b.num_rows - 1):
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_bounds(*columns):
    """First rows of the runs of equal values, and the number of rows."""
    change = np.zeros(len(columns[0]), bool)
    if len(change):
        change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), len(change))


def roots(n, a, b):
    """Least member reachable from each of 0..n-1 over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low
