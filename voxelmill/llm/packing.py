"""Best-fit packing by exact complements.

Only lengths decide a packing, and a length is at most ``capacity``. So the plan is made on the
histogram of lengths (at most ``capacity`` numbers, whatever the data size) and then applied to
the pieces by their rank among those of equal length.

The plan takes lengths from long to short and indexes what is left as single lengths, sums of two
and sums of three. While one of these fills the gap exactly, as many copies are consumed as the
counts allow. What finds no exact complement is placed by best fit.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from voxelmill.llm.common import record_batch, text_batches, without, written
from voxelmill.llm.text import ranges
from voxelmill.llm.tokens import WORD_BPE, vocabulary_path, word_bpe

CAPACITY = 4096
END = 1
#: Pieces of one length ranked in one task.
RANKED = 2_000


def tokenized_pieces(docs: DataFrame, doc_id="doc_id", text="text", capacity=CAPACITY, end=END,
                     keep_ids=False, vocabulary=WORD_BPE, folder=None) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (, ids binary).

    A document is its ids and one ``end``; a null or empty text is the ``end`` alone. Repeated rows
    are pieces of their own. Other columns are ignored. ``ids``: little-endian unsigned 32 bits.
    """
    path = vocabulary_path(vocabulary, folder)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
              + ", ids binary" * keep_ids)

    def run(batches):
        model = word_bpe(path)
        for b in text_batches(batches):
            ids, counts = model.encode(b.column("text"))
            last = np.cumsum(counts + 1) - 1
            flat = np.full(len(ids) + len(counts), end, "<u4")
            inside = np.ones(len(flat), bool)
            inside[last] = False
            flat[inside] = ids
            whole = counts + 1
            many = -(-whole // capacity)
            piece, doc = ranges(np.zeros(len(many), np.int64), many)
            start = piece * capacity
            length = np.minimum(whole[doc] - start, capacity)
            at = (last - counts)[doc] + start
            data = memoryview(flat).cast("B")
            crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            out = dict(doc_id=b.column("doc_id").take(pa.array(doc)), piece=pa.array(piece, pa.int32()),
                       start=pa.array(start), length=pa.array(length), ids_crc32=pa.array(crc, pa.int64()))
            if keep_ids:
                out["ids"] = pa.array([bytes(data[4 * a:4 * (a + n)])
                                       for a, n in zip(at.tolist(), length.tolist())], pa.binary())
            yield record_batch(**out)
    return kept.mapInArrow(run, schema)


class Plan:
    """Patterns of lengths for a histogram: ``patterns`` are (runs of (length, copies), times)."""

    def __init__(self, counts, capacity=CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        self.left[:len(counts)] = counts
        self.patterns = []
        self._exact()
        self._best_fit()

    def _times(self, combo):
        return min(int(self.left[x]) // k for x, k in Counter(combo).items())

    def _exact(self):
        c = self.capacity
        if self.left[c]:
            self._use((c,), int(self.left[c]))
        for long in range(c - 1, 0, -1):
            while self.left[long]:
                combo = self._complement(long)
                if combo is None:
                    break
                self._use(combo, self._times(combo))

    def _use(self, combo, times):
        for x in combo:
            self.left[x] -= times
        runs = tuple(sorted(Counter(combo).items(), reverse=True))
        self.patterns.append((runs, times))

    def _complement(self, long):
        """The lengths that fill the gap of ``long``: one, else two, else three; long ones first."""
        gap = self.capacity - long
        if self.left[gap] and self._times((long, gap)):
            return long, gap
        there = self.left > 0
        for pair in self._pairs(gap, there):
            if self._times((long, *pair)):
                return long, *pair
        size = 1 << (2 * gap + 1).bit_length()
        spectrum = np.fft.rfft(there[:gap + 1].astype(float), size)
        sums = np.fft.irfft(spectrum * spectrum, size)[:gap + 1] > 0.5  # sums of two lengths
        first = np.flatnonzero(there[:gap + 1] & sums[gap::-1])[::-1]
        for a in first[3 * first >= gap].tolist():
            for pair in self._pairs(gap - a, there, most=a):
                if self._times((long, a, *pair)):
                    return long, a, *pair
        return None

    @staticmethod
    def _pairs(total, there, most=None):
        low = (total + 1) // 2
        a = np.arange(min(total - 1, most or total), low - 1, -1)
        a = a[a > 0]
        for x in a[there[a] & there[total - a]].tolist():
            yield x, total - x

    def _best_fit(self):
        gaps = np.zeros(self.capacity + 1, np.int64)
        groups = [[] for _ in range(self.capacity + 1)]
        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                fits = np.flatnonzero(gaps[length:])
                if len(fits):
                    gap = length + int(fits[0])
                    runs, have = groups[gap].pop()
                    copies = min(gap // length, n)
                    take = min(have, n // copies)
                    if have > take:
                        groups[gap].append((runs, have - take))
                else:
                    gap, runs = self.capacity, ()
                    copies = min(gap // length, n)
                    take = have = n // copies
                    gaps[gap] += take
                gaps[gap] -= take
                rest = gap - copies * length
                groups[rest].append(((*runs, (length, copies)), take))
                gaps[rest] += take
                n -= take * copies
            self.left[length] = 0
        self.patterns += [g for rest in groups for g in rest]

    def slots(self):
        """Rows length, first rank, sequences, copies in each, first sequence, offset."""
        next_rank = np.zeros(self.capacity + 1, np.int64)
        rows, sequence = [], 0
        for runs, times in self.patterns:
            offset = 0
            for length, copies in runs:
                rows.append((length, next_rank[length], copies, sequence, offset))
                next_rank[length] += times * copies
                offset += length * copies
            sequence += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank of each piece among those of its length, from 0; a frequent length spreads over buckets."""
    spark = pieces.sparkSession
    buckets = max(1, -(-pieces.count() // RANKED))
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64("_uid"), F.lit(buckets)))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_b")) - F.col("_n")
    sizes = (rows.groupBy("length", "_b").agg(F.count("*").alias("_n"))
             .select("length", "_b", before.alias("_before")))
    local = F.row_number().over(W.partitionBy("length", "_b").orderBy("_uid")) - 1
    return (rows.withColumn("_local", local).join(sizes, ["length", "_b"])
            .withColumn("_rank", F.col("_before") + F.col("_local")).drop("_b", "_local", "_before"))


def pack(pieces: DataFrame, capacity=CAPACITY) -> DataFrame:
    """Adds sequence_id long and offset long to rows with a ``length`` from 1 to ``capacity``.

    Sequences are gapless from 0 and hold at most ``capacity``. Equal rows are separate pieces; an
    empty table gives an empty table. Columns of the two new names are replaced. Column names starting with ``_`` are reserved.
    """
    spark = pieces.sparkSession
    pieces = without(pieces, "sequence_id", "offset")
    pieces = written(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most capacity rows
    if len(found) and not found["length"].between(1, capacity).all():
        raise ValueError(f"lengths must lie in 1..{capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    counts[found["length"].to_numpy(np.int64)] = found["n"]
    slots, _ = Plan(counts, capacity).slots()
    sent = spark.sparkContext.broadcast(slots)
    ranked = _ranked(pieces).drop("_uid")
    names = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")

    def run(batches):
        s = sent.value
        key = s[:, 0] << 48 | s[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                            for c in ("length", "_rank"))
            slot = s[np.searchsorted(key, length << 48 | rank, "right") - 1]
            turn = rank - slot[:, 1]
            yield record_batch(**{c: b.column(c) for c in names},
                               sequence_id=slot[:, 3] + turn // slot[:, 2],
                               offset=slot[:, 4] + turn % slot[:, 2] * length)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")
