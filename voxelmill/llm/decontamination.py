"""Benchmark decontamination as a prefix-filtered set join.

The query side of the join are item-sized windows: ``size`` consecutive words of a benchmark item,
or the whole item where it has fewer words. A window is a set of positioned shingles. Shingles are
ordered by rarity over all documents; full containment needs one shingle of a window as prefix, so
only the rarest is joined with the shingles of the documents. Its position fixes where the window
would lie: positional and length bounds discard places before or behind the text, and the words
of the rest are compared one by one.

The benchmark is a stated query set. It is taken in blocks of at most ``block`` windows, so what is
sent to the workers is bounded whatever its size; each block passes over all documents.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import record_batch, text_batches, without, written
from voxelmill.llm.text import ngrams, ranges, words

SIZE = 13
SHINGLE = 4
BLOCK = 200_000
#: Candidate places compared at once in a task.
PAIRS = 1 << 18


def benchmark_windows(bench: DataFrame, item="item_id", text="text", size=SIZE) -> DataFrame:
    """(item string, words binary): every window of every item. Null items and texts have none."""
    def run(batches):
        for b in text_batches(batches):
            w = words(b.column("text"))
            items = b.column("item").to_pylist()
            first, n = w.first[:-1], w.counts
            many = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
            at, doc = ranges(first, many)
            length = np.minimum(n, size)[doc]
            yield record_batch(
                item=pa.array([items[d] for d in doc], pa.string()),
                words=pa.array([w.hash[a:a + k].tobytes() for a, k in zip(at, length)], pa.binary()))
    kept = bench.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return kept.filter("item is not null").mapInArrow(run, "item string, words binary").distinct()


class Index:
    """The windows of one block: shingles, later their rarest one, and the words to compare."""

    def __init__(self, rows, shingle):
        self.shingle = shingle
        keys = sorted({r["words"] for r in rows})
        number = {k: i for i, k in enumerate(keys)}
        self.length = np.array([len(k) // 8 for k in keys], np.int64)
        self.words = np.zeros((len(keys), max(self.length)), np.uint64)
        for i, k in enumerate(keys):
            self.words[i, :self.length[i]] = np.frombuffer(k, np.uint64)
        pairs = sorted((number[r["words"]], r["item"]) for r in rows)
        self.items = [i for _, i in pairs]
        self.item_start = np.searchsorted([w for w, _ in pairs], np.arange(len(keys) + 1))
        # all shingles of all windows: (fingerprint, window, offset); shorter windows have one
        self.parts = []
        for k in np.unique(np.minimum(self.length, shingle)).tolist():
            own = np.flatnonzero(np.minimum(self.length, shingle) == k)
            at, w = ranges(np.zeros(len(own), np.int64), self.length[own] - k + 1)
            self.parts.append((k, self._combined(own[w], at, k), own[w], at))
        self.all = np.unique(np.concatenate([p[1] for p in self.parts]))

    def _combined(self, win, at, k):
        from voxelmill.llm.text import _combined
        flat = self.words.ravel()
        return _combined(flat, win * self.words.shape[1] + at, k)

    def order_by_rarity(self, fingerprint, count):
        """Keep of each window the shingle with the fewest places in the documents."""
        order = np.argsort(fingerprint)
        fingerprint, count = fingerprint[order], count[order]
        self.prefix = []
        for k, h, win, at in self.parts:
            i = np.searchsorted(fingerprint, h)
            i = np.minimum(i, max(len(fingerprint) - 1, 0))
            freq = (np.where(fingerprint[i] == h, count[i], 0) if len(fingerprint)
                    else np.zeros(len(h), np.int64))
            best = np.lexsort((at, h, freq, win))
            best = best[np.unique(win[best], return_index=True)[1]]
            best = best[freq[best] > 0]  # a shingle in no document: the window is in none
            best = best[np.argsort(h[best], kind="stable")]
            self.prefix.append((k, h[best], win[best], at[best]))
        del self.parts, self.all

    def matches(self, w):
        """(first word, window) of every occurrence of a window in the texts."""
        found = [np.zeros((0, 2), np.int64)]
        for k, h, win, off in self.prefix:
            if not len(h):
                continue
            grams, _, at = _exact_ngrams(w, k)
            lo = np.searchsorted(h, grams, "left")
            hit = np.flatnonzero((lo < len(h)) & (h[np.minimum(lo, len(h) - 1)] == grams))
            lo = lo[hit]
            many = np.searchsorted(h, grams[hit], "right") - lo
            ends = np.cumsum(many)
            cuts = [0, *np.unique(np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS))), len(hit)]
            for a, b in zip(cuts, cuts[1:]):
                row, owner = ranges(lo[a:b], many[a:b])
                place = at[hit[a:b]][owner] - off[row]
                window = win[row]
                doc = w.doc[at[hit[a:b]][owner]]
                ok = (place >= w.first[doc]) & (place + self.length[window] <= w.first[doc + 1])
                place, window = place[ok], window[ok]
                same = np.ones(len(place), bool)
                for j in range(self.words.shape[1]):
                    inside = j < self.length[window]
                    there = w.hash[np.minimum(place + j, len(w.hash) - 1)]
                    same &= ~inside | (there == self.words[window, j])
                found.append(np.stack([place[same], window[same]], 1))
        return np.concatenate(found)


def _exact_ngrams(w, k):
    """n-grams of exactly k words; texts with fewer have none."""
    h, doc, at = ngrams(w, k)
    keep = w.counts[doc] >= k
    return h[keep], doc[keep], at[keep]


def _counts(docs: DataFrame, index: Index):
    """Places of each shingle of the block over all documents."""
    known = docs.sparkSession.sparkContext.broadcast((index.all, [p[0] for p in index.parts]))

    def run(batches):
        keys, sizes = known.value
        total = np.zeros(len(keys), np.int64)
        for b in text_batches(batches):
            w = words(b.column("text"))
            for k in sizes:
                grams, _, _ = _exact_ngrams(w, k)
                i = np.searchsorted(keys, grams)
                i = np.minimum(i, len(keys) - 1)
                total += np.bincount(i[keys[i] == grams], minlength=len(keys))
        some = np.flatnonzero(total)
        yield record_batch(h=keys[some].view(np.int64), n=total[some])

    rows = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    known.unpersist()
    return rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)


def find_hits(docs: DataFrame, bench: DataFrame, doc_id="doc_id", text="text", item="item_id",
              bench_text="text", size=SIZE, shingle=SHINGLE, block=BLOCK) -> DataFrame:
    """Words of each document inside an occurrence of a benchmark window.

    Returns one row per document row: the columns of ``docs``, n_words long, n_hit long,
    hits array<struct<first int, last int>> (disjoint word ranges, last exclusive) and
    items array<string> (distinct items with a window in the text, sorted as strings).

    Null and empty texts have no words and no hits; repeated rows are judged one by one; an empty
    benchmark hits nothing. Columns of ``docs`` with one of the new names are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_words", "n_hit", "hits", "items")
    out = docs.withColumns({
        "n_words": F.lit(None).cast("long"), "n_hit": F.lit(0).cast("long"),
        "hits": F.array().cast("array<struct<first:int,last:int>>"), "items": F.array().cast("array<string>")})
    schema = out.schema
    texts = docs.select(F.col(text).cast("string").alias("text"))
    windows = benchmark_windows(bench, item, bench_text, size)

    def passed(frame, index):
        sent = spark.sparkContext.broadcast(index) if index else None

        def run(batches):
            for b in text_batches(batches, text):
                w = words(b.column(text).cast(pa.string()))
                found = sent.value.matches(w) if sent else np.zeros((0, 2), np.int64)
                yield _merged(b, w, found, sent.value if sent else None)
        return frame.mapInArrow(run, schema)

    indexes, rows = 0, []

    def one(rows):
        index = Index(rows, shingle)
        index.order_by_rarity(*_counts(texts, index))
        return index

    for r in windows.toLocalIterator():  # a block at a time on the driver, never the benchmark whole
        rows.append(r)
        if len(rows) == block:
            out, rows, indexes = written(passed(out, one(rows)), "decontamination"), [], indexes + 1
    if rows or not indexes:
        out = passed(out, one(rows) if rows else None)
    return out


def _merged(b, w, found, index):
    """The batch with the hits of one block united with those of earlier blocks."""
    n = b.num_rows
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(found):
        np.add.at(covered, found[:, 0], 1)
        np.add.at(covered, found[:, 0] + index.length[found[:, 1]], -1)
    items = b.column("items").to_pylist()
    old = b.column("hits").to_pylist()
    for d, spans in enumerate(old):
        for s in spans:
            covered[w.first[d] + s["first"]] += 1
            covered[w.first[d] + s["last"]] -= 1
    hit = np.cumsum(covered)[:-1] > 0
    doc_start = np.zeros(len(w.hash) + 1, bool)
    doc_start[w.first] = True
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    begin = np.flatnonzero((edge == 1) | (doc_start & np.append(hit, False) & np.append(False, hit)))
    end = np.flatnonzero((edge == -1) | (doc_start & np.append(hit, False) & np.append(False, hit)))
    spans = [[] for _ in range(n)]
    for s, e in zip(begin.tolist(), end.tolist()):
        d = int(w.doc[s])
        spans[d].append({"first": s - int(w.first[d]), "last": e - int(w.first[d])})
    if len(found):
        for d, win in np.unique(np.stack([w.doc[found[:, 0]], found[:, 1]], 1), axis=0).tolist():
            items[d].extend(index.items[index.item_start[win]:index.item_start[win + 1]])
    new = {"n_words": pa.array(w.counts, pa.int64()),
           "n_hit": pa.array(np.bincount(w.doc[hit], minlength=n)[:n], pa.int64()),
           "hits": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
           "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([new.get(c, b.column(i)) for i, c in enumerate(b.schema.names)],
                                      names=b.schema.names)


def digests(hits: DataFrame, doc_id="doc_id") -> DataFrame:
    """Per document: counts, the digest of its items and whether a twentieth of its words is hit."""
    return hits.select(
        F.col(doc_id), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def item_digest(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
