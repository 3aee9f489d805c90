"""Text scores by an interpolated modified Kneser-Ney bigram model.

Counting is two shuffles of packed, pre-aggregated arrays: bigrams by their first word (by the whole
bigram where that word is very frequent), continuation counts by the last word. Reduce tasks leave
the model as sorted hash arrays in the shared folder, one file a shard; workers map the files and
look up the sorted queries of a batch, so memory does not grow with the model.

Words are known by 64-bit fingerprints; within bigrams by 48 bits of them.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import record_batch, shared_path, text_batches, without, written
from voxelmill.llm.hash_tables import find, load, save, segments, shard_of
from voxelmill.llm.text import NOT_BLANK, mix, words

#: Bytes of text counted before the counts of a task are sent on.
COUNTED_BYTES = 16 << 20
#: The most frequent words of a shard that may turn out hot.
HOT_LISTED = 256
_END, _BEGIN = (mix(np.array([x], np.uint64))[0] for x in (1, 2))
_LOW = np.uint64((1 << 48) - 1)


def tokens(texts: pa.Array):
    """Word fingerprints of all texts, each closed by one end token; the text of each token."""
    w = words(texts, NOT_BLANK)
    last = w.first[1:] + np.arange(1, len(w.first))
    out = np.full(len(w.hash) + len(texts), _END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[last - 1] = False
    out[inside] = w.hash
    return out, np.repeat(np.arange(len(texts)), w.counts + 1), last - 1


def _bigrams(tok, last):
    """First and last word (48 bits) of each token's bigram."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[0] = _BEGIN
    before[last[:-1] + 1] = _BEGIN
    return before & _LOW, tok & _LOW


def _joint(u, w):
    return mix(u * np.uint64(0x9E3779B97F4A7C15) ^ mix(w))


def _counted(keys, weights=None):
    """Sorted distinct keys, their counts (sums of weights) and a first place of each."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, int)
    if weights is None:
        n = np.diff(np.append(first, len(keys)))
    else:
        n = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
    return ordered[first], n, order[first]


def _bins(n):
    """Counts as classes 1, 2 and 3 for three and more."""
    return np.minimum(n, 3)


def _press(a):
    a = np.ascontiguousarray(a)
    return np.int64(a.nbytes).tobytes() + pa.compress(a.tobytes(), "zstd", asbytes=True)


def _expand(data, kind):
    return np.frombuffer(pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), "zstd", asbytes=True), kind)


def _narrow(keys):
    """48-bit keys as six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _widen(data):
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view("<u8")


def _gathered(batches):
    """Lists of token arrays of about COUNTED_BYTES of text."""
    held, size = [], 0
    for b in text_batches(batches):
        column = b.column("text")
        held.append(tokens(column))
        size += column.nbytes
        if size >= COUNTED_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_PACK = "shard int, kind string, keys binary, last binary, counts binary, stats array<long>"


def _row(shard, kind, keys=None, last=None, counts=None, stats=None):
    return dict(shard=shard, kind=kind, keys=keys, last=last, counts=counts, stats=stats)


def _rows(rows):
    kinds = dict(shard=pa.int32(), kind=pa.string(), keys=pa.binary(), last=pa.binary(), counts=pa.binary(),
                 stats=pa.list_(pa.int64()))
    return record_batch(**{k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})


def _by_shard(packs: DataFrame, shards):
    return packs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")  # a task a shard


def _shard_rows(batches):
    """(shard, rows) from batches sorted by shard."""
    at, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["shard"] != at and held:
                yield at, held
                held = []
            at = r["shard"]
            held.append(r)
    if held:
        yield at, held


def _count_words(docs, folder, shards):
    """Word counts into the files ``uni-*``; (all tokens, distinct tokens, hot words)."""
    def count(batches):
        for held in _gathered(batches):
            key, n, _ = _counted(np.concatenate([h[0] for h in held]))
            yield _rows([_row(s, "word", key[a:b].tobytes(), None, _press(n[a:b].astype(np.uint32)))
                         for s, a, b in segments(shard_of(key, shards))])

    def reduce(batches):
        for shard, rows in _shard_rows(batches):
            key, n, _ = _counted(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]),
                                 np.concatenate([_expand(r["counts"], np.uint32) for r in rows]).astype(np.int64))
            save(folder, f"uni-{shard}", key=key, n=n)
            top = np.argsort(-n, kind="stable")[:HOT_LISTED]
            yield _rows([_row(shard, "hot", key[top].tobytes(), None, n[top].tobytes(), [int(n.sum()), len(n)])])

    packs = docs.mapInArrow(count, _PACK)
    found = written(_by_shard(packs, shards).mapInArrow(reduce, _PACK), "words")
    total, distinct = found.agg(F.sum(F.col("stats")[0]), F.sum(F.col("stats")[1])).first()
    if not total:
        return 0, 0, np.array([_BEGIN & _LOW])
    limit = max(2, total // (8 * shards))

    def pick(batches):
        for b in batches:
            for r in b.to_pylist():
                key, n = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)
                yield record_batch(key=key[n > limit].view(np.int64))
    hot = found.mapInArrow(pick, "key long").toPandas()["key"].to_numpy(np.int64).view(np.uint64)  # at most 8 a shard
    return total, distinct, np.unique(np.append(hot, _BEGIN) & _LOW)


def _bigram_shard(u, joint, hot, shards):
    at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
    return shard_of(np.where(hot[at] == u, joint, mix(u)), shards)


def _discounts(n):
    """Discounts of counts 1, 2, 3 and more from the numbers of entries with counts 1 to 4."""
    n = [float(x) for x in n]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5
        out.append(min(max(d, 0.05 * k), 0.95 * k))
    return np.array(out)


@dataclass
class Model:
    folder: str
    shards: int
    train_tokens: int
    distinct: int
    hot: np.ndarray
    hot_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    discount: np.ndarray = None
    low_discount: np.ndarray = None
    types: int = 0
    low_rest: float = 1.0

    def _lookup(self, name, keys, columns):
        """Columns of the sorted 64-bit keys in the tables ``name``; 0 where absent."""
        out = np.zeros((len(columns), len(keys)), np.int64)
        for s, a, b in segments(shard_of(keys, self.shards)):
            table = load(self.folder, f"{name}-{s}")
            if table:
                at, there = find(table, keys[a:b])
                for row, c in zip(out, columns):
                    row[a:b] = np.where(there, table[c][at], 0)
        return out

    def score(self, held):
        """Per text of a list of token arrays: tokens, known tokens, base score and score, log10."""
        tok = np.concatenate([h[0] for h in held])
        u, w = (np.concatenate(x) for x in zip(*(_bigrams(h[0], h[2]) for h in held)))
        word, _, first = _counted(tok)
        of_word = np.searchsorted(word, tok)
        known = self._lookup("uni", word, ["n"])[0]
        base = np.log10((known + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))
        low = self._low(w[first])
        joint = _joint(u, w)
        pair, _, spot = _counted(joint)
        prob = self._pair(pair, u[spot], low[of_word[spot]])
        value = np.log10(prob)[np.searchsorted(pair, joint)]
        doc, shift = [], 0
        for h in held:
            doc.append(h[1] + shift)
            shift += len(h[2])
        doc = np.concatenate(doc)
        return (np.bincount(doc, minlength=shift), np.bincount(doc, known[of_word] > 0, shift).astype(np.int64),
                np.bincount(doc, base[of_word], shift), np.bincount(doc, value, shift))

    def _low(self, w):
        """Probability of each word (48 bits) by the number of words it follows."""
        flat = self.low_rest / (self.distinct + 1)
        if not self.types:
            return np.full(len(w), flat)
        key = mix(w)
        order = np.argsort(key)
        n = np.zeros(len(w), np.int64)
        n[order] = self._lookup("cont", key[order], ["n"])[0]
        return np.maximum(n - self.low_discount[_bins(n)], 0) / self.types + flat

    def _pair(self, joint, u, low):
        """Probability of distinct bigrams given the probability of their last words."""
        if not self.types:
            return low
        count = np.zeros(len(joint), np.int64)
        shard = _bigram_shard(u, joint, self.hot, self.shards)
        order = np.lexsort((joint, shard))
        for s, a, b in segments(shard[order]):
            table = load(self.folder, f"pair-{s}")
            if table:
                own = order[a:b]
                at, there = find(table, joint[own])
                count[own] = np.where(there, table["n"][at], 0)
        context, inverse = np.unique(mix(u), return_inverse=True)
        stats = np.zeros((4, len(context)))
        stats[:] = self._lookup("ctx", context, ["total", "n1", "n2", "n3"])
        if len(self.hot_stats):
            key = mix(self.hot)
            order = np.argsort(key)
            at = np.minimum(np.searchsorted(key[order], context), len(key) - 1)
            there = key[order][at] == context
            stats[:, there] = self.hot_stats[order[at[there]]].T
        total, n1, n2, n3 = stats[:, inverse]
        d = self.discount
        seen = np.maximum(total, 1)
        rest = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / seen, 1.0)
        return np.maximum(count - d[_bins(count)], 0) / seen * (total > 0) + rest * low


def fit(docs: DataFrame, text="text", folder=None) -> Model:
    """Counts the model over all rows of ``docs``; a null text is empty (its end token alone).

    Repeated rows count as often as they occur. The shuffle partitions of the session decide the
    number of shards. An empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "kneser-ney")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(text).cast("string").alias("text"))
    total, distinct, hot = _count_words(docs, folder, shards)
    model = Model(folder, shards, total, distinct, hot)
    if not total:
        return model
    sent = spark.sparkContext.broadcast(hot)

    def count(batches):
        for held in _gathered(batches):
            u, w = (np.concatenate(x) for x in zip(*(_bigrams(h[0], h[2]) for h in held)))
            joint, n, spot = _counted(_joint(u, w))
            u, w = u[spot], w[spot]
            shard = _bigram_shard(u, joint, sent.value, shards)
            order = np.lexsort((w, u, shard))
            u, w, n = u[order], w[order], n[order].astype(np.uint32)
            rows = []
            for s, a, b in segments(shard[order]):
                first = np.flatnonzero(np.concatenate([[True], u[a + 1:b] != u[a:b - 1]]))
                many = np.diff(np.append(first, b - a)).astype(np.uint32)
                rows.append(_row(s, "pair", _narrow(u[a:b][first]), _narrow(w[a:b]),
                                 _press(np.concatenate([many, n[a:b]])), [len(first)]))
            yield _rows(rows)

    def reduce_pairs(batches):
        for shard, rows in _shard_rows(batches):
            u, w, n = [], [], []
            for r in rows:
                numbers, k = _expand(r["counts"], np.uint32), r["stats"][0]
                u.append(np.repeat(_widen(r["keys"]), numbers[:k]))
                w.append(_widen(r["last"]))
                n.append(numbers[k:].astype(np.int64))
            rows.clear()
            u, w, n = (np.concatenate(x) for x in (u, w, n))
            joint, n, spot = _counted(_joint(u, w), n)
            u, w = u[spot], w[spot]
            save(folder, f"pair-{shard}", key=joint, n=n.astype(np.uint32) if n.max() > 255 else n.astype(np.uint8))
            out = [_row(0, "pairs", stats=[int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)])]
            key = mix(u)
            context, _, place = _counted(key)
            own = np.searchsorted(context, key)
            c = np.stack([np.bincount(own, n, len(context)), *(np.bincount(own, _bins(n) == k, len(context))
                                                              for k in (1, 2, 3))]).astype(np.int64)
            at = np.minimum(np.searchsorted(sent.value, u[place]), len(sent.value) - 1)
            hot_one = sent.value[at] == u[place]
            if hot_one.any():
                out.append(_row(0, "context", _narrow(u[place][hot_one]), counts=c[:, hot_one].tobytes()))
            plain = ~hot_one
            kind = np.uint32 if c.max() < 1 << 32 else np.uint64
            save(folder, f"ctx-{shard}", key=context[plain],
                 **{k: v[plain].astype(kind) for k, v in zip(("total", "n1", "n2", "n3"), c)})
            key, many, place = _counted(mix(w))
            out += [_row(s, "cont", _narrow(w[place[a:b]]), None, _press(many[a:b].astype(np.uint32)))
                    for s, a, b in segments(shard_of(key, shards))]
            yield _rows(out)

    def reduce_words(batches):
        for shard, rows in _shard_rows(batches):
            packs = [r for r in rows if r["kind"] == "cont"]
            out = [r for r in rows if r["kind"] != "cont"]
            if packs:
                key, n, _ = _counted(mix(np.concatenate([_widen(r["keys"]) for r in packs])),
                                     np.concatenate([_expand(r["counts"], np.uint32) for r in packs]).astype(np.int64))
                save(folder, f"cont-{shard}", key=key, n=n.astype(np.uint32))
                out.append(_row(shard, "words", stats=[int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]))
            yield _rows(out)

    pairs = _by_shard(docs.mapInArrow(count, _PACK), shards).mapInArrow(reduce_pairs, _PACK)
    # a statistics row goes with the shard it comes from, not all to one
    pairs = pairs.withColumn("shard", F.when(F.col("kind") == "cont", F.col("shard")).otherwise(
        F.pmod(F.spark_partition_id(), F.lit(shards))))
    found = written(_by_shard(pairs, shards).mapInArrow(reduce_words, _PACK), "counts")
    sums = {r["kind"]: [r[f"s{i}"] for i in range(5)] for r in found.filter("kind in ('pairs', 'words')").groupBy("kind")
            .agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(5)]).toLocalIterator()}
    model.types = sums["pairs"][4]
    model.discount, model.low_discount = _discounts(sums["pairs"][:4]), _discounts(sums["words"][:4])
    d, s = model.low_discount, sums["words"]
    model.low_rest = (d[1] * s[0] + d[2] * s[1] + d[3] * s[4]) / model.types

    def contexts(batches):
        for b in batches:
            for r in b.to_pylist():
                u = _widen(r["keys"])
                c = np.frombuffer(r["counts"], np.int64).reshape(4, len(u))
                yield record_batch(u=u.view(np.int64), a=c[0], b=c[1], c=c[2], d=c[3])
    rows = (found.filter("kind = 'context'").mapInArrow(contexts, "u long, a long, b long, c long, d long")
            .groupBy("u").agg(*[F.sum(x).alias(x) for x in "abcd"]).toPandas())  # the hot words only
    stats = np.zeros((len(hot), 4))
    stats[np.searchsorted(hot, rows["u"].to_numpy(np.int64).view(np.uint64))] = rows[list("abcd")].to_numpy()
    model.hot_stats = stats
    return model


def score(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens long, base_score and score double (log10).

    A null or empty text is scored by its end token. Repeated rows get equal results. Columns
    of ``docs`` with one of the new names are replaced.
    """
    new = dict(n_tokens="long", n_known="long", train_tokens="long", base_score="double", score="double")
    docs = without(docs, *new)
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text)

    def run(batches):
        held, rows, size = [], [], 0

        def flush():
            m = sent.value
            n, known, base, value = m.score(held)
            table = pa.Table.from_batches(rows).combine_chunks()
            for column in (n, known, np.full(len(n), m.train_tokens), base, value):
                table = table.append_column(f"c{table.num_columns}", pa.array(column))
            return table.rename_columns([*keep, *new]).to_batches()

        keep = [c for c in names if c != text]
        for b in text_batches(batches, text):
            held.append(tokens(b.column(at).cast(pa.string())))
            rows.append(pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at], names=keep))
            size += b.column(at).nbytes
            if size >= COUNTED_BYTES:
                yield from flush()
                held, rows, size = [], [], 0
        if held:
            yield from flush()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, schema + "".join(f", {k} {v}" for k, v in new.items()))
