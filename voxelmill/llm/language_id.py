"""Language identification with a small byte convolutional network.

Bytes are embedded, filters of several widths slide over a window, each filter keeps its maximum,
and a softmax layer names the language. The network is trained in numpy on the driver, on a sample
of labelled windows whose size is a parameter. Prediction cuts every whole text into windows of a
fixed number of bytes and averages their probabilities, weighted by length.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import record_batch, text_batches, without
from voxelmill.llm.text import text_buffer

WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
WINDOW = 256
TRAIN_WINDOW = 128
#: Labelled documents for each language that the network learns from, and windows from each.
SAMPLE = 1_000
WINDOWS_EACH = 2
UNKNOWN = "und"
_BATCH = 64


def windows(raw, start, end, size):
    """A row of ``size`` bytes and what the widest filter needs beyond for each window; 0 behind the end."""
    at = start[:, None] + np.arange(size + max(WIDTHS) - 1)
    return np.where(at < end[:, None], raw[np.minimum(at, max(len(raw) - 1, 0))], 0).astype(np.uint8)


@dataclass
class ByteNet:
    languages: list
    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, rows):
        """Each position's embedded bytes side by side, as wide as the widest filter."""
        width = max(WIDTHS)
        x = self.emb[rows]
        n, length, e = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(n, length * e), width * e, axis=1)[:, ::e]
        return np.ascontiguousarray(view)

    def probabilities(self, rows):
        parts = [np.zeros((0, len(self.languages)), np.float32)]
        for i in range(0, len(rows), _BATCH):
            x = self.columns(rows[i:i + _BATCH])
            n, p, d = x.shape
            top = (x.reshape(n * p, d) @ self.filters).reshape(n, p, -1).max(1)
            z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            parts.append(z / z.sum(1, keepdims=True))
        return np.concatenate(parts)


def train(texts, labels, epochs=5, rate=3e-3, seed=4) -> ByteNet:
    """Fits the network to (bytes, language) windows by Adam."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    width, n_f = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((width * EMBEDDING, n_f), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[:w * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
    emb = rng.normal(0, .5, (256, EMBEDDING)).astype(np.float32)
    emb[0] = 0
    net = ByteNet(languages, emb, (rng.normal(0, .2, mask.shape) * mask).astype(np.float32),
                  np.zeros(n_f, np.float32), rng.normal(0, .2, (n_f, len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    if not texts:
        return net
    length = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(length) - length
    rows = windows(raw, start, start + length, TRAIN_WINDOW)
    y = np.searchsorted(languages, labels)
    weights = [net.emb, net.filters, net.bias, net.out, net.out_bias]
    moment, spread = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), _BATCH):
            own = order[i:i + _BATCH]
            step += 1
            for w, g, m, v in zip(weights, _gradients(net, rows[own], y[own], mask), moment, spread):
                m += .1 * (g - m)
                v += .001 * (g * g - v)
                w -= rate * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .999 ** step)) + 1e-8)
    return net


def _gradients(net, rows, y, mask):
    x = net.columns(rows)
    n, p, d = x.shape
    z = (x.reshape(n * p, d) @ net.filters).reshape(n, p, -1)
    at = z.argmax(1)
    top = np.take_along_axis(z, at[:, None], 1)[:, 0] + net.bias
    hidden = np.maximum(top, 0)
    logits = hidden @ net.out + net.out_bias
    prob = np.exp(logits - logits.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    prob[np.arange(n), y] -= 1
    prob /= n
    back = (prob @ net.out.T) * (top > 0)
    chosen = x[np.arange(n)[:, None], at]
    g_filters = np.einsum("nf,nfd->df", back, chosen) * mask
    place = at[:, :, None] + np.arange(max(WIDTHS))
    g_bytes = (back[:, :, None] * net.filters.T[None]).reshape(n, -1, max(WIDTHS), EMBEDDING)
    g_emb = np.zeros_like(net.emb)
    np.add.at(g_emb, rows[np.arange(n)[:, None, None], place], g_bytes)
    g_emb[0] = 0
    return g_emb, g_filters, back.sum(0), hidden.T @ prob, prob.sum(0)


def fit(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", sample=SAMPLE) -> ByteNet:
    """Trains on ``sample`` documents a language at most (chosen by a hash of id and text).

    Rows with a null language or a null or empty text teach nothing. Without any labelled row the
    network knows no language.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
                       F.xxhash64(F.col(doc_id).cast("string"), F.length(text)).alias("h"))
    rows = rows.filter("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts:
        return train([], [])
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    draw = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    parts = F.array(*[F.expr(
        f"encode(substring(text, int(1 + pmod(xxhash64(h, {k}), greatest(length(text) - {TRAIN_WINDOW}, 1))), "
        f"{TRAIN_WINDOW}), 'UTF-8')") for k in range(WINDOWS_EACH)])
    chosen = (rows.filter(draw < share[F.col("lang")])
              .select("lang", F.explode(parts).alias("part"))
              .limit(2 * sample * len(counts) * WINDOWS_EACH).toPandas())
    return train(chosen["part"].map(bytes).tolist(), chosen["lang"].tolist())


def has_letter(texts, raw, offsets):
    """Whether a text has a letter: an ASCII one found at once, else any by the Unicode tables."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        t = texts[i].as_py()
        out[i] = bool(t) and any(c.isalpha() for c in t)
    return out


def predict(docs: DataFrame, net: ByteNet, text="text") -> DataFrame:
    """Adds lang_pred string and score double (mean probability of the language, 0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; so is everything if no language
    was learned. Repeated rows get equal results. Ties go to the first language by name.
    Columns of ``docs`` with one of the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    docs = without(docs, "lang_pred", "score")
    names = docs.columns

    def run(batches):
        model = sent.value
        for b in text_batches(batches, text):
            texts = b.column(names.index(text))
            raw, offsets = text_buffer(texts)
            known = has_letter(texts, raw, offsets) & (len(model.languages) > 0)
            n = np.maximum(-(-np.diff(offsets) // WINDOW), 1)
            doc = np.repeat(np.arange(len(n)), n)
            start = offsets[:-1][doc] + (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * WINDOW
            end = offsets[1:][doc]
            total = np.zeros((len(n), max(len(model.languages), 1)))
            for i in range(0, len(doc) if known.any() else 0, 4096):
                s, e, d = start[i:i + 4096], end[i:i + 4096], doc[i:i + 4096]
                size = np.minimum(e - s, WINDOW)
                np.add.at(total, d, model.probabilities(windows(raw, s, e, WINDOW)) * size[:, None])
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best = total.argmax(1)
            pred = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())]
            score = np.where(known, np.clip(total[np.arange(len(best)), best], 0, 1), 0.0)
            yield record_batch(**{c: b.column(i) for i, c in enumerate(names)},
                               lang_pred=pa.array(pred, pa.string()), score=score)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
