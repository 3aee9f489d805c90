"""Toxicity by noisy-channel deobfuscation and a word classifier.

A disguised word (digits and signs for letters, letters spaced out, letters repeated) is a noisy
copy of a plain one. Each of its characters offers candidates: the letters it may stand for, or
nothing where it repeats its neighbour or only separates letters. Viterbi decoding over this
lattice, with a character trigram model counted from the corpus as prior and fixed channel costs,
restores the word. A word of plain letters offers one path only and passes unchanged. The restored
text is scored by the words and word beginnings in it: each has the log odds of a toxic label among
the training documents holding it, and a logistic model turns the strongest evidence of a text
into a probability.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import record_batch, shared_path, text_batches, without
from voxelmill.llm.hash_tables import find, load, save, segments, shard_of
from voxelmill.llm.text import NOT_BLANK, mix, text_buffer, words

# Letters that a digit or sign is used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SEPARATORS = "._-~'`^/\\"
#: Costs in natural-log units: a letter for a sign, a sign or a repeated letter left out, and in long or
#: spaced runs the blank or separator between two letters left out, or kept as the end of a word.
SWAP, DROP, REPEAT = 1.0, 0.5, 0.7
JOIN, PART = 0.2, 3.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, SYMBOLS = 26, 27, 28
#: Bytes of a run without blanks that is read as one word; a longer one may hold several.
LONGEST = 64
#: Single letters in a row that are read as one spaced word.
SPACED = 4
#: Lengths in bytes of the word beginnings that are evidence besides whole words.
PREFIXES = (4, 5, 6, 7)
#: Evidence is every word with more than these log odds whose rate of toxic documents lies above the average by
#: a bound of SURE standard deviations (Wilson's), however rare or many they are; labelled rows for the logistic model.
LEAST_ODDS, SURE, FIT_ROWS = 0.7, 4.0, 20_000
#: Pseudo-documents of average toxicity added to the counts of each word.
PRIOR = 10
#: Labelled rows that may be broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 2_000_000

_BLANKS = b" \t\n\v\f\r"
_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_HARD = np.isin(_BYTES, list(b"0123456789@$|+*#%"))
_SOFT = np.isin(_BYTES, list(b"!(<._-~'`^/\\"))


def trigram_counts(docs: DataFrame, text="text") -> DataFrame:
    """(gram, n): counts of the character trigrams of all words, at most SYMBOLS cubed rows."""
    code_of = np.full(256, OTHER, np.uint8)
    code_of[97:123] = np.arange(26)
    code_of[[32, *range(9, 14), *b".,;:!?\"()"]] = EDGE

    def run(batches):
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for b in text_batches(batches):
            w = words(b.column("text"), NOT_BLANK)
            if not len(w.hash):
                continue
            size = w.end - w.start
            spot = np.cumsum(size + 3) - (size + 3)  # two edges before a word and one behind
            code = np.full(spot[-1] + size[-1] + 3, EDGE, np.int64)
            inside = np.repeat(spot + 2 - (np.cumsum(size) - size), size) + np.arange(size.sum())
            code[inside] = code_of[w.buffer[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(size.sum())]]
            gram = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
            ok = (code[1:-1] != EDGE) | (code[2:] != EDGE)
            total += np.bincount(gram[ok], minlength=SYMBOLS ** 3)
        some = np.flatnonzero(total)
        yield record_batch(gram=some, n=total[some])
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts) -> np.ndarray:
    """Costs -log p(third | first two), interpolated with shorter contexts."""
    c = np.zeros(SYMBOLS ** 3)
    for gram, n in counts:
        c[gram] = n
    c = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    uni = c.sum((0, 1)) + 1
    uni /= uni.sum()
    two = c.sum(0)
    two = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    three = (c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20)
    return -np.log(three)


def lattice(word):
    """For each character its candidates: (letter, or None to drop the character; channel cost)."""
    out, before = [], ""
    for c in word:
        if c.isalpha():
            options = [(c, 0.0)] + [(None, REPEAT)] * (c == before)
        else:
            options = [(x, SWAP) for x in LOOKALIKES.get(c, "")]
            if c in SEPARATORS or c == before or not options:
                options.append((None, DROP))
        out.append(options)
        before = c
    return out


def decode(word, lm):
    """The plain word of least cost on the lattice of ``word``, by Viterbi search over letter pairs."""
    states = {(EDGE, EDGE): (0.0, "")}
    for options in lattice(word):
        after = {}
        for (a, b), (cost, text) in states.items():
            for letter, channel in options:
                if letter is None:
                    key, total, grown = (a, b), cost + channel, text
                else:
                    k = ord(letter) - 97 if letter in LETTERS else OTHER
                    key, total, grown = (b, k), cost + channel + lm[a, b, k], text + letter
                if key not in after or (total, grown) < after[key]:
                    after[key] = (total, grown)
        states = after
    return min((cost + lm[a, b, EDGE], text) for (a, b), (cost, text) in states.items())[1]


def decode_run(run, lm):
    """The words of least cost in a long run without blanks, or in letters parted by blanks.

    As ``decode``, but blanks and separators may also end a word, so bounds of words are restored. Two
    blanks in a row always do. Of each path only its last letter and the path before are kept, so
    memory and time grow with the length of the run and no more. Ties go to the path found first.
    """
    states = {(EDGE, EDGE): (0.0, None)}
    before = ""
    for i, c in enumerate(run):
        blank = c.isspace()
        if blank and before.isspace():
            options = [(" ", 0.0)]
        elif blank and run[i + 1:i + 2].isspace():
            options = [(" ", 0.0)]
        elif blank or c in SEPARATORS:
            options = [(None, JOIN), (" ", PART)]
        else:
            options = lattice(before + c)[-1] if before and not before.isspace() else lattice(c)[0]
        after = {}
        for (a, b), (cost, path) in states.items():
            for letter, channel in options:
                if letter is None:
                    key, total, grown = (a, b), cost + channel, path
                elif letter == " ":
                    inside = b != EDGE
                    key, total = (EDGE, EDGE), cost + channel + (lm[a, b, EDGE] if inside else 0.0)
                    grown = (path, letter) if inside else path
                else:
                    k = ord(letter) - 97 if letter in LETTERS else OTHER
                    key, total, grown = (b, k), cost + channel + lm[a, b, k], (path, letter)
                if key not in after or total < after[key][0]:
                    after[key] = (total, grown)
        states, before = after, c
    path = min(((cost + (lm[a, b, EDGE] if b != EDGE else 0.0), a, b) for (a, b), (cost, _) in states.items()))
    path, out = states[path[1], path[2]][1], []
    while path is not None:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out)).strip()


def _disguised(w):
    """Words with a sign or digit where a letter should be, or with a letter three times in a row."""
    buf, n = w.buffer, len(w.buffer)
    same_word = np.zeros(n + 1, np.int64)
    same_word[w.start] = 1
    owner = np.cumsum(same_word[:-1]) - 1
    letter, hard, soft = _LETTER[buf], _HARD[buf], _SOFT[buf]
    inside = NOT_BLANK[buf]
    spot = np.zeros(n, bool)
    if n > 1:
        next_to = inside[1:] & inside[:-1] & (owner[1:] == owner[:-1])
        spot[1:] |= next_to & ((letter[1:] & hard[:-1]) | (letter[:-1] & hard[1:]))
    if n > 2:
        two = next_to[1:] & next_to[:-1]
        spot[1:-1] |= two & letter[:-2] & soft[1:-1] & letter[2:]
        spot[1:-1] |= two & letter[1:-1] & (buf[1:-1] < 128) & (buf[:-2] == buf[1:-1]) & (buf[2:] == buf[1:-1])
    return np.unique(owner[spot])


def _spaced(w):
    """(first, last) words of runs of at least SPACED words of one character in one text."""
    size = w.end - w.start
    first = w.buffer[np.minimum(w.start, max(len(w.buffer) - 1, 0))] if len(size) else np.zeros(0, np.uint8)
    single = ((size == 1) & (_LETTER[first] | _HARD[first] | (first == 33))) | ((size == 2) & (first >= 128))
    edge = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        cut = [a, *(a + 1 + np.flatnonzero(np.diff(w.doc[a:b]))).tolist(), b]
        out += [(x, y) for x, y in zip(cut, cut[1:]) if y - x >= SPACED]
    return out


@lru_cache(maxsize=200_000)
def _word_restored(word, lm):
    return decode(word.decode(errors="replace"), lm.cost).encode()


def _restored(run, lm):
    if len(run) > LONGEST or any(b in run for b in _BLANKS):
        return decode_run(run.decode(errors="replace"), lm.cost).encode()
    return _word_restored(run, lm)


class LanguageModel:
    """A character model that can key the cache of restored words."""

    def __init__(self, cost):
        self.cost = cost


def restore(texts: pa.Array, lm: LanguageModel) -> pa.Array:
    """The texts with A-Z in lower case and disguised words restored; null texts become empty."""
    w = words(texts, NOT_BLANK)
    _, offsets = text_buffer(texts)
    data = w.buffer.tobytes()
    edits = [(a, b, data[a:b]) for a, b in zip(*(x[_disguised(w)].tolist() for x in (w.start, w.end)))]
    for x, y in _spaced(w):
        a, b = int(w.start[x]), int(w.end[y - 1])
        edits.append((a, b, data[a:b]))
    out, at = [], 0
    edits.sort()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        parts, pos = [], a
        while at < len(edits) and edits[at][0] < b:
            x, y, word = edits[at]
            at += 1
            if x < pos:
                continue
            core = word.strip(b".,;:!?\"()[]{}<>")
            parts += [data[pos:x], word.replace(core, _restored(core, lm), 1) if core else word]
            pos = y
        parts.append(data[pos:b])
        out.append(b"".join(parts))
    return pa.array(out, pa.binary()).cast(pa.string())


def evidence(texts: pa.Array):
    """Fingerprints of the words and word beginnings of each text, once per text: (value, text)."""
    w = words(texts, _LETTER)
    size = w.end - w.start
    values, owner = [w.hash], [w.doc]
    for p in PREFIXES:
        longer = np.flatnonzero(size > p)
        packed = np.full(len(longer), p, np.uint64)
        for j in range(p):
            packed |= w.buffer[w.start[longer] + j].astype(np.uint64) << np.uint64(8 * (j + 1))
        values.append(mix(packed))
        owner.append(w.doc[longer])
    value, doc = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh], doc[fresh]


@dataclass
class Model:
    lm: LanguageModel
    folder: str
    shards: int
    weights: np.ndarray

    def odds(self, value):
        """Log odds of sorted distinct fingerprints; 0 for those that are no evidence."""
        out = np.zeros(len(value))
        for s, a, b in segments(shard_of(value, self.shards)):
            table = load(self.folder, f"odds-{s}")
            if table:
                at, there = find(table, value[a:b])
                out[a:b] = np.where(there, table["odds"][at], 0.0)
        return out

    def strength(self, restored):
        """Per restored text: strongest log odds, sum of the positive log odds (logarithm), any evidence."""
        n = len(restored)
        value, doc = evidence(restored)
        known, place = np.unique(value, return_inverse=True)
        odds = self.odds(known)[place]
        doc, odds = doc[odds > 0], odds[odds > 0]
        top = np.zeros(n)
        np.maximum.at(top, doc, odds)
        return np.stack([top, np.log1p(np.bincount(doc, odds, n)), (top > 0).astype(float)], 1)

    def score(self, restored):
        x = self.strength(restored)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x, y, ridge=1e-2, steps=30):
    """Weights of a logistic model (intercept first) by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _save_odds(best: DataFrame, folder, shards):
    """Fingerprints and log odds as sorted arrays in the shared folder, one file a shard."""
    def deal(batches):
        for b in batches:
            yield record_batch(shard=pa.array(shard_of(b.column("f").to_numpy().view(np.uint64), shards), pa.int32()),
                               f=b.column("f"), odds=b.column("odds"))

    def write(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            shard, key, odds = (t.column(c).to_numpy() for c in ("shard", "f", "odds"))
            key = key.view(np.uint64)
            order = np.argsort(key)
            shard, key, odds = shard[order], key[order], odds[order]
            for s, a, b in segments(shard):
                save(folder, f"odds-{s}", key=key[a:b], odds=odds[a:b])
        yield record_batch(n=pa.array([sum(b.num_rows for b in held)], pa.int64()))
    dealt = best.mapInArrow(deal, "shard int, f long, odds double").repartition(shards, "shard")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def fit(docs: DataFrame, labelled: DataFrame, calibration: DataFrame, text="text", toxic="toxic") -> Model:
    """Learns from three tables: all texts (character model), labelled texts, further labelled texts.

    Rows with a null label teach nothing. Without labelled rows, or with one label only, every text
    scores the rate of the label (0.5 without any).
    """
    spark = docs.sparkSession
    lm = LanguageModel(language_model([tuple(r) for r in trigram_counts(docs, text).toLocalIterator()]))
    sent = spark.sparkContext.broadcast(lm)

    def pick(df):
        return df.select(F.col(text).cast("string").alias("text"), F.col(toxic).cast("int").alias("toxic")
                         ).filter("toxic is not null")

    def count(batches):
        for b in text_batches(batches):
            value, doc = evidence(restore(b.column("text"), sent.value))
            hot = b.column("toxic").to_numpy()[doc]
            keys, inverse = np.unique(value, return_inverse=True)
            yield record_batch(f=keys.view(np.int64), n=np.bincount(inverse, minlength=len(keys)),
                               t=np.bincount(inverse, hot, len(keys)).astype(np.int64))

    rows = pick(labelled)
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    base = (t + 0.5) / (n + 1)
    counted = rows.mapInArrow(count, "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rate = (F.col("t") + PRIOR * base) / (F.col("n") + PRIOR)
    odds = F.log(rate / (1 - rate)) - float(np.log(base / (1 - base)))
    share, half = F.col("t") / F.col("n"), SURE ** 2 / (2 * F.col("n"))
    least = (share + half - SURE * F.sqrt(share * (1 - share) / F.col("n") + half ** 2 / SURE ** 2)) / (1 + 2 * half)
    best = counted.select("f", odds.alias("odds"), least.alias("least")).filter(
        (F.col("odds") > LEAST_ODDS) & (F.col("least") > base)).select("f", "odds")
    model = Model(lm, shared_path(spark, "evidence"), int(spark.conf.get("spark.sql.shuffle.partitions")),
                  np.array([np.log(base / (1 - base)), 0, 0, 0]))
    _save_odds(best, model.folder, model.shards)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for b in text_batches(batches):
            x = shared.value.strength(restore(b.column("text"), shared.value.lm))
            yield record_batch(a=x[:, 0], b=x[:, 1], c=x[:, 2], toxic=b.column("toxic"))

    seen = pick(calibration)
    share = min(1.0, FIT_ROWS / max(seen.count(), 1))
    drawn = (seen.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
             .mapInArrow(measure, "a double, b double, c double, toxic int").limit(FIT_ROWS).toPandas())
    if drawn["toxic"].nunique() == 2:
        model.weights = logistic(drawn[["a", "b", "c"]].to_numpy(), drawn["toxic"].to_numpy())
    return model


def predict(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """Adds restored string, score double (0 to 1) and predicted int (score >= 0.5).

    Null and empty texts are empty texts: they score what no evidence means. Repeated rows get equal
    results; an empty table gives none. Columns of ``docs`` with one of the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, "restored", "score", "predicted")
    names = docs.columns

    def run(batches):
        m = sent.value
        for b in text_batches(batches, text):
            restored = restore(b.column(names.index(text)), m.lm)
            score = m.score(restored)
            yield record_batch(**{c: b.column(i) for i, c in enumerate(names)}, restored=restored,
                               score=score, predicted=pa.array(score >= 0.5).cast(pa.int32()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, restored string, score double, predicted int")


def with_labels(docs: DataFrame, labels: DataFrame, doc_id="doc_id", toxic="toxic") -> DataFrame:
    """Documents that have a label; a document labelled twice is toxic if one label says so."""
    one = labels.groupBy(F.col(doc_id)).agg(F.max(toxic).alias(toxic))
    if labels.count() <= BROADCAST_LABELS:
        one = F.broadcast(one)
    return without(docs, toxic).join(one, doc_id)
