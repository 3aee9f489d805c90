"""Filter interaction audit by truth-table survival words.

FILTERS filters make 2^5 subsets. A document that fails the filters of the mask f survives a subset
S when f and S share none, so its failures are one 32-bit word: bit S is set when it survives S.
Counting, for every bit, the words that have it gives the survivors of all subsets at once. Each
task counts them positionally: carry-save adders (three words in, a sum and a carry word out) turn
blocks of words into a few weighted ones before single bits are looked at. Whatever is asked about
an order of the filters follows from the survivors of its beginnings, per part and label.
"""

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.llm.common import record_batch, written

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: Labelled rows that may be broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 2_000_000
#: Parts a task counts at once before it hands its counts on.
PARTS_HELD = 4_096


def survival_words() -> np.ndarray:
    """For each of the 32 masks of failed filters its word: bit S is set where the mask and S are disjoint."""
    mask, subset = np.arange(SUBSETS)[:, None], np.arange(SUBSETS)[None]
    return np.where(mask & subset == 0, np.uint32(1) << subset.astype(np.uint32), np.uint32(0)).sum(1, dtype=np.uint32)


def _adder(a, b, c):
    """Sum and carry words: at every bit the sum plus twice the carry is the number of ones."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, lowest first, by a tree of carry-save adders."""
    total, weight = np.zeros(32, np.int64), 1
    bits = np.arange(32, dtype=np.uint32)
    while len(words):
        carries = []
        while len(words) >= 3:
            third = len(words) // 3
            rest = words[3 * third:]
            low, high = _adder(words[:third], words[third:2 * third], words[2 * third:3 * third])
            carries.append(high)
            words = np.concatenate([low, rest])
        # at most two words of this weight are left
        total += weight * ((words[:, None] >> bits) & np.uint32(1)).sum(0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return total


def failures(text) -> dict:
    """Failure conditions of the filters that look at one text only, as columns."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {"A": n < LEAST_WORDS,
            "B": 100 * distinct < LEAST_DISTINCT * n,
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def _bit(name) -> int:
    return 1 << FILTERS.index(name)


def failure_masks(docs: DataFrame, doc_id="doc_id", text="text", part="lang") -> DataFrame:
    """(doc_id, part, mask): the failed filters of every row as bits; E is a copy of a text with a smaller id.

    Texts are compared by 128 bits of hashes. The least id of each text is aggregated map-side
    and joined back by text and id together, so the rows of a text with very many copies stay spread.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = sum((F.when(c, _bit(name)).otherwise(0) for name, c in failures(F.col("text")).items()), F.lit(0))
    # the texts are read once: the few bytes a row needs from here on are written
    rows = written(rows.select("doc_id", "part", own.alias("mask"), F.xxhash64("text").alias("h1"),
                               F.xxhash64(F.lit(1), "text").alias("h2")), "masks")
    least = rows.filter("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    first = least.withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["h1", "h2", "doc_id"], "left").select(
        "doc_id", "part", (F.col("mask") + F.when(copy, _bit("E")).otherwise(0)).alias("mask"))


def survivors(masks: DataFrame, labels: DataFrame, doc_id="doc_id", quality="quality", toxic="toxic") -> DataFrame:
    """(part, n, good, toxic): for every subset of filters the documents of the part that survive it.

    The three are arrays of 32 counts, placed by the subset's bits: all documents, those labelled
    of good quality, those labelled toxic.
    """
    one = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        one = F.broadcast(one)
    flags = ["good", "toxic"]
    marked = masks.join(one, "doc_id", "left").select(
        "part", "mask", *[F.coalesce(f, F.lit(0)).cast("int").alias(f) for f in flags])

    def count(batches):
        word_of, held = survival_words(), {}

        def flush():
            rows = [(p, *c) for p, c in held.items()]
            held.clear()
            return record_batch(part=pa.array([r[0] for r in rows], pa.string()),
                                **{k: pa.array([r[i].tolist() for r in rows], pa.list_(pa.int64()))
                                   for i, k in ((1, "n"), (2, "good"), (3, "toxic"))})
        for b in batches:
            words = word_of[b.column("mask").to_numpy()]
            good, bad = (b.column(f).to_numpy() == 1 for f in flags)
            names = b.column("part").dictionary_encode()
            own = names.indices.to_numpy()
            order = np.argsort(own, kind="stable")
            ends = np.searchsorted(own[order], np.arange(len(names.dictionary) + 1))
            for name, x, y in zip(names.dictionary.to_pylist(), ends, ends[1:]):
                at = order[x:y]
                found = np.stack([positional_popcount(words[i]) for i in (at, at[good[at]], at[bad[at]])])
                held[name] = held.get(name, 0) + found
            if len(held) >= PARTS_HELD:
                yield flush()
        yield flush()
    counted = marked.mapInArrow(count, "part string, n array<long>, good array<long>, toxic array<long>")
    sums = [F.array(*[F.sum(F.get(c, F.lit(s))) for s in range(SUBSETS)]).alias(c) for c in ("n", *flags)]
    return counted.groupBy("part").agg(*sums)


def _shapley(counts, x) -> Column:
    """Documents that filter x removes, summed over all orders: a set before it comes in |S|! (4 - |S|)! of them."""
    rest = [s for s in range(SUBSETS) if not s & x]
    terms = [factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1"))
             * (counts[s] - counts[s | x]) for s in rest]
    return sum(terms[1:], terms[0])


def filter_audit(survivors: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see ``audit``."""
    steps = []
    for order in permutations(FILTERS):
        for k, name in enumerate(order):
            before = sum(map(_bit, order[:k]))
            steps.append(f"struct('{''.join(order)}' AS filter_order, {k + 1} AS step, {before} AS before, {_bit(name)} AS x)")
    n = F.col("n")
    # per part, by the bit of the filter; the maps have five entries
    per_filter = {
        "failing": lambda x: n[0] - n[x],
        "unique_fails": lambda x: n[SUBSETS - 1 - x] - n[SUBSETS - 1],
        "shapley": lambda x: _shapley(n, x)}
    bits = [_bit(f) for f in FILTERS]
    tables = survivors.select("part", "n", "good", "toxic", *[
        F.create_map(*[y for x in bits for y in (F.lit(x), f(x))]).alias(f"of_{k}") for k, f in per_filter.items()])
    rows = tables.select("*", F.expr(f"inline(array({', '.join(steps)}))"))
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("before") + F.col("x"))
    return rows.select(
        "part", "filter_order", "step", F.get("n", F.col("before") + F.col("x")).alias("kept"), gone("n").alias("removed"),
        (F.col("of_failing")[F.col("x")] - gone("n")).alias("redundant"), F.col("of_unique_fails")[F.col("x")].alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.col("of_shapley")[F.col("x")].alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", part="lang", quality="quality",
          toxic="toxic") -> DataFrame:
    """What each filter does in every order: part, filter_order string, step int (from 1), and long counts
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty (and fails A only, and E beside another empty one), a null part the empty
    string. A null id is no smaller than another and copies nothing; rows of one id and text are
    no copies of each other. An id labelled twice has a label if one row says so. Without rows there
    is no part and no result. Texts of any length are judged whole. Other columns are not read.
    """
    return filter_audit(survivors(failure_masks(docs, doc_id, text, part), labels, doc_id, quality, toxic))
