"""Periodic runs of words by recompression.

The words of a batch of texts are one sequence of symbols, texts parted by symbols that occur once.
It is compressed in rounds: blocks (stretches of one symbol) become one symbol each, then pairs of
neighbours whose first is in the left and second in the right half of the alphabet. Equal stretches
are compressed alike but for a few symbols at their ends, so two places are compared symbol by
symbol where the grammar is coarse: climb while the symbols agree, descend where they differ. That
answers a longest common extension in as many steps as there are rounds, for all queries of a
batch together. Read backwards, the same grammar extends to the left.

A run of period p and at least LEAST_POWERS * p words agrees with itself p words on at three or more
successive multiples of p. Places where it does so twice in a row on that grid are candidates: about
n ln n comparisons a text. Their exact extensions are the maximal stretches of period p; of those
found with several periods the least one is kept.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.llm.common import record_batch, text_batches, without
from voxelmill.llm.text import mix, ranges

#: A run has at least LEAST_LENGTH words and LEAST_POWERS periods; the search needs four periods or more.
LEAST_LENGTH, LEAST_POWERS = 6, 4
#: Grid places compared at once, and rounds in which chains of agreeing places are extended one place each.
GRID, CHAIN_ROUNDS = 1 << 19, 4
#: Rounds after which a grammar is left as coarse as it is; about 45 halve a million symbols away.
ROUNDS = 200


def word_ids(texts: pa.Array):
    """The words (runs without blanks) of all texts as numbers by equality, first word of each text, dictionary."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    values, lengths = pc.list_flatten(split), pc.list_value_length(split).to_numpy()
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), lengths)[full]
    coded = values.filter(pa.array(full)).dictionary_encode()
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return coded.indices.to_numpy().astype(np.int64), first, coded.dictionary


@dataclass
class Level:
    """Symbols of one level and how they are grouped on the next one.

    ``length``: words of each symbol; ``parent``: its symbol on the next level; ``head``: whether it
    begins that; ``left``: symbols from here to the end of the parent; ``child``: for symbols of this
    level their first symbol on the level below.
    """
    symbol: np.ndarray
    length: np.ndarray
    child: np.ndarray
    parent: np.ndarray = None
    head: np.ndarray = None
    left: np.ndarray = None

    def group(self, head):
        """Joins the symbols up to the next head; gives the first places of the groups."""
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(head)))
        self.head = head
        self.parent = np.cumsum(head) - 1
        self.left = np.repeat(begin + size, size) - np.arange(len(head))
        return begin, size

    def mirrored(self, below=None, above=None):
        """The level read backwards, given the sizes of its neighbours."""
        n = len(self.symbol)
        # the first child from behind is the last one
        last = np.append(self.child[1:], below)[::-1] - 1 if below is not None else np.arange(n)[::-1]
        out = Level(self.symbol[::-1], self.length[::-1], (below if below is not None else n) - 1 - last)
        if self.parent is not None:
            head = np.append(self.head[1:], True)[::-1]
            out.group(head)
        return out


def _numbered(keys, start):
    """Numbers from ``start`` on for equal keys, and the next free number."""
    found, number = np.unique(keys, return_inverse=True)
    return number.reshape(-1) + start, start + len(found)


def grammar(symbols: np.ndarray) -> list:
    """Levels of the run-length grammar of a sequence, the sequence itself first.

    Odd steps join blocks, even steps pairs. It ends when no symbol occurs twice: nothing above
    could ever agree.
    """
    free = int(symbols.max()) + 1 if len(symbols) else 0
    levels = [Level(symbols, np.ones(len(symbols), np.int64), np.arange(len(symbols)))]
    for step in range(2 * ROUNDS):
        at = levels[-1]
        s = at.symbol
        if len(s) < 2 or np.bincount(s, minlength=1).max() < 2:
            break
        head = np.ones(len(s), bool)
        if step % 2 == 0:
            head[1:] = s[1:] != s[:-1]
        else:
            side = mix(s.astype(np.uint64) + np.uint64(step << 40))
            right = (side >> np.uint64(17)) & np.uint64(1) == 1
            head[1:] = ~(right[1:] & ~right[:-1])
        begin, size = at.group(head)
        new = s[begin].copy()
        many = size > 1
        if many.any():
            if step % 2 == 0:
                key = s[begin[many]] * (len(s) + 1) + size[many]
            else:
                key = s[begin[many]] * free + s[begin[many] + 1]
            new[many], free = _numbered(key, free)
        levels.append(Level(new, np.add.reduceat(at.length, begin), begin))
    return levels


def backwards(levels) -> list:
    """The same grammar for the sequence read from its end."""
    return [at.mirrored(len(levels[k - 1].symbol) if k else None) for k, at in enumerate(levels)]


def common_extensions(levels, x, y) -> np.ndarray:
    """Words from the places ``x`` and ``y`` on that agree; x and y differ in every pair.

    The sequence must end in a symbol that occurs once.
    """
    total = np.zeros(len(x), np.int64)
    a, b = x.astype(np.int64), y.astype(np.int64)
    stop = np.full(len(x), len(levels) - 1)
    live = np.arange(len(x))

    def advance(at, which, once):
        """Past the agreeing symbols of the queries ``which``: one, or as many as both groups have left."""
        i, j = a[which], b[which]
        n = 1 if once else np.minimum(at.left[i], at.left[j])
        total[which] += n * at.length[i]
        a[which], b[which] = i + n, j + n

    for k, at in enumerate(levels):
        top = at.parent is None
        for turn in range(1 << 62 if top else 4):
            same = at.symbol[a[live]] == at.symbol[b[live]]
            stop[live[~same]] = k
            live = live[same]
            if not len(live):
                break
            if top:
                advance(at, live, True)
                continue
            inner = live[~(at.head[a[live]] & at.head[b[live]])]
            if not len(inner):
                break
            # both climb together: those at a head wait while the others come to one
            advance(at, inner, k % 2 == 1)
        if not len(live):
            break
        if not top:
            a[live], b[live] = at.parent[a[live]], at.parent[b[live]]
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(stop >= k)
        if not len(down):
            continue
        at, below = levels[k], levels[k - 1]
        a[down], b[down] = at.child[a[down]], at.child[b[down]]
        same = down[below.symbol[a[down]] == below.symbol[b[down]]]
        if len(same):
            advance(below, same, k % 2 == 0)
    return total


def _grid(sizes, least_powers):
    """(first, period, places): the grids of all texts and periods, in parts of about GRID places.

    ``sizes``: words of each text. Yields the text, period and number of each place on its grid.
    """
    periods = sizes // least_powers
    period, text = ranges(np.ones(len(sizes), np.int64), periods)
    places = (sizes[text] - 1) // period  # i and i + p inside
    part = np.cumsum(places) // GRID
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        number, own = ranges(np.zeros(hi - lo, np.int64), places[lo:hi])
        yield text[lo:hi][own], period[lo:hi][own], number


def runs(ids: np.ndarray, first: np.ndarray, least_length=LEAST_LENGTH, least_powers=LEAST_POWERS):
    """(text, start, length, period) of all runs of the texts, sorted; ``first`` as in ``word_ids``."""
    sizes = np.diff(first)
    n_texts, n = len(sizes), int(sizes.sum())
    # a symbol of its own before, between and after the texts
    spot = np.arange(n) + np.repeat(np.arange(n_texts), sizes) + 1
    alone = int(ids.max()) + 1 if n else 0
    sequence = np.empty(n + n_texts + 1, np.int64)
    sequence[:] = alone
    mark = np.ones(len(sequence), bool)
    mark[spot] = False
    sequence[mark] = alone + np.arange(n_texts + 1)
    sequence[spot] = ids
    base = first[:-1] + np.arange(n_texts) + 1  # place of the first word of each text
    found = []
    for text, period, number in _grid(sizes, least_powers):
        i = base[text] + number * period
        # behind the text stands its closing symbol, so a place beyond it never agrees
        end = base[text] + sizes[text]
        agree = (sequence[i] == sequence[i + period]) & (sequence[i + period] == sequence[np.minimum(i + 2 * period, end)])
        text, i, period, number = (x[agree] for x in (text, i, period, number))
        if len(i):
            # places that follow each other on one grid are a chain: its first place and their number
            new = np.ones(len(i), bool)
            new[1:] = (text[1:] != text[:-1]) | (period[1:] != period[:-1]) | (number[1:] != number[:-1] + 1)
            at = np.flatnonzero(new)
            found.append(np.stack([text[at], i[at], period[at], np.diff(np.append(at, len(i)))]))
    if not found:
        return tuple(np.zeros((4, 0), np.int64))
    text, i, period, count = np.concatenate(found, 1)
    levels = grammar(sequence)
    behind, m = backwards(levels), len(sequence)
    rows = []
    for turn in range(CHAIN_ROUNDS + 1):
        if turn == CHAIN_ROUNDS:  # chains of many short stretches: every place on its own
            number, own = ranges(np.zeros(len(i), np.int64), count)
            text, period = text[own], period[own]
            i = i[own] + number * period
        right = common_extensions(levels, i, i + period)
        left = common_extensions(behind, m - i - period, m - i)
        start, length = i - left, left + period + right
        keep = length >= np.maximum(least_length, least_powers * period)
        rows.append(np.stack([text, start - base[text], length, period])[:, keep])
        if turn == CHAIN_ROUNDS:
            break
        # the places of the chain that lie in the stretch found are done
        done = (start + length - i) // period
        more = count > done
        text, i, period, count = text[more], (i + done * period)[more], period[more], (count - done)[more]
        if not len(i):
            break
    rows = np.concatenate(rows, 1)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)  # one stretch, several periods: the least
    return tuple(rows[:, fresh])


def _collapsed(ids, first, names, found) -> pa.Array:
    """The texts without the words that any run holds behind its first period, joined by single spaces."""
    text, start, length, period = found
    at = first[text] + start
    change = np.bincount(at + period, minlength=len(ids) + 1) - np.bincount(at + length, minlength=len(ids) + 1)
    stay = np.cumsum(change)[:len(ids)] == 0
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[stay]
    offsets = np.searchsorted(owner, np.arange(len(first)))
    words = names.take(pa.array(ids[stay]))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
    return pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())


def periodic_runs(docs: DataFrame, text="text", least_length=LEAST_LENGTH, least_powers=LEAST_POWERS) -> DataFrame:
    """``docs`` without its text, with n_words long, runs array<struct<start, length, period long>>, collapsed string.

    A run is a stretch of words (numbered from 0) with least period q and max(least_length,
    least_powers * q) words or more that no neighbouring word extends; runs are ordered by start, then
    period. ``collapsed`` holds the words that lie in no run or in the first period of all their runs.

    Words are compared exactly, case included. Null, empty and short texts have no run and collapse to
    their words (null: empty). Repeated rows get equal results, an empty table none. A text of any length
    is taken whole; memory grows with n log n. Columns of ``docs`` with one of the new names are replaced.
    """
    if least_powers < 4:
        raise ValueError("runs of less than four periods can lie between the places of the grid")
    docs = without(docs, "n_words", "runs", "collapsed").withColumn(text, F.col(f"`{text}`").cast("string"))
    fields = list(docs.schema)
    run = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
    at = docs.columns.index(text)

    def find(batches):
        for b in text_batches(batches, text):
            ids, first, names = word_ids(b.column(at))
            found = runs(ids, first, least_length, least_powers)
            ends = np.searchsorted(found[0], np.arange(b.num_rows + 1))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in found[1:]], fields=list(run))
            yield record_batch(
                **{f.name: b.column(i) for i, f in enumerate(fields) if i != at}, n_words=np.diff(first),
                runs=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), collapsed=_collapsed(ids, first, names, found))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields if f.name != text)
    return docs.mapInArrow(find, schema + "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
                                          "collapsed string")


def planted(text, h) -> Column:
    """The text with periodic tails planted by the number ``h`` (a column) of its row.

    Where h % 10 = 0, words from a on become those of a short stretch in turn: with g = h div 10 and n
    words, a = g % n and the period 1 + (n - a) div (3 + g % 8). Null stays null.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def tail(w):
        n, g = F.size(w), F.floor(h / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")
    # the words are bound once as the element of an array
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(F.transform(F.array(words), tail), F.lit(0))).otherwise(text)
