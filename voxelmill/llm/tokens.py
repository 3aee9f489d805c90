"""Token ids of public vocabularies inside tasks."""

import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from voxelmill.llm.text import LOWER, ranges, text_buffer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"

_BYTES = np.arange(256)
BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
ASCII_ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))


def vocabulary_path(name, folder=None):
    """The file of a vocabulary; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


class WordBpe:
    """Ids of a vocabulary that drops blanks, lower-cases and never joins text across blanks or
    between a letter and a following point or comma.

    Such a text's ids are those of its blank-separated chunks, so frequent chunks are encoded
    once per worker. When more than ``cache`` chunks are held, those seen least are let go.
    """

    JOIN = "<|endoftext|>"

    def __init__(self, path, cache=400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.closing = np.zeros(self.model.get_vocab_size(), bool)
        self.closing[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.cache = cache
        self.index = {}
        self.used = 0
        self.pool = np.zeros(1 << 20, np.uint32)
        self.start, self.size, self.seen = (np.zeros(1 << 18, np.int64) for _ in range(3))

    def _ids(self, text):
        return np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, chunks):
        """Encodes unknown chunks, many at once.

        A chunk of letters only is one word, and a word's last id is one that ends words: such chunks
        are joined by blanks and told apart by these ids. Others stand between special tokens.
        """
        words, other = [], []
        for c in chunks:
            (words if c.decode().isalpha() else other).append(c)
        for i in range(0, len(words), 5_000):
            part = words[i:i + 5_000]
            ids = self._ids(b" ".join(part).decode())
            end = np.flatnonzero(self.closing[ids]) + 1
            if len(end) == len(part) and end[-1] == len(ids):
                first = np.concatenate([[0], end[:-1]])
                self._add(part, ids, first, end - first)
            else:  # a letter that the vocabulary's pattern takes for something else
                other += part
        join_id, join = self.model.token_to_id(self.JOIN), self.JOIN.encode()
        for i in range(0, len(other), 5_000):
            part = other[i:i + 5_000]
            ids = self._ids(join.join(part).decode())
            cut = np.flatnonzero(ids == join_id)
            first = np.concatenate([[0], cut + 1])
            self._add(part, ids, first, np.concatenate([cut, [len(ids)]]) - first)

    def _add(self, chunks, ids, first, size):
        n = len(self.index)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(chunks) > len(self.start):
            self.start, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)])
                                                for x in (self.start, self.size, self.seen))
        self.pool[self.used:self.used + len(ids)] = ids
        self.start[n:n + len(chunks)] = first + self.used
        self.size[n:n + len(chunks)] = size
        self.seen[n:n + len(chunks)] = 0
        self.index.update(zip(chunks, range(n, n + len(chunks))))
        self.used += len(ids)

    def _forget(self):
        seen = self.seen[:len(self.index)]
        least = np.sort(seen)[len(seen) // 2] + 1
        keep = np.flatnonzero(seen >= least)
        chunks = np.fromiter(self.index, object, len(seen))[keep].tolist()
        flat, _ = ranges(self.start[keep], self.size[keep])
        ids, size, weight = self.pool[flat], self.size[keep], seen[keep] // 2
        self.index, self.used = {}, 0
        self._add(chunks, ids, np.cumsum(size) - size, size)
        self.seen[:len(keep)] = weight

    def encode(self, texts: pa.Array):
        """All ids one after the other and the number of ids of each text (null: empty)."""
        raw, offsets = text_buffer(texts)
        low = LOWER[raw]
        odd = {}
        if b"<|" in low.tobytes():  # perhaps the name of a special token: such texts go their own way
            for i, t in enumerate(texts.to_pylist()):
                if t and "<|" in t:
                    odd[i] = self._ids(t)
                    low[offsets[i]:offsets[i + 1]] = 32
        # a blank before a closing point or comma, and a line end behind each text
        mark = np.flatnonzero((low == 44) | (low == 46))
        mark = mark[(mark > 0) & (mark + 1 < len(low))]
        mark = mark[ASCII_ALNUM[low[mark - 1]] & BLANK[low[mark + 1]]]
        put = np.concatenate([mark, offsets[1:]])
        order = np.argsort(put, kind="stable")
        low = np.insert(low, put[order], np.where(order < len(mark), 32, 10).astype(np.uint8))
        chunks = low.tobytes().split()
        solid = ~BLANK[low]
        begin = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        ends = np.searchsorted(begin, offsets[1:] + np.searchsorted(mark, offsets[1:]) + np.arange(len(texts)))
        if len(self.index) > self.cache:
            self._forget()
        get = self.index.get
        at = np.fromiter(map(get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [chunks[i] for i in missing.tolist()]
            self._learn(list(set(unknown)))
            at[missing] = np.fromiter(map(get, unknown), np.int64, len(unknown))
        np.add.at(self.seen, at, 1)
        size = self.size[at]
        flat, _ = ranges(self.start[at], size)
        ids = self.pool[flat]
        total = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(total[np.concatenate([[0], ends])])
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [odd.get(i, p) for i, p in enumerate(parts)]
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(maxsize=2)
def word_bpe(path):
    return WordBpe(path)


@lru_cache(maxsize=2)
def byte_bpe(path):
    """A byte-level vocabulary; its ids cover every text."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


