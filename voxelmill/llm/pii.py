"""PII surrogates: keyed, type-consistent replacements that keep entities distinct.

Entities are found by patterns (mail addresses, phone numbers, IPv4 addresses, payment cards, secrets)
and names by title or by a known given name before a surname. A surrogate is the entity under a keyed permutation of all
entities of the same form: a Feistel network over its letters and digits, each staying in its class
(digit, small or capital letter, script), so that format, script and length are kept. Given names
are permuted within the list of their gender and script. A permutation cannot send two entities to
one surrogate, and the same entity gets the same surrogate wherever and however it is written.

A collision check over all distinct entities still verifies this; an entity that would be its own
surrogate exchanges it with another one.
"""

import hmac
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import record_batch, text_batches, without, written
from voxelmill.llm.text import text_buffer, words

# Given names by script and gender.
GIVEN_NAMES = {
    ("latin", "f"): "Anna Emma Julia Laura Maria Sarah Sophie Clara Helena Nina Elena Carla Alice Jane Mary Linda Susan".split(),
    ("latin", "m"): "Adam David Felix Hugo James John Karl Leon Lucas Martin Oscar Paul Peter Robert Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Μαρία Σοφία Κατερίνα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης".split(),
}
# Titles that are followed by a name.
TITLES = {"f": "Mrs Ms Miss Frau Mme Mlle Sra Señora Madame".split(), "m": "Mr Herr Monsieur Señor Sr Don".split(),
          "": "Dr Prof".split()}

ALPHABETS = {"digit": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "hex": "0123456789abcdef", "CYR": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "cyr": "абвгдежзийклмнопрстуфхцчшщыэюя",
             "GRE": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "gre": "αβγδεζηθικλμνξοπρστυφχψω",
             "LAT": "ÀÁÂÄÇÈÉÊÑÖÓÚÜ", "lat": "àáâäçèéêñöóúü"}
_CLASS = {c: k for k in ("digit", "lower", "upper", "CYR", "cyr", "GRE", "gre", "LAT", "lat") for c in ALPHABETS[k]}
ROUNDS = 8
#: Partners tried for an entity that is its own surrogate.
DRAWS = 20

_NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩЁА-Я](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_GIVEN = "|".join(sorted({n for v in GIVEN_NAMES.values() for n in v}, key=lambda n: (-len(n), n)))
_TITLE = "|".join(t for v in TITLES.values() for t in v)
#: Words before the ':' or '=' of a secret, and the pieces of them that are looked for.
_SECRET = r"password|passwd|pwd|passphrase|secret|token|(?:api|access|private|auth)[_ -]?key"
_SECRET_WORDS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "bearer",
                 "accesskey", "privatekey", "authkey"]
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"\bAKIA[0-9A-Z]{16}\b"),
    ("secret", rf"(?i:(?:{_SECRET})[\"']?[ \t]*[:=][ \t]*(?:bearer[ \t]+)?)(?P<q>[\"'])?"
               r"(?P<value>(?=\S*\w)(?(q)[^\"'\s]+|[^\"'\s,;&<>()]*[\w/+=-]))"),
    ("secret", r"(?i:\bbearer[ \t]+)(?P<bearer>[A-Za-z0-9._~+/-]{16,}=*)"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)"),
    ("card", r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,4}(?!\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("name", rf"\b(?:{_TITLE})\b\.? (?:{_NAME} )?{_NAME}"),
    ("name", rf"\b(?:{_GIVEN})\b {_NAME}"),
    ("given", rf"\b(?:{_GIVEN})\b"),
]
_LETTER = ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_FIND = re.compile("|".join(f"(?P<k{i}>{p})".replace(r"\1", rf"(?P=s{i})").replace("([ -]?)", f"(?P<s{i}>[ -]?)")
                            for i, (_, p) in enumerate(PATTERNS)))
#: Bytes taken along on both sides of a place that looks like an entity.
MARGIN = 80
_SIGN = np.zeros(256, bool)
_SIGN[list(b"@=0123456789")] = True


@lru_cache(maxsize=1)
def _name_hashes():
    names = [*(n for v in GIVEN_NAMES.values() for n in v), *(t for v in TITLES.values() for t in v), *_SECRET_WORDS]
    return np.unique(words(pa.array(names), _LETTER).hash)


def _places(w):
    """Bytes at which an entity may be: signs, digits, names, titles, key prefixes."""
    low = w.buffer
    hit = _SIGN[low]
    if len(low) > 3:
        hit[:-3] |= (low[:-3] == 97) & (low[1:-2] == 107) & (low[2:-1] == 105) & (low[3:] == 97)
    if len(w.hash):
        known = _name_hashes()
        at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
        hit[w.start[known[at] == w.hash]] = True
    return np.flatnonzero(hit)


def find(texts: pa.Array):
    """(text number, kind, first byte in the text, entity) of all entities, in order, not overlapping.

    Patterns run on the surroundings of likely places only, widened to the next blank.
    """
    raw, offsets = text_buffer(texts)
    w = words(texts, _LETTER)
    place = _places(w)
    if not len(place):
        return []
    doc = np.searchsorted(offsets, place, "right") - 1
    new = np.concatenate([[True], (np.diff(place) > 2 * MARGIN) | (np.diff(doc) > 0)])
    lead, tail = place[new], place[np.append(new[1:], True)]
    doc = doc[new]
    blank = np.flatnonzero((raw == 32) | (raw == 10) | (raw == 9) | (raw == 13))
    blank = np.concatenate([[-1], blank, [len(raw)]])
    first = blank[np.maximum(np.searchsorted(blank, lead - MARGIN) - 1, 0)] + 1
    last = blank[np.minimum(np.searchsorted(blank, tail + MARGIN), len(blank) - 1)]
    first, last = np.maximum(first, offsets[doc]), np.minimum(last, offsets[doc + 1])
    data, out, done = raw.tobytes(), [], -1
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()):
        part = data[a:b].decode()
        for m in _FIND.finditer(part):
            own = next((g for g in ("value", "bearer") if m[g] is not None), 0)  # a secret without its key word
            at = a + len(part[:m.start(own)].encode())
            if at >= done:
                out.append((d, PATTERNS[next(i for i in range(len(PATTERNS)) if m[f"k{i}"] is not None)][0],
                            at - int(offsets[d]), m[own]))
                done = at + len(m[own].encode())
    # a given name alone is a person only where the text also gives it with a title or surname
    people = {(d, word) for d, kind, _, e in out if kind == "name" for word in e.split(" ")}
    return [(d, "name" if kind == "given" else kind, at, e) for d, kind, at, e in out
            if kind != "given" or (d, e) in people]


class Surrogates:
    """Keyed permutations of entities; ``swapped`` are pairs that exchange their surrogates."""

    def __init__(self, key: bytes, swapped=None):
        self.key = key
        self.swapped = swapped or {}

    def __call__(self, kind, text):
        if self.swapped:
            other = self.swapped.get((kind, canonical(kind, text)))
            text = respelled(kind, text, other) if other else text
        return getattr(self, f"_{kind}")(text)

    def _number(self, tag, data, n):
        return int.from_bytes(hmac.digest(self.key, f"{tag}|{data}".encode(), "sha256")[:16], "big") % n

    def _permuted(self, tag, digits, radix):
        """A keyed permutation of all digit tuples of the given radixes."""
        half = len(digits) // 2
        if len(digits) == 1:
            order = sorted(range(radix[0]), key=lambda i: self._number(tag, i, 1 << 64))
            return [order[digits[0]]]
        a, b, ra, rb = digits[:half], digits[half:], radix[:half], radix[half:]
        for r in range(ROUNDS):
            mixed = hmac.digest(self.key, f"{tag}|{r}|{len(digits)}|{b}".encode(), "sha256")
            stream = mixed
            while len(stream) < 2 * len(a):
                stream += hmac.digest(self.key, stream, "sha256")
            a = [(x + (stream[2 * i] << 8 | stream[2 * i + 1])) % m for i, (x, m) in enumerate(zip(a, ra))]
            a, b, ra, rb = b, a, rb, ra
        return a + b if ROUNDS % 2 == 0 else b + a

    def _letters(self, tag, text, keep=()):
        """Permutes letters and digits within their classes; other characters and ``keep`` places stay."""
        at = [i for i, c in enumerate(text) if c in _CLASS and i not in keep]
        if not at:
            return text
        alphabets = [ALPHABETS[_CLASS[text[i]]] for i in at]
        new = self._permuted(f"{tag}|{''.join(x[0] for x in alphabets)}", [x.index(text[i]) for i, x in zip(at, alphabets)],
                             [len(x) for x in alphabets])
        out = list(text)
        for i, x, n in zip(at, alphabets, new):
            out[i] = x[n]
        return "".join(out)

    def _email(self, text):
        low = text.lower()
        top = low.rindex(".")
        new = self._letters("email", low[:top]) + low[top:]
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, text))

    def _phone(self, text):
        digits = [c for c in text if c.isdigit()]
        keep = len(re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)[0]) - 1
        return _refill(text, "".join(digits[:keep]) + self._letters("phone", "".join(digits[keep:])))

    def _card(self, text):
        digits = "".join(c for c in text if c.isdigit())
        off = (int(digits[-1]) - _check_digit(digits[:-1])) % 10  # 0: a valid number, and stays one
        body = digits[0] + self._letters("card", digits[1:-1])
        return _refill(text, body + str((_check_digit(body) + off) % 10))

    def _ip(self, text):
        return ".".join(map(str, self._permuted("ip", [int(x) for x in text.split(".")], [256] * 4)))

    def _secret(self, text):
        if text.startswith("AKIA"):
            return "AKIA" + self._letters("secret", text[4:])
        hexadecimal = re.compile(r"[0-9a-f]+")
        if hexadecimal.fullmatch(text):
            new = self._permuted(f"hex|{len(text)}", [int(c, 16) for c in text], [16] * len(text))
            return "".join(ALPHABETS["hex"][n] for n in new)
        # on until the surrogate is none of the other two forms, so that all three stay permutations
        new = self._letters("secret", text)
        while new.startswith("AKIA") or hexadecimal.fullmatch(new):
            new = self._letters("secret", new)
        return new

    def _name(self, text):
        m = re.match(rf"((?:{_TITLE})\b\.? )?(.*)", text, re.S)
        title, words = m[1] or "", m[2].split(" ")
        out = []
        for i, w in enumerate(words):
            pool = _pool(w) if i == 0 else None
            out.append(pool[self._permuted(f"given|{pool[0]}", [pool.index(w)], [len(pool)])[0]] if pool
                       else self._letters("surname", w))
        return title + " ".join(out)


def _pool(word):
    return next((v for v in GIVEN_NAMES.values() if word in v), None)


def _refill(text, digits):
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _check_digit(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def canonical(kind, text):
    """The form under which two spellings are the same entity."""
    if kind in ("phone", "card"):
        return "".join(c for c in text if c.isdigit())
    if kind == "name":
        return re.sub(rf"^(?:{_TITLE})\b\.? ", "", text)
    return text.lower() if kind == "email" else text


def respelled(kind, text, other):
    """The entity ``other``, in canonical form, written the way ``text`` is."""
    if kind in ("phone", "card"):
        return _refill(text, other)
    if kind == "name":
        return text[:len(text) - len(canonical(kind, text))] + other
    return "".join(n.upper() if o.isupper() else n for n, o in zip(other, text)) if kind == "email" else other


def replace(texts: pa.Array, surrogates):
    """The texts with their entities replaced, and for each the (kind, start, length) in the new text."""
    found = find(texts)
    new, spans = texts.to_pylist(), [[] for _ in range(len(texts))]
    i = 0
    while i < len(found):
        d = found[i][0]
        data, parts, at, size = new[d].encode(), [], 0, 0
        while i < len(found) and found[i][0] == d:
            _, kind, start, entity = found[i]
            before, surrogate = data[at:start].decode(), surrogates(kind, entity)
            parts += [before, surrogate]
            spans[d].append((kind, size + len(before), len(surrogate)))
            size += len(before) + len(surrogate)
            at = start + len(entity.encode())
            i += 1
        new[d] = "".join([*parts, data[at:].decode()])
    return new, spans


def entities(docs: DataFrame, key: bytes, text="text") -> DataFrame:
    """Distinct (kind, original, surrogate) of all texts, in canonical form."""
    def run(batches):
        s = Surrogates(key)
        for b in text_batches(batches):
            seen = {(k, e) for _, k, _, e in find(b.column("text"))}
            rows = sorted({(k, canonical(k, e), canonical(k, s(k, e))) for k, e in seen})
            yield record_batch(**{c: pa.array([r[i] for r in rows], pa.string())
                                  for i, c in enumerate(("kind", "original", "surrogate"))})
    return (docs.select(F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "kind string, original string, surrogate string").distinct())


def swaps(docs: DataFrame, key: bytes, text="text") -> dict:
    """The collision check: entities that must exchange surrogates so that none is its own.

    Fails if two entities share a surrogate, which a permutation rules out. An entity that is its own
    surrogate swaps with another entity of its form, in the text or not; the result is a permutation
    again. A permutation has one fixed point on average, however large its set, so what comes to the
    driver is about one entity for each form, not a share of the data. An entity without any letter
    or digit to permute stays as it is.
    """
    found = written(entities(docs, key, text), "entities")
    shared = found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1").first()
    if shared:
        raise ValueError(f"two entities of kind {shared['kind']} share a surrogate")
    out = {}
    for kind, entity in sorted((r["kind"], r["original"]) for r in found.filter("original = surrogate").toLocalIterator()):
        for draw in range(DRAWS):
            other = Surrogates(hmac.digest(key, b"draw %d" % draw, "sha256"))
            partner = canonical(kind, other(kind, entity))
            if partner != entity and not {(kind, entity), (kind, partner)} & out.keys():
                out[kind, entity], out[kind, partner] = partner, entity
                break
    return out


def pseudonymize(docs: DataFrame, key: bytes, text="text", check=True) -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and a column entities array<struct<kind, start, length>>.

    The replaced text takes the place of the old one; places count its characters. Null texts stay
    null, empty and clean ones as they are. Equal rows get equal results; an empty table gives none.
    ``key`` decides all surrogates. A column ``entities`` of ``docs`` is replaced.
    """
    docs = without(docs, "entities")
    names = docs.columns
    swapped = swaps(docs, key, text) if check else {}
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches):
        s = Surrogates(key, swapped)
        for b in text_batches(batches, text):
            new, spans = replace(b.column(names.index(text)), s)
            yield record_batch(**{c: pa.array(new, pa.string()) if c == text else b.column(i) for i, c in enumerate(names)},
                               entities=pa.array([[dict(zip(("kind", "start", "length"), x)) for x in own]
                                                  for own in spans], kinds))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != text else 'string'}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, entities array<struct<kind:string,start:int,length:int>>")
