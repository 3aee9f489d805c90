"""Text operators against plain Python versions and on odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import text as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
ODD = [None, "", "   ", "...", "a", "Ä-ß 1x", "one two three", "x" * 70_000, "tab\tnew\nline", "A b C d E f g",
       "same text again and again", "same text again and again"]
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma".split()


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def random_texts(n, words, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(VOCABULARY) for _ in range(words)) for _ in range(n)]


def documents(spark, texts, **extra):
    rows = [dict(doc_id=i, text=t, **{k: v[i] for k, v in extra.items()}) for i, t in enumerate(texts)]
    kinds = "doc_id long, text string" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([tuple(r.values()) for r in rows], kinds)


@pytest.fixture
def stored(spark, tmp_path):
    def store(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)
    return store


def test_words_match_pattern():
    w = T.words(pa.array(ODD))
    for i, t in enumerate(ODD):
        assert [w.text(j).decode() for j in range(w.first[i], w.first[i + 1])] == plain_words(t)
    again = T.words(pa.array(["theta mu", "mu"]))
    assert again.hash[1] == again.hash[2] != again.hash[0]


def test_ngrams_short_and_across_texts():
    h, doc, at = T.ngrams(T.words(pa.array(["a b c", "", "a b", "b c d e"])), 3)
    assert doc.tolist() == [0, 2, 3, 3] and len(set(h.tolist())) == 4


# ---- token counts

def test_token_files_with_documents_over_blocks(spark, stored):
    from voxelmill.llm.token_counts import document_spans, read_blocks, token_counts, write_token_files
    from voxelmill.llm.common import shared_path
    from voxelmill.llm.tokens import BYTE_BPE, byte_bpe, vocabulary_path
    texts = [*ODD, " ".join(VOCABULARY * 300)]
    docs = stored(documents(spark, texts, n_tokens=["clash"] * len(texts)))
    model = byte_bpe(vocabulary_path(BYTE_BPE))
    want = [len(model.encode_ordinary(t or "")) for t in texts]
    assert sorted(map(tuple, token_counts(docs).collect())) == list(enumerate(want))
    path = shared_path(spark, "tokens")
    write_token_files(stored(documents(spark, texts).coalesce(1)), path)
    spans = [document_spans(read_blocks(spark, path, block_tokens=b, whole_file=f)).orderBy("ordinal").drop("file").collect()
             for b, f in ((1 << 16, 1 << 28), (7, 1 << 28), (64, 1))]
    assert spans[0] == spans[1] == spans[2] and [r["n_tokens"] for r in spans[0]] == want
    assert token_counts(stored(docs.limit(0))).count() == 0


def test_token_file_without_last_end(spark):
    from voxelmill.llm.token_counts import document_spans
    blocks = spark.createDataFrame([("f", 2, 0, bytearray([1, 0, 0, 0])), ("f", 2, 1, bytearray([5, 0, 6, 0]))],
                                   "file string, block_tokens long, block long, bytes binary")
    got = [(r["start"], r["n_tokens"], r["ended"]) for r in document_spans(blocks).orderBy("start").collect()]
    assert got == [(0, 1, True), (2, 2, False)]


# ---- decontamination

def plain_hits(text, items, size=13):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        w = plain_words(item)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            window = w[i:i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j:j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    names.add(str(name))
    return len(words), len(hit), names


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_against_scan(spark, block):
    from voxelmill.llm.decontamination import digests, find_hits, item_digest
    items = [(i, t) for i, t in enumerate(random_texts(6, 20, 1))] + [(7, "short item"), (8, None), (9, ""), (None, "mu nu xi"), (7, "short item")]
    texts = random_texts(8, 60, 2) + ODD + [items[0][1] + " tail", "head " + items[1][1][30:], "a SHORT item, short item",
                                            items[2][1] + " " + items[3][1], items[0][1] + " tail", "mu nu xi"]
    docs = documents(spark, texts, item_id=["x"] * len(texts), words=["y"] * len(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = find_hits(docs, bench, block=block)
    got = {r["doc_id"]: r for r in hits.collect()}
    known = [x for x in items if x[0] is not None]
    for i, t in enumerate(texts):
        n, hit, names = plain_hits(t, known)
        assert (got[i]["n_words"], got[i]["n_hit"], set(got[i]["items"])) == (n, hit, names), t
        assert sum(s["last"] - s["first"] for s in got[i]["hits"]) == hit
    digest = {r["doc_id"]: r["items_sha256"] for r in digests(hits).collect()}
    assert digest[0] == item_digest(got[0]["items"]) and len(digest) == len(texts)
    assert find_hits(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert find_hits(docs.limit(0), bench).count() == 0


# ---- n-gram Jaccard join

def plain_sets(texts, size=5):
    out = []
    for t in texts:
        w = plain_words(t)
        out.append({tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    return out


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join_against_all_pairs(spark, stored, block, monkeypatch):
    from voxelmill.llm import minhash
    from voxelmill.llm.ngram_jaccard import near_duplicates
    monkeypatch.setattr(minhash.dealt_groups, "__defaults__", (block,))
    rng = random.Random(3)
    base = random_texts(6, 80, 4)
    texts = [*ODD, *base, *(edited(base[0], rng, rng.randrange(4)) for _ in range(20)),
             *(edited(base[1], rng, 1) for _ in range(5)), base[2], base[2].upper()]
    got = {r["doc_id"]: r for r in near_duplicates(stored(documents(spark, texts, row=["r"] * len(texts)))).collect()}
    sets = plain_sets(texts)
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i].add(j)
    group = list(range(len(texts)))
    for _ in group:
        for i in links:
            group[i] = min(group[i], *(group[j] for j in links[i]))
    assert [(got[i]["class_id"], got[i]["n_links"]) for i in range(len(texts))] == \
        [(group[i], len(links[i])) for i in range(len(texts))]
    assert near_duplicates(stored(documents(spark, []))).count() == 0


def test_bands_reach_recall():
    from voxelmill.llm.minhash import bands_for
    for threshold in (0.5, 0.8, 1.0):
        bands, rows = bands_for(threshold, 0.999)
        assert 1 - (1 - threshold ** rows) ** bands >= 0.999


def test_components(spark):
    from voxelmill.llm.components import components
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (60, 50), (70, 70), (None, 3)] + [(99, k) for k in range(80, 98)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 40, **{k: 80 for k in range(80, 98)}, 99: 80}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- language

def test_language_id(spark):
    from voxelmill.llm.language_id import fit, predict
    rng = random.Random(5)
    tongues = {"xx": "abcde", "yy": "vwxyz", "zz": "äöüßé"}
    texts, langs = [], []
    for _ in range(150):
        k = rng.choice(list(tongues))
        texts.append(" ".join("".join(rng.choice(tongues[k]) for _ in range(rng.randrange(2, 7))) for _ in range(30)))
        langs.append(k)
    docs = documents(spark, texts + ODD, lang=langs + [None] * len(ODD))
    net = fit(docs)
    rows = {r["doc_id"]: r for r in predict(docs, net).collect()}
    right = sum(rows[i]["lang_pred"] == k for i, k in enumerate(langs)) / len(langs)
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in rows.values())
    odd = {t: rows[len(langs) + i]["lang_pred"] for i, t in enumerate(ODD)}
    assert odd[None] == odd[""] == odd["..."] == "und" and odd["a"] in tongues
    unknown = predict(docs, fit(docs.filter("lang is null"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unknown] == ["und"]
    assert predict(docs.limit(0), net).count() == 0
    replaced = predict(docs.withColumn("score", F.lit("x")), net)
    assert dict(replaced.dtypes)["score"] == "double" and replaced.count() == len(texts) + len(ODD)


def test_network_gradients():
    from voxelmill.llm import language_id as L
    rng = np.random.default_rng(0)
    net = L.train([], [])
    net.languages, net.out, net.out_bias = ["a", "b"], rng.normal(size=(48, 2)), np.zeros(2)
    net.emb, net.filters, net.bias = (x.astype(float) for x in (net.emb, net.filters, net.bias))
    rows, y = rng.integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    mask = (net.filters != 0).astype(float)
    grads = L._gradients(net, rows, y, mask)

    def loss():
        return -np.log(net.probabilities(rows)[np.arange(5), y]).mean()
    for w, g in zip((net.emb, net.filters, net.bias, net.out, net.out_bias), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, w[at] = w[at], w[at] + 1e-5
        up = loss()
        w[at] = before - 1e-5
        down = loss()
        w[at] = before
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))


# ---- packing

def test_pieces_round_trip_and_packing(spark):
    from tokenizers import Tokenizer

    from voxelmill.llm.packing import pack, tokenized_pieces
    from voxelmill.llm.tokens import WORD_BPE, vocabulary_path
    texts = ODD + random_texts(40, 30, 6) + ["x y. z, <|endoftext|> <|ENDOFTEXT|>\x1c q", "É. é, don't"]
    docs = documents(spark, texts + texts[:3], length=["clash"] * (len(texts) + 3))
    packed = pack(tokenized_pieces(docs, capacity=64, keep_ids=True), capacity=64).collect()
    model = Tokenizer.from_file(vocabulary_path(WORD_BPE))
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
    for i, t in enumerate(texts + texts[:3]):
        rows = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows]).tolist()
        assert ids == model.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(r["length"] == 64 for r in rows[:-1]) and [r["start"] for r in rows] == [64 * k for k in range(len(rows))]
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(tokenized_pieces(docs.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    from voxelmill.llm.packing import Plan
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    counts[1:] = rng.integers(0, 9, 100) * (rng.random(100) < (0.2, 0.5, 1)[seed % 3])
    plan = Plan(counts, 100)
    used = Counter()
    for runs, times in plan.patterns:
        assert sum(length * copies for length, copies in runs) <= 100
        for length, copies in runs:
            used[length] += copies * times
    assert used == Counter({i: int(c) for i, c in enumerate(counts) if c})
    slots, sequences = plan.slots()
    bound = -(-int((counts * np.arange(101)).sum()) // 100)
    assert bound <= sequences <= bound * 1.2 + 1


def test_exact_complements_first():
    from voxelmill.llm.packing import Plan
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 6, 2, 5, 4, 1]] = [3, 3, 1, 2, 4, 1, 5]
    assert Plan(counts, 10).slots()[1] == math.ceil((counts * np.arange(11)).sum() / 10)


# ---- toxicity

def test_restoring_and_scoring(spark):
    from voxelmill.llm import toxicity as X
    clean = random_texts(300, 12, 8)
    rng = random.Random(9)
    toxic = [t + " " + rng.choice(("scoundrel", "villain")) + " omega" for t in random_texts(100, 10, 10)]
    docs = documents(spark, clean + toxic)
    labelled = docs.withColumn("toxic", (F.col("doc_id") >= len(clean)).cast("int"))
    model = X.fit(docs, labelled, labelled)
    lm = model.lm
    for word, plain in (("sc0undr3l", "scoundrel"), ("v1lla1n", "villain"), ("v i l l a i n", "villain"),
                        ("v.i.l.l.a.i.n", "villain"), ("scoundrelll", "scoundrel"), ("$coundrel", "scoundrel"), ("theta", "theta")):
        assert X.restore(pa.array([f"xi {word} mu"]), lm)[0].as_py() == f"xi {plain} mu"
    tests = ["pi rho v1ll4in sigma", "pi rho SCOUNDREL", "pi rho sigma", *ODD]
    got = [r["predicted"] for r in X.predict(documents(spark, tests), model).orderBy("doc_id").collect()]
    assert got == [1, 1] + [0] * (1 + len(ODD))
    blind = X.fit(docs, labelled.limit(0), labelled.limit(0))
    scores = X.predict(docs.limit(5), blind).select("score").collect()
    assert all(0 <= r[0] <= 1 for r in scores)


def test_long_and_spaced_runs_are_restored(spark):
    from voxelmill.llm import toxicity as X
    docs = documents(spark, random_texts(300, 12, 8) + ["you scoundrel you villain"] * 60)
    lm = X.LanguageModel(X.language_model([tuple(r) for r in X.trigram_counts(docs).collect()]))
    words = "scoundrel villain theta omega".split() * 110
    restore = lambda t: X.restore(pa.array([t]), lm)[0].as_py()
    spaced = "   ".join(" ".join(w) for w in words)
    assert len(spaced) > 4_000 and restore(spaced) == " ".join(words)
    assert restore("xi " + "_".join(w.replace("o", "0").replace("l", "1") for w in words) + " mu") == f"xi {' '.join(words)} mu"
    # without any wider gap the letters are all kept, parted where the language says so
    assert restore(" ".join("villain" * 40)).replace(" ", "") == "villain" * 40
    # plain letters of any length pass unchanged
    assert restore("theta " + "ab" * 3_000) == "theta " + "ab" * 3_000


def test_run_decoding_is_cheapest_path():
    from itertools import product

    from voxelmill.llm import toxicity as X
    lm = X.language_model([(i, (i * 7919) % 50) for i in range(X.SYMBOLS ** 3)])

    def cost_of(text):
        total = 0.0
        for word in text.split():
            code = [X.EDGE, X.EDGE, *(ord(c) - 97 for c in word), X.EDGE]
            total += sum(lm[a, b, k] for a, b, k in zip(code, code[1:], code[2:]))
        return total
    for run in ("a b c", "a_b-c", "t 0 p  x", "a1_b b"):
        options, before = [], ""
        for i, c in enumerate(run):
            if c == " " and (before == " " or run[i + 1:i + 2] == " "):
                options.append([(" ", 0.0)])
            elif c == " " or c in X.SEPARATORS:
                options.append([(None, X.JOIN), (" ", X.PART)])
            else:
                options.append(X.lattice(before + c)[-1] if before.strip() else X.lattice(c)[0])
            before = c
        best = min((sum(c for _, c in path) + cost_of("".join(x for x, _ in path if x)), "".join(x for x, _ in path if x))
                   for path in product(*options))
        got = X.decode_run(run, lm)
        assert got.split() == best[1].split(), run


def test_rare_evidence_counts(spark):
    """A word of three toxic documents is evidence, however many stronger ones there are."""
    from voxelmill.llm import toxicity as X
    clean, strong = random_texts(1_500, 12, 8), [f"word{k}" for k in range(30)]
    toxic = [f"{t} {w}" for k, w in enumerate(strong) for t in random_texts(4, 8, k)] + [f"{t} rarely" for t in random_texts(3, 8, 55)]
    docs = documents(spark, clean + toxic)
    labelled = docs.withColumn("toxic", (F.col("doc_id") >= len(clean)).cast("int"))
    model = X.fit(docs, labelled, labelled)
    texts = ["pi rho rarely", "pi rho sigma", "pi word7 rho", "pi rho once"]
    s = [r["score"] for r in X.predict(documents(spark, texts), model).orderBy("doc_id").collect()]
    assert s[0] > 5 * s[1] and s[2] > 5 * s[1] and s[3] == s[1]


def test_viterbi_is_cheapest_path():
    from itertools import product

    from voxelmill.llm import toxicity as X
    lm = X.language_model([(i, (i * 7919) % 50) for i in range(X.SYMBOLS ** 3)])
    for word in ("a1b", "he11o", "t-0-p", "aab*"):
        best = min(
            (sum(c for _, c in path) + sum(lm[a, b, k] for a, b, k in zip(code, code[1:], code[2:])), text)
            for path in product(*X.lattice(word))
            for text in ["".join(x for x, _ in path if x)]
            for code in [[X.EDGE, X.EDGE, *(ord(c) - 97 for c in text), X.EDGE]])
        assert X.decode(word, lm) == best[1]
