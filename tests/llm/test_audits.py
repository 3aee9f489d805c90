"""Quality rules, filter audit and periodic runs against plain Python versions and on odd input."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_text_operators import ODD, documents, random_texts

RUN = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 9_001} the" for i in range(120_000))


# ---- quality rules

def plain_measures(text):
    text = text or ""
    w = RUN.findall(text)
    lines = [x for x in text.split("\n") if RUN.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    return dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall("[#*$%&|<>]", text)),
                n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(hit), n_lines=len(lines),
                n_capitals=len(re.findall("[A-Z]", text)), n_digits=len(re.findall("[0-9]", text)))


QUALITY_TEXTS = [*ODD, *random_texts(6, 80, 3), "a b c " * 40, "a b c a b c d a b", "x y\nx y\n\nz\nx y", "#$% && ** <b>|",
                 "non breaking \x1c odd\x85blanks", "- one\n• two\n* three\n-four", "end...\nmore… \nno", "\U0001f600 " * 60]


def test_quality_measures_against_plain(spark):
    from voxelmill.llm.quality_rules import LEAST_WORDS, MEASURES, quality_rules
    texts = [*QUALITY_TEXTS, LONG]
    docs = documents(spark, texts, n_words=["clash"] * len(texts), kept=["x"] * len(texts), words=["stays"] * len(texts),
                     text_=["y"] * len(texts))
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_measures(t)
        assert {k: got[i][k] for k in want} == want, t[:80] if t else t
        failed = want["n_words"] < LEAST_WORDS or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i]["base_failed"] == failed and got[i]["words"] == "stays" and got[i]["text"] == t
        assert got[i]["kept"] == (got[i]["failed"] == []) and (not failed or got[i]["failed"][0] == "base")
    lines = {t: got[i] for i, t in enumerate(texts)}
    assert lines["- one\n• two\n* three\n-four"]["n_bullet_lines"] == 3
    assert lines["end...\nmore… \nno"]["n_ellipsis_lines"] == 2
    assert got[0]["n_stop_words"] == 0 and got[len(texts) - 1]["n_stop_words"] == 120_000
    assert quality_rules(docs.limit(0)).count() == 0
    assert all(quality_rules(docs).schema[m].dataType.simpleString() == "bigint" for m in MEASURES)


def test_quality_plan_is_one_projection(spark):
    from voxelmill.llm.quality_rules import quality_rules
    out = quality_rules(documents(spark, ["a"])).filter("kept and n_words > 3")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    # a filter on the result stays above the arrays: they are computed once
    assert plan.count("sort_array(") == 2 and plan.count("array_remove(") == 1


def test_quality_thresholds(spark):
    from voxelmill.llm.quality_rules import Rule, quality_rules, rules_from
    clean = " ".join(f"the word{i} of" for i in range(40))
    texts = [clean, clean + " " + "# " * 15, " ".join(f"Zorblex{i} quuxify{i}" for i in range(40)), clean.upper(),
             "\n".join(["the same line of words here"] * 3 + [f"the alpha{i} beta{i} of gamma{i}" for i in range(12)]),
             " ".join(f"the {i * 1000003} of" for i in range(40))]
    failed = [r["failed"] for r in quality_rules(documents(spark, texts)).orderBy("doc_id").collect()]
    assert failed == [[], ["symbols"], ["stop_words"], ["capitals"], [], ["digits"]]
    # a tie with a bound holds; a ratio of nothing holds
    edge = rules_from([("most", "n_symbols", "n_words", None, 10), ("least", "n_symbols", "n_words", 10, None)])
    tie = " ".join([f"w{i}" for i in range(90)] + ["#"] * 5 + ["|x", "|y", "|z", "&a", "&b"])
    rows = quality_rules(documents(spark, [tie, tie + " more", ""]), edge).orderBy("doc_id").collect()
    assert [r["failed"] for r in rows] == [[], ["least"], ["base"]]
    with pytest.raises(ValueError):
        rules_from([Rule("x", "no_such", "n_words").__dict__.values()])


# ---- filter audit

def plain_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1}
    bad = {d for d, _, t in labels if t == 1}
    docs = []
    for d, text, lang in rows:
        t = text or ""
        w = RUN.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)),
                 "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)}
        docs.append((lang or "", fails, d in good and d is not None, d in bad and d is not None))
    out = {}
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        taken = Counter()
        for order in itertools.permutations("ABCDE"):
            live = own
            for k, x in enumerate(order):
                gone = [y for y in live if y[1][x]]
                live = [y for y in live if not y[1][x]]
                taken[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(live), len(gone), sum(y[1][x] for y in own) - len(gone),
                    sum(y[1][x] and sum(y[1].values()) == 1 for y in own), sum(y[2] for y in gone), sum(y[3] for y in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(taken[key[1][key[2] - 1]])
    return out


def test_audit_against_plain(spark):
    from voxelmill.llm.filter_audit import audit
    rng = random.Random(7)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [None, "", "a", long, long + " #", "a b " * 150, long.upper(), "A#", "a b " * 150 + "|", LONG]
    rows = [(i if i % 9 else None, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(80)]
    rows += [rows[1], rows[1], (5, long, "fr"), (5, long, "fr"), (5, "other", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, mask string")
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = audit(docs, marks).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        assert list(r[3:]) == want[r["part"], r["filter_order"], r["step"]], r
    assert audit(docs.limit(0), marks).count() == 0
    assert sum(r["good_lost"] + r["toxic_lost"] for r in audit(docs, marks.limit(0)).collect()) == 0


def test_positional_popcount():
    from voxelmill.llm.filter_audit import positional_popcount, survival_words
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 1000, 4_097):
        x = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert positional_popcount(x).tolist() == [int(((x >> np.uint32(k)) & np.uint32(1)).sum()) for k in range(32)]
    for mask, word in enumerate(survival_words().tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(mask & s == 0) for s in range(32)]


# ---- periodic runs

def plain_runs(w, least=6, powers=4):
    n, out = len(w), set()
    for p in range(1, n // powers + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, powers * p):
                q = next(q for q in range(1, p + 1) if all(w[t] == w[t + q] for t in range(i, j + p - q)))
                if q == p:
                    out.add((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_texts(rng, n):
    for _ in range(n):
        size, letters = rng.randint(0, 150), rng.randint(1, 4)
        w = [rng.choice("abcd"[:letters]) for _ in range(size)]
        if size and rng.random() < 0.6:
            a, p = rng.randrange(size), rng.randint(1, max(1, size // 4))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        yield w


def test_runs_against_plain():
    from voxelmill.llm import periodic_runs as P
    rng = random.Random(5)
    for _ in range(60):
        texts = [" ".join(w) for w in periodic_texts(rng, rng.randint(1, 6))]
        ids, first, _ = P.word_ids(pa.array(texts))
        found = P.runs(ids, first)
        for i, t in enumerate(texts):
            own = [tuple(int(x[j]) for x in found[1:]) for j in np.flatnonzero(found[0] == i)]
            assert own == plain_runs(t.split()), t


def test_chains_with_many_breaks(monkeypatch):
    from voxelmill.llm import periodic_runs as P
    rng = random.Random(8)
    monkeypatch.setattr(P, "GRID", 50)
    w = ["x" if i % 5 == 0 else rng.choice("ab") for i in range(400)]
    ids, first, _ = P.word_ids(pa.array([" ".join(w)]))
    assert [tuple(map(int, r)) for r in zip(*P.runs(ids, first)[1:])] == plain_runs(w)


def test_common_extensions():
    from voxelmill.llm import periodic_runs as P
    rng = np.random.default_rng(3)
    for letters in (1, 2, 3, 50):
        s = np.concatenate([[1000], rng.integers(0, letters, 500), [1001]])
        levels = P.grammar(s)
        x, y = (np.sort(rng.integers(1, 501, (2, 300)), 0))
        x, y = x[x < y], y[x < y]
        plain = [next(k for k in range(600) if s[a + k] != s[b + k]) for a, b in zip(x, y)]
        assert P.common_extensions(levels, x, y).tolist() == plain
        m = len(s)
        back = [next(k for k in range(600) if s[a - k] != s[b - k]) for a, b in zip(x, y)]
        assert P.common_extensions(P.backwards(levels), m - 1 - y, m - 1 - x).tolist() == back
        # the levels spell the sequence
        for k, at in enumerate(levels):
            assert at.length.sum() == m and (k == 0 or at.child[0] == 0)


def test_periodic_runs_on_rows(spark):
    from voxelmill.llm.periodic_runs import periodic_runs
    rng = random.Random(11)
    texts = [*ODD, *(" ".join(w) for w in periodic_texts(rng, 30)), "A a A a A a A a", "x\ty\nx  y \x0cx y x y x y x y x y",
             "la " * 100_000, LONG, "x" * 300_000 + " y", "a a a a a", "a a a a a a"]
    docs = documents(spark, texts, runs=["clash"] * len(texts), n_words=["clash"] * len(texts), period=[None] * len(texts))
    got = {r["doc_id"]: r for r in periodic_runs(docs).collect()}
    assert len(got) == len(texts) and "text" not in periodic_runs(docs).columns
    for i, t in enumerate(texts):
        w = RUN.findall(t or "")
        found = [tuple(r) for r in got[i]["runs"]]
        # the long texts are periodic as a whole, the last one after 9,001 pairs of words
        want = plain_runs(w) if len(w) < 1000 else [(0, 100_000, 1)] if t.startswith("la") else [(0, 240_000, 18_002)]
        assert found == want and got[i]["n_words"] == len(w) and got[i]["collapsed"] == plain_collapse(w, want)
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, least_powers=3)


def test_planted_tails(spark):
    from pyspark.sql import functions as F

    from voxelmill.llm.periodic_runs import planted
    texts = [*random_texts(40, 30, 9), None, "", "one", "a\n\nb  c"] * 3
    docs = documents(spark, texts)
    got = docs.select("doc_id", planted(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("t")).collect()
    some = 0
    for r in got:
        t, h = texts[r["doc_id"]], zlib.crc32(str(r["doc_id"]).encode())
        w, g = RUN.findall(t or ""), h // 10
        if h % 10 or not w:
            assert r["t"] == t if not (h % 10 == 0 and t == "") else r["t"] == ""
            continue
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert r["t"].split(" ") == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        some += 1
    assert some > 5
