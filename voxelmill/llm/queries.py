"""Registered queries of the operators, each beside its SQL oracle where SQL can state it."""

from pyspark.sql import functions as F

from voxelmill.llm.common import fold, table

QUERIES = {}
ORACLES = {}

#: A-Z to lower case, nothing else: DuckDB's lower() also changes letters beyond ASCII.
SQL_WORDS = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')")


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@query("op2_decontamination", f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS.format('text')} AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item, {SQL_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS m,
               unnest(list_transform(range(1, greatest(len(w) - 11, 2)),
                                     lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS k
        FROM item WHERE len(w) > 0),
place AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i
          FROM doc, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT rid, i, place.m, item
        FROM place JOIN win ON win.m = place.m AND win.k = array_to_string(w[i:i + place.m - 1], ' ')),
covered AS (SELECT rid, count(DISTINCT p) AS n
            FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s
          FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit,
       coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(found.s, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
""")
def op2_decontamination(spark, sf_dir):
    """Benchmark passages in every document."""
    from voxelmill.llm.decontamination import digests, find_hits
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(find_hits(docs, table(spark, sf_dir, "benchmark")))


@query("op5_packing")
def op5_packing(spark, sf_dir):
    """Every document's pieces in sequences of 4096 tokens."""
    from voxelmill.llm.packing import pack, tokenized_pieces
    return pack(tokenized_pieces(table(spark, sf_dir, "documents")))


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """Tokens of every document, counted in flat token files."""
    from voxelmill.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard", f"""
WITH RECURSIVE doc AS (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc WHERE len(w) > 0)),
own AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS s FROM gram GROUP BY 1),
copy AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, s) AS copy_id FROM own),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN own x ON x.doc_id = a JOIN own y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc.doc_id, coalesce(copy_id, doc.doc_id) AS copy_id, least(doc.doc_id, coalesce(r.low, doc.doc_id)) AS class_id,
       coalesce(l.n, 0)::BIGINT AS n_links
FROM doc LEFT JOIN copy USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) r ON r.a = doc.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY 1) l ON l.a = doc.doc_id
""")
def op3_ngram_jaccard(spark, sf_dir):
    """Class and number of links of every document at Jaccard 0.8 on five-word n-grams."""
    from voxelmill.llm.ngram_jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row", "class_row")


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """Language of every document by the byte network, learned outside the held-out fold."""
    from voxelmill.llm.language_id import fit, predict
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.filter(fold("doc_id") != 0).select("doc_id", "text", "lang"))
    scored = predict(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    """Toxicity of every document; labels of fold 0 are never seen, those of fold 4 calibrate."""
    from voxelmill.llm.toxicity import fit, predict, with_labels
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = with_labels(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    model = fit(docs, labelled.filter(fold("doc_id").isin(1, 2, 3)), labelled.filter(fold("doc_id") == 4))
    return predict(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


@query("op7_nearest")
def op7_nearest(spark, sf_dir):
    """The ten nearest vectors of every hundredth embedding."""
    from voxelmill.llm.kmeans_tree import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_kneser_ney")
def op6_kneser_ney(spark, sf_dir):
    """Score of every document by the bigram model learned outside the held-out fold."""
    from voxelmill.llm.kneser_ney import fit, score
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.filter(fold("doc_id") != 1))
    return score(docs, model).withColumn("held_out", fold("doc_id") == 1)


@query("op9_paragraph_dedup")
def op9_paragraph_dedup(spark, sf_dir):
    """Passages that each document shares with others, and what of it is removed."""
    from voxelmill.llm.paragraph_dedup import shared_passages
    return shared_passages(table(spark, sf_dir, "documents")).drop("row")


#: The key of the registered query; a run on real data passes its own secret.
PII_KEY = b"registered query"


@query("op10_pii_surrogates")
def op10_pii_surrogates(spark, sf_dir):
    """Every document with its personal data replaced, and where the replacements stand."""
    from voxelmill.llm.pii import pseudonymize
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PII_KEY).withColumn("n_entities", F.size("entities"))


#: Runs without blanks, as all three queries below take for words.
SQL_RUNS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _sql_rules():
    """The threshold table as SQL over the measures."""
    from voxelmill.llm.quality_rules import RULES
    return " AND ".join([f"100 * {r.part} >= {r.least} * {r.whole}" for r in RULES if r.least is not None]
                        + [f"100 * {r.part} <= {r.most} * {r.whole}" for r in RULES if r.most is not None])


def _sql_stop_words():
    from voxelmill.llm.quality_rules import STOP_WORDS
    return ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


@query("op11_quality_rules", rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {SQL_RUNS.format('text')} AS w,
                    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
             FROM documents),
place AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM place),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM win WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
             length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
             len(list_filter(w, lambda x: trim(lower(x), '.,;:!?()"''') IN ({_sql_stop_words()})))::BIGINT AS n_stop_words,
             len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*\x{{2022}}]\s')))::BIGINT AS n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})\s*$')))::BIGINT AS n_ellipsis_lines
      FROM doc LEFT JOIN again USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules()} AS kept
FROM base
""")
def op11_quality_rules(spark, sf_dir):
    """Measures and verdict of the threshold table for every document, by Spark functions alone."""
    from voxelmill.llm.quality_rules import quality_rules
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept")


@query("op12_filter_audit", rf"""
WITH word AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {SQL_RUNS.format('text')} AS w FROM documents),
least AS (SELECT t, min(doc_id) AS low FROM word GROUP BY t),
label AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
doc AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, map {{
               'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
               'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
               'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(low < doc_id, false)}} AS f
        FROM word JOIN least USING (t) LEFT JOIN label USING (doc_id)),
kind AS (SELECT part, good, bad, f, count(*) AS c FROM doc GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
step AS (SELECT o, k, o[k] AS x, string_split(left(o, k - 1), '') AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS k)),
judged AS (SELECT part, o, k, x, c, good, bad, f[x] AS fails,
                  len(list_filter(earlier, lambda y: y <> '' AND f[y])) > 0 AS gone,
                  len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) = 1 AS once
           FROM kind, step),
counted AS (SELECT part, o, k, x, sum(CASE WHEN NOT gone AND NOT fails THEN c ELSE 0 END) AS kept,
                   sum(CASE WHEN NOT gone AND fails THEN c ELSE 0 END) AS removed,
                   sum(CASE WHEN gone AND fails THEN c ELSE 0 END) AS redundant,
                   sum(CASE WHEN once AND fails THEN c ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN NOT gone AND fails AND good THEN c ELSE 0 END) AS good_lost,
                   sum(CASE WHEN NOT gone AND fails AND bad THEN c ELSE 0 END) AS toxic_lost
            FROM judged GROUP BY part, o, k, x)
SELECT part, o AS filter_order, k::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
""")
def op12_filter_audit(spark, sf_dir):
    """What five filters remove in every order, by part and label."""
    from voxelmill.llm.filter_audit import audit
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# the checksum is worked out bit by bit, and equal words of a text are paired at every distance
@query("op13_periodic_runs", rf"""
WITH given AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_RUNS.format('text')} AS w,
                      list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1),
                                  lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                          lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r
               FROM documents),
named AS (SELECT *, xor(r, 4294967295) AS h, xor(r, 4294967295) // 10 AS g, len(w) AS n FROM given),
tail AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM named),
doc AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
               THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
                                   ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
               ELSE w END AS w FROM tail),
word AS (SELECT rid, n, i, w[i + 1] AS x FROM (SELECT rid, n, w, unnest(range(n)) AS i FROM doc)),
pair AS (SELECT a.rid, a.i, b.i - a.i AS p FROM word a JOIN word b ON a.rid = b.rid AND a.x = b.x AND a.i < b.i
         AND 4 * (b.i - a.i) <= a.n),
streak AS (SELECT rid, p, min(i) AS s, count(*) + p AS l
           FROM (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM pair)
           GROUP BY rid, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
run AS (SELECT rid, s, l, min(p) AS q FROM streak GROUP BY rid, s, l),
found AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t,
                 first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS top
          FROM run GROUP BY rid),
gone AS (SELECT rid, list(DISTINCT i) AS away FROM (SELECT rid, unnest(range(s + q, s + l)) AS i FROM run) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length,
       top.q::BIGINT AS period, (1000 * top.l // top.q)::BIGINT AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256,
       sha256(coalesce(array_to_string(CASE WHEN away IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(away, i - 1)) END,
                                       ' '), '')) AS collapsed_sha256
FROM doc LEFT JOIN found USING (rid) LEFT JOIN gone USING (rid)
""")
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of every document, some with planted tails, and its text without their repetitions."""
    from voxelmill.llm.periodic_runs import periodic_runs, planted
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", planted(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    found = periodic_runs(docs)
    # longest first, then earliest, then of least period: the greatest of these structs
    top = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    named = found.select("doc_id", "collapsed", "runs", F.inline_outer(F.array(top)).alias("length", "low", "period"))
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("low")).alias("start"), "length",
        (-F.col("period")).alias("period"), F.floor(1000 * F.col("length") / -F.col("period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
