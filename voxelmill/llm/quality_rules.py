"""Quality rules: a table of thresholds compiled into one projection of Spark functions.

A rule bounds the ratio of two counted measures of a text in hundredths. All measures are whole
numbers and bounds are compared after cross-multiplication, so no rounding decides a verdict. The
text is split into words and lines once; everything else reads these two arrays. There is no join,
exchange or user function: rows are judged where they are read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.llm.common import without

_BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window that may be repeated.
WINDOW = 3
#: Base rules: fewest words, and the most hundredths of the words that lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
_EDGE = ".,;:!?()\"'"

# Frequent function words of seven languages.
STOP_WORDS = """
the be to of and that have with for in is was it on as are this by from at or an
der die das und ist von mit für den ein eine zu im auf nicht sich auch dem des
le la les de et un une est que qui dans pour pas sur au plus par il
el los las y en es por para con del una no su
di che per non sono del della il lo
o os as um uma do da em com não
het een van dat niet op te zijn
""".split()

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
            "n_capitals", "n_digits", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """``least`` to ``most`` hundredths of ``part`` per ``whole``, both names of measures; None leaves an end open."""
    name: str
    part: str
    whole: str
    least: int = None
    most: int = None

    def holds(self) -> Column:
        part, whole = 100 * F.col(self.part), F.col(self.whole)
        ends = [c for bound, c in ((self.least, part >= whole * F.lit(self.least or 0)),
                                   (self.most, part <= whole * F.lit(self.most or 0))) if bound is not None]
        out = F.lit(True)
        for c in ends:
            out = out & c
        return out


#: The thresholds in use. Words of clean prose have 4 to 7 characters, a fifth of them are stop words.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1_200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("capitals", "n_capitals", "word_chars", None, 30),
    Rule("digits", "n_digits", "word_chars", None, 30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
)


def rules_from(rows) -> tuple:
    """Rules from rows (name, part, whole, least, most), as of a threshold table; unknown measures are an error."""
    rules = tuple(Rule(*r) for r in rows)
    for r in rules:
        if r.part not in MEASURES or r.whole not in MEASURES:
            raise ValueError(f"rule {r.name}: measures are {', '.join(MEASURES)}")
    return rules


def measured(docs: DataFrame, text="text") -> DataFrame:
    """``docs`` with the MEASURES of each whole text as long columns.

    n_words and word_chars (code points) are those of the runs without blanks; n_symbols counts the
    SYMBOLS; n_lines the newline-split lines with a word; n_dup_lines those equal to an earlier one;
    n_repeat_words the words in WINDOW-word windows that the text holds at least twice. Null and
    blank texts measure 0 throughout. Windows are compared by 64-bit hashes. Columns of ``docs``
    named like a measure are replaced; any others are carried along untouched.
    """
    docs = without(docs, *MEASURES)
    # everything but the text travels in one struct, so no name can clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # each array is read several times by the next step, which keeps Catalyst from computing it twice
    rows = rows.select("doc", "text", F.array_remove(F.split("text", _BLANK_RUN), "").alias("words"),
                       F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.withColumn("windows", F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, WINDOW)])))
    # equal windows become neighbours; a text without any is not sorted
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(
        F.transform("windows", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array()))
    beside = lambda k: F.get("sorted", k)["g"]
    rows = rows.withColumn("places", F.sort_array(F.transform(
        F.filter("sorted", lambda x, k: (beside(k - 1) == x["g"]) | (beside(k + 1) == x["g"])), lambda x: x["i"])))
    # a place covers the words up to the next place, WINDOW at most
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.concat_ws("", "words")),
        "n_symbols": F.regexp_count("text", F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("lines"),
        "n_stop_words": F.size(F.filter("words", lambda w: F.btrim(F.lower(w), F.lit(_EDGE)).isin(sorted(set(STOP_WORDS))))),
        "n_capitals": F.regexp_count("text", F.lit("[A-Z]")),
        "n_digits": F.regexp_count("text", F.lit("[0-9]")),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*\u2022]\s"))),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|\u2026)\s*$"))),
    }
    # generated columns: filters on them are not pushed into the arrays, where they would be computed anew
    found = F.inline(F.array(F.struct(*[counts[m].cast("long").alias(m) for m in MEASURES])))
    return rows.select("doc", found).select("doc.*", *MEASURES)


def base_failed() -> Column:
    """Too short, or mostly repetition."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean column."""
    out = ~base_failed()
    for r in rules:
        out = out & r.holds()
    return out


def failed_rules(rules=RULES) -> Column:
    """Names of the rules that a text breaks, the base rule first."""
    names = [F.when(base_failed(), F.lit("base")), *[F.when(~r.holds(), F.lit(r.name)) for r in rules]]
    return F.array_compact(F.array(*names))


def quality_rules(docs: DataFrame, rules=RULES, text="text") -> DataFrame:
    """``docs`` with MEASURES, base_failed and kept boolean, failed array<string>.

    Null, empty and short texts fail the base rule. A ratio with an empty whole holds. Ties with a
    bound hold. Repeated rows are judged alike, an empty table gives an empty one, a very long text
    costs its sorted windows. Columns of ``docs`` with one of the new names are replaced.
    """
    docs = without(docs, "base_failed", "kept", "failed")
    return measured(docs, text).withColumns({
        "base_failed": base_failed(), "kept": verdict(rules), "failed": failed_rules(rules)})
