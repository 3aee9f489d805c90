"""A training corpus from raw documents, stage by stage.

Every stage works on all rows its predecessor kept. The first four return the columns of the
documents, the last the packed sequences.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import fold, shared_path, small_batches, table, written

#: Columns that stages read or write; all others are only carried along.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less likely than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.3
#: The key of the surrogates; a run on real data sets its own secret.
PII_KEY = b"corpus pipeline"


def sheltered(stage):
    """The stage on documents whose further columns are out of its way under plain numbers."""
    @functools.wraps(stage)
    def on_plain_names(spark, docs, sf_dir):
        small_batches(spark)
        names = {c: c if c in COLUMNS else f"_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
    return on_plain_names


@sheltered
def language(spark, docs, sf_dir) -> DataFrame:
    """Rejects documents in no recognisable language; ``lang`` becomes the predicted one.

    Learns from the rows that have a language, outside fold 0.
    """
    from voxelmill.llm.language_id import UNKNOWN, fit, predict
    net = fit(docs.filter(fold("doc_id") != 0).select("doc_id", "text", "lang"))
    known = predict(docs, net).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return known.withColumn("lang", F.col("lang_pred")).select(docs.columns)


@sheltered
def near_duplicates(spark, docs, sf_dir) -> DataFrame:
    """Keeps one document of each group of copies and near copies: the least id, then the first row."""
    from voxelmill.llm.hash_tables import save_rows, wanted
    from voxelmill.llm.ngram_jaccard import near_duplicates as join
    folder = shared_path(spark, "dropped")
    save_rows(join(docs).filter("row != class_row"), folder)

    def keep(batches):
        for b in batches:
            gone = np.zeros(b.num_rows, bool)
            gone[wanted(folder, b.column("row").to_numpy())] = True
            yield b.filter(pa.array(~gone))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(keep, numbered.schema).select(docs.columns)


@sheltered
def decontamination(spark, docs, sf_dir) -> DataFrame:
    """Rejects documents of which a twentieth of the words or more lies in benchmark passages."""
    from voxelmill.llm.decontamination import contaminated, find_hits
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.filter(~contaminated()).select(docs.columns)


@sheltered
def private_data(spark, docs, sf_dir) -> DataFrame:
    """Replaces personal data; n_chars follows the text."""
    from voxelmill.llm.pii import pseudonymize
    replaced = pseudonymize(docs, PII_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced = replaced.withColumn("n_chars", F.length("text").cast(kind))
    return replaced.select(docs.columns)


def packing(spark, docs, sf_dir) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens."""
    from voxelmill.llm.packing import pack, tokenized_pieces
    small_batches(spark)
    return pack(tokenized_pieces(docs))


STAGES = [("language", language), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("private data", private_data), ("packing", packing)]
#: The stages learn, hash and tokenize: SQL cannot state them.
ORACLE_SQL = None


def run(spark, sf_dir) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
