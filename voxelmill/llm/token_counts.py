"""Token counts by a separator scan of flat token files.

A token file is nothing but fixed-width little-endian ids, every document followed by the
end-of-document id: no header, no index. Files are read in blocks. Within a block the separators
are found at once; a prefix scan over the blocks of a file (number of separators before, place
behind the last one) then tells for each block which document it continues, so documents may
cross any number of blocks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.common import pin_scans, record_batch, shared_path, text_batches
from voxelmill.llm.tokens import BYTE_BPE, byte_bpe, vocabulary_path
from voxelmill.model import running

END = 0
WIDTH = 2
BLOCK_TOKENS = 1 << 16
#: A longer file is not read as a whole but in records of fixed length.
WHOLE_FILE = 256 << 20
_ROW_BITS = 33


def write_token_files(docs: DataFrame, path, text="text", vocabulary=BYTE_BPE, folder=None):
    """One flat file of 2-byte ids per partition of ``docs``, in row order.

    Ids are those of the vocabulary plus one, since 0 ends a document. Null and empty texts are a
    lone 0. Spark's text writer puts the separator (two zero bytes) behind each row's bytes.
    """
    name = vocabulary_path(vocabulary, folder)

    def run(batches):
        model = byte_bpe(name)
        for b in text_batches(batches):
            yield record_batch(ids=pa.array(
                [(np.asarray(model.encode_ordinary(t), np.int64) + 1).astype("<u2").tobytes() if t else b""
                 for t in b.column("text").to_pylist()], pa.binary()))

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "ids binary")
    rows.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\0" * WIDTH).text(path)


def read_blocks(spark, path, width=WIDTH, block_tokens=BLOCK_TOKENS, whole_file=WHOLE_FILE) -> DataFrame:
    """(file, block, bytes) of all files under ``path``, in blocks of ``block_tokens`` ids.

    A file beyond ``whole_file`` bytes is split by Hadoop's fixed-length input instead; its block is
    the largest divisor of its length in ids that is at most ``block_tokens``.
    """
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path)
    pieces = F.explode(F.expr(
        f"transform(sequence(0L, (length - 1) div {size}), b -> struct(b as block, "
        f"substring(content, int(b * {size} + 1), {size}) as bytes))"))
    small = files.filter((F.col("length") > 0) & (F.col("length") <= whole_file))
    blocks = (small.select(F.col("path").alias("file"), pieces.alias("_p"))
              .select("file", F.lit(block_tokens).cast("long").alias("block_tokens"), "_p.block", "_p.bytes"))
    for row in files.filter(F.col("length") > whole_file).select("path", "length").toLocalIterator():
        blocks = blocks.unionByName(_fixed_records(spark, row["path"], row["length"], width, block_tokens))
    return blocks


def _fixed_records(spark, file, length, width, block_tokens):
    if length % width:
        raise ValueError(f"{file}: {length} bytes are no multiple of {width}")
    tokens = length // width
    per = max(d for d in range(1, min(block_tokens, tokens) + 1) if tokens % d == 0)
    rows = spark.sparkContext.newAPIHadoopFile(
        file, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(per * width)})
    rows = rows.map(lambda kv: (file, per, kv[0], bytearray(kv[1])))
    return spark.createDataFrame(rows, "file string, block_tokens long, block long, bytes binary")


def document_spans(blocks: DataFrame, end=END, width=WIDTH) -> DataFrame:
    """Documents of flat token files: file, ordinal, start, n_tokens (without the end id), ended.

    ``start`` and ``ordinal`` count ids and documents of the file from 0. Ids behind the last end id
    are a document with ``ended`` false. Empty files and an empty table have no documents.
    """
    kind = f"<u{width}"

    def scan(batches):
        for b in batches:
            found, size, last = [], [], []
            first = (b.column("block").to_numpy() * b.column("block_tokens").to_numpy())
            for start, raw in zip(first.tolist(), b.column("bytes")):
                ids = np.frombuffer(raw.as_buffer(), kind)
                at = np.flatnonzero(ids == end)
                found.append(at.astype(np.int32))
                size.append(len(ids))
                last.append(start + int(at[-1]) + 1 if len(at) else None)
            yield record_batch(
                file=b.column("file"), block=b.column("block"), first=first, size=pa.array(size, pa.int64()),
                n=pa.array([len(f) for f in found], pa.int64()), behind=pa.array(last, pa.int64()),
                found=pa.array(found, pa.list_(pa.int32())))

    seen = blocks.mapInArrow(scan, "file string, block long, first long, size long, n long, behind long, "
                                   "found array<int>")
    carried = running(seen, ["file"], "block", {"before": ("sum", "n", False), "open": ("max", "behind", False)})
    ends = carried.select("file", F.coalesce("before", F.lit(0)).alias("before"),
                          F.coalesce("open", F.lit(0)).alias("open"), "first", F.posexplode("found").alias("i", "at"),
                          "found")
    behind_previous = F.when(F.col("i") == 0, F.col("open")).otherwise(
        F.col("first") + F.expr("found[i - 1]") + 1)
    whole = ends.select("file", (F.col("before") + F.col("i")).alias("ordinal"), behind_previous.alias("start"),
                        (F.col("first") + F.col("at") - behind_previous).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = (seen.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("behind"), F.lit(0)).alias("start"),
                                     F.max(F.col("first") + F.col("size")).alias("_size"))
            .select("file", "ordinal", "start", (F.col("_size") - F.col("start")).alias("n_tokens"),
                    F.lit(False).alias("ended")).filter("n_tokens > 0"))
    return whole.unionByName(rest)


def token_counts(docs: DataFrame, doc_id="doc_id", text="text", path=None, **vocabulary) -> DataFrame:
    """Writes flat token files for ``docs`` and counts by scanning them: doc_id, n_tokens.

    ``docs`` must be read straight from stored files, so that a second pass deals its rows out alike:
    the files know nothing of ids, the n-th document of a file is the n-th row of its partition.
    A document that one side lacks fails the job. Every row counts, repeated ids too; null and
    empty texts have 0 tokens.
    """
    spark = docs.sparkSession
    pin_scans(spark)
    path = path or shared_path(spark, "tokens")
    write_token_files(docs, path, text, **vocabulary)
    row = F.monotonically_increasing_id()
    order = docs.select(F.col(doc_id).alias("doc_id")).withColumn("_row", row)
    spans = document_spans(read_blocks(spark, path))
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    spans = spans.select((F.shiftleft(part, _ROW_BITS) + F.col("ordinal")).alias("_row"), "n_tokens")
    both = order.withColumn("_doc", F.lit(True)).join(spans, "_row", "full_outer")
    n = F.when(F.col("_doc") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(
        F.raise_error(F.lit("the token files do not have the documents of the table")))
    return both.select("doc_id", n.cast("long").alias("n_tokens"))
