"""Volume files, CSV tables and the sinks."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxelmill.functions.nifti import decode
from voxelmill.functions.scalars import case_id

SLICE_SCHEMA = ("path string, t int, z int, shape array<int>, spacing array<double>, "
                "affine array<double>, data array<double>, error string")
#: Planes of a file handed on at once.
PLANES = 16


def scan_files(spark, folder, recursive=False) -> DataFrame:
    """Volume files of a folder; ``recursive`` takes every .nii / .nii.gz below it."""
    r = spark.read.format("binaryFile")
    if recursive:
        return (r.option("recursiveFileLookup", "true").load(folder)
                .filter(F.col("path").rlike(r"\.nii(\.gz)?$")))
    return r.option("pathGlobFilter", "*.nii*").load(folder)


def _read(content):
    """Decoded file, or the error after one retry."""
    for last in (False, True):
        try:
            return (*decode(bytes(content)), None)
        except Exception as e:
            if last:
                return None, None, None, f"{type(e).__name__}: {e}"


def _planes(path, content, frames):
    """Tables of a few planes each, so that one file is never a table as a whole."""
    names = [c.split()[0] for c in SLICE_SCHEMA.split(", ")]
    data, spacing, affine, error = _read(content)
    if error:
        parts = [[(path, None, None, None, None, None, None, error)]]
    else:
        stack = data if data.ndim == 4 else data[..., None]
        wanted = [t for t in range(stack.shape[3]) if frames is None or t in frames]
        parts = ([(path, t, z, list(data.shape), spacing, affine, stack[z, :, :, t].ravel(), None)
                  for z in range(start, min(start + PLANES, len(stack)))]
                 for t in wanted for start in range(0, len(stack), PLANES))
    for rows in parts:
        yield pd.DataFrame(rows, columns=names).astype({"t": "Int32", "z": "Int32"})


def decode_volumes(files: DataFrame, on_error="skip", frames=None) -> DataFrame:
    """One row per z plane of files(path, content). A broken file gives one row with
    ``error``; "skip" leaves those out, "keep" returns them too. ``frames``: numbers of the
    time frames wanted, all by default."""
    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                yield from _planes(path, content, frames)
    out = files.select("path", "content").mapInPandas(run, SLICE_SCHEMA)
    name = F.element_at(F.split("path", "/"), -1)
    out = out.withColumn("case_id", case_id(name, True))
    return out if on_error == "keep" else out.filter("error is null").drop("error")


def read_volumes(spark, folder, recursive=False, on_error="skip", frames=None) -> DataFrame:
    return decode_volumes(scan_files(spark, folder, recursive), on_error, frames)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes files(path, content) below a shared folder, each by the task that holds it.

    Spark's own writers put their format around the bytes, so tasks write through the folder's file
    system. A repeated task writes the same bytes again.
    """
    def run(batches):
        from pyarrow import fs as arrow_fs
        root = folder.replace("file:", "", 1) if folder.startswith("file:/") else folder
        system, base = (arrow_fs.FileSystem.from_uri(root) if "://" in root
                        else (arrow_fs.LocalFileSystem(), "/" + root.lstrip("/")))
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                name = f"{base}/{path}"
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name, compression=None) as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(pdf)]})
    return files.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def explode_slices(slices: DataFrame) -> DataFrame:
    """Dense voxel rows of plane rows (data holds y-major values)."""
    w = F.element_at("shape", 3)
    return slices.select("case_id", "t", "z", w.alias("_w"), F.posexplode("data").alias("_p", "value")).select(
        "case_id", "t", "z", F.expr("cast(_p div _w as int)").alias("y"),
        F.expr("cast(_p % _w as int)").alias("x"), "value")


def read_csv(spark, path, schema) -> DataFrame:
    """Typed CSV with header; blanks are NULL, a missing file is an empty table."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_report(df: DataFrame, path: str):
    df.write.mode("overwrite").option("header", True).csv(path)


def append_results(df: DataFrame, path: str):
    df.write.mode("append").parquet(path)


def write_splits(df: DataFrame, path: str, meta_cols, map_cols):
    """Each split's rows in its own directory, as the two column subsets."""
    df.select("split", *meta_cols).write.mode("overwrite").partitionBy("split").parquet(f"{path}/metadata")
    df.select("split", *map_cols).write.mode("overwrite").partitionBy("split").parquet(f"{path}/mapping")


def write_masks(labels: DataFrame, volumes: DataFrame, path: str):
    """Sparse masks next to the grid and spacing of their images; files are cut by case hash
    and plane, so neither tiny cases nor huge ones make a bad file."""
    (labels.repartition("case_id", "z").sortWithinPartitions("case_id", "z")
     .write.mode("overwrite").parquet(f"{path}/labels"))
    volumes.write.mode("overwrite").parquet(f"{path}/volumes")
