"""Volume files read in ranges: several tasks a file, a few slabs of it in memory.

A NIfTI file stores its first axis fastest, so what lies together is a slab: all (z, y) of one x and
one time frame. Headers are read by tasks, a few hundred bytes a file. They give a table of slab
ranges, which is what the work is dealt out by; wanted frames and x are chosen there, before any
voxel is read. Plain files are entered at the range. Compressed ones cannot be: one task runs
through such a file once, from its first wanted slab to its last, and hands on slab by slab.
"""

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxelmill.functions.nifti import DTYPES
from voxelmill.functions.scalars import case_id
from voxelmill.model import python_partitions
from voxelmill.sources.volumes import scan_files

HEADER = ("path string, packed boolean, kind string, offset long, slope double, inter double, nz int, ny int, nx int, nt int, "
          "spacing array<double>, affine array<double>, error string")
SLAB = "path string, t int, x int, nz int, ny int, nx int, spacing array<double>, affine array<double>, data array<double>, error string"
#: Bytes of a plain file that one task reads in one go.
RANGE_BYTES = 32 << 20
#: Small slabs are handed on together, up to so many rows or values.
ROWS, VALUES = 1024, 1 << 18


def open_file(path):
    """A stored file for reading, through its own file system."""
    from pyarrow import fs as arrow_fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    system, name = (arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path))
    return system.open_input_file(name)


def _unpacked(f):
    head = f.read(2)
    f.seek(0)
    return (gzip.GzipFile(fileobj=f), True) if head == b"\x1f\x8b" else (f, False)


def header(path):
    """The fields of HEADER behind the path."""
    with open_file(path) as f:
        stream, packed = _unpacked(f)
        raw = stream.read(352)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", raw[40:56])
    shape = [*dim[1:1 + dim[0]], 1, 1, 1][:4]
    if not 2 < dim[0] < 5 or min(shape) < 1:
        raise ValueError(f"{dim[0]} axes of {dim[1:]}")
    pix = struct.unpack(order + "8f", raw[76:108])
    kind = order + DTYPES[struct.unpack(order + "h", raw[70:72])[0]]
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    affine = np.eye(4)
    if struct.unpack(order + "h", raw[254:256])[0] > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    else:
        affine[[0, 1, 2], [0, 1, 2]] = pix[1:4]
    scaled = slope not in (0.0, 1.0) or (slope and inter)
    return (packed, kind, int(offset), slope if scaled else 1.0, inter if scaled else 0.0, *shape,
            [float(p) for p in pix[1:4]], affine.ravel().tolist(), None)


def _twice(fn, *args):
    """The result, or the error of the second try."""
    for last in (False, True):
        try:
            return fn(*args), None
        except Exception as e:
            if last:
                return None, f"{type(e).__name__}: {e}"


def read_headers(spark, folder, recursive=False) -> DataFrame:
    """One row of HEADER per volume file; ``error`` says what was wrong with one."""
    names = [c.split()[0] for c in HEADER.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for path in pdf.path:
                found, error = _twice(header, path)
                rows.append((path, *(found or [None] * (len(names) - 2) + [error])))
            out = pd.DataFrame(rows, columns=names)
            ints = {c.split()[0]: "Int64" if "long" in c else "Int32" for c in HEADER.split(", ") if c.split()[1] in ("int", "long")}
            yield out.astype({**ints, "packed": "boolean"})
    return scan_files(spark, folder, recursive).select("path").mapInPandas(run, HEADER)


def slab_ranges(headers: DataFrame, frames=None, xs=None, range_bytes=RANGE_BYTES) -> DataFrame:
    """Ranges (path, ..., first, last, ts, xs) of slab numbers t * nx + x that are read together.

    ``frames``: numbers of the wanted time frames, ``xs``: (first, last exclusive) of the wanted x; all
    by default. A file without a wanted slab has no range; one with an error keeps its row.
    """
    d = headers.withColumn("ts", F.sequence(F.lit(0), F.col("nt") - 1))
    if frames is not None:
        d = d.withColumn("ts", F.array_intersect("ts", F.array(*[F.lit(int(t)) for t in frames]).cast("array<int>")))
    low, high = (0, None) if xs is None else xs
    d = d.withColumn("x0", F.lit(int(low))).withColumn("x1", F.least(F.col("nx"), F.lit(int(high))) if high is not None else F.col("nx"))
    d = d.filter("error is not null or (size(ts) > 0 and x0 < x1)")
    per = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / (F.col("nz").cast("long") * F.col("ny") * F.substring("kind", 3, 1).cast("int"))))
    whole = F.array(F.struct((F.array_min("ts").cast("long") * F.col("nx") + F.col("x0")).alias("first"),
                             (F.array_max("ts").cast("long") * F.col("nx") + F.col("x1")).alias("last")))
    parts = F.flatten(F.transform("ts", lambda t: F.transform(
        F.sequence(F.col("x0").cast("long"), F.col("x1").cast("long") - 1, per),
        lambda x: F.struct((t.cast("long") * F.col("nx") + x).alias("first"),
                           (t.cast("long") * F.col("nx") + F.least(x + per, F.col("x1").cast("long"))).alias("last")))))
    broken = F.array(F.struct(*[F.lit(None).cast("long").alias(n) for n in ("first", "last")]))
    return d.select("*", F.inline(F.when(F.col("error").isNotNull(), broken).when(F.col("packed"), whole).otherwise(parts)))


def _slabs(r):
    """(t, x, values) of the wanted slabs of a range, one after the other."""
    kind = np.dtype(r["kind"])
    size = r["nz"] * r["ny"] * kind.itemsize
    wanted = set(r["ts"])
    with open_file(r["path"]) as f:
        stream, _ = _unpacked(f)
        for n in range(r["first"], r["last"]):
            t, x = divmod(n, r["nx"])
            if t not in wanted or not r["x0"] <= x < r["x1"]:
                continue
            stream.seek(r["offset"] + n * size)
            raw = stream.read(size)
            if len(raw) < size:
                raise EOFError(f"file ends in slab {n}")
            values = np.frombuffer(raw, kind).astype("f8")
            if r["slope"] != 1.0 or r["inter"] != 0.0:
                values = values * r["slope"] + r["inter"]
            yield t, x, values


def read_slabs(spark, folder, recursive=False, on_error="skip", frames=None, xs=None, range_bytes=RANGE_BYTES) -> DataFrame:
    """One row per slab (path, case_id, t, x, nz, ny, nx, spacing, affine, data): data holds y-major (y, z) values.

    A broken file gives a row with ``error`` ("keep"), or none ("skip"). A file that breaks off keeps
    the slabs before.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    fields = list(to_arrow_schema(StructType.fromDDL(SLAB)))
    failed = lambda r, error: (r["path"], *[None] * (len(fields) - 2), error)

    def rows(r):
        if r["error"]:
            yield failed(r, r["error"])
            return
        head = r["nz"], r["ny"], r["nx"], r["spacing"], r["affine"]
        done = 0
        for last in (False, True):  # a second try goes on behind the slabs handed on
            try:
                for t, x, values in _slabs(r | {"first": r["first"] + done}):
                    yield (r["path"], t, x, *head, values, None)
                    done = t * r["nx"] + x + 1 - r["first"]
                break
            except Exception as e:
                if last:
                    yield failed(r, f"{type(e).__name__}: {e}")

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(fields, zip(*held))], names=[f.name for f in fields])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for row in rows(r):
                    held.append(row)
                    n += 0 if row[-2] is None else len(row[-2])
                    if n >= VALUES or len(held) >= ROWS:
                        yield table(held)
                        held, n = [], 0
        if held:
            yield table(held)
    ranges = slab_ranges(read_headers(spark, folder, recursive), frames, xs, range_bytes)
    out = python_partitions(ranges, "path", "first").mapInArrow(run, SLAB)
    out = out.withColumn("case_id", case_id(F.element_at(F.split("path", "/"), -1), True))
    return out if on_error == "keep" else out.filter("error is null").drop("error")


def explode_slabs(slabs: DataFrame) -> DataFrame:
    """Dense voxel rows of slabs."""
    return slabs.select("case_id", "t", "x", "nz", F.posexplode("data").alias("_p", "value")).select(
        "case_id", "t", F.expr("cast(_p % nz as int)").alias("z"), F.expr("cast(_p div nz as int)").alias("y"), "x", "value")
