"""Planes of voxels in the shared folder, looked up by tasks.

Points are many and their places are full numbers, so they stay where they are made. Voxels are packed by
plane, dealt out by case and block of planes and written once, a file a bucket; a task maps the files
it needs and reads the planes around its points.
"""

import hashlib
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from voxelmill.functions import arrays
from voxelmill.functions.grouped import SENT, pack, together, widened
from voxelmill.model import AXES, CASE, VOXEL
from voxelmill.session import ensure_checkpoint_dir

#: Planes of a case that lie in one file.
BLOCK = 16
#: Points interpolated at once, and cells of the planes around them.
POINTS, CELLS = 1 << 17, 1 << 22
#: Files a worker keeps open: mapped ones take no memory, others are read whole.
MAPPED, READ = 4096, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _names(column):
    """128 bits of hash of each distinct case name of a column, and which one each row has."""
    column = column.dictionary_encode(null_encoding="encode")
    digests = [hashlib.blake2b(b"\0" if v is None else b"\1" + str(v).encode(), digest_size=16).digest()
               for v in column.dictionary.to_pylist()]
    marks = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return marks, column.indices.to_numpy(zero_copy_only=False)


def _bucket(mark, z, buckets):
    """Bucket of a plane: the same for planes of a block."""
    h = (mark.astype(np.uint64) + (z // BLOCK).astype(np.uint64)) * _MIX
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _local(folder):
    for scheme in ("file://", "file:"):
        if folder.startswith(scheme):
            return folder[len(scheme):]
    return None if "://" in folder else folder


def _save(folder, name, batch):
    """Writes a batch as one file; a repeated task replaces it by the same content."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        part = os.path.join(local, f".{name}-{uuid.uuid4().hex}")
        with pa.OSFile(part, "wb") as f, pa.ipc.new_file(f, batch.schema) as out:
            out.write_batch(batch)
        os.replace(part, os.path.join(local, name))
        return
    from pyarrow import fs as arrow_fs
    fs, path = arrow_fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/{name}") as f, pa.ipc.new_file(f, batch.schema) as out:
        out.write_batch(batch)


def _arrays(raw):
    batch = pa.ipc.open_file(raw).get_batch(0)
    plain = {c: batch.column(c).to_numpy() for c in ("mark", "mark2", "z", "_n")}
    kinds = np.frombuffer(b"".join(batch.column("_kinds").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return plain, kinds, batch


@lru_cache(MAPPED)
def _mapped(path):
    return _arrays(pa.memory_map(path)) if os.path.exists(path) else None


@lru_cache(READ)
def _fetched(uri):
    from pyarrow import fs as arrow_fs
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == arrow_fs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return _arrays(pa.BufferReader(f.read()))


def _load(folder, name):
    """The planes of a file; None of a bucket without any."""
    local = _local(folder)
    return _fetched(f"{folder}/{name}") if local is None else _mapped(os.path.join(local, name))


def save_planes(vox: DataFrame):
    """Voxels (case_id, z, y, x, value) written by plane: the folder and the number of buckets."""
    spark = vox.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/planes-{uuid.uuid4().hex}"
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = T.StructType.fromDDL("bucket int, mark long, mark2 long, z int, _n int, _kinds binary, y binary, x binary, value binary")

    def send(batches):
        for table in together(batches, SENT):
            b = pack(table, [CASE, "z"])
            marks, own = _names(b.column(CASE))
            z = b.column("z").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_bucket(marks[own, 0], z, buckets)), pa.array(marks[own, 0]), pa.array(marks[own, 1]), b.column("z"),
                 *[b.column(c) for c in kind.names[4:]]], names=kind.names)

    def write(batches):
        held, at, n = [], None, 0
        for b in batches:
            bucket = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and bucket[i] != at:
                    _save(folder, f"bucket-{at}", pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                at = int(bucket[i])
                held.append(b.slice(i, j - i))
                n += j - i
        if held:
            _save(folder, f"bucket-{at}", pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])
    # a place without a number is of no plane
    src = vox.filter(" and ".join(f"{a} is not null" for a in VOXEL)).select(
        CASE, *[F.col(a).cast("int").alias(a) for a in AXES], F.col("value").cast("double").alias("value"))
    sent = src.mapInArrow(send, kind).repartition(buckets, "bucket").sortWithinPartitions("bucket", "mark", "mark2", "z")
    sent.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder, buckets


def _planes(folder, buckets, mark, wanted):
    """(z, y, x, value) of the voxels of a case in the wanted planes, which increase."""
    found = []
    own = _bucket(np.full(len(wanted), mark[0]), wanted, buckets)
    for bucket in np.unique(own):
        held = _load(folder, f"bucket-{bucket}")
        if held is None:
            continue
        plain, kinds, batch = held
        low, high = np.searchsorted(plain["mark"], mark[0], "left"), np.searchsorted(plain["mark"], mark[0], "right")
        rows = low + np.flatnonzero((plain["mark2"][low:high] == mark[1]) & np.isin(plain["z"][low:high], wanted[own == bucket]))
        for i, j in zip(rows[np.diff(rows, prepend=-2) > 1], rows[np.diff(rows, append=high + 1) > 1] + 1):
            n = plain["_n"][i:j]
            found.append((np.repeat(plain["z"][i:j], n), *[
                widened(kinds[i:j, k], n, batch.column(c).slice(i, j - i), np.dtype(t))
                for k, (c, t) in enumerate((("y", "i4"), ("x", "i4"), ("value", "f8")))]))
    return [np.concatenate(c) for c in zip(*found)] if found else None


def interpolated(points: DataFrame, folder, buckets) -> DataFrame:
    """(case_id, z, y, x, value) at the places fz, fy, fx of points, by the planes of ``save_planes``; they do not move."""
    def of_case(mark, place):
        """Values at some places of a case, a few of their planes at a time."""
        out = np.zeros(len(place))
        low = np.floor(place[:, 0])
        # a place without a number is of no plane
        known = np.flatnonzero(np.isfinite(low) & (np.abs(low) < 1 << 30))
        known = known[np.argsort(low[known], kind="stable")]
        levels, first = np.unique(low[known].astype(np.int64), return_index=True)
        first = np.append(first, len(known))
        at, step = 0, 1
        while at < len(levels):
            some = levels[at:at + step]
            own = known[first[at]:first[at + len(some)]]
            at += len(some)
            wanted = np.union1d(some, some + 1)
            voxels = _planes(folder, buckets, mark, wanted)
            if voxels is None:
                continue
            out[own], cells = arrays.between_planes(place[own], wanted, *voxels)
            step = max(1, CELLS // cells)
        return out

    def run(batches):
        for table in together(batches, POINTS):
            marks, own = _names(table.column(CASE).combine_chunks())
            place = np.stack([table.column(f"f{a}").to_numpy() for a in AXES], axis=1)
            value = np.zeros(table.num_rows)
            order = np.argsort(own, kind="stable")
            ends = np.cumsum(np.bincount(own, minlength=len(marks)))
            for mark, rows in zip(marks, np.split(order, ends[:-1])):
                if len(rows):
                    value[rows] = of_case(mark, place[rows])
            table = table.select(VOXEL).append_column("value", pa.array(value))
            yield from table.to_batches()
    schema = T.StructType([points.schema[c] for c in VOXEL] + [T.StructField("value", T.DoubleType())])
    return points.select(*VOXEL, *[F.col(f"f{a}").cast("double").alias(f"f{a}") for a in AXES]).mapInArrow(run, schema)
