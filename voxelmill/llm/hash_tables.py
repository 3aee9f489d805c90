"""Sorted hash arrays in the shared folder: written by reduce tasks, memory-mapped by workers."""

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Tables a worker keeps mapped at once.
OPEN = 200


def _local(folder):
    for scheme in ("file://", "file:"):
        if folder.startswith(scheme):
            return folder[len(scheme):]
    return None if "://" in folder else folder


def _put(folder, name, parts):
    """Writes the parts of a file one after the other; the file is there as a whole or not at all."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        part = os.path.join(local, f".{name}-{uuid.uuid4().hex}")
        with open(part, "wb") as f:
            for p in parts:
                f.write(p)
        os.replace(part, os.path.join(local, name))
    else:
        import pyarrow.fs
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
            for p in parts:
                f.write(p)


def _parts(n, columns):
    """Head and arrays (name, kind, pieces) of ``n`` entries; every array starts at a multiple of eight bytes."""
    head = ";".join(f"{k}:{kind}:{n}" for k, kind, _ in columns).encode()
    at = 8 + len(head)
    yield np.int64(len(head)).tobytes() + head
    for _, kind, pieces in columns:
        yield b"\0" * (-at % 8)
        at += -at % 8 + np.dtype(kind).itemsize * n
        yield from pieces


def save(folder, name, **arrays):
    """Writes arrays of one length as one file; a repeated task replaces it by the same content."""
    n = len(next(iter(arrays.values())))
    _put(folder, name, _parts(n, [(k, a.dtype.str, [pa.py_buffer(np.ascontiguousarray(a))]) for k, a in arrays.items()]))


class Saver:
    """A file of ``save`` from pieces added one after the other: they wait on the task's own disk, not in its memory."""

    def __init__(self, folder, name):
        self.to, self.spools, self.n = (folder, name), {}, 0

    def add(self, **arrays):
        for k, a in arrays.items():
            if k not in self.spools:
                self.spools[k] = a.dtype.str, tempfile.TemporaryFile()
            self.spools[k][1].write(np.ascontiguousarray(a, self.spools[k][0]))
        self.n += len(next(iter(arrays.values())))

    def close(self):
        def pieces(spool):
            spool.seek(0)
            while piece := spool.read(1 << 20):
                yield piece
            spool.close()
        _put(*self.to, _parts(self.n, [(k, kind, pieces(f)) for k, (kind, f) in self.spools.items()]))
        return self.n


@lru_cache(maxsize=OPEN)
def load(folder, name):
    """The arrays of a file: mapped where the folder is mounted, else read through its file system.

    A table without a file has no entries: None.
    """
    local = _local(folder)
    if local is not None:
        path = os.path.join(local, name)
        if not os.path.exists(path):
            return None
        raw = np.memmap(path, np.uint8, "r")
    else:
        import pyarrow.fs
        fs, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}")
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return None
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int(raw[:8].view(np.int64)[0])
    at, out = 8 + size, {}
    for field in raw[8:at].tobytes().decode().split(";"):
        key, kind, n = field.split(":")
        at += -at % 8
        width = np.dtype(kind).itemsize * int(n)
        out[key] = raw[at:at + width].view(kind)
        at += width
    return out


def shard_of(keys, shards):
    """Shard of 64-bit keys by range, so that sorted keys are sorted by shard too."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def segments(shard):
    """(shard, first, last) of the runs of a sorted shard column."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
    for lo, hi in zip(cut[:-1], cut[1:]):
        yield int(shard[lo]), int(lo), int(hi)


def find(table, keys):
    """Places of keys in a table sorted by ``key``, and whether they are there."""
    have = table["key"]
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def save_rows(rows, folder):
    """Row numbers (monotonically_increasing_id of a scan) as one sorted array per scan partition.

    A second pass over the same scan finds the rows it wants without moving any text.
    """
    from pyspark.sql import functions as F

    from voxelmill.llm.common import record_batch

    def write(batches):
        out, at, last, n = None, None, None, 0
        for b in batches:
            row = b.column("row").to_numpy()
            for _, x, y in segments(row >> 33):
                if row[x] >> 33 != at:
                    n += out.close() if out else 0
                    at, last = int(row[x] >> 33), None
                    out = Saver(folder, f"rows-{at}")
                own = row[x:y]
                fresh = np.append(last is None or own[0] != last, own[1:] != own[:-1])
                out.add(key=own[fresh])
                last = own[-1]
        n += out.close() if out else 0
        yield record_batch(n=pa.array([n], pa.int64()))

    part = F.shiftright("row", 33)
    rows.select("row").repartition(part).sortWithinPartitions("row").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def wanted(folder, row):
    """Places in ``row`` (one partition's, increasing) of the rows saved."""
    table = load(folder, f"rows-{row[0] >> 33}") if len(row) else None
    return np.flatnonzero(find(table, row)[1]) if table else np.zeros(0, np.int64)
