"""Many small groups per task: sorted partitions streamed through numpy.

``groupBy().applyInPandas`` builds a pandas frame for every group, which costs more than the work when
groups are small blocks. Here a task's partition is sorted by the keys and read in parts; every group
is a slice of a few arrays. Only the groups of one part, and one that is still open, are in memory.

Rows of numbers are packed before they are sent: what a task has of a group is one row, each column the
bytes of the smallest kind of number that holds its values.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxelmill.model import python_partitions

#: Rows read, and rows of results handed on, at once.
PART = 1 << 16
#: Rows of a task that are packed at once.
SENT = 1 << 17
#: Kinds of packed numbers.
KINDS = [np.dtype(k) for k in ("?", "u1", "i2", "i4", "i8", "f4", "f8")]
_NUMBERS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _array(column):
    """A column as numpy; lists of numbers as an array of all their values and the bounds of each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(column.type):
        bounds = column.offsets.to_numpy()
        return column.values.to_numpy(zero_copy_only=False), bounds
    return column.to_numpy(zero_copy_only=False)


def _bounds(table, keys):
    """First rows of the groups of a sorted table."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        if column.null_count or not pa.types.is_integer(column.type):
            column = column.dictionary_encode(null_encoding="encode").indices
        code = column.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _groups(batches, keys):
    """(key values, name -> arrays) of each group; a group never comes in parts."""
    held, n = [], 0

    def split(table, last):
        begin = _bounds(table, keys)
        ends = np.append(begin[1:], table.num_rows)
        if not last:
            begin, ends = begin[:-1], ends[:-1]
        arrays = {c: _array(table.column(c)) for c in table.column_names if c not in keys}
        named = list(zip(*(table.column(k).take(pa.array(begin)).to_pylist() for k in keys)))
        for key, a, b in zip(named, begin, ends):
            yield key, {c: (x[0][x[1][a]:x[1][b]] if isinstance(x, tuple) else x[a:b]) for c, x in arrays.items()}

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= PART:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(_bounds(table, keys)[-1])
            if last:
                yield from split(table, False)
            held = table.slice(last).to_batches()
            n = table.num_rows - last
    if n:
        yield from split(pa.Table.from_batches(held).combine_chunks(), True)


def narrow(column):
    """A column as an array of the smallest kind that holds every value as it is; nulls are NaN."""
    a = _array(column.cast(pa.int8()) if pa.types.is_boolean(column.type) and column.null_count else column)
    if a.dtype.kind == "i":
        low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        return a.astype(next(k for k in KINDS[1:5] if np.iinfo(k).min <= low and high <= np.iinfo(k).max))
    if a.dtype == np.float64:
        with np.errstate(over="ignore", invalid="ignore"):
            for kind in ("u1", "i2", "f4"):
                short = a.astype(kind)
                # a negative zero is no whole number
                if np.array_equal(short.astype("f8"), a, equal_nan=kind == "f4") and (kind == "f4" or not np.signbit(a[short == 0]).any()):
                    return short
    return a


def widened(kinds, sizes, cells, plain):
    """The values of packed cells one after the other: as ``plain``, unless there are nulls among whole numbers."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks()
    if not len(cells):
        return np.zeros(0, plain)
    bounds = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1]
    data, ends = cells.buffers()[2], np.cumsum(sizes)
    nulls = plain.kind != "f" and any(KINDS[k].kind == "f" for k in set(kinds.tolist()))
    out = np.empty(int(ends[-1]), "f8" if nulls else plain)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts, cuts[1:]):
        n, kind = int(sizes[a:b].sum()), KINDS[kinds[a]]
        if n:
            out[ends[b - 1] - n:ends[b - 1]] = np.frombuffer(data, kind, n, int(bounds[a]))
    return out


def _order(table, keys):
    """Rows of equal keys together, and the first of each group in this order."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        column = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        if code.max(initial=0) >= 1 << 40:
            code = np.unique(code, return_inverse=True)[1]
        code = code * max(len(column.dictionary), 1) + column.indices.to_numpy(zero_copy_only=False)
    if table.num_rows and code.max() < 1 << 16:
        code = code.astype(np.uint16)
    order = np.argsort(code, kind="stable")
    code = code[order]
    return order, np.flatnonzero(np.append(True, code[1:] != code[:-1])[:table.num_rows])


def pack(table, keys):
    """Groups of a table of numbers as one row each: keys, ``_n`` rows, ``_kinds`` of the columns, their bytes."""
    order, begin = _order(table, keys)
    sizes = np.diff(np.append(begin, table.num_rows))
    columns = {k: table.column(k).combine_chunks().take(pa.array(order[begin])) for k in keys}
    rest, kinds = {}, []
    for c in table.column_names:
        if c not in keys:
            a = narrow(table.column(c).combine_chunks())
            kinds.append(KINDS.index(a.dtype))
            bounds = (np.append(begin, table.num_rows) * a.itemsize).astype(np.int32)
            rest[c] = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(a[order].tobytes())])
    columns["_n"] = pa.array(sizes, pa.int32())
    columns["_kinds"] = pa.array([bytes(kinds)] * len(begin), pa.binary())
    return pa.RecordBatch.from_arrays([*columns.values(), *rest.values()], names=[*columns, *rest])


def together(batches, rows):
    """The batches as tables of about so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def packable(df: DataFrame, keys) -> bool:
    return all(isinstance(f.dataType, _NUMBERS) for f in df.schema.fields if f.name not in keys)


def packed(df: DataFrame, keys) -> DataFrame:
    """What each task has of the groups, as one row (see ``pack``)."""
    numbers = [f.name for f in df.schema.fields if f.name not in keys]
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_n", T.IntegerType()),
                           T.StructField("_kinds", T.BinaryType()), *[T.StructField(c, T.BinaryType()) for c in numbers]])

    def run(batches):
        for table in together(batches, SENT):
            yield pack(table, keys)
    return df.select(*keys, *numbers).mapInArrow(run, schema)


def _unpacked_groups(batches, keys, plain):
    """(key values, name -> array) of each group of packed rows sorted by the keys; ``plain``: name -> kind of number."""
    held, n = [], 0

    def split(table, last):
        begin = _bounds(table, keys)
        ends = np.append(begin[1:], table.num_rows)
        if not last:
            begin, ends = begin[:-1], ends[:-1]
            table = table.slice(0, int(ends[-1]))
        sizes = table.column("_n").to_numpy()
        kinds = np.array([list(k) for k in table.column("_kinds").to_pylist()], np.int64).reshape(len(sizes), -1)
        arrays = {c: widened(kinds[:, i], sizes, table.column(c), k) for i, (c, k) in enumerate(plain.items())}
        named = list(zip(*(table.column(k).take(pa.array(begin)).to_pylist() for k in keys)))
        place = np.append(0, np.cumsum(sizes))
        for key, a, b in zip(named, place[begin], place[ends]):
            yield key, {c: x[a:b] for c, x in arrays.items()}

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += int(pc.sum(b.column("_n")).as_py())
        if n >= PART:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(_bounds(table, keys)[-1])
            if last:
                yield from split(table, False)
            rest = table.slice(last)
            held = rest.to_batches()
            n = int(pc.sum(rest.column("_n")).as_py())
    if n:
        yield from split(pa.Table.from_batches(held).combine_chunks(), True)


def _result(rows, fields, keys):
    """One record batch of the results of several groups; two-dimensional arrays become lists."""
    sizes = [len(next(iter(r.values()))) for _, r in rows]
    columns = []
    for f in fields:
        if f.name in keys:
            at = keys.index(f.name)
            own = pa.array([key[at] for key, _ in rows], f.type)
            columns.append(own.take(pa.array(np.repeat(np.arange(len(rows)), sizes))))
        elif pa.types.is_list(f.type):
            parts = [r[f.name] for _, r in rows]
            lengths = np.repeat([p.shape[1] for p in parts], [len(p) for p in parts])
            values = pa.array(np.concatenate([p.reshape(-1) for p in parts]), f.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values))
        else:
            columns.append(pa.array(np.concatenate([r[f.name] for _, r in rows]), f.type))
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])


def map_groups(df: DataFrame, keys, fn, schema: str, part=PART, dealt=None) -> DataFrame:
    """``fn(name -> array)`` for every group of equal ``keys``; it returns name -> array of the other columns of ``schema``.

    A list column comes as the values of all its rows one after the other. A group must be bounded.
    ``part``: rows of results handed on at once, fewer than usual where a row is large. Rows of numbers
    are sent packed, others as they are. ``dealt``: the first of the keys, if groups that agree in them are to
    meet in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    keys = list(keys)
    fields = list(to_arrow_schema(T.StructType.fromDDL(schema)))
    plain = None
    if packable(df, keys):
        numbers = to_arrow_schema(T.StructType([f for f in df.schema.fields if f.name not in keys]))
        plain = {f.name: np.dtype(f.type.to_pandas_dtype()) for f in numbers}
        df = packed(df, keys)

    def run(batches):
        rows, n = [], 0
        for key, arrays in _groups(batches, keys) if plain is None else _unpacked_groups(batches, keys, plain):
            out = fn(arrays)
            size = len(next(iter(out.values())))
            if size:
                rows.append((key, out))
                n += size
            if n >= part:
                yield _result(rows, fields, keys)
                rows, n = [], 0
        if rows:
            yield _result(rows, fields, keys)
    return python_partitions(df, *(dealt or keys)).sortWithinPartitions(*keys).mapInArrow(run, schema)
