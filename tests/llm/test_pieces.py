"""Work in tasks that must not grow with what is dealt to a task."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import hash_tables
from voxelmill.llm.common import list_batches


def test_files_are_saved_in_pieces(tmp_path):
    """all rows of a scan partition were held, and copied twice to be written."""
    key, side = np.arange(1000), np.arange(1000, dtype="u1")
    hash_tables.save(f"file:{tmp_path}", "whole", key=key, side=side, n=key * 2)
    out = hash_tables.Saver(f"file:{tmp_path}", "pieces")
    for x, y in ((0, 1), (1, 1), (1, 700), (700, 1000)):
        out.add(key=key[x:y], side=side[x:y], n=key[x:y] * 2)
    assert out.close() == 1000
    assert (tmp_path / "pieces").read_bytes() == (tmp_path / "whole").read_bytes()
    assert {p.name for p in tmp_path.iterdir()} == {"whole", "pieces"}
    empty = hash_tables.load(f"file:{tmp_path}", "pieces")
    assert np.array_equal(empty["side"], side) and np.array_equal(empty["n"], key * 2)


def test_rows_of_many_scan_partitions_are_saved_one_by_one(spark, tmp_path, monkeypatch):
    """one list held the rows of all scan partitions of a task."""
    folder = f"file:{tmp_path}/rows"
    part = (F.col("id") % 7) * F.lit(1 << 33)
    rows = spark.range(700).select((part + F.col("id")).alias("row")).repartition(3)
    hash_tables.save_rows(rows.unionByName(rows.limit(50)), folder)
    for p in range(7):
        want = np.arange(p, 700, 7) + (p << 33)
        assert np.array_equal(hash_tables.load(folder, f"rows-{p}")["key"], want)
        assert np.array_equal(hash_tables.wanted(folder, np.arange(700) + (p << 33)), np.arange(p, 700, 7))


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_lists_are_cut(limit):
    """the hits of all documents of a batch became objects at once."""
    lists = [[1] * n if n >= 0 else None for n in (0, 2, 5, -1, 1, 1, 0, 3)]
    batch = pa.record_batch({"row": list(range(8)), "hits": pa.array(lists, pa.list_(pa.int64()))})
    parts = list(list_batches([batch, batch], "hits", limit))
    assert [r for p in parts for r in p.column("row").to_pylist()] == [*range(8), *range(8)]
    assert all(sum(len(x or []) for x in p.column("hits").to_pylist()) <= limit or sum(bool(x) for x in p.column("hits").to_pylist()) == 1 for p in parts)
