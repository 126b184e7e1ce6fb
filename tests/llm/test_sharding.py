"""Sharding by permuted row numbers: bijection, sizes, inverse, the same places under any partitioning."""

import zlib

import numpy as np
import pytest

from cairnflow.llm import common, sharding


def plain_place(row, rows, shards, keys, half):
    mask = (1 << half) - 1
    while True:
        left, right = row >> half, row & mask
        for key in keys:
            x = (right ^ key) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ (x >> 31)) * 0x94D049BB133111EB % (1 << 64)
            left, right = right, left ^ ((x ^ (x >> 29)) & mask)
        row = left << half | right
        if row < rows:
            return row % shards, row // shards


@pytest.mark.parametrize("rows,shards", [(1, 1), (2, 16), (3, 2), (17, 16), (1000, 7), (65_537, 16)])
def test_shuffle_is_a_permutation(rows, shards):
    s = sharding.Shuffle(rows, shards, 5)
    shard, slot = s.placed(np.arange(rows))
    some = range(0, rows, max(1, rows // 50))
    assert [(shard[k], slot[k]) for k in some] == [plain_place(k, rows, shards, [int(x) for x in s.keys], s.half) for k in some]
    assert s.rows_at(shard, slot).tolist() == list(range(rows))
    counts = np.bincount(shard, minlength=shards)
    assert counts.max() - counts.min() <= 1 and counts.sum() == rows
    for k in range(shards):
        assert sorted(slot[shard == k].tolist()) == list(range(counts[k]))


def test_shuffle_mixes():
    shard, slot = sharding.Shuffle(100_000, 16, 1).placed(np.arange(100_000))
    other, _ = sharding.Shuffle(100_000, 16, 2).placed(np.arange(100_000))
    assert abs((shard == other).mean() - 1 / 16) < 0.01
    assert abs((shard[1:] == shard[:-1]).mean() - 1 / 16) < 0.01
    assert abs(np.corrcoef(np.arange(100_000), slot)[0, 1]) < 0.02
    big = sharding.Shuffle(10**15, 1000, 3)  # numbers far beyond 32 bits
    rows = np.array([0, 1, 10**15 - 1, 123_456_789_012_345])
    assert big.rows_at(*big.placed(rows)).tolist() == rows.tolist()
    with pytest.raises(ValueError):
        big.placed(np.array([10**15]))
    with pytest.raises(ValueError):
        sharding.Shuffle(3, 0)


ROWS = [(k, f"text {k % 7}", k, "x") for k in range(300)] + [(None, None, 1, None), (5, "text 5", 9, "again"), (5, "other", 9, "again"), (6, "", 0, "")] + [(77, "hot", 1, "h")] * 200


def test_placed_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, slot long, _at string")
    found = {}
    for parts in (1, 5):
        got = sharding.placed(df.repartition(parts), 16, 3)
        assert got.columns == ["doc_id", "text", "_at", "row", "shard", "slot"]
        rows = got.collect()
        assert sorted(r.row for r in rows) == list(range(len(ROWS)))
        by_row = sorted(rows, key=lambda r: r.row)
        assert [r.doc_id for r in by_row] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
        shard, slot = sharding.Shuffle(len(ROWS), 16, 3).placed(np.arange(len(ROWS)))
        assert [(r.shard, r.slot) for r in by_row] == list(zip(shard.tolist(), slot.tolist(), strict=True))
        found[parts] = sorted((r.row, r.doc_id, r.text) for r in rows if r.doc_id is not None)
    assert found[1] == found[5]
    path = common.scratch_path(spark, "t")
    sharding.write_shards(sharding.placed(df, 4), path)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS)
    for k in range(4):  # in the order of the files' names
        files = sorted({r.f for r in back.where(f"shard = {k}").selectExpr("input_file_name() f").collect()})
        slots = [r.slot for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
        assert slots == list(range(len(slots)))


def test_empty_table(spark):
    assert sharding.placed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    got = sharding.op11(spark, sf_dir).collect()
    want = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf_dir, "documents").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in want.items()}
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    counts = np.bincount([r.shard for r in got], minlength=16)
    assert counts.max() - counts.min() <= 1
    assert {(r.shard, r.slot) for r in got} == {(k, s) for k in range(16) for s in range(counts[k])}
